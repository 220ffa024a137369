"""First-wins duplicates, priority unions, derived keys, set operations and limits by group.

Order is always given: rows without an order column would make the result depend on the
partitioning.  Null keys form one group.  Where a group can be huge, the first row is taken
by a minimum (combined before the shuffle), never by sorting the group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row for each key: the first by ``order``.  Rows equal in keys and order are one."""
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*order)
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), rank).alias("_row"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])


def priority_union(parts: Sequence[DataFrame], keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Union of parts in falling priority; of equal keys the row of the earlier part wins."""
    out = None
    for i, p in enumerate(parts):
        p = p.withColumn("_priority", F.lit(i))
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    return first_wins(out, keys, ["_priority", *order])


def unseen(df: DataFrame, history: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose keys history lacks."""
    return df.join(history.select(*keys).distinct(), list(keys), "left_anti")


def top_n(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first n rows of each group; Spark keeps n rows a group before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)


def comment_key(author: str, text: str, chars: int = 80) -> Column:
    """Comments of one author that begin alike are the same."""
    return F.concat_ws("|", F.coalesce(F.lower(F.col(author)), F.lit("")), F.substring(F.coalesce(F.col(text), F.lit("")), 1, chars))


def split_by(df: DataFrame, good: Column) -> tuple[DataFrame, DataFrame]:
    """(rows for which ``good`` holds, all others, null included)."""
    ok = F.coalesce(good, F.lit(False))
    return df.where(ok), df.where(~ok)


def merged_comments(stages: Sequence[DataFrame], post: str, text: str, order: Sequence[str]) -> DataFrame:
    """Comments of several stages; of comments of one post with exactly the same text that of the
    earlier stage stays, then the first by ``order``."""
    return priority_union(stages, [post, text], order).drop("_priority")


def replies(found: DataFrame, root: str, ident: str, order: Sequence[str], most: int | None = None) -> DataFrame:
    """Replies below each root post: the root itself is left out, an id counts once (the first by
    ``order``), ``position`` counts from 1, and at most ``most`` stay for each root."""
    rows = found.where(F.col(ident).isNotNull() & (F.col(ident) != "") & (F.col(ident) != F.col(root)))
    once = first_wins(rows, [root, ident], order)
    placed = top_n(once, [root], [F.asc(c) for c in (*order, ident)], most if most is not None else 2**31 - 1, "position")
    return placed
