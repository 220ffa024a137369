"""Sinks: JSON lines, flat CSV, envelopes with side tables, keyed upserts."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mentionlake.session import cut


#: How a CSV says null, so that it can be told from an empty text.
_NULL = "\\N"


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def flattened(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text; the whole schema, not that of the first row."""
    nested = (T.ArrayType, T.StructType, T.MapType)
    return df.select(*[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in df.schema.fields])


def unflattened(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The inverse of ``flattened`` for a known schema."""
    nested = (T.ArrayType, T.StructType, T.MapType)
    return df.select(*[F.from_json(f.name, f.dataType).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name).cast(f.dataType) for f in schema.fields])


def write_csv(df: DataFrame, path: str, columns: Sequence[str] | None = None, cut: dict[str, int] | None = None, bom: bool = False) -> None:
    """Flat CSV with a header; ``columns``: a fixed schema, where absent ones are empty; ``cut``:
    lengths to which texts are cut for display."""
    out = flattened(df)
    for c, n in (cut or {}).items():
        out = out.withColumn(c, F.substring(c, 1, n))
    if columns is not None:
        out = out.select(*[F.col(c) if c in out.columns else F.lit("").alias(c) for c in columns])
    if bom and out.columns:
        out = out.withColumnRenamed(out.columns[0], "﻿" + out.columns[0])
    out.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').option("nullValue", _NULL).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


# The columns of the flat files, by dialect, each with what it reads of a canonical post.
_TAGS, _NAMES = "array_join(coalesce(hashtags, array()), ', ')", "array_join(coalesce(mentions, array()), ', ')"
_SAME = lambda *names: {n: n for n in names}
_COUNTS = {n: f"coalesce(engagement.{n}, 0)" for n in ("likes", "comments", "shares", "views")}
_ABOUT = {"platform": "platform", "post_id": "post_id", "post_url": "post_url", "source_type": "source_type", "query": "query"}
_END = {"total_engagement": "coalesce(engagement.total, 0)", "comments_json": "coalesce(to_json(comments), '[]')", "scraped_at": "scraped_at"}
_RATE = "CASE WHEN author.followers > 0 THEN round((coalesce(engagement.likes, 0) + coalesce(engagement.comments, 0)) * 100 / CAST(author.followers AS DECIMAL(20, 0)), 2) ELSE 0 END"
_WHO = {"username": "author.username", "author_name": "author.name"}
LAYOUTS: dict[str, dict[str, str]] = {
    "x": {
        "post_url": "post_url", "post_date": "ts_raw", **_WHO, "is_verified": "author.verified", "follower_count": "coalesce(author.followers, 0)", "source_hashtag": "query",
        "post_type": "coalesce(nullif(post_type, ''), 'tweet')", "likes": _COUNTS["likes"], "comments": _COUNTS["comments"], "engagement_rate": _RATE, "location": "location", "location_source": "location_source",
        "caption": "text", "hashtags": "array_join(transform(coalesce(hashtags, array()), h -> concat('#', h)), ' ')", "source_window": "source_window", "comments_json": _END["comments_json"],
        "retweets": _COUNTS["shares"], "lang": "lang_hint", "error": "''",
    },
    "hashtag": {
        "hashtag_source": "query", "post_category": "source_type", "post_url": "post_url", "shortcode": "post_id", "post_type": "post_type", "post_date": "ts_raw", **_WHO,
        "follower_count": "coalesce(author.followers, 0)", "following_count": "coalesce(author.following, 0)", **_COUNTS, "engagement_rate": _RATE, **_SAME("location", "location_source", "location_confidence"),
        "caption": "substring(text, 1, 500)", "hashtags": _TAGS, "mentions": _NAMES, "comment_count_extracted": "greatest(size(comments), 0)", "scraped_at": "scraped_at",
    },
    "demo": {
        "post_url": "post_url", "post_date": "ts_raw", **_WHO, "is_verified": "author.verified", "follower_count": "author.followers", "source_hashtag": "query", "post_type": "post_type",
        "likes": "engagement.likes", "comments": "engagement.comments", "engagement_rate": _RATE, **_SAME("location", "location_source"), "caption": "substring(text, 1, 300)", "hashtags": _TAGS,
        "source_window": "source_window", "comments_json": _END["comments_json"],
    },
    "tiktok": {
        **_ABOUT, "author_username": "author.username", "author_name": "author.name", "author_followers": "coalesce(author.followers, 0)", "author_verified": "coalesce(author.verified, false)",
        "text": "substring(text, 1, 500)", "timestamp": "ts", "language": "lang_hint", "hashtags": _TAGS, "mentions": _NAMES, "music_title": "music.title", "music_author": "music.author", **_COUNTS, **_END,
    },
    "facebook": {
        **_ABOUT, "author_name": "author.name", "author_id": "author.id", "text": "substring(text, 1, 500)", "timestamp": "ts", "language": "lang_hint", "hashtags": _TAGS, "mentions": _NAMES,
        "reactions": _COUNTS["likes"], "comments": _COUNTS["comments"], "shares": _COUNTS["shares"], **_END,
    },
    "linkedin": {
        "platform": "platform", "post_id": "post_id", "post_urn": "concat('urn:li:activity:', post_id)", **{k: v for k, v in _ABOUT.items() if k not in ("platform", "post_id")},
        "author_name": "author.name", "author_id": "author.id", "text": "substring(text, 1, 1000)", "article_title": "''", "timestamp": "ts", "language": "lang_hint", "hashtags": _TAGS, "mentions": _NAMES,
        "reactions": _COUNTS["likes"], "comments": _COUNTS["comments"], "shares": _COUNTS["shares"], **_END,
    },
}


def laid_out(posts: DataFrame, layout: str) -> DataFrame:
    """Canonical posts as flat rows of one of the LAYOUTS: texts cut to the layout's length, lists
    joined, comments as JSON; null texts become ''."""
    out = posts.select(*[F.expr(e).alias(n) for n, e in LAYOUTS[layout].items()])
    return out.select(*[F.coalesce(F.col(f.name), F.lit("")).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name) for f in out.schema.fields])


def write_laid_out(posts: DataFrame, path: str, layout: str) -> None:
    """A CSV of one of the LAYOUTS; that of ``x`` begins with a byte order mark."""
    write_csv(laid_out(posts, layout), path, bom=layout == "x")


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """What ``write_csv`` wrote, all texts; with ``schema`` the nested columns are made again."""
    rows = spark.read.option("header", True).option("escape", '"').option("multiLine", True).option("nullValue", _NULL).option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    rows = rows.toDF(*[c.removeprefix("\ufeff") for c in rows.columns])
    return unflattened(rows, schema) if schema is not None else rows


def write_summaries(summaries: dict[str, DataFrame], path: str) -> None:
    """Each summary as JSON lines below ``path``; they are small, so one file each."""
    for name, df in summaries.items():
        write_json(df.coalesce(1), f"{path}/{name}")


def new_rows(found: DataFrame, path: str, keys: Sequence[str]) -> DataFrame:
    """Those of ``found`` whose keys are not yet in the table at ``path``, each key once; they are
    added to it, so that a discovery that is started again goes on where it stopped."""
    spark = found.sparkSession
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    known = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    fresh = found.dropDuplicates(list(keys))
    if known:
        fresh = fresh.join(spark.read.parquet(path).select(*keys).distinct(), list(keys), "left_anti")
    fresh = cut(fresh, "found")
    fresh.write.mode("append").parquet(path)
    return fresh


def write_envelope(posts: DataFrame, failed: DataFrame, path: str, **about: str) -> None:
    """Posts, failed rows and run metadata as tables of one folder."""
    write_json(posts, f"{path}/posts")
    write_json(failed, f"{path}/failed")
    n, bad = posts.count(), failed.count()
    write_json(posts.sparkSession.createDataFrame([(n, bad, *about.values())], ["post_count", "failed_count", *about]), f"{path}/metadata")


def write_layers(raw: DataFrame, canonical: DataFrame, path: str, partition: str = "platform") -> None:
    """The raw payloads as they came, and the canonical posts partitioned for pruning."""
    raw.write.mode("overwrite").parquet(f"{path}/bronze")
    canonical.write.mode("overwrite").partitionBy(partition).parquet(f"{path}/silver")


def upsert(df: DataFrame, keys: Sequence[str], send: Callable[[list[dict]], None], batch: int = 500) -> None:
    """Hands the rows to ``send`` in batches of dicts, one connection a partition; keys must be
    set, rows without them are left out.  ``send`` must be idempotent: a lost executor repeats it."""

    def run(rows) -> None:
        part = []
        for r in rows:
            part.append(r.asDict(recursive=True))
            if len(part) == batch:
                send(part)
                part = []
        if part:
            send(part)

    keep = F.lit(True)
    for k in keys:
        keep = keep & F.col(k).isNotNull()
    df.where(keep).foreachPartition(run)


def merged(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What a keyed upsert of ``new`` into ``old`` gives: new rows win, old ones without a successor stay."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new, allowMissingColumns=True)
