"""Batch summaries: averages, distributions, drivers, themes, high intent and engagement.

Each summary is a small grouped DataFrame; ``by`` adds grouping columns (platform, query,
month), so that one call reports on all of them.  Ties of a top list go to the key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mentionlake.operators.nlp import label_of
from mentionlake.session import cut


def score_stats(df: DataFrame, by: Sequence[str] = (), score: str = "score") -> DataFrame:
    s = F.col(score)
    one = lambda name: F.count_if(label_of(s) == name).alias(name)
    exact = s.cast("decimal(12,6)")
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("posts"), F.round(F.avg(exact), 4).cast("double").alias("score_avg"), F.min(s).alias("score_min"), F.max(s).alias("score_max"), one("positive"), one("negative"), one("neutral"))


def value_counts(df: DataFrame, column: str, by: Sequence[str] = (), default: str = "unknown") -> DataFrame:
    return df.groupBy(*by, F.coalesce(F.col(column), F.lit(default)).alias(column)).agg(F.count(F.lit(1)).alias("posts"))


def top_values(df: DataFrame, values: str, n: int, by: Sequence[str] = (), name: str = "value") -> DataFrame:
    """The n values of an array column that most rows hold (a row counts a value once)."""
    each = df.select(*by, F.explode(F.array_distinct(values)).alias(name)).groupBy(*by, name).agg(F.count(F.lit(1)).alias("posts"))
    if not by:
        return each.orderBy(F.desc("posts"), name).limit(n)
    w = Window.partitionBy(*by).orderBy(F.desc("posts"), name)
    return each.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def complaint_themes(df: DataFrame, n: int = 5, score: str = "score", topics: str = "topics", by: Sequence[str] = ()) -> DataFrame:
    """Topics of posts whose score is under -0.25."""
    bad = df.where(F.col(score) < -0.25).withColumn("_t", F.transform(topics, lambda t: t["topic"]))
    return top_values(bad, "_t", n, by, name="topic")


def high_intent(df: DataFrame, by: Sequence[str] = (), intent: str = "intent", username: str = "username") -> DataFrame:
    """(by..., username, posts): who wrote posts of high intent; one row each, never one list of all."""
    return df.where(F.col(f"{intent}.level") == "high").groupBy(*by, username).agg(F.count(F.lit(1)).alias("posts"))


def weighted_engagement(weights: dict[str, float]) -> Column:
    return sum(F.coalesce(F.col(c), F.lit(0)).cast("decimal(20,2)") * F.lit(w).cast("decimal(6,2)") for c, w in weights.items())


def top_posts(df: DataFrame, weights: dict[str, float], key: str, n: int = 5, by: Sequence[str] = ()) -> DataFrame:
    """The n posts (of each group) with the greatest weighted engagement."""
    rows = df.select(*by, key, weighted_engagement(weights).cast("double").alias("engagement"))
    if not by:
        return rows.orderBy(F.desc("engagement"), key).limit(n)
    w = Window.partitionBy(*by).orderBy(F.desc("engagement"), key)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def hinted(df: DataFrame, hint: str, by: Sequence[str] = ()) -> DataFrame:
    """How many posts came with a language, of how many."""
    return df.groupBy(*by).agg(F.count_if(F.trim(F.coalesce(F.col(hint), F.lit(""))) != "").alias("hinted"), F.count(F.lit(1)).alias("posts"))


def run_report(df: DataFrame, ok: Column, by: Sequence[str], at: str) -> DataFrame:
    """Rows, rows that went well, failed ones, and the seconds from first to last, for each group
    (target, category) and every level above it."""
    base = df.withColumns({"_ok": F.coalesce(ok, F.lit(False)).cast("bigint"), "_at": F.col(at).cast("timestamp")})
    return base.rollup(*by).agg(F.count(F.lit(1)).alias("rows"), F.sum("_ok").alias("ok"), (F.count(F.lit(1)) - F.sum("_ok")).alias("failed"), (F.unix_seconds(F.max("_at")) - F.unix_seconds(F.min("_at"))).alias("seconds"))


def totals(df: DataFrame, by: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """Sums for each group and for every level above it."""
    return df.rollup(*by).agg(F.count(F.lit(1)).alias("rows"), *[F.sum(F.coalesce(F.col(c), F.lit(0))).alias(c) for c in sums])


def summarize(df: DataFrame, by: Sequence[str] = (), weights: dict[str, float] | None = None, key: str = "post_id") -> dict[str, DataFrame]:
    """All summaries of annotated posts (see ``plans.pipeline``), each by the columns ``by``.

    What the summaries read is written once, so that no text is annotated again for each of
    them.  ``weights``: of ``top_posts``; the default counts likes, comments and shares alike."""
    columns = [c for c in (*by, key, "score", "language", "lang_hint", "tone", "positive", "negative", "topics", "intent", "username", "engagement") if c in df.columns]
    df = cut(df.select(*dict.fromkeys(columns)).withColumn("lang", F.col("language.language")), "annotated")
    out = {
        "scores": score_stats(df, by), "languages": value_counts(df, "lang", by), "tones": value_counts(df, "tone", by),
        "positive_drivers": top_values(df, "positive", 10, by), "negative_drivers": top_values(df, "negative", 10, by), "complaint_themes": complaint_themes(df, by=by), "high_intent": high_intent(df, by),
        "high_intent_count": df.groupBy(*by).agg(F.count_if(F.col("intent.level") == "high").alias("posts")),
    }
    if "engagement" in df.columns:
        out["top_posts"] = top_posts(df, weights or {f"engagement.{c}": 1 for c in ("likes", "comments", "shares")}, key, 5, by)
        flat = df.select(*by, F.col("engagement.views").alias("plays"), F.col("engagement.shares").alias("shares"))
        out["totals"] = totals(flat, by, ["plays", "shares"]) if by else flat.agg(F.count(F.lit(1)).alias("rows"), *[F.sum(F.coalesce(F.col(c), F.lit(0))).alias(c) for c in ("plays", "shares")])
    if "lang_hint" in df.columns:
        out["hinted"] = hinted(df, "lang_hint", by)
    return out
