"""Predicates over comments, handles and ages, and the SQL functions of the engine."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Texts of controls that page captures mix with comments, and path names that are no handle.
CONTROLS = ("reply", "like", "follow", "share", "send", "more", "see translation", "view replies", "hide replies", "load more comments", "verified", "edited", "log in", "sign up")
RESERVED = ("p", "reel", "reels", "explore", "accounts", "stories", "direct", "about", "help", "login", "hashtag", "search", "watch")
_AGE = r"^[0-9]+\s*(?:s|m|h|d|w|y|sec|min|hours?|days?|weeks?)(?:\s+ago)?$"


def is_noise(text: Column, controls: Sequence[str] = CONTROLS) -> Column:
    """Whether a comment is a control, a number, an age or a pointer to more; null counts as noise."""
    t = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    return t.isin(*controls) | t.rlike(r"^[0-9.,\s]*$") | t.rlike(_AGE) | t.rlike(r"^view (?:all )?[0-9,]+")


def is_genuine(text: Column) -> Column:
    """A comment that says something: over two characters and no noise."""
    return (F.length(F.trim(F.coalesce(text, F.lit("")))) > 2) & ~is_noise(text)


def is_handle(name: Column) -> Column:
    return name.rlike(r"^[A-Za-z0-9._]{2,30}$") & ~F.lower(name).isin(*RESERVED)


def by_another(commenter: Column, author: Column, likes: Column, least: int = 0) -> Column:
    """Comments with enough likes that the post's author did not write."""
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    return (F.coalesce(likes, F.lit(0)) >= least) & (low(commenter) != low(author))


def genuine_comments(df: DataFrame, comments: str, counted: str) -> DataFrame:
    """Where the counted comments are 0 although some were read, keeps the genuine ones and counts them."""
    kept = F.filter(comments, lambda c: is_genuine(c["text"]))
    missing = (F.coalesce(F.col(counted), F.lit(0)) == 0) & (F.size(F.coalesce(F.col(comments), F.expr("array()"))) > 0)
    return df.withColumns({comments: F.when(missing, kept).otherwise(F.col(comments)), counted: F.when(missing, F.size(kept).cast("bigint")).otherwise(F.col(counted))})


def in_range(ts: Column, lo: str | None = None, hi: str | None = None) -> Column:
    """Whether an instant lies in [lo, hi]; bounds are ISO dates or times in UTC, open where None.
    A comparison with literals, so that a scan can skip what lies outside; null is outside."""
    at = lambda x: F.to_timestamp(F.lit(x))
    out = F.lit(True)
    if lo is not None:
        out = out & (ts >= at(lo))
    if hi is not None:
        out = out & (ts <= at(hi))
    return out if lo is not None or hi is not None else F.lit(True)


def stale(verified: Column, at: Column, days: int = 30) -> Column:
    """Whether something was last verified more than ``days`` days before ``at``; never verified is stale."""
    return F.coalesce(F.datediff(at, verified) > days, F.lit(True))


#: SQL functions that the optimizer inlines; they are what the Column functions say.
SQL_FUNCTIONS = {
    "follower_tier(n BIGINT) RETURNS STRING": "CASE WHEN n >= 100000 THEN 'macro' WHEN n >= 10000 THEN 'micro' WHEN n >= 5000 THEN 'nano' ELSE 'individual' END",
    "engagement_rate(reactions BIGINT, followers BIGINT) RETURNS DOUBLE": "CASE WHEN followers > 0 THEN CAST(round(CAST(coalesce(reactions, 0) AS DECIMAL(20, 0)) * 100 / CAST(followers AS DECIMAL(20, 0)), 2) AS DOUBLE) ELSE 0.0D END",
    "tone(score DOUBLE, p INT, n INT) RETURNS STRING": "CASE WHEN score > 0.3 THEN 'positive' WHEN score < -0.3 THEN 'negative' WHEN p > n + 2 THEN 'positive' WHEN n > p + 2 THEN 'negative' WHEN p >= 2 AND n >= 2 THEN 'mixed' ELSE 'neutral' END",
}


def register(spark: SparkSession) -> None:
    """Makes the SQL functions available to ``spark.sql``."""
    for head, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
