"""Calendar windows, gaps to the second best, and positions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def month_windows(spark: SparkSession, lo: str, hi: str) -> DataFrame:
    """Half-open months that cover [lo, hi), clipped at both ends."""
    d = spark.range(1).select(F.lit(lo).cast("date").alias("lo"), F.lit(hi).cast("date").alias("hi"))
    m = d.select("lo", "hi", F.explode(F.expr("sequence(trunc(lo, 'MM'), hi, interval 1 month)")).alias("m"))
    return m.select(F.greatest("lo", "m").alias("start"), F.least("hi", F.add_months("m", 1)).alias("end")).where("start < end")


def week_windows(spark: SparkSession, lo: str, hi: str) -> DataFrame:
    """Half-open spans of seven days from ``lo``, the last clipped at ``hi``."""
    d = spark.range(1).select(F.lit(lo).cast("date").alias("lo"), F.lit(hi).cast("date").alias("hi"))
    return d.select("hi", F.explode(F.expr("sequence(lo, hi, interval 7 days)")).alias("start")).select("start", F.least("hi", F.date_add("start", 7)).alias("end")).where("start < end")


def margin(df: DataFrame, by: Sequence[str], score: str, tie: str) -> DataFrame:
    """The best row of each group with the second best score and the gap to it."""
    w = Window.partitionBy(*by).orderBy(F.desc(score), tie)
    ranked = df.withColumn("_n", F.row_number().over(w)).withColumn("second", F.lead(score).over(w))
    return ranked.where("_n = 1").drop("_n").withColumn("margin", F.col(score) - F.coalesce("second", F.lit(0)))


def position(by: Sequence[str], order: Sequence[Column]) -> Column:
    return F.row_number().over(Window.partitionBy(*by).orderBy(*order))
