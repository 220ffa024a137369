"""Structured Streaming: landing folders, duplicates within a watermark, event-time windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from mentionlake.session import scratch


def landing(spark: SparkSession, path: str, schema, fmt: str = "json", files: int = 1000) -> DataFrame:
    """A stream over a folder in which payloads land."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).format(fmt).load(path)


def once(stream: DataFrame, keys: Sequence[str], ts: str, late: str = "1 day") -> DataFrame:
    """Each key once within ``late`` of its first row; later copies pass, as state is bounded."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark(list(keys))


def tumbling(stream: DataFrame, ts: str, width: str, by: Sequence[str] = (), late: str = "1 hour") -> DataFrame:
    """Counts by window of fixed width."""
    w = F.window(F.col(ts), width)
    return _marked(stream, ts, late).groupBy(w.alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


def sliding(stream: DataFrame, ts: str, width: str, step: str, by: Sequence[str] = (), late: str = "1 hour") -> DataFrame:
    w = F.window(F.col(ts), width, step)
    return _marked(stream, ts, late).groupBy(w.alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


def sessions(stream: DataFrame, ts: str, gap: str, by: Sequence[str], late: str = "1 hour") -> DataFrame:
    """Counts by session: rows of one group that follow each other within ``gap``."""
    w = F.session_window(F.col(ts), gap)
    return _marked(stream, ts, late).groupBy(w.alias("w"), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


def _marked(df: DataFrame, ts: str, late: str) -> DataFrame:
    df = df.withColumn(ts, F.col(ts).cast("timestamp"))
    return df.withWatermark(ts, late) if df.isStreaming else df


def to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", fmt: str = "parquet") -> StreamingQuery:
    """Writes what is there and stops; restarted, it goes on from its checkpoint."""
    return stream.writeStream.outputMode(mode).format(fmt).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drained(stream: DataFrame, label: str) -> DataFrame:
    """All rows that an append-mode stream gives for the files that are there, as a table."""
    spark = stream.sparkSession
    path, mark = scratch(spark, label), scratch(spark, f"{label}-mark")
    to_table(stream, path, mark).awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
