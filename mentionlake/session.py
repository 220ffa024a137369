"""Session settings and the shared checkpoint folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Settings that the operators rely on; sizes are left to the cluster.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    b = SparkSession.builder.master(f"local[{cores}]").appName("mentionlake")
    for k, v in SETTINGS.items():
        b = b.config(k, v)
    return (
        b.config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bound on the bytes of a side that is sent to every executor.
MOST_BROADCAST = 24_000_000
_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (``spark.checkpoint.dir``).

    Where the session names none and its master is local, a temporary folder is made, which
    goes with the process; on a cluster that is an error, since executors would write to
    their own disks.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not named:
        named = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else None
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        own = tempfile.mkdtemp(prefix="mentionlake-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        named = "file://" + own
        spark.conf.set("spark.checkpoint.dir", named)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder, for a table that one query writes and reads."""
    path = f"{shared_dir(spark)}/mentionlake-{label}-{os.getpid()}-{uuid.uuid4().hex[:12]}"
    _made.append(path)
    return path


def release(spark: SparkSession) -> None:
    """Deletes the tables that queries of this process have cut; their results are no longer readable."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    while _made:
        path = hadoop(_made.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back: its lineage ends there."""
    path = scratch(df.sparkSession, label)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _bytes(c: Column, t: T.DataType) -> Column:
    """About how many bytes a value takes in a broadcast row."""
    if isinstance(t, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16
    if isinstance(t, T.ArrayType):
        if isinstance(t.elementType, (T.StringType, T.BinaryType, T.ArrayType, T.StructType, T.MapType)):
            return F.coalesce(F.aggregate(c, F.lit(16).cast("bigint"), lambda a, x: a + _bytes(x, t.elementType)), F.lit(16).cast("bigint"))
        return F.greatest(F.size(c), F.lit(0)) * 8 + 16
    if isinstance(t, T.StructType):
        return sum((_bytes(c[f.name], f.dataType) for f in t.fields), F.lit(16))
    if isinstance(t, T.MapType):
        return _bytes(F.map_entries(c), T.ArrayType(T.StructType([T.StructField("key", t.keyType), T.StructField("value", t.valueType)])))
    return F.lit(8)


def weighed(df: DataFrame) -> int:
    """The bytes that all rows of ``df`` take, by a distributed sum."""
    row = sum((_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(8)).cast("bigint")
    return df.agg(F.sum(row)).first()[0] or 0


def small(df: DataFrame, max_bytes: int = MOST_BROADCAST, written: bool = False) -> DataFrame:
    """``df`` marked for broadcast if all its rows take at most ``max_bytes``, else as it is.

    The bytes are summed first, so what is broadcast has a checked size, and a larger side is
    left to a shuffled join with the same result.  ``df`` is written before it is weighed, so
    that it is computed once; ``written`` says that it already is a table.
    """
    df = df if written else cut(df, "small")
    return F.broadcast(df) if weighed(df) <= max_bytes else df


def parallel(spark: SparkSession) -> int:
    """Partitions for a stage of Python work, which adaptive execution would merge by its small input."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)


def sampled(df: DataFrame, key: str, n: int) -> DataFrame:
    """At most ``n`` rows, picked by a hash of their key: the same ones however the table is cut.

    The keys are picked first, without the other columns, so that little moves however many
    partitions there are; then a broadcast of at most n keys takes their rows at the scan.
    """
    order = (F.xxhash64(key), F.col(key))
    keys = df.select(key).orderBy(*order).limit(n).distinct()
    return df.join(F.broadcast(keys), key, "left_semi").orderBy(*order).limit(n)
