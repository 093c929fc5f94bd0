"""Cutting lineage with tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where the cluster names no folder, as in tests.
LOCAL_DEFAULT = "/tmp/checkpoints/orrery"

#: Rows of (long, long) that may be broadcast: about 32 MB before hashing.
BROADCAST_ROWS = 2_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a default only where that is unset and all of Spark is one process."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and not spark.conf.get("spark.master", "local").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (path or LOCAL_DEFAULT).rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/orrery-{tag}-{uuid.uuid4().hex}"


def cut(df: DataFrame, tag: str = "cut") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: later jobs neither
    recompute it nor depend on the executors that made it."""
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if a count shows at most ``limit`` (narrow) rows; else as it
    is, for a shuffled join."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if df.count() <= limit else df


def drop_cut(*tables: DataFrame) -> None:
    """Delete tables of ``cut`` that no later step reads, and let Spark's cleaner see that the
    shuffles behind them are out of use."""
    import gc

    for df in tables:
        spark = df.sparkSession
        for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if f"{shared_dir(spark).split(':')[-1].rstrip('/')}/orrery-" in name:
                path = spark._jvm.org.apache.hadoop.fs.Path(name)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    if tables:
        tables[0].sparkSession._jvm.System.gc()


#: Rows and bytes of an Arrow batch that carries texts or vectors, instead of the default's 10,000 rows of any size.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def text_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of a session that sends texts to Python workers; lower settings of
    the cluster stay. They hold for the session: plans read them when they run."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        number, unit = re.fullmatch(r"(-?\d+)\s*([kmgt]?)b?", spark.conf.get(key).lower()).groups()
        if not 0 < int(number) * 1024 ** " kmgt".index(unit or " ") <= most:
            spark.conf.set(key, most)
