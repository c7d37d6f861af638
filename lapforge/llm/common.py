"""Helpers shared by the operators: session settings, staged tables and tables of a directory."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where a local session names none (tests), a temporary folder is set up as such; on a
    cluster that would split driver from executors, so there it is an error.
    """
    bounded_batches(spark)
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="lapforge-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def bounded_batches(spark: SparkSession) -> None:
    """Keep what a Python worker holds at once to some megabytes, however long the rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def staged_at(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """``staged`` with the folder, for ``discard``."""
    path = f"{shared_dir(df.sparkSession)}/lapforge/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cut lineage that any executor can reread."""
    return staged_at(df, label)[0]


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete folders of the shared storage that nothing reads any more, and let Spark drop unreferenced shuffles."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    gc.collect()
    jvm.System.gc()


def shards_for(texts: DataFrame, text_col: str, bytes_each: int) -> int:
    """Number of shards of about ``bytes_each`` bytes of text, and no fewer than the session's shuffle partitions."""
    total = texts.agg(F.coalesce(F.sum(F.octet_length(text_col).cast("long")), F.lit(0))).first()[0]
    return max(1, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // bytes_each))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
