"""Intermediate tables in the folder that driver and executors share, and their spread over tasks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame

TASK_ROWS = 200_000  # of a partition of ``spread``, about


def staged(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet under ``spark.checkpoint.dir`` and read back, so that loops keep a short lineage.

    Where a local session names no folder (tests), a temporary one is set up; on a cluster that is an error.
    """
    context = df.sparkSession.sparkContext
    at = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not at:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="lapforge-")
        context.setCheckpointDir(at)
    path = f"{at.rstrip('/')}/lapforge/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *by: str, rows: int = 0) -> DataFrame:
    """``df`` in as many partitions as the session shuffles into, or as its number of ``rows`` asks for, however few bytes it has: for rows of few bytes and much work."""
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS)), *by)
