"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a local folder only where the session runs in one process (tests)."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named.rstrip("/")
    if re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        return f"{tempfile.gettempdir()}/courtspark-checkpoints"
    raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")


#: Rows that a task should sort at most.
TASK_ROWS = 400_000


def task_parts(spark: SparkSession, rows: int) -> int:
    """Partitions for so many rows: ``df.repartition(parts, "match_id")`` keeps a task's memory from growing with them.

    Numbered partitions are not merged again by their compressed size, which says little about sorted rows; windows,
    groups and joins that have the match among their keys work in place on sides dealt alike.
    """
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` written as Parquet and read back: its uses share one computation, which survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/courtspark/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
