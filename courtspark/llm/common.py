"""Shared-folder tables, key hygiene and small column helpers for the corpus operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table of at most this many slim rows (two or three numbers each, so under 64 MB) may be broadcast.
BROADCAST_ROWS = 1_000_000
#: Whole texts go to Python so many at a time: batches of them are held several times over, by the JVM and its workers.
TEXTS = 512


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where the session names none and runs in one
    process, as in tests."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named
    if re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        return f"{tempfile.gettempdir()}/courtspark-checkpoints"
    raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")


@contextmanager
def few_texts(spark: SparkSession) -> Iterator[None]:
    """What runs inside hands Python at most ``TEXTS`` rows at a time; afterwards the session is as before."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if 0 < int(before) <= TEXTS:
        yield
        return
    spark.conf.set(key, str(TEXTS))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def table(df: DataFrame, what: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back, so lost executors cost no recomputation
    and row ids that Spark dealt out stay what they are."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/courtspark/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table_of_texts(df: DataFrame, what: str) -> DataFrame:
    """``table`` for what Python makes of whole texts."""
    with few_texts(df.sparkSession):
        return table(df, what)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``df`` if it has at most ``rows`` rows, else leave the join to a shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def local(spark: SparkSession, rows: Iterable[tuple], **columns: pa.DataType) -> DataFrame:
    """A few rows from the driver, handed over as one Arrow table, so no Python runs on the executors for it."""
    of = list(zip(*rows, strict=True)) or [[] for _ in columns]
    return spark.createDataFrame(pa.table({n: pa.array(v, t) for (n, t), v in zip(columns.items(), of, strict=True)}))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(col: str | Column = "text") -> Column:
    """The text, null read as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names like ``wanted`` that no column of ``df`` has, in whatever case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def unit(*cols: Column | int | str) -> Column:
    """A uniform number in [0, 1) from the hash of its arguments; the same everywhere and always."""
    of = [c if isinstance(c, Column) else F.lit(c) for c in cols]
    return F.shiftrightunsigned(F.xxhash64(*of), 11).cast("double") / F.lit(float(1 << 53))
