"""A training corpus from raw documents: each stage is one of the corpus operators with its decisions applied."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from courtspark.llm.common import table
from courtspark.llm.decontaminate import clean
from courtspark.llm.jaccard_join import one_of_each
from courtspark.llm.mixing import mix
from courtspark.llm.sharding import shard
from courtspark.llm.toxicity import THRESHOLD, fit, toxicity

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose clauses score as toxic go; the grammar is fitted on labelled rows that are not held out."""
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(toxicity(model) < THRESHOLD).select(*COLUMNS)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by runs of five words at 80 % or more, the one with the least doc_id stays."""
    return one_of_each(docs).select(*COLUMNS)


def no_benchmark_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that repeat a benchmark item, also edited, go."""
    return clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat each source's documents to its square-root share and shuffle them."""
    return mix(docs).select(*COLUMNS)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deal all rows into 40 shards of equal bytes."""
    return shard(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("n-gram jaccard join", one_of_near_copies),
    ("benchmark decontamination", no_benchmark_items),
    ("mixing sources", mixing),
    ("sharding", sharding),
]

#: The stages learn from labels, align and draw by hash, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = table(docs, f"pipeline-{name.replace(' ', '-')}")
    return docs
