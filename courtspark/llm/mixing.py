"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, free_names, local, shuffle_width, small, text_of

#: A source's rate is dealt in parts of at most this much, each with a uniform number of its own: a sum of Poisson
#: counts is a Poisson count of the summed rate, and no tail of exp(-rate) underflows.
PART = 16.0
#: Entries of a part's distribution function; beyond them the tail of Poisson(16) is under 1e-18.
STEPS = 72


def rates(docs: DataFrame, targets: dict[str, float] | None = None, alpha: float = 0.5, budget: float = 1.0) -> DataFrame:
    """Per source: its bytes, share, target share and mean repetition ``rate`` = target bytes / own bytes.

    ``targets`` are weights by source name (others get none); without them the target share of a source is its byte
    share to the power ``alpha``, renormalised, which lifts small sources. ``budget`` is the size of the mixture as
    a multiple of the corpus. Null is a source of its own, named by the empty string in ``targets``. Sources without
    a byte of text get rate 1.
    """
    per = docs.groupBy("source").agg(F.sum(F.octet_length(text_of())).cast("double").alias("bytes"))
    if targets is None:
        weight = F.pow("bytes", F.lit(alpha))
    else:
        pairs = local(docs.sparkSession, [(k, float(v)) for k, v in targets.items()], name=pa.string(), weight=pa.float64())
        per = per.join(F.broadcast(pairs), F.coalesce("source", F.lit("")) == F.col("name"), "left").drop("name")
        weight = F.coalesce("weight", F.lit(0.0))
    per = per.withColumn("w", weight)
    total = per.agg(F.sum("bytes").alias("all_bytes"), F.sum("w").alias("all_w"))
    share = F.when(F.col("all_w") > 0, F.col("w") / F.col("all_w")).otherwise(0.0)
    rate = F.when(F.col("bytes") > 0, F.lit(budget) * share * F.col("all_bytes") / F.col("bytes")).otherwise(1.0)
    return per.crossJoin(F.broadcast(total)).select("source", "bytes", (F.col("bytes") / F.col("all_bytes")).alias("share"), share.alias("target_share"), rate.alias("rate"))


def draw(key: str, part: Column | int | str, digits: int = 13) -> Column:
    """A whole number below 16 ** ``digits`` from the hash of a key and a part; any engine with md5 draws the same."""
    part = part if isinstance(part, Column) else F.lit(part)
    return F.conv(F.substr(F.md5(F.concat_ws("|", F.col(key), part.cast("string"))), F.lit(1), F.lit(digits)), 16, 10).cast("long")


def poisson_count(rate: str, cdf: str, key: str) -> Column:
    """Invert the distribution function ``cdf`` (of ``rate`` / parts) at hash-seeded uniform numbers, summed over parts."""
    parts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.col(rate) / PART).cast("int")))
    one = lambda k: F.size(F.filter(F.col(cdf), lambda c: c <= draw(key, k).cast("double") / float(16**13)))
    return F.when(F.col(rate) > 0, F.aggregate(parts, F.lit(0), lambda n, k: n + one(k))).otherwise(0)


def with_cdf(per: DataFrame) -> DataFrame:
    """Adds ``cdf``: P(count <= 0), P(count <= 1), ... for one part of each source's rate."""
    part = F.col("rate") / F.greatest(F.lit(1.0), F.ceil(F.col("rate") / PART).cast("double"))
    step = lambda acc, k: F.struct((acc["p"] * part / k).alias("p"), F.concat(acc["c"], F.array(F.element_at(acc["c"], -1) + acc["p"] * part / k)).alias("c"))
    start = F.struct(F.exp(-part).alias("p"), F.array(F.exp(-part)).alias("c"))
    return per.withColumn("cdf", F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step, lambda acc: acc["c"]))


def mix(docs: DataFrame, targets: dict[str, float] | None = None, alpha: float = 0.5, budget: float = 1.0, seed: int = 0) -> DataFrame:
    """The mixture: every column of ``docs`` plus ``copy`` (from 0) and ``order_key``, laid out in random order.

    Each document is repeated a Poisson number of times with its source's rate, drawn by inverting the distribution
    at a uniform number hashed from (seed, doc_id, text): any executor draws the same count for the same document,
    so lost tasks change nothing. Copies are dealt to partitions by ranges of a random 60-bit key and sorted by it
    inside, which is a global shuffle. Repeated rows draw the same count, and rows that tie by key lie side by side.
    Null texts count as empty, null doc_ids as one more id; texts are hashed whole, however long. Columns of ``docs``
    named ``copy`` or ``order_key`` are replaced. An empty table gives an empty mixture.
    """
    spark = docs.sparkSession
    of, rate, cdf, keyed, times = free_names(docs, "of_source", "rate", "cdf", "key", "times")
    per = with_cdf(rates(docs, targets, alpha, budget)).select(F.col("source").alias(of), F.col("rate").alias(rate), F.col("cdf").alias(cdf))
    kept = docs.select(*[c for c in docs.columns if c not in ("copy", "order_key")])
    key = F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(text_of().cast("binary")))
    drawn = kept.withColumn(keyed, key).join(small(per, 100_000), F.col("source").eqNullSafe(F.col(of)))
    drawn = drawn.withColumn(times, poisson_count(rate, cdf, keyed)).drop(of, rate, cdf)
    copies = drawn.where(F.col(times) > 0).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col(times) - 1)))
    copies = copies.withColumn("order_key", draw(keyed, F.concat(F.lit("order"), F.col("copy").cast("string")), 15)).drop(times, keyed)
    width = shuffle_width(spark)
    place = F.floor(F.col("order_key").cast("double") / F.lit(math.pow(2.0, 60)) * width).cast("int")
    return copies.repartitionById(width, F.least(place, F.lit(width - 1))).sortWithinPartitions("order_key")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Square-root mixing of all sources: one row per copy, in mixture order within each part of the key range."""
    mixed = mix(documents(spark, sf_dir).select("doc_id", "text", "source"))
    return mixed.select("doc_id", "source", F.col("copy").cast(T.LongType()).alias("copy"), "order_key", F.octet_length(text_of()).cast("long").alias("n_bytes"), F.md5(text_of().cast("binary")).alias("text_md5"))


OP2_SQL = """
WITH RECURSIVE d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
per AS (SELECT source, cast(sum(strlen(text)) AS double) AS bytes, pow(cast(sum(strlen(text)) AS double), 0.5) AS w FROM d GROUP BY source),
total AS (SELECT sum(bytes) AS all_bytes, sum(w) AS all_w FROM per),
rates AS (SELECT source, CASE WHEN bytes > 0 THEN w / all_w * all_bytes / bytes ELSE 1e0 END AS rate FROM per CROSS JOIN total),
parts AS (SELECT source, rate, greatest(1, cast(ceil(rate / 16e0) AS bigint)) AS parts, rate / greatest(1e0, ceil(rate / 16e0)) AS part FROM rates),
cdf(source, k, part, p, c) AS (SELECT source, 0, part, exp(-part), exp(-part) FROM parts
  UNION ALL SELECT source, k + 1, part, p * part / (k + 1), c + p * part / (k + 1) FROM cdf WHERE k < 72),
lists AS (SELECT source, list(c) AS cs FROM cdf GROUP BY source),
keyed AS (SELECT doc_id, d.source, text, '0|' || coalesce(cast(doc_id AS varchar), '') || '|' || md5(text) AS key, parts, cs
  FROM d JOIN parts ON parts.source IS NOT DISTINCT FROM d.source JOIN lists ON lists.source IS NOT DISTINCT FROM d.source),
drawn AS (SELECT doc_id, source, text, key, cast(list_sum(list_transform(range(1, parts + 1), lambda i:
  len(list_filter(cs, lambda c: c <= cast('0x' || substr(md5(key || '|' || cast(i AS varchar)), 1, 13) AS bigint) / 4503599627370496e0)))) AS bigint) AS n FROM keyed)
SELECT doc_id, source, copy, cast('0x' || substr(md5(key || '|order' || cast(copy AS varchar)), 1, 15) AS bigint) AS order_key, strlen(text) AS n_bytes, md5(text) AS text_md5
FROM (SELECT *, unnest(range(0, n)) AS copy FROM drawn)
"""

QUERIES = {"op2_mixing": op2_mixing}
SQL = {"op2_mixing": OP2_SQL}
