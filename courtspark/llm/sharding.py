"""Shards of equal size from a k-d tree over document metadata."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, local, table, text_of, unit

DIMS = ("d0", "d1", "d2", "d3")
#: A group of equal texts heavier than this part of a shard is placed before the tree is built. At most
#: shards * HEAVY such groups exist, whatever the input.
HEAVY = 256
BINS = 1024
REFINE = 2


@dataclass
class Cell:
    """A leaf cell of the growing tree, with the shards it is to fill."""

    id: int
    leaves: list[int]
    dim: int = 0
    low: float = 0.0
    high: float = 0.0
    aim: float = 0.0
    under: int = 0


def _room(loads: list[int], total: int) -> list[float]:
    """What each shard still takes when ``total`` more bytes level all loads as far as they go."""
    level, rest = 0.0, float(total)
    order = sorted(loads)
    for i, low in enumerate(order):
        top = order[i + 1] if i + 1 < len(order) else float("inf")
        level = min(float(top), low + rest / (i + 1))
        rest -= (level - low) * (i + 1)
        if rest <= 0:
            break
    return [max(0.0, level - x) for x in loads]


def _split(light: DataFrame, shards: int, room: list[float]) -> DataFrame:
    """``light`` with the column ``shard``: all cells of a depth are cut at once, until each has one shard.

    A depth is three aggregations and a join with its cuts (at most ``shards`` rows, broadcast); every other depth's
    cells are written, so that no depth repeats the joins of all before it.
    """
    spark = light.sparkSession
    x = F.element_at(F.array(*DIMS), F.col("dim") + 1)
    cells, front, number = light.withColumn("cell", (F.col("bytes") * 0).cast("int")), [Cell(0, list(range(shards)))], 1
    spans: list[float] = []
    depth = 0
    while any(len(c.leaves) > 1 for c in front):
        ends = [f(d).alias(f"{k}_{d}") for d in DIMS for k, f in (("lo", F.min), ("hi", F.max))]
        stats = {r["cell"]: r for r in cells.groupBy("cell").agg(*ends, F.sum("bytes").alias("w")).collect()}
        cut = [c for c in front if len(c.leaves) > 1]
        for c in cut:
            half = c.leaves[: len(c.leaves) // 2]
            if r := stats.get(c.id):
                wide = [r[f"hi_{d}"] - r[f"lo_{d}"] for d in DIMS]
                spans = spans or [max(w, 1e-9) for w in wide]
                c.dim = max(range(len(DIMS)), key=lambda i: wide[i] / spans[i])
                c.low, c.high = r[f"lo_{DIMS[c.dim]}"], r[f"hi_{DIMS[c.dim]}"]
                c.high += max(1e-9, abs(c.high) * 1e-12)
                c.aim = r["w"] * sum(room[s] for s in half) / (sum(room[s] for s in c.leaves) or 1.0)
        for _ in range(REFINE):
            grid = local(spark, [(c.id, c.dim, c.low, (c.high - c.low) / BINS) for c in cut], cell=pa.int32(), dim=pa.int32(), low=pa.float64(), step=pa.float64())
            bins = cells.join(F.broadcast(grid), "cell").withColumn("bin", F.floor((x - F.col("low")) / F.col("step"))).where(f"bin between 0 and {BINS - 1}")
            found: dict[int, dict[int, int]] = {}
            for r in bins.groupBy("cell", "bin").agg(F.sum("bytes").alias("w")).collect():
                found.setdefault(r["cell"], {})[r["bin"]] = r["w"]
            for c in (c for c in cut if c.aim > 0):  # else nothing goes below ``low``
                step, at = (c.high - c.low) / BINS, BINS - 1
                for b, w in sorted(found.get(c.id, {}).items()):
                    if c.under + w >= c.aim:
                        at = b
                        break
                    c.under += w
                c.low, c.high = c.low + at * step, c.low + (at + 1) * step
        cuts, front = [], [c for c in front if len(c.leaves) == 1]
        for c in cut:
            half = len(c.leaves) // 2
            cuts.append((c.id, c.dim, c.high if c.aim > 0 else c.low, number, number + 1))
            front += [Cell(number, c.leaves[:half]), Cell(number + 1, c.leaves[half:])]
            number += 2
        at = F.broadcast(local(spark, cuts, cell=pa.int32(), dim=pa.int32(), at=pa.float64(), below=pa.int32(), above=pa.int32()))
        to = F.when(F.col("at").isNull(), F.col("cell")).otherwise(F.when(x < F.col("at"), F.col("below")).otherwise(F.col("above")))
        cells = cells.join(at, "cell", "left").withColumn("cell", to).drop("dim", "at", "below", "above")
        if depth % 2:
            cells = table(cells, "cells")
        depth += 1
    leaf = F.broadcast(local(spark, [(c.id, c.leaves[0]) for c in front], cell=pa.int32(), shard=pa.int32()))
    return cells.join(leaf, "cell")


def shard(docs: DataFrame, shards: int = 40) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law (``bytes``), shard, slot, grown_shard (null).

    Documents with equal texts are one group and stay together; a group's metadata are its least doc_id, the log of
    its text's size, its least source and least language (the last two as hashed places), each spread by a hash so
    that no value holds a mass that a cut cannot divide. The cells of a k-d tree over these four are cut, depth by
    depth, at weighted medians along their relatively widest dimension (weighted by what the shards on either side
    still take), until each has one shard's bytes. Medians come from histograms that Spark adds up, refined
    ``REFINE`` times; only histograms reach the driver: shards * BINS numbers at most.

    Groups heavier than 1 / ``HEAVY`` of a shard (at most shards * HEAVY of them) are dealt first, heaviest to the
    emptiest shard, and the tree levels the rest around them; a group above a shard's share fills a shard alone.
    Slots number a shard's rows by doc_id within hashed parts, with offsets from the parts' counts, so no task holds
    a shard. Size is the text's UTF-8 bytes plus 16. Null texts count as empty, null metadata as least; repeated
    rows are rows of one group; a text longer than a shard's share fills a shard; an empty table gives no rows; other
    columns of ``docs``, whatever their names, play no part.
    """
    rows = docs.select(F.col("doc_id").alias("doc_id"), text_of().alias("text"), F.col("source").alias("source"), F.col("lang").alias("lang"))
    rows = table(
        rows.select(
            "doc_id", (F.octet_length("text") + 16).cast("long").alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
            F.unhex(F.sha2("text", 256)).alias("text_key"), "source", "lang", F.monotonically_increasing_id().alias("row"),
        ),
        "rows",
    )
    mine = F.min(F.coalesce("doc_id", F.lit(-1)))
    groups = rows.groupBy("text_key").agg(F.sum("size").alias("bytes"), F.min("size").alias("size"), mine.alias("first"), F.min("source").alias("source"), F.min("lang").alias("lang"))
    spread = lambda d: unit(F.col("text_key"), d)
    place = lambda c: F.pmod(F.xxhash64(F.coalesce(c, F.lit(""))), F.lit(1000))
    dims = [F.col("first") + spread("first"), F.log2(F.col("size") + spread("size")), place("source") + spread("source"), place("lang") + spread("lang")]
    groups = table(groups.select("text_key", "bytes", *[d.cast("double").alias(n) for d, n in zip(dims, DIMS, strict=True)]), "groups")

    total = groups.agg(F.sum("bytes")).first()[0] or 0
    bound = max(1, total // (shards * HEAVY))
    heavy = groups.where(F.col("bytes") > bound).select("text_key", "bytes").orderBy(F.desc("bytes"), "text_key").collect()
    loads, placed = [0] * shards, []
    for key, size in heavy:
        s = min(range(shards), key=lambda i: (loads[i], i))
        loads[s] += size
        placed.append((key, s))
    room = _room(loads, total - sum(loads))
    light = _split(groups.where(F.col("bytes") <= bound), shards, room)
    first = F.broadcast(local(docs.sparkSession, [(bytes(k), s) for k, s in placed], text_key=pa.binary(), shard=pa.int32()))
    by_group = light.select("text_key", "shard").unionByName(first)
    of_rows = table(rows.join(by_group, "text_key").select("doc_id", "size", "text_crc32", "shard", "row"), "sharded")
    return _slots(of_rows).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _slots(rows: DataFrame, part_rows: int = 200_000) -> DataFrame:
    """Adds ``slot``, numbering each shard's rows from 0 without gaps."""
    parts = max(8, rows.count() // (40 * part_rows))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int"))
    counts = rows.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("shard", "part", before.alias("before"))
    at = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "row"))
    return rows.withColumn("at", at).join(offsets, ["shard", "part"]).withColumn("slot", F.col("before") + F.col("at") - 1)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of equal bytes."""
    return shard(documents(spark, sf_dir))


QUERIES = {"op10_sharding": op10_sharding}
SQL: dict[str, str] = {}
