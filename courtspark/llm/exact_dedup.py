"""Exact duplicates by deterministic block naming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, small, table, text_of

BLOCK_CHARS = 8192


def _blocks(text: Column, block_chars: int) -> Column:
    """The text in pieces of ``block_chars`` characters, in one pass over it; an empty text is one empty piece."""
    cut = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{block_chars}}}"), F.lit(0))
    return F.when(text == "", F.array(F.lit(""))).otherwise(cut)


def _hash(block: Column, bits: int) -> Column:
    return F.xxhash64(block) if bits == 64 else F.pmod(F.xxhash64(block), F.lit(1 << bits))


def _named(rows: DataFrame, keys: list[str], what: str) -> DataFrame:
    """An integer for each distinct value of ``keys``: rows are spread by hash, sorted, and numbered in that order."""
    spread = rows.select(*keys).distinct().sortWithinPartitions(*keys)
    return table(spread.withColumn("name", F.monotonically_increasing_id()), what)


def identities(docs: DataFrame, text: str = "text", block_chars: int = BLOCK_CHARS, hash_bits: int = 64) -> DataFrame:
    """Rows of ``docs`` as (row, doc_id, text_sha256, n, name): two rows have equal (n, name) iff their texts are equal.

    Each text is cut into blocks of ``block_chars`` characters; distinct blocks are sorted into integer names; then
    adjacent names are paired and the distinct pairs named in turn, until one name per document is left. A name
    stands for one content, so there are no collisions to check afterwards. Only documents of several blocks take
    part in the pairing, which has as many rounds as the longest text's block count has binary digits.

    A null text counts as empty; repeated rows stay apart as rows; an empty table gives an empty result.
    ``hash_bits`` narrows the hash that spreads blocks and is there for tests of colliding hashes.
    """
    of = docs.select(F.col("doc_id").alias("doc_id"), text_of(F.col(text)).alias("text"))
    cut = F.transform(_blocks(F.col("text"), block_chars), lambda b: _hash(b, hash_bits))
    rows = table(of.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.sha2("text", 256).alias("text_sha256"), cut.alias("hs")), "rows")
    n = F.size("hs").alias("n")

    # Contents meet once, in this distinct; after it a block goes by its hash. Where two contents share a hash, those
    # few are named and joined by content instead.
    contents = of.select(F.explode(_blocks(F.col("text"), block_chars)).alias("block")).select(_hash(F.col("block"), hash_bits).alias("h"), "block")
    seen = contents.distinct().sortWithinPartitions("h", "block").select("h", F.monotonically_increasing_id().alias("name"))
    names = table(seen.groupBy("h").agg(F.min("name").alias("name"), F.count("*").alias("contents")), "names")
    slim = rows.select("row", n, F.posexplode("hs").alias("pos", "h"))
    level = slim.join(names.where("contents = 1").select("h", "name"), "h").select("row", "n", "pos", "name")
    clash = names.where("contents > 1").select("h")
    if not clash.isEmpty():
        level = level.unionByName(_clashing(of, rows, clash, block_chars, hash_bits))
    level = table(level, "level")
    width = rows.agg(F.max(F.size("hs"))).first()[0] or 0
    done = level.where("n = 1").select("row", "n", "name")
    level = level.where("n > 1")
    while width > 1:
        left, right = F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))), F.max(F.when(F.col("pos") % 2 == 1, F.col("name")))
        pairs = level.groupBy("row", "n", F.shiftright("pos", 1).alias("pos")).agg(left.alias("l"), F.coalesce(right, F.lit(-(1 << 62))).alias("r"))
        pairs = table(pairs, "pairs")
        level = table(pairs.join(_named(pairs, ["l", "r"], "pair-names"), ["l", "r"]).select("row", "n", "pos", "name"), "level")
        width = (width + 1) // 2
    if width == 1:
        done = done.unionByName(level.select("row", "n", "name"))
    return rows.drop("hs").join(done, "row")


def _clashing(of: DataFrame, rows: DataFrame, clash: DataFrame, block_chars: int, hash_bits: int) -> DataFrame:
    """Names for blocks whose hash two contents share; their content comes along from a second reading, by text hash."""
    texts = of.select(F.sha2("text", 256).alias("text_sha256"), F.posexplode(_blocks(F.col("text"), block_chars)).alias("pos", "block")).select("text_sha256", "pos", "block", _hash(F.col("block"), hash_bits).alias("h"))
    apart = table(texts.join(small(clash), "h", "left_semi").distinct(), "clashing")
    names = _named(apart, ["h", "block"], "clash-names").withColumn("name", -F.col("name") - 1)
    at = apart.join(names, ["h", "block"]).select("text_sha256", "pos", "name")
    return rows.select("row", "text_sha256", F.size("hs").alias("n")).join(at, "text_sha256").select("row", "n", "pos", "name")


def exact_dedup(docs: DataFrame, text: str = "text", block_chars: int = BLOCK_CHARS, hash_bits: int = 64) -> DataFrame:
    """One row per document: doc_id, keep_id (largest doc_id of its equal texts), group_size, kept, text_sha256.

    Of rows that repeat the largest doc_id itself all are marked kept. A group whose doc_ids are all null has a null
    keep_id and keeps its rows. Null texts count as empty; an empty table gives no rows; other columns of ``docs``,
    whatever their names, play no part; long texts are blocks of one document.
    """
    named = identities(docs, text, block_chars, hash_bits)
    named = table(named, "identities")
    groups = named.groupBy("n", "name").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    groups = table(groups, "groups")  # read back, both sides of the join below are plain shuffles, which are split at a hot group
    return named.join(groups, ["n", "name"]).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal texts among all documents, byte for byte."""
    return exact_dedup(documents(spark, sf_dir))


OP4_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.text) AS text_sha256
FROM d JOIN g ON d.text = g.text
"""

QUERIES = {"op4_exact_dedup": op4_exact_dedup}
SQL = {"op4_exact_dedup": OP4_SQL}
