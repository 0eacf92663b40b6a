"""Documents linked by the Jaccard similarity of their word n-grams, as a blocked sparse product."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import grams
from .common import documents, few_texts, free_names, local, shuffle_width, small, table, table_of_texts, text_of
from .graph import connected_components

WORDS = 5
#: Two sets link when 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Counters of the frequency sketch that orders n-grams from rare to frequent. It has this size for any corpus.
SKETCH = 1 << 18
#: Blocks are multiplied in tiles of about this many entries a side, or more where that makes more than ``PARTS``.
TILE = 2048
#: A side of a block has at most so many parts, so an entry goes out at most twice as often, however large the block.
PARTS = 4
#: Linked pairs share at least this many n-grams more than one within their prefixes, which are longer by as many.
MORE = 4
#: Lists up to SHORT are multiplied together; at most about PAIRS pairs and HELD entries of one block wait in a task.
SHORT, PAIRS, HELD = 32, 1 << 20, 1 << 18
MINHASHES, STARS, AGREE = 8, 4, 6
#: Components of at least so many sets are tested against each other as wholes; at most so many pairs of them are
#: handed to every task (16 MB).
MANY, EXCLUDED = 32, 1 << 20
_MULT = np.array([0x9E3779B97F4A7C15 * (2 * k + 1) + 2 * k & ((1 << 64) - 1) | 1 for k in range(1, MINHASHES + 1)], np.uint64)


def least_overlap(sizes, percent: int):
    """The least intersection with which sets of these summed sizes link: i with 100 i >= percent (sizes - i)."""
    return -(-percent * sizes // (100 + percent))


def prefix_length(n, percent: int):
    """So many of a set's rarest n-grams hold ``MORE`` + 1 of any linked set's, or all that they share."""
    return n - -(-percent * n // 100) + 1 + MORE


def _sets(batch: pa.RecordBatch, col: int, words: int) -> Iterator[np.ndarray]:
    for t in batch.column(col).to_pylist():
        yield np.unique(grams.gram_hashes(grams.word_hashes(t), words))


def frequency_sketch(docs: DataFrame, text: str, words: int, size: int = SKETCH) -> np.ndarray:
    """Occurrences of n-grams by hash bucket, over all documents: ``size`` numbers, added up by Spark."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b in batches:
            for s in _sets(b, 0, words):
                np.add.at(total, (s & np.uint64(size - 1)).astype(np.int64), 1)
        at = np.flatnonzero(total)
        for i in range(0, len(at), 1 << 16):
            part = at[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(total[part], pa.int64())], ["bucket", "n"])

    found = docs.select(text_of(text).cast("binary").alias("text")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    with few_texts(docs.sparkSession):
        found = found.toArrow()
    sketch = np.zeros(size, np.int64)
    sketch[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return np.minimum(sketch, np.iinfo(np.uint32).max).astype(np.uint32)


def _described(docs: DataFrame, text: str, words: int, percent: int) -> DataFrame:
    """Each row's set: its size n, a 128-bit digest (s1, s2), minhashes, and its rarest n-grams as ``prefix``."""
    sketch = docs.sparkSession.sparkContext.broadcast(frequency_sketch(docs, text, words))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rare = sketch.value
        for b in batches:
            n, s1, s2, mins, first = [], [], [], [], []
            for s in _sets(b, 2, words):
                n.append(len(s))
                with np.errstate(over="ignore"):
                    one, two = grams.mix(s), grams.mix(s ^ np.uint64(0x5851F42D4C957F2D))
                    s1.append(int(one.sum().view(np.int64)) if len(s) else 0)
                    s2.append(int(two.sum().view(np.int64)) if len(s) else 0)
                    mins.append([int(((one * m) >> np.uint64(1)).min()) for m in _MULT] if len(s) else [])
                order = np.lexsort((s, rare[(s & np.uint64(len(rare) - 1)).astype(np.int64)]))
                first.append(s[order[: prefix_length(len(s), percent)]].view(np.int64) if len(s) else s.view(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, first)]), pa.int32()), pa.array(np.concatenate([*first, np.empty(0, np.int64)]), pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(n, pa.int32()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(mins, pa.list_(pa.int64())), lists],
                ["doc_id", "text_hash", "n", "s1", "s2", "mins", "prefix"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64(text_of(text)).alias("text_hash"), text_of(text).cast("binary").alias("text"))
    out = rows.mapInArrow(describe, "doc_id long, text_hash long, n int, s1 long, s2 long, mins array<long>, prefix array<long>")
    return table_of_texts(out.withColumn("row", F.monotonically_increasing_id()), "sets")


def _whole_sets(docs: DataFrame, text: str, words: int, described: DataFrame, rows: DataFrame) -> DataFrame:
    """(row, set) of the asked ``rows`` of ``described``, made anew from the texts."""
    want = table(described.select("row", "doc_id", "text_hash").join(rows, "row"), "wanted")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [s.view(np.int64) for s in _sets(b, 1, words)]
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), pa.array(np.concatenate([*sets, np.empty(0, np.int64)]), pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], ["row", "set"])

    d = docs.select(F.col("doc_id").cast("long").alias("d"), F.xxhash64(text_of(text)).alias("h"), text_of(text).cast("binary").alias("text"))
    texts = d.join(small(want), F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("h") == F.col("text_hash"))).select("row", "text")
    return table_of_texts(texts.mapInArrow(make, "row long, set array<long>").dropDuplicates(["row"]), "whole-sets")


def _verified(docs: DataFrame, text: str, words: int, percent: int, described: DataFrame, pairs: DataFrame) -> DataFrame:
    """The ``pairs`` (a, b, rows of ``described``) that link, decided on whole sets."""
    sets = _whole_sets(docs, text, words, described, pairs.select(F.explode(F.array("a", "b")).alias("row")).distinct())
    left, right = sets.select(F.col("row").alias("a"), F.col("set").alias("sa")), sets.select(F.col("row").alias("b"), F.col("set").alias("sb"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b")
    overlap = F.size(F.array_intersect("sa", "sb"))
    return table(both.where((100 + percent) * overlap >= percent * (F.size("sa") + F.size("sb"))).select("a", "b"), "links")


def _unlinked(docs: DataFrame, text: str, words: int, percent: int, described: DataFrame, components: DataFrame, met: DataFrame) -> np.ndarray:
    """Of pairs of components that ``met`` (rows a, b of different ones), those that no link can join: sorted (p, q).

    What a set shares with one of another component it shares with the union of that component's sets. If no set of
    the one shares as much with the other's union as a link of these sizes takes, there is no link between them. That
    takes one count for each member, not one for each two members. A component of fewer than ``MANY`` sets costs no
    more rows than that for each set it meets and is left out; of the pairs, at most ``EXCLUDED`` are kept, the largest.
    """
    size = components.groupBy("component").agg(F.count("*").alias("members")).where(F.col("members") >= MANY)
    of = lambda x, c: components.join(size, "component").select(F.col("node").alias(x), F.col("component").alias(c), F.col("members").alias(f"{c}_members"))
    pairs = met.join(of("a", "p"), "a").join(of("b", "q"), "b").where("p <> q").select(F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q"), (F.col("p_members") * F.col("q_members")).alias("square")).distinct()
    pairs = table(pairs, "met")
    if pairs.isEmpty():
        return np.empty((0, 2), np.int64)
    ways = table(pairs.select(F.explode(F.array(F.struct("p", "q"), F.struct(F.col("q").alias("p"), F.col("p").alias("q")))).alias("w")).select("w.p", "w.q"), "ways")
    members = table(components.join(small(ways.select(F.col("p").alias("component")).distinct()), "component", "left_semi").select(F.col("node").alias("row"), F.col("component").alias("p")), "members")
    sets = _whole_sets(docs, text, words, described, members.select("row")).join(members, "row")
    sets = sets.select("row", "p", F.size("set").alias("n"), "set")
    union = table(sets.select(F.col("p").alias("q"), F.explode("set").alias("gram")).distinct(), "unions")
    least = sets.groupBy(F.col("p").alias("q")).agg(F.min("n").alias("least"))
    entries = sets.select("row", "p", "n", F.explode("set").alias("gram")).join(small(ways), "p")
    shared = entries.join(union, ["q", "gram"]).groupBy("row", "p", "q", "n").agg(F.count("*").alias("o")).join(least, "q")
    other = F.greatest("least", F.expr(f"({percent} * n + 99) div 100"))
    may = table(shared.where((100 + percent) * F.col("o") >= percent * (F.col("n") + other)).select("p", "q").distinct(), "may-link")
    both = may.join(may.select(F.col("q").alias("p"), F.col("p").alias("q")), ["p", "q"])
    none = pairs.join(both, ["p", "q"], "left_anti").orderBy(F.desc("square"), "p", "q").limit(EXCLUDED).toArrow()
    found = np.column_stack([none.column("p").to_numpy(), none.column("q").to_numpy()]).astype(np.int64)
    return found[np.lexsort((found[:, 1], found[:, 0]))]


def _shared(reps: DataFrame) -> DataFrame:
    """The prefixes' n-grams that stand in several prefixes: gram, c (prefixes), anchor (the least row among them, so
    that most of what near copies share has one anchor), row, n, at (place), before (such ones before it). One alone in its list is shared with no set that this one meets further on, so it counts for none."""
    entries = reps.select(F.posexplode("prefix").alias("at", "gram"), "row", "n")
    lists = table(entries.groupBy("gram").agg(F.count("*").alias("c"), F.min("row").alias("anchor")).where("c > 1"), "lists")
    before = F.row_number().over(Window.partitionBy("row").orderBy("at")) - 1
    return table(table(entries.join(lists, "gram"), "entries").withColumn("before", before), "shared")


def _minhash_keys(reps: DataFrame, shared: DataFrame, percent: int) -> DataFrame:
    """By which sets meet centres: row, typical, and for ``STARS`` minhashes (k, v) with the size's step.

    Typical is, the more so the less of its prefix a set has to itself, the text that others were edited from. Sizes
    count as alike within steps of half the ratio that a link allows, shifted by half a step for every other minhash.
    """
    step = F.floor(F.log("n") * (2 / math.log(100 / percent)) + F.col("k") % 2 / 2) if percent < 100 else F.col("n")
    typical = shared.groupBy("row").agg(F.count("*").alias("held"))
    of = reps.join(typical, "row").select("row", "n", "mins", (F.col("held") / F.size("prefix")).alias("typical"))
    return table(of.select("row", "n", "typical", F.posexplode(F.slice("mins", 1, STARS)).alias("k", "v")).select("row", "typical", "k", "v", step.alias("step")), "minhashes")


def _stars(reps: DataFrame, keys: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Pairs that join most near copies at once: each set of ``keys`` with the most typical one of about its size that
    shares a minhash, at most ``STARS`` pairs a set, so that their number is linear in any group of near copies; and
    the keys that several sets share, as no other can make a pair in a later round."""
    best = F.max(F.struct("typical", (-F.col("row")).alias("minus"))).alias("best")
    centres = keys.groupBy("k", "v", "step").agg(best, F.count("*").alias("c")).where("c > 1")
    centres = table(centres.select("k", "v", "step", (-F.col("best.minus")).alias("b")), "centres")
    shared = table(keys.join(centres, ["k", "v", "step"]), "shared-keys")
    pairs = shared.where("row <> b").select(F.col("row").alias("a"), "b").distinct()
    info = lambda x: reps.select(F.col("row").alias(x), F.col("n").alias(f"n{x}"), F.col("mins").alias(f"m{x}"))
    near = table(pairs, "star-pairs").join(info("a"), "a").join(info("b"), "b")
    same = F.size(F.filter(F.zip_with("ma", "mb", lambda x, y: x == y), lambda e: e))
    near = near.where((100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")) & (same >= AGREE)).select("a", "b")
    return table(near, "stars"), shared.drop("b")


class Excluded:
    """Pairs of components between which there is no link."""

    def __init__(self, pairs: np.ndarray):
        self.ids = np.unique(pairs)
        place = np.searchsorted(self.ids, pairs)
        self.codes = np.sort(place[:, 0] * len(self.ids) + place[:, 1])

    def __call__(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        if not len(self.codes):
            return np.zeros(np.broadcast(x, y).shape, bool)
        low, high = np.minimum(x, y), np.maximum(x, y)
        i, j = (np.minimum(np.searchsorted(self.ids, v), len(self.ids) - 1) for v in (low, high))
        code = i * len(self.ids) + j
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return (self.ids[i] == low) & (self.ids[j] == high) & (self.codes[at] == code)


def _pairs_of_lists(c: dict[str, np.ndarray], excluded: Excluded) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of entries that stand in one list, on different sides of it and in different components that may
    be linked.

    Short lists are paired all at once, place by place apart; in a long one, entries outside its commonest component
    are paired with all others, so that a list of near copies already joined costs no square.
    """
    size = len(c["row"])
    start = np.flatnonzero(np.concatenate(([True], (np.diff(c["gram"]) != 0) | (np.diff(c["tile"]) != 0))))
    ends = np.append(start[1:], size)
    mixed = np.minimum.reduceat(c["component"], start) != np.maximum.reduceat(c["component"], start)
    apart = lambda i, j: (c["component"][i] != c["component"][j]) & ((c["side"][i] != c["side"][j]) | (c["side"][i] < 0)) & ~excluded(c["component"][i], c["component"][j])
    short = mixed & (ends - start <= SHORT)
    last = np.repeat(np.where(short, ends, 0), ends - start)
    at = np.arange(size)
    for k in range(1, SHORT):
        at = at[at + k < last[at]]
        if not len(at):
            break
        ok = apart(at, at + k)
        yield at[ok], at[ok] + k
    for s, e in zip(start[mixed & ~short].tolist(), ends[mixed & ~short].tolist(), strict=True):
        kinds, often = np.unique(c["component"][s:e], return_counts=True)
        if len(kinds) <= SHORT and (excluded(kinds[:, None], kinds[None, :]) | np.eye(len(kinds), dtype=bool)).all():
            continue
        bulk = c["component"][s:e] == kinds[often.argmax()]
        few, rest = s + np.flatnonzero(~bulk), s + np.flatnonzero(bulk)
        step = max(1, PAIRS // (e - s))
        for f in range(0, len(few), step):
            part = few[f : f + step]
            i = np.concatenate([np.repeat(part, len(rest)), np.repeat(part, len(few))])
            j = np.concatenate([np.tile(rest, len(part)), np.tile(few, len(part))])
            ok = (~bulk[i - s] & bulk[j - s] | (i < j)) & apart(i, j)
            yield i[ok], j[ok]


def _multiplied(batches: Iterator[pa.RecordBatch], percent: int, best: bool, excluded: Excluded) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (anchor, tile, gram): one row (a, b, na, nb, c) for each pair of documents of different
    components that share ``c`` n-grams of a block, if sizes allow a link, each n-gram stands, in both, within the
    prefix that a link of these sizes must meet, and what can be shared before and after it suffices.

    With ``best`` only the pair that shares most, of such the smallest, is made of each two components that meet in a
    block. A block is what a batch holds of whole (anchor, tile) groups; of a group beyond ``HELD`` entries, whole
    lists at a time.
    """
    names = ["anchor", "tile", "side", "gram", "n", "at", "before", "row", "component"]

    def product(c: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        if len(c["row"]) < 2:
            return
        rows, first, own = np.unique(c["row"], return_index=True, return_inverse=True)
        sums, waiting, size = (np.empty(0, np.int64), np.empty(0, np.int64)), [], 0

        def added() -> tuple[np.ndarray, np.ndarray]:
            codes, n = np.unique(np.concatenate([sums[0], *waiting]), return_inverse=True)
            return codes, np.bincount(n, np.concatenate([sums[1], np.ones(size, np.int64)]), len(codes)).astype(np.int64)

        for i, j in _pairs_of_lists(c, excluded):
            small, large = np.minimum(c["n"][i], c["n"][j]), np.maximum(c["n"][i], c["n"][j])
            need = least_overlap(small.astype(np.int64) + large, percent)
            ok = 100 * small.astype(np.int64) >= percent * large
            ok &= np.minimum(c["before"][i], c["before"][j]) + np.minimum(c["n"][i] - c["at"][i], c["n"][j] - c["at"][j]) >= need
            ok &= (c["at"][i] - MORE <= c["n"][i] - need) & (c["at"][j] - MORE <= c["n"][j] - need)
            x, y = own[i[ok]], own[j[ok]]
            waiting.append(np.minimum(x, y).astype(np.int64) * len(rows) + np.maximum(x, y))
            size += len(x)
            if size > PAIRS:
                sums, waiting, size = added(), [], 0
        codes, n = added()
        a, b = codes // len(rows), codes % len(rows)
        if best and len(a):
            component = c["component"][first]
            low, high = np.minimum(component[a], component[b]), np.maximum(component[a], component[b])
            order = np.lexsort((c["n"][first][a] + c["n"][first][b], -n, high, low))
            new = np.ones(len(order), bool)
            new[1:] = (np.diff(low[order]) != 0) | (np.diff(high[order]) != 0)
            a, b, n = (v[order[new]] for v in (a, b, n))
        sizes = c["n"][first]
        for i in range(0, len(a), 1 << 16):
            x, y = a[i : i + (1 << 16)], b[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (rows[x], rows[y], sizes[x], sizes[y], n[i : i + (1 << 16)])], ["a", "b", "na", "nb", "c"])

    held: dict[str, np.ndarray] | None = None
    for b in batches:
        cols = {n: b.column(i).to_numpy(zero_copy_only=False) for i, n in enumerate(names)}
        cols = {n: np.concatenate([held[n], cols[n]]) for n in names} if held else cols
        last = (cols["anchor"] == cols["anchor"][-1]) & (cols["tile"] == cols["tile"][-1])
        if last.sum() > HELD:
            last &= cols["gram"] == cols["gram"][-1]
        cut = int(np.argmax(last))
        yield from product({n: v[:cut] for n, v in cols.items()})
        held = {n: v[cut:] for n, v in cols.items()}
    if held:
        yield from product(held)


def _tiles(shared: DataFrame, heavy: DataFrame, tile: int) -> DataFrame:
    """Entries with the tiles of their anchor's block in which they are multiplied.

    A block of at most ``tile`` entries is one tile. In a larger one, of ``heavy``, rows of its commonest component and
    the others are dealt into at most ``PARTS`` parts each, of ``tile`` entries or more; each part of the former meets
    each of the latter, and these meet each other. So the rows grow with a block, not with its square, and what two
    rows share in a block meets in one tile. A task holds at most about ``HELD`` entries of a tile at a time.
    """
    short = shared.join(small(heavy.select("anchor")), "anchor", "left_anti").withColumn("tile", F.lit(0).cast("long")).withColumn("side", F.lit(-1))
    long = shared.join(small(heavy), "anchor")
    by = long.groupBy("anchor", "component").agg(F.count("*").alias("k")).groupBy("anchor")
    bulk = table(by.agg(F.max(F.struct("k", "component")).alias("most"), F.count("*").alias("kinds")).where("kinds > 1"), "bulk")
    long = long.join(small(bulk.select("anchor", F.col("most.component").alias("bulk"), F.col("most.k").alias("k"))), "anchor")
    deal = lambda n: F.pmod(F.xxhash64("row"), n)
    parts = lambda n: F.least(F.greatest(F.ceil(n / tile), F.lit(1)), F.lit(PARTS))
    tiles, others = parts(F.col("k")), parts(F.col("held") - F.col("k"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    in_bulk = long.where("component = bulk").withColumn("tile", every(others)).withColumn("tile", 1 + deal(tiles) * others + F.col("tile")).withColumn("side", F.lit(1))
    few = long.where("component <> bulk")
    to_bulk = few.withColumn("tile", every(tiles)).withColumn("tile", 1 + F.col("tile") * others + deal(others)).withColumn("side", F.lit(0))
    own = few.withColumn("own", deal(others)).withColumn("other", every(others))
    name = -1 - (F.least("own", "other") * others + F.greatest("own", "other"))
    each = own.withColumn("tile", name).withColumn("side", F.when(F.col("own") == F.col("other"), -1).otherwise((F.col("own") > F.col("other")).cast("int")))
    columns = ["anchor", "tile", "side", "gram", "n", "at", "before", "row", "component"]
    return short.select(columns).unionByName(in_bulk.select(columns)).unionByName(to_bulk.select(columns)).unionByName(each.select(columns))


def _products(shared: DataFrame, heavy: DataFrame, components: DataFrame, percent: int, tile: int, best: bool = False, unlinked: np.ndarray | None = None) -> DataFrame:
    """Pairs of sets of different components that meet in a block, with what they share there; of each two components
    in a block, with ``best``, the closest only. Pairs of ``unlinked`` components are not made."""
    spark = shared.sparkSession
    pairs = spark.sparkContext.broadcast(np.empty((0, 2), np.int64) if unlinked is None else unlinked)
    shared = shared.join(components.select(F.col("node").alias("row"), "component"), "row", "left").withColumn("component", F.coalesce("component", "row"))
    shared = table(shared, "entries-of-components")
    sorted_ = _tiles(shared, heavy, tile).repartition(shuffle_width(spark), "anchor", "tile").sortWithinPartitions("anchor", "tile", "gram")
    return sorted_.mapInArrow(lambda batches: _multiplied(batches, percent, best, Excluded(pairs.value)), "a long, b long, na int, nb int, c long")


def _candidates(products: DataFrame, percent: int) -> DataFrame:
    """Pairs whose overlap within their prefixes, summed over blocks, allows a link."""
    counted = products.groupBy("a", "b", "na", "nb").agg(F.sum("c").alias("c"))
    need = F.expr(f"least({MORE} + 1, ({percent} * (na + nb) + {99 + percent}) div {100 + percent})")
    return table(counted.where(F.col("c") >= need).select("a", "b"), "candidates")


def jaccard_rows(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, text: str = "text", tile: int = TILE) -> DataFrame:
    """One row per document: doc_id, text_hash, n (size of its set), component_id, stays.

    ``component_id`` is the least doc_id reachable by links; one row of each component ``stays``, one with that id.
    A-Z is lower-cased; words are what white space separates; a set holds the distinct runs of ``words`` words, or
    the whole sequence where there are fewer. Sets link when 100 * intersection >= percent * union.

    The similarity matrix is the product of the document by n-gram incidence matrix with its transpose. Rows with
    equal sets are one row of it. N-grams are ordered from rare to frequent (by a sketch of fixed size) and each
    row keeps the prefix that any linked row must meet. A block holds all lists of n-grams whose least row is the
    same, large ones in tiles; it multiplies row pairs whose sizes allow a link and adds up their overlaps, so that
    one row for each pair leaves it; blocks' overlaps are summed, and pairs below the bound that sizes and prefixes
    set are discarded. What is left is decided on whole sets. Before the product, stars around minhash centres join
    near copies into components, round after round with new centres among sets that are still alone, until none joins;
    then a product that keeps, of each two components in a block, the closest pair joins what is left of them; both are
    decided on whole sets. Large components that met and were not joined are tested as wholes, each set against the
    other's union; the last product takes pairs of different components that may still be linked. A group of copies,
    or several that nearly link, thus cost rows in proportion to their size, and no link between components is lost.

    Sets are kept as 64-bit hashes. A null or blank text has no set, is its own component and stays; repeated rows
    share one; null doc_ids are members that lend no id (a component of nothing else has a null id). Texts of any
    length are taken whole; an empty table gives no rows; other columns of ``docs``, whatever their names, play no
    part.
    """
    d = _described(docs, text, words, percent)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    classes = d.where("n > 0").groupBy("n", "s1", "s2").agg(first.alias("first"))
    classes = table(classes.select("n", "s1", "s2", "first", F.col("first.row").alias("row")), "classes")
    reps = table(d.select("row", "n", "mins", "prefix").join(classes.select("row"), "row"), "representatives")

    shared = _shared(reps)
    heavy = table(shared.groupBy("anchor").agg(F.count("*").alias("held")).where(F.col("held") > tile), "heavy")

    def with_links(links: DataFrame, joined: DataFrame) -> DataFrame:
        return table(connected_components(links.unionByName(joined.select(F.col("node").alias("a"), F.col("component").alias("b")))), "joined")

    verified = lambda pairs: _verified(docs, text, words, percent, d, pairs)
    joined, keys = local(d.sparkSession, [], node=pa.int64(), component=pa.int64()), _minhash_keys(reps, shared, percent)
    while True:
        pairs, keys = _stars(reps, keys, percent)
        if (links := verified(pairs)).isEmpty():
            break
        joined = with_links(links, joined)
        keys = table(keys.join(joined.select(F.col("node").alias("row")), "row", "left_anti"), "alone")
    met = table(_products(shared, heavy, joined, percent, tile, best=True), "closest")
    joined = with_links(verified(_candidates(met, percent)), joined)
    unlinked = _unlinked(docs, text, words, percent, d, joined, met.select("a", "b"))
    whole = with_links(verified(_candidates(_products(shared, heavy, joined, percent, tile, unlinked=unlinked), percent)), joined)

    named = classes.join(whole.select(F.col("node").alias("row"), "component"), "row", "left").withColumn("component", F.coalesce("component", "row"))
    named = table(named, "named")
    least = table(named.groupBy("component").agg(F.min("first").alias("least")), "least")
    ids = named.join(least, "component").select("n", "s1", "s2", F.col("least.doc_id").alias("component_id"), F.col("least.row").alias("staying"))
    full = d.where("n > 0").select("doc_id", "text_hash", "n", "s1", "s2", "row").join(table(ids, "component-ids"), ["n", "s1", "s2"])
    full = full.select("doc_id", "text_hash", "n", "component_id", (F.col("row") == F.col("staying")).alias("stays"))
    none = d.where("n = 0").select("doc_id", "text_hash", "n", F.col("doc_id").alias("component_id"), F.lit(True).alias("stays"))
    return full.unionByName(none)


def one_of_each(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that stay, one of each component, with all their columns; rows with null or blank texts all
    stay. Columns of ``docs`` may have any names; texts are taken whole, however long; an empty table stays empty."""
    mine, hashed = free_names(docs, "id", "hash")
    found = jaccard_rows(docs, words, percent).groupBy(F.col("doc_id").alias(mine), F.col("text_hash").alias(hashed))
    found = table(found.agg(F.max("stays").alias("stays"), F.count("*").alias("times"), F.max("n").alias("n")), "decisions")
    key = [F.col(mine).eqNullSafe(F.col("doc_id").cast("long")), F.col(hashed) == F.xxhash64(text_of())]
    kept = docs.join(small(found.where("not stays").select(mine, hashed)), key, "left_anti")
    repeated = found.where("stays and times > 1 and n > 0").select(mine, hashed)
    if repeated.isEmpty():
        return kept
    repeated = small(repeated)
    return kept.join(repeated, key, "left_anti").unionByName(kept.join(repeated, key, "left_semi").dropDuplicates(["doc_id", "text"]))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of four words, linked from 85 % on."""
    return jaccard_rows(documents(spark, sf_dir), 4, 85).select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")


OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a, least(a, min(b)) AS c FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.c, d.doc_id) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.a = d.doc_id
"""

QUERIES = {"op6_jaccard_join": op6_jaccard_join}
SQL = {"op6_jaccard_join": OP6_SQL}
