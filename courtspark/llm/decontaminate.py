"""Training passages that repeat benchmark items, also edited ones."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import grams
from .common import TEXTS, documents, few_texts, text_of

#: Words of the shortest seed and of the longest; one between is as long as it takes for the run to be rare.
SHORT, SEED = 2, 4
#: A run is frequent if it stands at more than this part of as many places as there are texts, and between at least
#: ``NEIGHBOURS`` of 64 classes of neighbours, so that copies of one passage do not make its runs frequent.
FREQUENT, NEIGHBOURS = 0.001, 32
MATCH, MISMATCH, GAP = 2, -1, -1
#: A passage repeats an item if its alignment scores at least this part of the item's own, and at least as much as four
#: words with one edit (or as the whole item, if that is less).
THRESHOLD, LEAST = 0.5, 7
#: Benchmark words that one reading of the corpus carries along; larger benchmarks take several readings.
ITEM_WORDS = 2_000_000


def smith_waterman(item: np.ndarray, window: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment of two word sequences, linear gaps: (score, first, end) in ``window``.

    Rows follow the item. The best of gaps along a row is a running maximum, so each row is a few vector operations.
    The start of the best alignment rides along with every cell.
    """
    n = len(window)
    ramp = np.arange(n + 1) * -GAP
    score, start = np.zeros(n + 1, np.int64), np.arange(n + 1)
    best = (0, 0, 0)
    for w in item:
        step = score[:-1] + np.where(window == w, MATCH, MISMATCH)
        down = score[1:] + GAP
        cell, begin = np.zeros(n + 1, np.int64), np.arange(n + 1)
        take = (step >= down) & (step > 0)
        cell[1:][take], begin[1:][take] = step[take], start[:-1][take]
        take = (down > step) & (down > 0)
        cell[1:][take], begin[1:][take] = down[take], start[1:][take]
        lifted = cell + ramp
        peak = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == peak, np.arange(n + 1), 0))
        along = peak - ramp
        begin = np.where(along > cell, begin[source], begin)
        score, start = np.maximum(cell, along), begin
        j = int(score.argmax())
        if score[j] > best[0]:
            best = (int(score[j]), int(start[j]), j)
    return best


class Benchmark:
    """Items as word hashes, with their seeds sorted for lookup.

    At each place of an item the seed is its shortest run of ``SHORT`` words or more that is not ``frequent`` (sorted
    hashes by length), or the run of ``SEED`` words. An item shorter than that is one seed.
    """

    def __init__(self, items: list[tuple[int, np.ndarray]], frequent: dict[int, np.ndarray] | None = None):
        self.ids = [i for i, _ in items]
        self.words = [w for _, w in items]
        found: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        for k, w in enumerate(self.words):
            open_ = np.ones(len(w), bool)
            for n in range(SHORT if len(w) >= SEED else len(w), min(SEED, len(w)) + 1):
                runs = grams.gram_hashes(w, n)
                at = np.flatnonzero(open_[: len(runs)])
                if n < min(SEED, len(w)) and frequent and len(frequent.get(n, ())):
                    at = at[~_in(runs[at], frequent[n])]
                open_[at] = False
                found.setdefault(n, []).append((runs[at], np.full(len(at), k), at))
        #: By length: hashes in order, with item and place of each.
        self.seeds = {}
        for n, parts in sorted(found.items()):
            runs, item, place = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(runs, kind="stable")
            self.seeds[n] = runs[order], item[order], place[order]
        self.bags = [np.unique(w, return_counts=True) for w in self.words]

    def shared(self, i: int, window: np.ndarray) -> int:
        """Words that item ``i`` and a window have in common, repeats counted: no alignment matches more."""
        words, often = self.bags[i]
        at = np.searchsorted(words, window)
        at[at == len(words)] = 0
        return int(np.minimum(often, np.bincount(at[words[at] == window], minlength=len(words))).sum())

    def hits(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Items met by their seeds, and on which diagonal, each seed at each of its places; by item."""
        met = [(np.empty(0, np.int64), np.empty(0, np.int64))]
        for n, (seeds, item, place) in self.seeds.items():
            if n <= len(words):
                runs = grams.gram_hashes(words, n)
                low, high = np.searchsorted(seeds, runs, "left"), np.searchsorted(seeds, runs, "right")
                at = np.flatnonzero(high > low)
                often = high[at] - low[at]
                entry = np.repeat(low[at], often) + np.arange(often.sum()) - np.repeat(np.cumsum(often) - often, often)
                met.append((item[entry], np.repeat(at, often) - place[entry]))
        items, diagonals = (np.concatenate(x) for x in zip(*met, strict=True))
        order = np.argsort(items, kind="stable")
        return items[order], diagonals[order]


def _in(runs: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Which runs are among the sorted ones."""
    at = np.minimum(np.searchsorted(held, runs), len(held) - 1)
    return held[at] == runs


def _document_words(text: bytes) -> np.ndarray:
    return grams.word_hashes(text, grams.SIGNS)


def _windows(diagonals: np.ndarray, length: int, end: int) -> Iterator[tuple[int, int, int]]:
    """Stretches of a text of ``end`` words that an item can reach from its seeds, as (first, end, seeds).

    Diagonals within half an item of the next share a stretch. One longer than eight items is cut into such pieces,
    which overlap by two items and a few words: no alignment above the threshold is longer.
    """
    d = np.sort(diagonals)
    cuts = np.flatnonzero(np.diff(d) > max(4, length // 2)) + 1
    pad, piece, lap = 4 + length // 3, 8 * length + 16, 2 * length + 4
    for part in np.split(d, cuts):
        low, high = max(0, int(part[0]) - pad), min(end, int(part[-1]) + length + pad)
        while high - low > piece:
            yield low, low + piece, int(np.searchsorted(part, low + piece) - np.searchsorted(part, low - length))
            low += piece - lap
        yield low, high, int(len(part) - np.searchsorted(part, low - length))


def align(text: bytes, bench: Benchmark, threshold: float) -> list[tuple[int, int, float, int, int]]:
    """Passages of a text that repeat an item: (item, seeds, score, first word, end word), by item and place.

    Every seed shared with an item proposes a diagonal; the stretch around it is aligned with the item, and then what
    lies left and right of that alignment, until none passes. Stretches whose words in common with the item are too few
    for the threshold in any order are left out. Of an item's passages that overlap, the best stays, of equals the first.
    """
    words = _document_words(text)
    item, diagonal = bench.hits(words)
    found: list[tuple[int, int, float, int, int]] = []
    start = np.flatnonzero(np.diff(item, prepend=-1))
    for i, diagonals in zip(item[start].tolist(), np.split(diagonal, start[1:]), strict=False):
        own = bench.words[i]
        least = max(threshold * MATCH * len(own), min(LEAST, MATCH * len(own)))
        passages: set[tuple[float, int, int, int]] = set()
        for first, end, seeds in _windows(diagonals, len(own), len(words)):
            left = [(first, end)]
            while left:
                low, high = left.pop()
                if MATCH * bench.shared(i, words[low:high]) < least:
                    continue
                score, begin, stop = smith_waterman(own, words[low:high])
                if score >= least:
                    passages.add((-score / (MATCH * len(own)), low + begin, low + stop, seeds))
                    left += [(low, low + begin), (low + stop, high)]
        kept: list[tuple[int, int]] = []
        best: list[tuple[int, int, float, int, int]] = []
        for share, begin, stop, seeds in sorted(passages):
            k = bisect_left(kept, (begin, stop))
            if (k == 0 or kept[k - 1][1] <= begin) and (k == len(kept) or stop <= kept[k][0]):
                insort(kept, (begin, stop))
                best.append((bench.ids[i], seeds, -share, begin, stop))
        found += sorted(best, key=lambda m: m[3])
    return found


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """One row per passage that repeats an item: doc_id, item_id, n_seeds, score, first_word, end_word.

    Texts and items are compared by words (runs of digits, letters and what lies outside ASCII, A-Z lower-cased).
    Runs of words are counted over all texts; at each place of an item its shortest rare run, of two to ``SEED`` words,
    is the seed, and where all are frequent the run of ``SEED``. Every text that shares a seed with an item is aligned
    with it by Smith-Waterman; ``score`` is the alignment's part of the item's full score. Items of fewer than ``SEED``
    words are searched as they are, one seed each. Benchmarks beyond ``ITEM_WORDS`` words are taken in blocks, each with
    readings of its own, so a task holds one block and one text. Null texts count as empty and match nothing, as do
    items without words; repeated rows are reported each; empty tables of either kind give no rows; other columns of
    ``docs`` play no part; texts are searched whole, however long. Passages that tie are reported each, unless they
    overlap.

    Rare runs of two words meet every alignment above the threshold whose edits replace or drop words: an item of n
    words passes with n/3 of them at most, and then two matching words stand side by side. Not met are items whose
    runs left by the edits are all frequent and shorter than ``SEED``, or single words between inserted ones.
    """
    rows = docs.select(F.col("doc_id").cast("long"), text_of(text).cast("binary").alias("text"))
    kind = "doc_id long, item_id long, n_seeds long, score double, first_word long, end_word long"
    found = [rows.mapInArrow(_aligner(held, threshold), kind) for held in _readings(rows.select("text"), benchmark)]
    return reduce(DataFrame.unionByName, found) if found else rows.sparkSession.createDataFrame([], kind)


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that repeat no item, with all their columns; rows with null or empty texts stay."""
    for held in _readings(docs.select(text_of(text).cast("binary").alias("text")), benchmark):
        docs = docs.where(~_repeats(held, threshold)(text_of(text).cast("binary")))
    return docs


def _repeats(held, threshold: float):
    @F.arrow_udf("boolean")
    def repeats(texts: pa.Array) -> pa.Array:
        return pa.array([bool(align(t, held.value, threshold)) for i in range(0, len(texts), TEXTS) for t in texts[i : i + TEXTS].to_pylist()], pa.bool_())

    return repeats


def _readings(texts: DataFrame, benchmark: DataFrame) -> Iterator:
    """Block by block of the benchmark, a broadcast of its items with the seeds that are rare in ``texts``."""
    for block in _blocks(benchmark):
        yield texts.sparkSession.sparkContext.broadcast(Benchmark(block, _frequent(texts, block)))


def _joined(texts: list[bytes], most: int = 500_000) -> Iterator[np.ndarray]:
    """The words of several texts in a row, up to about ``most`` of them at once, with a word of none between and around."""
    edge, held, size = np.array([1], np.uint64), [], 0
    for t in texts:
        held += [edge, _document_words(t)]
        size += len(held[-1])
        if size >= most:
            yield np.concatenate([*held, edge, edge])
            held, size = [], 0
    if size:
        yield np.concatenate([*held, edge, edge])


def _frequent(texts: DataFrame, block: list[tuple[int, np.ndarray]]) -> dict[int, np.ndarray]:
    """The block's runs below ``SEED`` words that are frequent in the texts, by length, sorted.

    A task counts into arrays as long as the block's runs: places, and a bit for each class of neighbours (the words
    before and after). Spark adds them up; the driver gets runs with many neighbours, at most two a word of the block.
    """
    long = [w for _, w in block if len(w) >= SEED]
    if not long:
        return {}
    runs = {n: np.unique(np.concatenate([grams.gram_hashes(w, n) for w in long])) for n in range(SHORT, SEED)}
    held = texts.sparkSession.sparkContext.broadcast(runs)
    names, kinds = ["n", "run", "places", "beside"], [pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = {n: np.zeros(len(r), np.int64) for n, r in held.value.items()}
        beside = {n: np.zeros(len(r), np.uint64) for n, r in held.value.items()}
        read = 0
        for b in batches:
            read += b.num_rows
            for words in _joined(b.column(0).to_pylist()):
                for n, known in held.value.items():
                    own = grams.gram_hashes(words[1:-1], n)
                    place = np.minimum(np.searchsorted(known, own), len(known) - 1)
                    at = np.flatnonzero(known[place] == own)
                    side = grams.mix(words[at] * np.uint64(3) + words[at + n + 1]) & np.uint64(63)
                    np.add.at(places[n], place[at], 1)
                    np.bitwise_or.at(beside[n], place[at], np.uint64(1) << side)
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((0, 0, read, -1), kinds, strict=True)], names)
        for n in places:
            for i in range(0, len(places[n]), 50_000):
                at = i + np.flatnonzero(places[n][i : i + 50_000])
                cols = (np.full(len(at), n), at, places[n][at], beside[n][at].view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    counted = texts.mapInArrow(count, "n int, run long, places long, beside long").groupBy("n", "run")
    counted = counted.agg(F.sum("places").alias("places"), F.bit_count(F.bit_or("beside")).alias("beside"))
    with few_texts(texts.sparkSession):
        many = counted.where(F.col("beside") >= NEIGHBOURS).select("n", "run", "places").toPandas()
    texts_read = many.loc[many["n"] == 0, "places"].sum()
    many = many[many["places"] > FREQUENT * texts_read]
    return {n: r[np.sort(many.loc[many["n"] == n, "run"].to_numpy(np.int64))] for n, r in runs.items()}


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, np.ndarray]]]:
    """The benchmark's items, streamed to the driver and cut into blocks of about ``ITEM_WORDS`` words."""
    block: list[tuple[int, np.ndarray]] = []
    size = 0
    for r in benchmark.select(F.col("item_id").cast("long"), text_of().cast("binary").alias("text")).toLocalIterator():
        words = _document_words(bytes(r["text"]))
        if len(words):
            block.append((r["item_id"], words))
            size += len(words)
        if size >= ITEM_WORDS:
            yield block
            block, size = [], 0
    if block:
        yield block


def _aligner(held, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench = held.value
        names = ["doc_id", "item_id", "n_seeds", "score", "first_word", "end_word"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
        for b in batches:
            found = [(d, *m) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for m in align(t, bench, threshold)]
            cols = list(zip(*found, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    return run


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All passages of all documents that repeat a benchmark item."""
    return decontaminate(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {"op8_decontamination": op8_decontamination}
SQL: dict[str, str] = {}
