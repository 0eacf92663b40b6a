"""Removal of repeated byte strings by suffix sorting with a difference cover."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, small, table, text_of
from .grams import mix
from .membership import may_hold, membership

LENGTH = 200
#: Texts are scanned together up to BUFFER bytes; longer ones in slices of that many starts.
BUFFER = 1 << 16
#: A task sorts suffixes of about CHUNK bytes at once. Symbols and ranks have BITS bits, so CHUNK and one group must
#: stay below 1 << BITS. A group of more than GROUP stretches is not sorted in one task.
CHUNK, BITS, GROUP = 1 << 20, 21, 2048
#: Hashes held before a task hands their counts on, and stretches whose bytes a task remembers to have sent.
HASHES, SENT = 1 << 20, 200_000
_ODD = 0x9E3779B97F4A7C15
_PLACE = np.uint64((1 << 20) - 1)


def _gram_hashes(raw: np.ndarray, gram: int) -> np.ndarray:
    """Hashes of all runs of ``gram`` bytes, put together from runs of powers of two."""
    power, size, total, width = raw.astype(np.uint64) + np.uint64(1), 1, None, 0
    with np.errstate(over="ignore"):
        while True:
            factor = np.uint64(pow(_ODD, size, 1 << 64))
            if gram & size:
                n = len(raw) - width - size + 1
                total = power[:n] if total is None else total[:n] * factor + power[width : width + n]
                width += size
            if 2 * size > gram:
                return mix(total)
            n = len(raw) - 2 * size + 1
            power = power[:n] * factor + power[size : size + n]
            size *= 2


def _window_least(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return x if size == width else np.minimum(x[: len(x) - (width - size)], x[width - size :])


def anchored(raw: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of starts of ``length``-byte strings with one anchor: first start, number of starts, the anchor's hash.

    A string's anchor is the half-length run in it with the least hash, the first of equals: equal strings have equal
    anchors at the same place in them. Strings lie within one text; ``ends`` are the texts' ends in ``raw``.
    """
    gram = max(length // 2, 1)
    if len(raw) < length:
        return (np.empty(0, np.int64),) * 2 + (np.empty(0, np.uint64),)
    h = _gram_hashes(raw, gram)
    at = (_window_least((h & ~_PLACE) | np.arange(len(h), dtype=np.uint64), length - gram + 1) & _PLACE).astype(np.int64)
    begins = np.concatenate(([0], ends[:-1]))
    inside = np.zeros(len(raw) + 1, np.int64)
    np.add.at(inside, begins, 1)
    np.add.at(inside, np.maximum(ends - length + 1, begins), -1)
    at[np.cumsum(inside)[: len(at)] == 0] = -1
    first = np.flatnonzero(np.diff(at, prepend=-2))
    n = np.diff(np.append(first, len(at)))
    held = at[first] >= 0
    return first[held], n[held], h[at[first[held]]]


def _scanned(texts: list[bytes], length: int) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """All texts in buffers: the bytes, then for each run its text's number, its place there and in the buffer, its
    starts, and its anchor's hash."""
    held: list[tuple[int, int, bytes]] = []
    size = 0

    def out():
        raw = b"".join(t for _, _, t in held)
        ends = np.cumsum([len(t) for _, _, t in held])
        first, n, h = anchored(np.frombuffer(raw, np.uint8), ends, length)
        of = np.searchsorted(ends, first, "right")
        begins = np.concatenate(([0], ends[:-1]))
        row, base = np.array([k for k, _, _ in held])[of], np.array([i for _, i, _ in held])[of]
        held.clear()
        return raw, row, base + first - begins[of], first, n, h

    for k, t in enumerate(texts):
        for i in range(0, len(t) - length + 1, BUFFER):
            held.append((k, i, t[i : i + BUFFER + length - 1]))
            size += len(held[-1][2])
            if size >= BUFFER:
                yield out()
                size = 0
    if held:
        yield out()


def _anchor_counts(texts: DataFrame, length: int) -> DataFrame:
    """How many runs each anchor's hash has in all documents: h, n."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def out() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate([*held, np.empty(0, np.uint64)]), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n, pa.int64())], ["h", "n"])

        for b in batches:
            for *_, h in _scanned(b.column(1).to_pylist(), length):
                held.append(h)
                size += len(h)
                if size > HASHES:
                    yield out()
                    size = 0
        yield out()

    return texts.mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def _stretches(texts: DataFrame, repeated: np.ndarray, length: int) -> DataFrame:
    """The runs whose anchor may stand elsewhere: h, digest (d1, d2) of their bytes, key of the text, place, starts,
    and the bytes, null where the task has sent the same before."""
    held = texts.sparkSession.sparkContext.broadcast(repeated)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        for b in batches:
            for raw, row, place, first, n, h in _scanned(b.column(1).to_pylist(), length):
                mine = np.flatnonzero(may_hold(held.value, h))
                if not len(mine):
                    continue
                digests, contents = [], []
                for a, z in zip(first[mine].tolist(), (first + n + length - 1)[mine].tolist(), strict=True):
                    content = raw[a:z]
                    d = xxhash.xxh3_128_intdigest(content)
                    digests.append(d)
                    contents.append(None if d in sent else content)
                    sent.add(d)
                if len(sent) > SENT:
                    sent.clear()
                d = np.frombuffer(b"".join(x.to_bytes(16, "little") for x in digests), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[mine].view(np.int64)), pa.array(d[:, 0]), pa.array(d[:, 1]), b.column(0).take(pa.array(row[mine])), pa.array(place[mine], pa.int64()), pa.array(n[mine], pa.int32()), pa.array(contents, pa.binary())],
                    ["h", "d1", "d2", "key", "place", "n", "content"],
                )

    return table(texts.mapInArrow(find, "h long, d1 long, d2 long, key binary, place long, n int, content binary"), "stretches")


def suffix_order(s: np.ndarray) -> np.ndarray:
    """Suffixes of symbols (from 1, of fewer than ``BITS`` bits) in order, by a difference cover modulo three.

    Suffixes at places 1 and 2 modulo 3 are the sample: their triples are sorted into names, and where names repeat,
    the string of names is sorted the same way. The others follow from their first symbol and the next one's rank.
    They are merged by counting, for each, the sampled suffixes below it: a pair of symbol and rank compares with
    places 1, two symbols and a rank with places 2.
    """
    n, one = len(s), np.uint64(BITS)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    t = np.concatenate((s, [0, 0, 0])).astype(np.uint64)
    first, second = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.concatenate((first, second))
    triples = (((t[sample] << one) | t[sample + 1]) << one) | t[sample + 2]
    names, name = np.unique(triples, return_inverse=True)
    if len(names) < len(sample):
        order = suffix_order(name + 1)
    else:
        order = np.empty(len(sample), np.int64)
        order[name] = np.arange(len(sample))
    sampled = sample[order]
    rank = np.zeros(n + 3, np.uint64)
    rank[sampled] = np.arange(1, len(sampled) + 1, dtype=np.uint64)
    sampled = sampled[sampled < n]

    pair = lambda i: (t[i] << one) | rank[i + 1]
    triple = lambda i: (((t[i] << one) | t[i + 1]) << one) | rank[i + 2]
    rest = np.arange(0, n, 3)
    rest = rest[np.argsort(pair(rest), kind="stable")]
    below = np.searchsorted(pair(sampled[sampled % 3 == 1]), pair(rest)) + np.searchsorted(triple(sampled[sampled % 3 == 2]), triple(rest))
    out, at = np.empty(n, np.int64), below + np.arange(len(rest))
    out[at] = rest
    free = np.ones(n, bool)
    free[at] = False
    out[free] = sampled
    return out


def repeated_starts(contents: list[bytes], length: int) -> list[np.ndarray]:
    """For each stretch the starts whose ``length`` bytes stand at another start of any stretch too."""
    raw = np.frombuffer(b"".join(contents), np.uint8)
    sizes = np.array([len(c) for c in contents])
    begins = np.cumsum(sizes) - sizes
    starts = sizes - length + 1
    is_start = np.zeros(len(raw), bool)
    for a, k in zip(begins.tolist(), starts.tolist(), strict=True):
        is_start[a : a + k] = True
    order = suffix_order(raw.astype(np.int64) + 1)
    order = order[is_start[order]]
    left, right, alike = order[:-1], order[1:], np.arange(max(len(order) - 1, 0))
    eight = np.ndarray(max(len(raw) - 7, 0), np.uint64, raw.tobytes(), strides=(1,))
    for at in [*range(0, length - 7, 8), *range(length - length % 8, length)]:
        symbols = eight if at + 8 <= length else raw
        alike = alike[symbols[left[alike] + at] == symbols[right[alike] + at]]
    hit = np.zeros(len(raw), bool)
    hit[left[alike]] = hit[right[alike]] = True
    return [np.flatnonzero(hit[a : a + k]) for a, k in zip(begins.tolist(), starts.tolist(), strict=True)]


def _spans(starts: np.ndarray, length: int) -> list[int]:
    """The bytes covered by strings at ``starts``: from, to, from, to, ..."""
    cut = np.flatnonzero(np.diff(starts) > length)
    return np.column_stack((starts[np.concatenate(([0], cut + 1))], starts[np.append(cut, len(starts) - 1)] + length)).ravel().tolist()


def _sorted_groups(contexts: DataFrame, length: int) -> DataFrame:
    """d1, d2 and spans of lone stretches, from suffix sorts of whole groups of one anchor."""

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk: list[tuple] = []
        group: list[tuple] = []
        size, anchor = 0, None

        def out() -> pa.RecordBatch:
            found = repeated_starts([c for *_, c in chunk], length)
            rows = [(d1, d2, _spans(at, length)) for (d1, d2, copies, _), at in zip(chunk, found, strict=True) if copies == 1 and len(at)]
            chunk.clear()
            columns = list(zip(*rows, strict=True)) or [[], [], []]
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.list_(pa.int32()))], ["d1", "d2", "spans"])

        def close() -> None:
            nonlocal size
            if len(group) > 1 and any(copies == 1 for _, _, copies, _ in group):
                chunk.extend(group)
                size += sum(len(c) for *_, c in group)
            group.clear()

        for b in batches:
            for h, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if h != anchor:
                    close()
                    anchor = h
                    if size >= CHUNK:
                        yield out()
                        size = 0
                group.append(tuple(row))
        close()
        if chunk:
            yield out()

    rows = contexts.select("h", "d1", "d2", "copies", "content").repartition("h").sortWithinPartitions("h")
    return rows.mapInArrow(sort, "d1 long, d2 long, spans array<int>")


def _spread_groups(contexts: DataFrame, length: int) -> DataFrame:
    """The same for stretches of groups too large for a task: every string goes by its 128-bit digest."""

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d1, d2, copies, content in zip(*(c.to_pylist() for c in b.columns), strict=True):
                k = len(content) - length + 1
                d = np.frombuffer(b"".join(xxhash.xxh3_128_digest(content[i : i + length]) for i in range(k)), np.int64).reshape(-1, 2)
                same = lambda v, t: pa.array(np.full(k, v), t)
                yield pa.RecordBatch.from_arrays([same(d1, pa.int64()), same(d2, pa.int64()), same(copies, pa.int64()), pa.array(range(k), pa.int32()), pa.array(d[:, 0]), pa.array(d[:, 1])], ["d1", "d2", "copies", "at", "s1", "s2"])

    rows = contexts.select("d1", "d2", "copies", "content").mapInArrow(strings, "d1 long, d2 long, copies long, at int, s1 long, s2 long")
    rows = table(rows, "strings")
    twice = table(rows.groupBy("s1", "s2").agg(F.sum("copies").alias("c")).where("c > 1").select("s1", "s2"), "twice")
    hit = table(rows.where("copies = 1").join(twice, ["s1", "s2"]).select("d1", "d2", "at"), "hits")
    starts = hit.groupBy("d1", "d2").agg(F.array_sort(F.collect_list("at")).alias("starts"))  # at most a stretch's starts
    return starts.select("d1", "d2", F.flatten(F.transform("starts", lambda i: F.array(i, i + length))).cast("array<int>").alias("spans"))


def repeats(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """Bytes of ``texts`` (key, text) covered by strings of ``length`` bytes that start anywhere else too: key, and
    pieces (place, spans from there), in no order and with overlaps.

    1. Every string has an anchor in it, chosen by content. Strings whose anchor stands nowhere else are passed over:
       a filter of bounded size tells them in the second reading. What more it lets through is sorted out below.
    2. The strings left are stretches: runs of starts with one anchor, at most 1.5 times ``length`` bytes each. Equal
       stretches are counted and go on as one; all their strings are repeated.
    3. Different stretches with one anchor may share strings. Such groups are suffix-sorted whole, many in a task, and
       neighbours in the order are compared. Groups of more than ``GROUP`` stretches are spread by string.
    """
    counts = _anchor_counts(texts, length)
    repeated = table(counts.where("n > 1").select("h"), "anchors")
    found = _stretches(texts, membership(repeated, "h"), length)
    contexts = found.groupBy("d1", "d2").agg(F.max("h").alias("h"), F.count("*").alias("copies"), F.max("n").alias("n"), F.max("content").alias("content"))
    contexts = table(contexts, "contexts")
    large = table(contexts.groupBy("h").count().where(F.col("count") > GROUP).select("h"), "large")
    spans = contexts.where("copies > 1").select("d1", "d2", F.array(F.lit(0), (F.col("n") + length - 1).cast("int")).alias("spans"))
    if large.isEmpty():
        spans = spans.unionByName(_sorted_groups(contexts, length))
    else:
        large = small(large)
        spans = spans.unionByName(_sorted_groups(contexts.join(large, "h", "left_anti"), length)).unionByName(_spread_groups(contexts.join(large, "h", "left_semi"), length))
    spans = table(spans, "spans")
    pieces = found.select("d1", "d2", "key", "place").join(spans, ["d1", "d2"])
    return pieces.groupBy("key").agg(F.collect_list(F.struct("place", "spans")).alias("pieces"))  # one text's own pieces


def _merged(pieces: list[dict]) -> list[tuple[int, int]]:
    """Sorted spans of a text that neither meet nor overlap."""
    all_ = sorted((p["place"] + a, p["place"] + z) for p in pieces for a, z in zip(p["spans"][::2], p["spans"][1::2], strict=True))
    out: list[tuple[int, int]] = []
    for a, z in all_:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], z))
        else:
            out.append((a, z))
    return out


def suffix_dedup(docs: DataFrame, text: str = "text", length: int = LENGTH) -> DataFrame:
    """One row per document: doc_id, kept (the remaining bytes, joined), removed (spans as from, to), n_bytes.

    Each byte covered by a string of ``length`` bytes that also starts anywhere else in any document goes, all
    occurrences alike; strings never cross documents and are judged on the input. Null texts count as empty; texts
    shorter than ``length`` stay whole; repeated rows repeat each other's bytes and lose them; null ids are kept; long
    texts are scanned whole, in slices; other columns play no part; an empty table gives no rows.
    """
    raw = text_of(text).cast("binary")
    key = F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"), F.lit("|").cast("binary"), raw)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("key"), raw.alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, spans = [], []
            for t, pieces in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                gone = _merged(pieces or [])
                edges = [0, *(x for span in gone for x in span), len(t)]
                kept.append(b"".join(t[a:z] for a, z in zip(edges[::2], edges[1::2], strict=True)))
                spans.append([{"from": a, "to": z} for a, z in gone])
            kind = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(kept, pa.binary()), pa.array(spans, kind), pa.array([len(t) for t in b.column(1).to_pylist()], pa.int64())], ["doc_id", "kept", "removed", "n_bytes"])

    joined = rows.join(repeats(rows.select("key", "text"), length), "key", "left").select("doc_id", "text", "pieces")
    return joined.mapInArrow(cut, "doc_id long, kept binary, removed array<struct<from: long, to: long>>, n_bytes long")


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without their strings of 200 bytes that stand elsewhere too."""
    done = suffix_dedup(documents(spark, sf_dir))
    return done.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op12_suffix_dedup": op12_suffix_dedup}
SQL: dict[str, str] = {}
