"""Phrase collocations: pairs of frequency-ranked ids counted in direct-address tiles, level by level."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, local, table, text_of
from .grams import mix
from .membership import may_hold, membership

LEAST, LONGEST, TOP, INSIDE = 10, 3, 2000, 50
#: So many of the most frequent words, and of the phrases of each length, go by rank; the others by hash.
RANKS = 1 << 18
#: A tile is EDGE x EDGE pairs of ranks. In one flush of HELD pairs a tile of at least DENSE is counted by address.
EDGE, DENSE, HELD = 1 << 10, 1 << 16, 1 << 18
#: Texts of one language are scanned together up to BUFFER bytes; hashes are made in pieces; words in this number are
#: held before a task hands its counts on; longer words than LONG bytes are hashed one by one.
BUFFER, PIECE, WORDS, LONG = 1 << 19, 1 << 19, 100_000, 256
LEADING = 19
_MASK = (1 << 64) - 1
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_BREAK = np.isin(np.arange(256), list(b".,;:!?\n\x0b\x0c\r"))
_APART = _BREAK | np.isin(np.arange(256), list(b" \t"))


class Level(NamedTuple):
    """The frequent phrases of one length: keys of those that go by rank, sorted, with a greatest one behind them,
    where the keys of each leading ``LEADING`` bits start, their ranks; the word codes of each rank; and a filter of
    the others' keys."""

    keys: np.ndarray
    starts: np.ndarray
    ranks: np.ndarray
    words: list[np.ndarray]
    others: np.ndarray


@cache
def _powers(seed: int) -> tuple[np.ndarray, np.ndarray]:
    odd = (0x9E3779B97F4A7C15 * (2 * seed + 1)) & _MASK | 1
    return tuple(np.concatenate(([np.uint64(1)], np.cumprod(np.full(PIECE, x, np.uint64)))) for x in (odd, pow(odd, -1, 1 << 64)))


def words_of(text: bytes, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of a lower-cased text: 64-bit hashes, starts, ends, and the number of the piece that each stands in."""
    raw = np.frombuffer(text, np.uint8)
    apart = _APART[raw]
    edge = np.flatnonzero(np.diff(~apart, prepend=False, append=False))
    start, end = edge[::2], edge[1::2]
    piece = np.cumsum(_BREAK[raw], dtype=np.int32)[start] if len(start) else np.empty(0, np.int64)
    h = np.empty(len(start), np.uint64)
    up, down = _powers(seed)
    lo = 0
    while lo < len(start):
        hi = max(int(np.searchsorted(end, start[lo] + PIECE, "right")), lo + 1)
        a, b = start[lo:hi], end[lo:hi]
        if b[-1] - a[0] <= PIECE:
            codes = raw[a[0] : b[-1]].astype(np.uint64) + np.uint64(1)
            sums = np.concatenate(([np.uint64(0)], np.cumsum(codes * up[: len(codes)], dtype=np.uint64)))
            h[lo:hi] = mix((sums[b - a[0]] - sums[a - a[0]]) * down[a - a[0]] + (b - a).astype(np.uint64))
        for k in lo + np.flatnonzero(b - a > LONG):
            h[k] = xxhash.xxh64_intdigest(text[start[k] : end[k]], seed)
        lo = hi
    return h, start, end, piece


def _by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    """Whole texts of one language, lower-cased, a line end between any two."""
    held: dict[str, list[bytes]] = {}
    size: dict[str, int] = {}
    for b in (b.slice(i, 256) for b in batches for i in range(0, b.num_rows, 256)):
        for lang, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            held.setdefault(lang, []).append(t)
            size[lang] = size.get(lang, 0) + len(t)
            if size[lang] >= BUFFER:
                yield lang, b"\n".join(held.pop(lang)).translate(_LOWER)
                size[lang] = 0
    for lang, texts in held.items():
        yield lang, b"\n".join(texts).translate(_LOWER)


def _keys(h: np.ndarray, lang: str, seed: int) -> np.ndarray:
    """63-bit keys of a language's words."""
    return mix(h + np.uint64(xxhash.xxh64_intdigest(lang, seed))) >> np.uint64(1)


def _texts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), text_of(text).cast("binary").alias("text"))


def vocabulary(texts: DataFrame) -> tuple[DataFrame, int]:
    """Every word of every language with its count (key, lang, word, n), and the seed under which no two share a key."""
    for seed in range(64):

        def count(batches: Iterator[pa.RecordBatch], seed: int = seed) -> Iterator[pa.RecordBatch]:
            held: dict[tuple[str, int], list] = {}

            def out() -> Iterator[pa.RecordBatch]:
                rows = list(held.items())
                held.clear()
                for i in range(0, len(rows), 1 << 16):
                    part = rows[i : i + (1 << 16)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([k for (_, k), _ in part], pa.int64()), pa.array([g for (g, _), _ in part]), pa.array([w.decode() for _, (_, w) in part], pa.string()), pa.array([n for _, (n, _) in part], pa.int64())],
                        ["key", "lang", "word", "n"],
                    )

            for lang, text in _by_language(batches):
                h, start, end, _ = words_of(text, seed)
                found, at, n = np.unique(_keys(h, lang, seed), return_index=True, return_counts=True)
                for k, i, m in zip(found.tolist(), at.tolist(), n.tolist(), strict=True):
                    if (old := held.get((lang, k))) is None:
                        held[lang, k] = [m, text[start[i] : end[i]]]
                    else:
                        old[0] += m
                if len(held) > WORDS:
                    yield from out()
            yield from out()

        rows = texts.mapInArrow(count, "key long, lang string, word string, n long")
        words = table(rows.groupBy("key", "lang", "word").agg(F.sum("n").alias("n")), "vocabulary")
        if words.groupBy("key").count().where("count > 1").isEmpty():
            return words, seed
    raise ArithmeticError("no seed keeps the words apart")


def _level(frequent: DataFrame, codes: list[str]) -> Level:
    """Rank the rows (key, n and word codes) by n: those above the least n that at most RANKS reach go by rank."""
    steps = frequent.groupBy(F.least("n", F.lit(100_000)).alias("n")).count().orderBy(F.desc("n")).toArrow()
    total = np.cumsum(steps.column("count").to_numpy())
    fit = int(np.searchsorted(total, RANKS, "right"))
    least = int(steps.column("n")[fit - 1].as_py()) if fit else _MASK >> 1
    top = frequent.where(F.col("n") >= least).select("key", "n", *codes).toArrow()
    key, n = top.column("key").to_numpy(), top.column("n").to_numpy()
    order = np.lexsort((key, -n))
    by_key = np.argsort(key[order])
    keys = key[order][by_key].view(np.uint64)
    starts = np.searchsorted(keys, np.arange(1 << LEADING, dtype=np.uint64) << np.uint64(63 - LEADING))
    return Level(np.append(keys, np.uint64(_MASK)), starts, by_key.astype(np.int64), [top.column(c).to_numpy()[order] for c in codes], membership(frequent.where(F.col("n") < least), "key"))


def _coded(level: Level, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of keys: the rank, else the key below zero; and whether the phrase may be frequent."""
    at = level.starts[keys >> np.uint64(63 - LEADING)]
    behind = np.flatnonzero(level.keys[at] < keys)
    while len(behind):
        at[behind] += 1
        behind = behind[level.keys[at[behind]] < keys[behind]]
    ranked = level.keys[at] == keys
    code = ~keys.view(np.int64)
    code[ranked] = level.ranks[at[ranked]]
    return code, ranked | may_hold(level.others, keys)


def phrase_keys(first: np.ndarray, word: np.ndarray) -> np.ndarray:
    """63-bit keys of phrases, from the codes of all words but the last, and of the last."""
    return mix(mix(first.view(np.uint64)) * np.uint64(3) + word.view(np.uint64)) >> np.uint64(1)


def tile_counts(first: np.ndarray, word: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Distinct pairs of ranks with their counts. A tile that holds many is counted by address in one dense bincount;
    what lies in thinly filled tiles is sorted and counted by runs."""
    across = RANKS // EDGE + 1
    tile = (first // EDGE) * across + word // EDGE
    full = np.bincount(tile, minlength=across * across) >= DENSE
    for t in np.flatnonzero(full):
        mine = tile == t
        cells = np.bincount((first[mine] % EDGE) * EDGE + word[mine] % EDGE, minlength=EDGE * EDGE)
        at = np.flatnonzero(cells)
        yield t // across * EDGE + at // EDGE, t % across * EDGE + at % EDGE, cells[at]
    thin = ~full[tile]
    pairs, n = np.unique(first[thin] * RANKS + word[thin], return_counts=True)
    yield pairs // RANKS, pairs % RANKS, n


def _runs(columns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of some columns with their counts, by sorting."""
    order = np.lexsort(columns[::-1])
    columns = [c[order] for c in columns]
    new = reduce(np.logical_or, (np.diff(c, prepend=c[:1] - 1) != 0 for c in columns)) if len(order) else np.zeros(0, bool)
    if len(new):
        new[0] = True
    at = np.flatnonzero(new)
    return [c[at] for c in columns], np.diff(np.append(at, len(order)))


def _counted(texts: DataFrame, seed: int, levels: list[Level], least: int) -> DataFrame:
    """Phrases one word longer than ``levels`` goes, of at least ``least`` places: c0, c1, ... and n.

    A phrase of m words is a pair: the frequent phrase of its first m - 1 words, and its last word; the phrase of its
    last m - 1 words is frequent too. Pairs of ranks are counted in tiles, the others as sorted rows of word codes.
    """
    held, m = texts.sparkSession.sparkContext.broadcast(levels), len(levels) + 1
    names = [f"c{k}" for k in range(m)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = held.value
        ranked: list[tuple[np.ndarray, np.ndarray]] = []
        others: list[list[np.ndarray]] = []

        def rows(columns: list[np.ndarray], n: np.ndarray) -> Iterator[pa.RecordBatch]:
            for i in range(0, len(n), 1 << 17):
                yield pa.RecordBatch.from_arrays([pa.array(c[i : i + (1 << 17)].astype(np.int64)) for c in (*columns, n)], [*names, "n"])

        def out() -> Iterator[pa.RecordBatch]:
            if ranked:
                first, word = (np.concatenate(x) for x in zip(*ranked, strict=True))
                ranked.clear()
                for a, b, n in tile_counts(first, word):
                    yield from rows([*[c[a] for c in levels[-1].words], b], n)
            if others:
                columns = [np.concatenate(x) for x in zip(*others, strict=True)]
                others.clear()
                yield from rows(*_runs(columns))

        for lang, text in _by_language(batches):
            h, _, _, piece = words_of(text, seed)
            word, ok = _coded(levels[0], _keys(h, lang, seed))
            code, good = word, ok
            for length, level in enumerate(levels[1:], 2):
                n = len(word) - length + 1
                good = good[:-1] & good[1:] & (piece[length - 1 :] == piece[:n])
                code, may = _coded(level, phrase_keys(code[:-1], word[length - 1 :]))
                good &= may
            if len(word) < m:
                continue
            at = np.flatnonzero(good[:-1] & good[1:] & (piece[m - 1 :] == piece[: len(word) - m + 1]))
            for part in np.array_split(at, len(at) // HELD + 1):
                first, last = code[part], word[part + m - 1]
                both = (first >= 0) & (last >= 0)
                ranked.append((first[both], last[both]))
                rest = part[~both]
                others.append([word[rest + k] for k in range(m)])
                if sum(len(x) for x, _ in ranked) + sum(len(x[0]) for x in others) > HELD:
                    yield from out()
        yield from out()

    found = texts.mapInArrow(count, ", ".join(f"{c} long" for c in [*names, "n"]))
    return table(found.groupBy(*names).agg(F.sum("n").alias("n")).where(F.col("n") >= least), f"phrases-{m}")


def _with_keys(phrases: DataFrame, levels: list[Level]) -> DataFrame:
    """Adds the key by which scans look a phrase up, made from the codes of its beginnings."""
    held, m = phrases.sparkSession.sparkContext.broadcast(levels[1:]), len(levels) + 1

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = [b.column(k).to_numpy(zero_copy_only=False) for k in range(m)]
            code = columns[0]
            for k, level in enumerate(held.value, 1):
                code = _coded(level, phrase_keys(code, columns[k]))[0]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(phrase_keys(code, columns[-1]).view(np.int64))], [*b.schema.names, "key"])

    return phrases.mapInArrow(add, ", ".join(f"{f} long" for f in [*phrases.columns, "key"]))


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(10^6 a a / (l r)), exact in decimals of 38 digits."""
    wide = lambda c: c.cast("decimal(20,0)")
    top = (F.lit(1_000_000).cast("decimal(7,0)") * (wide(a) * wide(a)).cast("decimal(31,0)")).cast("decimal(38,0)")
    return F.call_function("div", top, (wide(left) * wide(right)).cast("decimal(38,0)"))


def _scored(counts: list[DataFrame], m: int) -> DataFrame:
    """Phrases of ``m`` words with a, and l, r and score of their lowest-scoring cut, the earliest of equals."""
    names = [f"c{k}" for k in range(m)]
    rows = counts[m - 1].withColumnRenamed("n", "a")
    for k in range(1, m):
        left = counts[k - 1].withColumnRenamed("n", f"l{k}")
        right = counts[m - k - 1].select(*[F.col(f"c{i}").alias(f"c{i + k}") for i in range(m - k)], F.col("n").alias(f"r{k}"))
        rows = rows.join(left, names[:k]).join(right, names[k:])
    cuts = [F.struct(_score(F.col("a"), F.col(f"l{k}"), F.col(f"r{k}")).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")) for k in range(1, m)]
    return rows.select(*names, "a", F.array_min(F.array(*cuts)).alias("cut")).select(*names, "a", "cut.l", "cut.r", "cut.score")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, top: int = TOP, inside: int = INSIDE) -> DataFrame:
    """Each language's ``top`` phrases of 2 to ``longest`` words: lang, rank, phrase, a, l, r, n, score.

    Words are counted, ranked by frequency and go by their ranks; then every phrase of m words is counted as a pair of
    ids, frequent ones are ranked again, and so on to ``longest``. Words and phrases beyond the first ``RANKS`` go by
    hashes that no two words share; a filter of bounded size tells which of them may be frequent, and counts decide.
    A phrase goes where a longer one of at least ``least`` places around it has ``inside`` percent of its places.

    A null language is ``und``; null and empty texts have no words; repeated rows count again; ties are ordered by the
    phrase's bytes; long texts are scanned whole; other columns play no part; an empty table gives no rows.
    """
    texts = _texts(docs, text, lang)
    words, seed = vocabulary(texts)
    totals = words.groupBy("lang").agg(F.sum("n").alias("total"))
    frequent = words.where(F.col("n") >= least)
    first = _level(frequent.select("key", "n"), [])
    ranks = local(docs.sparkSession, list(zip(first.keys[:-1].view(np.int64).tolist(), first.ranks.tolist(), strict=True)), key=pa.int64(), rank=pa.int64())
    coded = frequent.join(F.broadcast(ranks), "key", "left")  # at most RANKS rows of two numbers
    coded = table(coded.select(F.coalesce("rank", F.bitwise_not("key")).alias("c0"), "lang", "word", "n"), "coded")
    levels, counts = [first._replace(words=[np.arange(len(first.ranks))])], [coded.select("c0", "n")]
    while len(counts) < longest:
        counts.append(_counted(texts, seed, levels, least))
        if len(counts) < longest:
            levels.append(_level(_with_keys(counts[-1], levels), [f"c{k}" for k in range(len(counts))]))

    kept = []
    for m in range(2, longest + 1):
        rows, names = _scored(counts, m), [f"c{k}" for k in range(m)]
        around = [counts[n - 1].select(*[F.col(f"c{k + i}").alias(f"c{i}") for i in range(m)], "n") for n in range(m + 1, longest + 1) for k in range(n - m + 1)]
        if around:
            most = reduce(DataFrame.unionByName, around).groupBy(*names).agg(F.max("n").alias("longer"))
            rows = rows.join(most, names, "left").where(F.coalesce(100 * F.col("longer") < inside * F.col("a"), F.lit(True)))
        for k in range(m):
            of = coded.select(F.col("c0").alias(f"c{k}"), F.col("word").alias(f"w{k}"), *(["lang"] if k == 0 else []))
            rows = rows.join(of, f"c{k}")
        kept.append(rows.select("lang", F.concat_ws(" ", *[f"w{k}" for k in range(m)]).alias("phrase"), "a", "l", "r", "score"))
    rows = reduce(DataFrame.unionByName, kept)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # A language's best are found in parts dealt by hash first, so that no task orders a whole language.
    part = F.row_number().over(Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(256))).orderBy(*order))
    best = rows.withColumn("at", part).where(F.col("at") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of two and three words in each language of all documents."""
    return collocations(documents(spark, sf_dir))


OP11_SQL = """
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, row_number() OVER () AS piece, text FROM (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\\x0A-\\x0D]')) AS text FROM d)),
w AS (SELECT lang, piece, generate_subscripts(ws, 1) AS i, unnest(ws) AS w FROM (SELECT lang, piece, list_filter(string_split_regex(text, '[\\x20\\x09]+'), lambda x: x <> '') AS ws FROM p)),
t AS (SELECT lang, w AS w1, lead(w, 1) OVER here AS w2, lead(w, 2) OVER here AS w3 FROM w WINDOW here AS (PARTITION BY piece ORDER BY i)),
f1 AS (SELECT lang, w1, count(*) AS n FROM t GROUP BY lang, w1),
f2 AS (SELECT lang, w1, w2, count(*) AS n FROM t WHERE w2 IS NOT NULL GROUP BY lang, w1, w2 HAVING count(*) >= 10),
f3 AS (SELECT lang, w1, w2, w3, count(*) AS n FROM t WHERE w3 IS NOT NULL GROUP BY lang, w1, w2, w3 HAVING count(*) >= 10),
total AS (SELECT lang, sum(n) AS n FROM f1 GROUP BY lang),
around AS (SELECT lang, w1, w2, max(n) AS longer FROM (SELECT lang, w1, w2, n FROM f3 UNION ALL SELECT lang, w2, w3, n FROM f3) GROUP BY lang, w1, w2),
cuts AS (
  SELECT c.lang, c.w1 || ' ' || c.w2 AS phrase, c.n AS a, 1 AS k, x.n AS l, y.n AS r
  FROM f2 c JOIN f1 x ON x.lang = c.lang AND x.w1 = c.w1 JOIN f1 y ON y.lang = c.lang AND y.w1 = c.w2
  LEFT JOIN around o ON o.lang = c.lang AND o.w1 = c.w1 AND o.w2 = c.w2 WHERE o.longer IS NULL OR 100 * o.longer < 50 * c.n
  UNION ALL SELECT c.lang, c.w1 || ' ' || c.w2 || ' ' || c.w3, c.n, 1, x.n, y.n
  FROM f3 c JOIN f1 x ON x.lang = c.lang AND x.w1 = c.w1 JOIN f2 y ON y.lang = c.lang AND y.w1 = c.w2 AND y.w2 = c.w3
  UNION ALL SELECT c.lang, c.w1 || ' ' || c.w2 || ' ' || c.w3, c.n, 2, x.n, y.n
  FROM f3 c JOIN f2 x ON x.lang = c.lang AND x.w1 = c.w1 AND x.w2 = c.w2 JOIN f1 y ON y.lang = c.lang AND y.w1 = c.w3),
scored AS (SELECT *, (1000000::HUGEINT * a::HUGEINT * a::HUGEINT) // (l::HUGEINT * r::HUGEINT) AS score FROM cuts),
low AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
best AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM low)
SELECT best.lang, rank, phrase, a, l, r, cast(total.n AS bigint) AS n, cast(score AS bigint) AS score
FROM best JOIN total ON total.lang = best.lang WHERE rank <= 2000
"""

QUERIES = {"op11_phrases": op11_phrases}
SQL = {"op11_phrases": OP11_SQL}
