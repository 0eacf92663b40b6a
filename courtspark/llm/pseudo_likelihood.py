"""Documents scored by masked pseudo-likelihood under a bidirectional window network."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import grams
from .common import documents, table, text_of

#: Frequent words with an id of their own; all others share ``BUCKETS`` ids by hash, and are told apart within their id
#: by their counts. The network's vocabulary is classes of SIDE ids.
FREQUENT, BUCKETS, SIDE = 896, 128, 32
VOCABULARY = FREQUENT + BUCKETS
OFFSETS = (-2, -1, 1, 2)
WIDTH = 16
#: Each round masks every position of every document in turn, and averages the networks of all partitions.
ROUNDS = 1
BATCH, RATE = 4096, 0.4
#: Positions that wait for a step, but for the rest of the text they come with.
WAITING = 8 * BATCH
SHAPES = {"embed": (len(OFFSETS), VOCABULARY + 1, WIDTH), "bias": (WIDTH,), "top": (WIDTH, SIDE), "top_bias": (SIDE,), "low": (SIDE, WIDTH, SIDE), "low_bias": (SIDE, SIDE)}


@dataclass
class Network:
    """Context words on both sides, embedded by place and summed, through tanh to a two-step softmax: class, then word."""

    embed: np.ndarray
    bias: np.ndarray
    top: np.ndarray
    top_bias: np.ndarray
    low: np.ndarray
    low_bias: np.ndarray

    @classmethod
    def initial(cls, frequency: np.ndarray, seed: int = 7) -> Network:
        """Small random weights; the output starts at the corpus's word frequencies."""
        rng = np.random.default_rng(seed)
        p = (frequency + 1.0).reshape(SIDE, SIDE)
        made = {k: rng.normal(0, 0.1, s).astype(np.float32) for k, s in SHAPES.items()}
        made["embed"][:, VOCABULARY] = 0
        made |= {"bias": np.zeros(WIDTH, np.float32), "top_bias": np.log(p.sum(1) / p.sum()).astype(np.float32), "low_bias": np.log(p / p.sum(1, keepdims=True)).astype(np.float32)}
        return cls(**made)

    @classmethod
    def from_flat(cls, flat: np.ndarray) -> Network:
        ends = np.cumsum([int(np.prod(s)) for s in SHAPES.values()])
        return cls(**{k: v.reshape(SHAPES[k]).astype(np.float32) for k, v in zip(SHAPES, np.split(flat, ends[:-1]), strict=True)})

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, k).ravel() for k in SHAPES])

    def hidden(self, context: np.ndarray) -> np.ndarray:
        total = self.bias + self.embed[0][context[0]]
        for e, c in zip(self.embed[1:], context[1:], strict=True):
            total += e[c]
        return np.tanh(total)

    def log_probabilities(self, ids: np.ndarray, context: np.ndarray) -> np.ndarray:
        """log p(word | words on both sides) for each position."""
        h = self.hidden(context)
        group, word = ids // SIDE, ids % SIDE
        out = _log_softmax_at(self.top.T @ h.T + self.top_bias[:, None], group)
        order = np.argsort(group, kind="stable")
        ends = np.searchsorted(group[order], np.arange(SIDE + 1))
        for g in range(SIDE):
            at = order[ends[g] : ends[g + 1]]
            if len(at):
                out[at] += _log_softmax_at(self.low[g].T @ h[at].T + self.low_bias[g][:, None], word[at])
        return out

    def gradients(self, ids: np.ndarray, context: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean negative log probability. Positions are sorted by their ids, so that classes are slices."""
        n = len(ids)
        order = np.argsort(ids, kind="stable")
        ids, context = ids[order], context[:, order]
        h = self.hidden(context)
        group, word = (ids // SIDE).astype(np.intp), (ids % SIDE).astype(np.intp)
        ends = np.searchsorted(group, np.arange(SIDE + 1)).tolist()
        d = _softmax(h @ self.top + self.top_bias)
        d[np.arange(n), group] -= 1
        g = {"top": h.T @ d, "top_bias": d.sum(0), "low": np.zeros_like(self.low), "low_bias": np.zeros_like(self.low_bias)}
        dh = d @ self.top.T
        for k in range(SIDE):
            a, b = ends[k], ends[k + 1]
            if a < b:
                d = _softmax(h[a:b] @ self.low[k] + self.low_bias[k])
                d[np.arange(b - a), word[a:b]] -= 1
                g["low"][k], g["low_bias"][k] = h[a:b].T @ d, d.sum(0)
                dh[a:b] += d @ self.low[k].T
        dz = dh * (1 - h * h)
        g["bias"] = dz.sum(0)
        g["embed"] = np.zeros_like(self.embed)
        for k, c in enumerate(context):
            order = np.argsort(c, kind="stable")
            at = c[order]
            start = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
            g["embed"][k][at[start]] = np.add.reduceat(dz[order], start)
        g["embed"][:, VOCABULARY] = 0
        for v in g.values():
            v /= n
        return g


def _softmax(x: np.ndarray) -> np.ndarray:
    """Softmax along rows; ``x`` is used up."""
    x -= x.max(1, keepdims=True)
    np.exp(x, out=x)
    x /= x.sum(1, keepdims=True)
    return x


def _log_softmax_at(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Log softmax down the columns of ``x``, at one row of each; ``x`` is used up."""
    x -= x.max(0)
    picked = x[at, np.arange(x.shape[1])]
    return picked - np.log(np.exp(x, out=x).sum(0))


class Trainer:
    """Adagrad on one partition's positions, starting from a shared network."""

    def __init__(self, network: Network):
        self.network, self.squares, self.seen = network, {k: np.full(s, 1e-4, np.float32) for k, s in SHAPES.items()}, 0

    def step(self, ids: np.ndarray, context: np.ndarray) -> None:
        for k, g in self.network.gradients(ids, context).items():
            self.squares[k] += g * g
            getattr(self.network, k)[...] -= RATE * g / np.sqrt(self.squares[k])
        self.seen += len(ids)


@dataclass(frozen=True)
class Vocabulary:
    """Word hashes of the frequent words (sorted) with their ids by frequency; occurrences by bucket of all others.

    ``counts`` holds the occurrences of every word of the corpus (word, n); it stays a table, of any size.
    """

    hashes: np.ndarray
    ids: np.ndarray
    buckets: np.ndarray
    counts: DataFrame | None = None

    def __call__(self, words: np.ndarray) -> np.ndarray:
        rest = FREQUENT + (words >> np.uint64(40)).astype(np.int64) % BUCKETS
        if not len(self.hashes):
            return rest
        at = np.searchsorted(self.hashes, words)
        at[at == len(self.hashes)] = 0
        return np.where(self.hashes[at] == words, self.ids[at], rest)

    def bucket_logs(self, ids: np.ndarray) -> np.ndarray:
        """Log of what a word's occurrences are divided by to give p(word | id); 0 for frequent words.

        Each bucket has room for one occurrence more, that of words which the corpus does not hold.
        """
        return np.concatenate((np.zeros(FREQUENT), np.log(self.buckets + 1.0)))[ids]


def contexts(ids: np.ndarray) -> np.ndarray:
    """Ids at each offset from every position; places outside the text hold the padding id."""
    pad = max(map(abs, OFFSETS))
    wide = np.full(len(ids) + 2 * pad, VOCABULARY, ids.dtype)
    wide[pad : pad + len(ids)] = ids
    return np.stack([wide[pad + o : pad + o + len(ids)] for o in OFFSETS])


def _word_counts(texts: DataFrame) -> DataFrame:
    """Occurrences of every word hash in the corpus."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [grams.word_hashes(t) for t in b.column(0).to_pylist()]
            seen, n = np.unique(np.concatenate([*words, np.empty(0, np.uint64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(seen.view(np.int64)), pa.array(n.astype(np.int64))], ["word", "n"])

    return texts.mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, text: str = "text", rounds: int = ROUNDS) -> tuple[Vocabulary, Network]:
    """Vocabulary and network from the whole corpus.

    Words are counted over all documents. In each round every partition trains a copy of the shared network on every
    position of all its documents, masked in turn, and Spark averages the copies, weighted by positions. The weights
    thus depend a little on how rows lie in partitions: the same layout gives the same network. What reaches the
    driver is the frequent words and one network, whatever the corpus; the counts of all words stay a table. Null and
    blank texts teach nothing; an empty table gives the initial network.
    """
    spark = docs.sparkSession
    texts = docs.select(text_of(text).cast("binary").alias("text"))
    counts = table(_word_counts(texts), "word-counts")
    top = counts.orderBy(F.desc("n"), "word").limit(FREQUENT).collect()
    words = np.array([r["word"] for r in top], np.int64).view(np.uint64)
    order = np.argsort(words)
    frequency = np.zeros(VOCABULARY)
    frequency[: len(top)] = [r["n"] for r in top]
    bucket = F.shiftrightunsigned("word", 40) % BUCKETS
    for r in counts.groupBy(bucket.alias("bucket")).agg(F.sum("n").alias("n")).collect():
        frequency[FREQUENT + r["bucket"]] = r["n"]
    np.subtract.at(frequency, FREQUENT + (words >> np.uint64(40)).astype(np.int64) % BUCKETS, frequency[: len(top)].copy())
    vocabulary = Vocabulary(words[order], order.astype(np.int64), frequency[FREQUENT:].copy(), counts)
    network = Network.initial(frequency)
    for _ in range(rounds):
        held = spark.sparkContext.broadcast((replace(vocabulary, counts=None), network.flat()))
        parts = texts.mapInArrow(_train_partition(held), "i int, w double, n long")
        mean = parts.groupBy("i").agg((F.sum(F.col("w") * F.col("n")) / F.sum("n")).alias("w")).toArrow()
        if mean.num_rows:
            flat = np.empty(mean.num_rows)
            flat[mean.column("i").to_numpy()] = mean.column("w").to_numpy()
            network = Network.from_flat(flat)
    return vocabulary, network


def _train_partition(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, flat = held.value
        trainer = Trainer(Network.from_flat(flat.copy()))
        ids: list[np.ndarray] = []
        around: list[np.ndarray] = []
        size = 0

        def learn() -> None:
            i, c = np.concatenate(ids), np.concatenate(around, axis=1)
            for a in range(0, len(i), BATCH):
                trainer.step(i[a : a + BATCH], c[:, a : a + BATCH])

        for b in batches:
            for t in b.column(0).to_pylist():
                own = vocabulary(grams.word_hashes(t)).astype(np.uint16)
                if len(own):
                    ids.append(own)
                    around.append(contexts(own))
                    size += len(own)
                if size >= WAITING:
                    learn()
                    ids, around, size = [], [], 0
        if size:
            learn()
        if trainer.seen:
            w = trainer.network.flat().astype(np.float64)
            for a in range(0, len(w), 1 << 15):
                part = w[a : a + (1 << 15)]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, a + len(part), dtype=np.int32)), pa.array(part), pa.array(np.full(len(part), trainer.seen))], ["i", "w", "n"])

    return run


def score_text(text: bytes, vocabulary: Vocabulary, network: Network, block: int = 1 << 15) -> tuple[int, float]:
    """Number of tokens and the sum of their conditional log probabilities; long texts go block by block."""
    words = grams.word_hashes(text)
    ids = vocabulary(words)
    around = contexts(ids)
    total = sum(float(network.log_probabilities(ids[a : a + block], around[:, a : a + block]).sum(dtype=np.float64)) for a in range(0, len(ids), block))
    rare, n = np.unique(words[ids >= FREQUENT].view(np.int64), return_counts=True)
    if len(rare):
        known = {r["word"]: r["n"] for r in vocabulary.counts.where(F.col("word").isin(rare.tolist())).collect()}
        total += sum(k * np.log(known.get(w, 1)) for w, k in zip(rare.tolist(), n.tolist(), strict=True)) - float(vocabulary.bucket_logs(ids).sum())
    return len(ids), total


def pseudo_likelihood(docs: DataFrame, vocabulary: Vocabulary, network: Network, text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens, log_likelihood (sum of log p(token | both sides)), per_token.

    Texts are predicted whole, token by token, from the two words on either side. The network gives p(id | both
    sides); for words that share an id, p(word | id) follows from the word's count in the corpus, which a join brings
    to each document's words, and a word not met in the corpus counts as met once. A null or blank text has no tokens,
    log likelihood 0 and a null mean; repeated rows are scored each, alike; an empty table gives no rows; other columns
    of ``docs`` play no part. Long texts are scored block by block. Documents are stacked for speed, but no token sees
    another document.
    """
    held = docs.sparkSession.sparkContext.broadcast((replace(vocabulary, counts=None), network.flat()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, flat = held.value
        net = Network.from_flat(flat)
        for b in batches:
            n, total, rare, times, ends_rare = [], [], [], [], [0]
            for part in _stacks([grams.word_hashes(t) for t in b.column(2).to_pylist()]):
                own = [vocabulary(w) for w in part]
                ids, around = np.concatenate(own), np.concatenate([contexts(p) for p in own], axis=1)
                got = np.concatenate([net.log_probabilities(ids[a : a + (1 << 15)], around[:, a : a + (1 << 15)]) for a in range(0, len(ids), 1 << 15)] or [np.empty(0)])
                sums = np.concatenate(([0.0], np.cumsum(got - vocabulary.bucket_logs(ids), dtype=np.float64)))
                ends = np.cumsum([len(p) for p in part])
                n += [len(p) for p in part]
                total += (sums[ends] - sums[ends - [len(p) for p in part]]).tolist()
                for w, i in zip(part, own, strict=True):
                    words, often = np.unique(w[i >= FREQUENT], return_counts=True)
                    rare.append(words)
                    times.append(often)
                    ends_rare.append(ends_rare[-1] + len(words))
            words = pa.array(np.concatenate([*rare, np.empty(0, np.uint64)]).view(np.int64))
            pairs = pa.StructArray.from_arrays([words, pa.array(np.concatenate([*times, np.empty(0, np.int64)]).astype(np.int32))], ["word", "times"])
            lists = pa.ListArray.from_arrays(pa.array(ends_rare, pa.int32()), pairs)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(total, pa.float64()), lists], ["row", "doc_id", "n_tokens", "by_id", "rare"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), text_of(text).cast("binary").alias("text"))
    scored = table(rows.mapInArrow(run, "row long, doc_id long, n_tokens long, by_id double, rare array<struct<word: long, times: int>>"), "scored")
    # a word met once adds log 1, so only words met more often need to be found
    rare = scored.select("row", F.inline("rare")).join(vocabulary.counts.where("n > 1"), "word")
    within = rare.groupBy("row").agg(F.sum(F.col("times") * F.log(F.col("n").cast("double"))).alias("within"))
    total = F.col("by_id") + F.coalesce("within", F.lit(0.0))
    return scored.drop("rare").join(within, "row", "left").select("doc_id", "n_tokens", total.alias("log_likelihood"), F.when(F.col("n_tokens") > 0, total / F.col("n_tokens")).alias("per_token"))


def _stacks(texts: list[np.ndarray], size: int = 1 << 15) -> Iterator[list[np.ndarray]]:
    part: list[np.ndarray] = []
    held = 0
    for t in texts:
        part.append(t)
        held += len(t)
        if held >= size:
            yield part
            part, held = [], 0
    if part:
        yield part


def op1_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document under a network and counts of all documents: doc_id, n_tokens, log_likelihood, per_token."""
    docs = documents(spark, sf_dir)
    return pseudo_likelihood(docs, *train(docs))


QUERIES = {"op1_pseudo_likelihood": op1_pseudo_likelihood}
SQL: dict[str, str] = {}
