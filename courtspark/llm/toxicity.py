"""Toxicity from a weighted finite-state grammar over clauses."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import TEXTS, documents, few_texts, table, text_of

#: The classifier is fitted on at most so many labelled rows, those with the least hashed ids.
FIT_ROWS = 20_000
THRESHOLD = 0.7
#: A unit enters the insult lexicon with this log odds ratio and so many different words before it in toxic texts.
LOG_ODDS, CONTEXTS = 3.5, 3
#: A stem enters it only if so many words of the lexicon begin with it, and no word of a clean text does.
STEMS, STEM_WORDS = (5, 6, 7), 2
FOLDS = 3
#: Unit counts that a task holds before it hands them on; Spark adds them up.
HELD = 200_000

THREATS = ("kill", "hurt", "destroy", "beat", "burn", "shoot", "stab", "töten", "umbringen", "tuer", "tuerai", "frapper", "matar", "golpear")
TARGETS = ("you", "your", "he", "she", "they", "them", "this", "these", "those", "people", "du", "ihr", "dich", "euch", "tu", "vous", "toi", "ils", "tú", "vosotros", "ustedes", "ellos")
NEGATIONS = ("not", "never", "no", "nobody", "isn't", "aren't", "nicht", "kein", "keine", "nie", "pas", "jamais", "aucun", "nunca", "jamás", "tampoco")
REPORTS = ("said", "says", "wrote", "quoted", "called", "reported", "according", "sagte", "schrieb", "zitierte", "dit", "écrit", "selon", "dijo", "escribió", "según")
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
CLAUSE = re.compile(r"[^.!?;:\n]+")

INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER = range(6)


class Transducer:
    """A weighted finite-state transducer over word classes: (state, class) -> (state, factor on an insult's weight)."""

    def __init__(self, arcs: dict[tuple[object, int], tuple[object, float]], start: object):
        self.arcs, self.start = arcs, start

    def compose(self, other: Transducer) -> Transducer:
        """Both run over the same classes; their factors multiply."""
        arcs = {((p, q), c): ((self.arcs[p, c][0], other.arcs[q, c][0]), self.arcs[p, c][1] * other.arcs[q, c][1]) for p, c in self.arcs for q, d in other.arcs if c == d}
        return Transducer(arcs, (self.start, other.start))


def grammar(negated: float = 0.25, reported: float = 0.5, aimed: float = 1.5, threatened: float = 1.5, reach: int = 3) -> Transducer:
    """Negation damps the ``reach`` words after it, reported speech the rest of its clause; a target seen raises what
    follows, and so does a threat. One machine, composed of four."""
    harm = (INSULT, THREAT)
    negation = {(s, c): ((reach if c == NEGATION else max(0, s - 1)), negated if s and c in harm else 1.0) for s in range(reach + 1) for c in range(6)}
    report = {(s, c): (s or c == REPORT, reported if s and c in harm else 1.0) for s in (False, True) for c in range(6)}
    target = {(s, c): (s or c == TARGET, aimed if s and c in harm else 1.0) for s in (False, True) for c in range(6)}
    threat = {(s, c): (s or c == THREAT, threatened if s and c == INSULT else 1.0) for s in (False, True) for c in range(6)}
    return Transducer(negation, 0).compose(Transducer(report, False)).compose(Transducer(target, False)).compose(Transducer(threat, False))


def units(word: str) -> list[str]:
    """A word as lexicon units: itself, closed by ``$``, and its stems."""
    return [word + "$", *(word[:n] for n in STEMS if len(word) >= n)]


@dataclass(frozen=True)
class Toxicity:
    """The fitted grammar: insult units with weights, and the logistic curve over clause scores."""

    lexicon: dict[str, float]
    curve: tuple[float, float, float] = (-4.0, 2.0, 1.0)

    @cached_property
    def _machine(self):
        import ahocorasick

        stems = ahocorasick.Automaton()
        for u in [*self.lexicon, *(t + "$" for t in THREATS)]:
            stems.add_word(u.rstrip("$"), u.rstrip("$"))
        if len(stems):
            stems.make_automaton()
        classes = {w: c for c, ws in ((THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)) for w in ws}
        return stems, classes, grammar()

    def _weight(self, word: str) -> float:
        return max((self.lexicon.get(u, 0.0) for u in units(word)), default=0.0)

    def clauses(self, text: str) -> list[float]:
        """Scores of the clauses that hold an insult or a threat; texts without any are told apart in one scan."""
        stems, classes, machine = self._machine
        low = text.lower()
        if not len(stems):
            return []
        at = [end - len(s) + 1 for end, s in stems.iter(low) if end < len(s) or not low[end - len(s)].isalpha()]
        if not at:
            return []
        out, k = [], 0
        for clause in CLAUSE.finditer(low):
            while k < len(at) and at[k] < clause.start():
                k += 1
            if k < len(at) and at[k] < clause.end():
                state, score = machine.start, 0.0
                for word in WORD.findall(clause.group()):
                    weight = self._weight(word)
                    kind = INSULT if weight else classes.get(word, OTHER)
                    state, factor = machine.arcs[state, kind]
                    score += factor * (weight or (1.0 if kind == THREAT else 0.0))
                if score:
                    out.append(score)
        return out

    def features(self, text: str) -> tuple[float, float]:
        found = self.clauses(text)
        return (float(np.log1p(sum(found))), float(np.log1p(max(found)))) if found else (0.0, 0.0)

    def score(self, text: str) -> float:
        a, b, c = self.curve
        x, y = self.features(text)
        return float(1 / (1 + np.exp(-(a + b * x + c * y))))


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never looked at in fitting."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _unit_counts(sample: DataFrame) -> DataFrame:
    """Units by the texts that hold them, for each fold k: toxic_k, clean_k (texts), before_k (words before it in toxic texts)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clean: Counter[tuple[str, int]] = Counter()
        toxic: Counter[tuple[str, int]] = Counter()
        before: set[tuple[str, int, str]] = set()

        def told() -> Iterator[pa.RecordBatch]:
            rows = [(*k, toxic[k], clean[k], None) for k in {*toxic, *clean}] + [(u, k, 0, 0, p) for u, k, p in before]
            for held in (clean, toxic, before):
                held.clear()
            for i in range(0, len(rows), 20_000):
                cols = list(zip(*rows[i : i + 20_000], strict=True))
                kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["unit", "fold", "toxic", "clean", "before"])

        for b in batches:
            for text, bad, fold in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                words = WORD.findall(text.lower())
                (toxic if bad else clean).update((u, fold) for u in {u for w in set(words) for u in units(w)})
                if bad:
                    before.update((u, fold, p) for p, w in zip(["", *words], words, strict=False) for u in units(w))
                if len(toxic) + len(clean) + len(before) > HELD:
                    yield from told()
        yield from told()

    rows = sample.select("text", "toxic", "fold").mapInArrow(count, "unit string, fold int, toxic long, clean long, before string")
    once = rows.groupBy("unit", "fold", "before").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    own = lambda k, c: F.coalesce(F.sum(F.when(F.col("fold") == k, F.col(c))), F.lit(0))
    of = [own(k, c).alias(f"{c}_{k}") for k in range(FOLDS) for c in ("toxic", "clean")]
    seen = [F.count(F.when(F.col("fold") == k, F.col("before"))).alias(f"before_{k}") for k in range(FOLDS)]
    return once.groupBy("unit").agg(*of, *seen)


def _lexicon(counts: list[dict], sizes: dict, folds: list[int]) -> dict[str, float]:
    """Whole words of these folds with their log odds ratios, and the stems that several of them share."""
    bad, good = sum(sizes.get((k, True), 0) for k in folds), sum(sizes.get((k, False), 0) for k in folds)
    words: dict[str, float] = {}
    stems: dict[str, float] = {}
    for r in counts:
        toxic, clean, before = (sum(r[f"{c}_{k}"] for k in folds) for c in ("toxic", "clean", "before"))
        odds = float(np.log((toxic + 0.5) / (bad + 1)) - np.log((clean + 1) / (good + 2)))
        if odds >= LOG_ODDS and before >= CONTEXTS:
            if r["unit"].endswith("$"):
                words[r["unit"]] = odds
            elif not clean:
                stems[r["unit"]] = odds
    under = Counter(u for w in words for u in units(w.rstrip("$")) if u in stems)
    return dict(sorted((words | {u: stems[u] for u, n in under.items() if n >= STEM_WORDS}).items()))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", fit_rows: int = FIT_ROWS) -> Toxicity:
    """Learn the insult lexicon and the curve from at most ``fit_rows`` labelled rows that are not held out.

    Whole words count by texts, and only those seen after several different words, so that copies of one toxic text do
    not pass its other words for insults; stems only follow from several such words, and no clean text may hold a word of
    theirs. The curve is fitted on scores that each fold gets from the other folds'
    lexicon; the lexicon that stays is that of all folds. Without labelled rows of both kinds nothing is learned and
    no text is toxic.
    """
    marked = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    marked = marked.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    sample = docs.select(F.col("doc_id"), text_of(text).alias("text")).join(F.broadcast(marked), "doc_id")
    sample = sample.groupBy("doc_id").agg(F.max("text").alias("text"), F.max("toxic").alias("toxic"))  # as many rows as labels, also of repeated ids
    fold = F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int")
    sample = table(sample.select("text", (F.col("toxic") > 0).alias("toxic"), fold.alias("fold")), "labelled")
    sizes = {(r["fold"], r["toxic"]): r["count"] for r in sample.groupBy("fold", "toxic").count().collect()}
    if not any(bad for _, bad in sizes) or all(bad for _, bad in sizes):
        return Toxicity({}, (-4.0, 0.0, 0.0))
    all_of = lambda c: sum(F.col(f"{c}_{k}") for k in range(FOLDS))
    likely = _unit_counts(sample).where((all_of("before") >= CONTEXTS) & (all_of("toxic") > all_of("clean")))
    with few_texts(docs.sparkSession):
        counts = [r.asDict() for r in likely.toLocalIterator()]
    every = list(range(FOLDS))
    models = [Toxicity(_lexicon(counts, sizes, [j for j in every if j != k])) for k in every]

    @F.pandas_udf("x double, y double")
    def features(texts: pd.Series, folds: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([models[k].features(t) for t, k in zip(texts, folds, strict=True)], columns=["x", "y"])

    with few_texts(docs.sparkSession):
        rows = sample.select("toxic", features("text", "fold").alias("f")).select("toxic", "f.*").toPandas()
    curve = _logistic(rows[["x", "y"]].to_numpy(float), rows["toxic"].to_numpy(float))
    return Toxicity(_lexicon(counts, sizes, every), curve)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 40) -> tuple[float, float, float]:
    """Ridge logistic regression by Newton steps."""
    a, w = np.column_stack([np.ones(len(x)), x]), np.ones(len(x))
    beta = np.zeros(3)
    penalty = np.diag([1e-6, ridge, ridge]) * len(y) / 100
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        hess = (a * (w * p * (1 - p))[:, None]).T @ a + penalty + 1e-9 * np.eye(3)
        beta = beta + np.linalg.solve(hess, a.T @ (w * (y - p)) - penalty @ beta)
    return tuple(float(b) for b in beta)


def toxicity(model: Toxicity, text: str | Column = "text") -> Column:
    """The score of a text column, 0 to 1; null counts as empty. Only the text goes in."""

    @F.arrow_udf(T.DoubleType())
    def score(texts: pa.Array) -> pa.Array:
        return pa.array([model.score(t) for i in range(0, len(texts), TEXTS) for t in texts[i : i + TEXTS].to_pylist()], pa.float64())

    return score(text_of(text))


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (1 from ``threshold`` on).

    Repeated rows score alike; null doc_ids are not held out and have no label; a null text counts as empty and scores
    what the curve gives no clause. Texts are read whole, clause by clause. An empty table gives no rows, empty labels
    a model that calls nothing toxic; other columns play no part.
    """
    scored = docs.select(F.col("doc_id"), held_out(F.col("doc_id")).alias("held_out"), toxicity(fit(docs, labels)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents under the grammar fitted on labels that are not held out."""
    return toxicity_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {"op9_toxicity": op9_toxicity}
SQL: dict[str, str] = {}
