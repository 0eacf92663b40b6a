import zlib

import numpy as np
import pytest

from courtspark.llm import pseudo_likelihood as P
from courtspark.llm import toxicity as X


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    net = P.Network.initial(rng.integers(0, 90, P.VOCABULARY))
    for k in P.SHAPES:
        setattr(net, k, getattr(net, k).astype(np.float64))
    ids = rng.integers(0, P.VOCABULARY, 200)
    around = P.contexts(ids)
    grads = net.gradients(ids, around)
    for k in P.SHAPES:
        p, i = getattr(net, k), np.unravel_index(np.abs(grads[k]).argmax(), P.SHAPES[k])
        p[i] += 1e-5
        up = -net.log_probabilities(ids, around).mean()
        p[i] -= 2e-5
        down = -net.log_probabilities(ids, around).mean()
        p[i] += 1e-5
        assert grads[k][i] == pytest.approx((up - down) / 2e-5, rel=1e-3)


def test_conditional_probabilities_sum_to_one():
    net = P.Network.initial(np.arange(P.VOCABULARY), seed=1)
    around = np.array([[3], [P.VOCABULARY], [900], [7]])
    total = sum(np.exp(net.log_probabilities(np.array([i]), around)[0]) for i in range(P.VOCABULARY))
    assert total == pytest.approx(1, abs=1e-4)


@pytest.fixture(scope="module")
def trained(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(40)]
    texts = []
    for i in range(600):
        k, out = int(rng.integers(40)), []
        for _ in range(60):
            out.append(words[k])
            k = (k + int(rng.integers(1, 3))) % 40
        texts.append((i, " ".join(out)))
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    return docs, P.train(docs)


def test_training_beats_word_frequencies(trained):
    docs, (vocabulary, network) = trained
    plain = P.train(docs, rounds=0)
    mean = lambda m: docs.sparkSession.createDataFrame(P.pseudo_likelihood(docs, *m).toPandas()).selectExpr("sum(log_likelihood) / sum(n_tokens)").first()[0]
    assert mean((vocabulary, network)) > mean(plain) + 0.3


def test_scores_are_those_of_single_texts_and_order_matters(trained, docs):
    own, (vocabulary, network) = trained
    rows = own.limit(20).collect()
    rng = np.random.default_rng(1)
    shuffled = [" ".join(rng.permutation(r["text"].split())) for r in rows]
    texts = [r["text"] for r in rows] + shuffled + [None, "", "w1", "w1 " * 40000]
    got = {r["doc_id"]: r for r in P.pseudo_likelihood(docs(texts), vocabulary, network).collect()}
    for i, t in enumerate(texts):
        n, total = P.score_text((t or "").encode(), vocabulary, network)
        assert got[i]["n_tokens"] == n and got[i]["log_likelihood"] == pytest.approx(total, abs=1e-2)
        assert got[i]["per_token"] == (pytest.approx(total / n, abs=1e-4) if n else None)
    better = sum(got[i]["log_likelihood"] > got[20 + i]["log_likelihood"] for i in range(20))
    assert better >= 18


def test_every_word_is_scored_as_itself(docs, spark):
    own = [" ".join([f"f{i}" for i in range(P.FREQUENT)] * 9)] + [" ".join(f"r{i}" for i in range(3000) for _ in range(1 + i % 6))]
    vocabulary, network = P.train(docs(own))
    counts = {r["word"]: r["n"] for r in vocabulary.counts.collect()}
    words = np.array([w for w in counts if counts[w] < 9], np.int64).view(np.uint64)
    assert len(words) == 3000 and vocabulary.buckets.sum() == sum(1 + i % 6 for i in range(3000))
    ids, n = vocabulary(words), np.array([counts[w] for w in words.view(np.int64).tolist()])
    inside = np.bincount(ids, n * np.exp(-vocabulary.bucket_logs(ids)), P.VOCABULARY)[P.FREQUENT :]
    assert inside + 1 / (vocabulary.buckets + 1) == pytest.approx(1)
    bucket = {t: int(vocabulary(P.grams.word_hashes(t.encode()))[0]) for t in [f"r{i}" for i in range(3000)] + [f"unseen{i}" for i in range(3000)]}
    often, once, unseen = (next(t for t in bucket if t.startswith(k) and bucket[t] == bucket["r5"] and (k == "u" or int(t[1:]) % 6 == m)) for k, m in (("r", 5), ("r", 0), ("u", 0)))
    texts = [often, once, unseen, f"{often} {once} {unseen} {often}"]
    got = {r["doc_id"]: r["log_likelihood"] for r in P.pseudo_likelihood(docs(texts), vocabulary, network).collect()}
    assert got[0] == pytest.approx(got[1] + np.log(6)) and got[1] == pytest.approx(got[2])
    assert [got[i] for i in range(4)] == pytest.approx([P.score_text(t.encode(), vocabulary, network)[1] for t in texts])


def test_nothing_to_learn_from(docs):
    empty = docs([])
    model = P.train(empty)
    assert P.pseudo_likelihood(empty, *model).count() == 0
    assert P.pseudo_likelihood(docs([(1, "a b"), (1, "a b"), (None, None)]), *model).count() == 3


MODEL = X.Toxicity({"idio": 3.0, "scum$": 2.0})


@pytest.mark.parametrize(
    ("louder", "softer"),
    [
        ("you are an idiot", "this thing says idiot"),
        ("an idiot", "not an idiot"),
        ("scum here", "he wrote scum here"),
        ("you idiot", "never you idiot"),
        ("kill the idiot", "see the idiot"),
        ("idiot and scum", "idiot"),
    ],
)
def test_the_grammar_weighs_clauses(louder, softer):
    assert sum(MODEL.clauses(louder)) > sum(MODEL.clauses(softer)) > 0


def test_words_in_other_clauses_do_not_bear_on_it():
    assert MODEL.clauses("not. an idiot") == MODEL.clauses("an idiot")
    assert MODEL.clauses("videoidiot scummy") == [] and MODEL.clauses("") == []


def test_composition_multiplies():
    one = X.Transducer({(s, c): (s ^ (c == 3), 2.0 if s else 1.0) for s in (0, 1) for c in range(6)}, 0)
    both = one.compose(one)
    state, factor = both.start, []
    for c in (3, 0, 3, 0):
        state, f = both.arcs[state, c]
        factor.append(f)
    assert factor == [1.0, 4.0, 4.0, 1.0]


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    got = X.op9_toxicity(spark, folder).toPandas()
    assert len(got) == 1000 and got["score"].between(0, 1).all()
    assert all(h == (zlib.crc32(str(i).encode()) % 3 == 1) for i, h in zip(got["doc_id"], got["held_out"], strict=True))
    held = got[got["held_out"]].merge(labels.toPandas(), on="doc_id")
    bad, good = held[held["toxic"] == 1], held[held["toxic"] == 0]
    assert bad["predicted"].mean() >= 0.75 and good["predicted"].mean() <= 0.02


def test_clean_prose_is_not_toxic_by_stems_it_shares_with_insults(spark):
    folder = "/root/testdata/sf0.01"
    model = X.fit(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    clean = (
        "They follow this path through the forest.", "The path is long.", "You are in Morocco.", "We lose time, you said.",
        "Dieses Wort ist schön. Du kennst das Wort.", "Ihr trefft euch am Abend.", "Vous êtes à Moroni, ce chemin est long.",
        "Tú sabes que este camino es largo.", "He has a cloud of ideas for this study.",
    )
    assert {t: model.score(t) for t in clean if model.score(t) >= X.THRESHOLD} == {}
    assert all(model.score(t) >= X.THRESHOLD for t in ("You are a worthless idiot.", "This is trash and they are scum."))
    assert model.score("You are not an idiot.") < model.score("You are an idiot.")


def test_stems_need_several_toxic_words_and_no_clean_one():
    row = lambda unit, toxic, clean: {"unit": unit, **{f"{c}_{k}": v for k in range(X.FOLDS) for c, v in (("toxic", toxic), ("clean", clean), ("before", toxic))}}
    counts = [row("idiot$", 9, 0), row("idiots$", 9, 0), row("idiot", 18, 0), row("pathos$", 9, 0), row("patho", 9, 0), row("trash$", 9, 0), row("trashy$", 9, 0), row("trash", 18, 1)]
    sizes = {(k, bad): 30 if bad else 300 for k in range(X.FOLDS) for bad in (True, False)}
    assert set(X._lexicon(counts, sizes, list(range(X.FOLDS)))) == {"idiot$", "idiots$", "idiot", "pathos$", "trash$", "trashy$"}


def test_labels_of_held_out_rows_are_not_looked_at(spark):
    folder = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    flipped = labels.withColumn("toxic", X.F.when(X.held_out(X.F.col("doc_id")), 1 - X.F.col("toxic")).otherwise(X.F.col("toxic")))
    assert X.fit(docs, labels) == X.fit(docs, flipped)


def test_no_labels_nulls_and_nothing(docs, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = X.toxicity_scores(docs([(1, None), (1, "idiot"), (None, "x")]), none).collect()
    assert [r["predicted"] for r in got] == [0, 0, 0] and X.toxicity_scores(docs([]), none).count() == 0
