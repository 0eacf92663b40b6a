import random
import re
from collections import Counter

import numpy as np
import pytest

from courtspark.llm import phrases as P


def brute(rows, least, top=P.TOP, longest=3):
    """From (lang, text) rows to (lang, rank, phrase, a, l, r, n, score)."""
    f = {}
    for lang, text in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = tuple(w for w in re.split(r"[\x20\x09]+", piece) if w)
            c = f.setdefault(lang or "und", Counter())
            c.update(words[i : i + m] for m in range(1, longest + 1) for i in range(len(words) - m + 1))
    out = []
    for lang, c in f.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in cand.items():
            if any(len(q) > len(p) and 100 * b >= 50 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in cand.items()):
                continue
            score, _, left, right = min((10**6 * a * a // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), left, right))
        n = sum(v for p, v in c.items() if len(p) == 1)
        out += [(lang, i + 1, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(kept)[:top])]
    return sorted(out)


def texts(rng, n, words):
    vocab = [f"{'AbcÉ'[k % 4]}{k}{'x' * (k % 3)}" for k in range(words)]
    weights = [1 / (k + 1) for k in range(words)]
    return [("".join(w + rng.choice([" ", " ", "\t ", ". ", "\n", "  "]) for w in rng.choices(vocab, weights, k=rng.randrange(40)))) for _ in range(n)]


@pytest.mark.parametrize(("ranks", "edge", "dense"), [(1 << 18, 1 << 10, 1 << 17), (8, 4, 3), (40, 4, 1), (0, 4, 1)])
def test_counts_are_plain_counts(spark, docs, monkeypatch, ranks, edge, dense):
    for k, v in {"RANKS": ranks, "EDGE": edge, "DENSE": dense, "HELD": 500, "BUFFER": 3000, "WORDS": 50}.items():
        monkeypatch.setattr(P, k, v)
    rng = random.Random(ranks)
    rows = texts(rng, 400, 60) + [None, "", "...", " a  b ", "same line here and again. " * 40, "x" * 5000 + " tail " + "x" * 5000]
    df = docs(rows)
    want = brute([(r["lang"], r["text"]) for r in df.collect()], 4)
    got = P.collocations(df.repartition(3), least=4)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == want


def test_four_words_and_few_ranks_of_them(spark, docs, monkeypatch):
    rng = random.Random(5)
    rows = texts(rng, 300, 12)
    df = docs(rows)
    want = brute([(r["lang"], r["text"]) for r in df.collect()], 3, top=25, longest=4)
    assert sorted(map(tuple, P.collocations(df, least=3, longest=4, top=25).collect())) == want


def test_words_that_share_a_key_get_another_seed(spark, docs, monkeypatch):
    plain = P.words_of

    def weak(text, seed):
        h, *rest = plain(text, seed)
        return (h & np.uint64(15) if seed == 0 else h, *rest)

    monkeypatch.setattr(P, "words_of", weak)
    df = docs(texts(random.Random(9), 200, 30))
    assert P.vocabulary(P._texts(df, "text", "lang"))[1] == 1


def test_nothing(spark, docs):
    assert P.collocations(docs([])).collect() == []
    assert P.collocations(docs([None, "", "one"])).collect() == []


def test_long_words_and_long_texts():
    a, b = b"ab" * 400_000, b"ba" * 600_000
    text = b" ".join([a, b, a, b"q"])
    h, start, end, piece = P.words_of(text, 0)
    assert h[0] == h[2] != h[1] and len(set(h.tolist())) == 3 and set(piece) == {0}
    long = b"word other. " * 200_000
    h, _, _, piece = P.words_of(long, 0)
    assert len(h) == 400_000 and len(set(h.tolist())) == 2 and piece[-1] == 199_999
