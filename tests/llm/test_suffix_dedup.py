import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from courtspark.llm import suffix_dedup as S


def brute(texts, length):
    """Kept bytes and number of removed spans of each text."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + length] for t in raw for i in range(len(t) - length + 1))
    out = []
    for t in raw:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        out.append((bytes(b for b, g in zip(t, gone, strict=True) if not g), sum(bytes(gone[i - 1 : i] + gone[i : i + 1]) in (b"\0\1", b"\1") for i in range(len(t)))))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_suffixes_are_in_order(seed):
    rng = np.random.default_rng(seed)
    for n in (*range(12), 500):
        s = rng.integers(1, 1 + rng.integers(1, 5), n)
        if seed == 5:
            s[:] = 1
        assert S.suffix_order(s).tolist() == sorted(range(n), key=lambda i: s[i:].tolist())


def cases(rng):
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randrange(1, 9)))
    text = lambda k: " ".join(word() for _ in range(k))
    shared = [text(rng.randrange(4, 40)) for _ in range(6)]
    out = [text(8) + " " + rng.choice(shared) + " " + text(8) for _ in range(60)] + [text(30) for _ in range(20)]
    copy = text(60)
    edited = copy.split()
    edited[20] = "zz"
    period = "abcdefghij" * 30
    return [*out, copy, copy, copy, " ".join(edited), "a" * 400, period, period[3:250], "x" + period[:205], None, "", "ab", shared[0] * 9, text(700), text(3000) + shared[1] + text(3000)]


@pytest.mark.parametrize(("seed", "buffer", "chunk", "group", "length"), [(0, 1 << 16, 1 << 20, 2048, 50), (1, 300, 2000, 2048, 50), (2, 1 << 16, 500, 3, 50), (3, 97, 1 << 20, 1, 41), (4, 1 << 16, 1 << 20, 2048, 200)])
def test_rows_are_brute_force(spark, docs, monkeypatch, seed, buffer, chunk, group, length):
    for k, v in {"BUFFER": buffer, "CHUNK": chunk, "GROUP": group, "HASHES": 200, "SENT": 5}.items():
        monkeypatch.setattr(S, k, v)
    texts = cases(random.Random(seed))
    got = S.suffix_dedup(docs(texts).withColumn("key", S.F.lit("k")).withColumn("place", S.F.lit(1)).repartition(5), length=length).collect()
    rows = {r["doc_id"]: (bytes(r["kept"]), len(r["removed"])) for r in got}
    assert len(got) == len(texts) and [rows[i] for i in range(len(texts))] == brute(texts, length)
    assert all(r["n_bytes"] == len((texts[r["doc_id"]] or "").encode()) for r in got)


def test_repeated_and_null_ids(spark, docs):
    long = "".join(random.Random(1).choices("abcdefgh", k=500))
    other = "".join(random.Random(2).choices("abcdefgh", k=300))
    got = S.suffix_dedup(docs([(1, long), (1, long), (None, long[:220]), (None, None), (None, other), (7, other[:199])])).collect()
    assert sorted((r["doc_id"] or 0, len(r["kept"])) for r in got) == [(0, 0), (0, 0), (0, 300), (1, 0), (1, 0), (7, 199)]
    assert S.suffix_dedup(docs([])).count() == 0


def test_query_is_brute_force(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    want = brute([r["text"] for r in rows], 200)
    got = {r["doc_id"]: r for r in S.op12_suffix_dedup(spark, sf_dir).collect()}
    assert len(got) == len(rows)
    for r, (kept, spans) in zip(rows, want, strict=True):
        g, n = got[r["doc_id"]], len((r["text"] or "").encode())
        assert (g["n_bytes"], g["n_removed"], g["n_spans"], g["kept_sha256"]) == (n, n - len(kept), spans, hashlib.sha256(kept).hexdigest())
