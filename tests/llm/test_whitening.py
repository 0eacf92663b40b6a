import numpy as np
import pytest

from courtspark.llm import whitening as W


def of_spectrum(values, seed=0):
    rng = np.random.default_rng(seed)
    n = len(values)
    u, v = np.linalg.qr(rng.standard_normal((n, n)))[0], np.linalg.qr(rng.standard_normal((n, n)))[0]
    return np.linalg.qr(u @ np.diag(values) @ v.T, mode="r")


@pytest.mark.parametrize("values", [np.geomspace(1, 1e-9, 40), np.ones(12), np.r_[5.0, 5.0, 5.0, 3.0, 3.0, 1.0], np.r_[4.0, 2.0, 0.0, 0.0], np.array([3.0]), np.r_[np.full(6, 2.0), 2 + 1e-12 * np.arange(6)], np.random.default_rng(1).random(64)])
def test_decomposition(values):
    r = of_spectrum(values)
    z, squares = W.decompose(r, len(values))
    want = np.sort(values)[::-1][: len(z)]
    assert len(z) == (values > 1e-12 * values.max()).sum()
    np.testing.assert_allclose(np.sqrt(squares), want, rtol=1e-10, atol=1e-13 * want[0])
    np.testing.assert_allclose(z @ z.T, np.eye(len(z)), atol=1e-8)
    np.testing.assert_allclose(r.T @ (r @ z.T), z.T * squares, atol=1e-9 * squares[0])


def test_bidiagonal_values_are_relatively_accurate():
    a, b = np.geomspace(1, 1e-12, 25), np.geomspace(1, 1e-12, 25)[1:] * 3
    m = np.diag(a) + np.diag(b, 1)
    inverse = np.linalg.svd(np.linalg.inv(m), compute_uv=False)
    got = W.squared_singular_values(a, b)
    np.testing.assert_allclose(np.sqrt(got[-5:]), 1 / inverse[:5][::-1], rtol=1e-9)


def brute(vectors, k):
    x = np.floor(1024 * vectors) + 100_000
    c = x - x.mean(axis=0)
    e, v = np.linalg.eigh(c.T @ c / len(x))
    e, v = e[::-1][:k], v[:, ::-1][:, :k]
    return x, e, c @ v / np.sqrt(e), e / np.trace(c.T @ c / len(x))


def check(got, ids, vectors, k):
    x, e, w, part = brute(vectors, k)
    n, s = len(x), x.sum(axis=0)
    rows = {(r["vec_id"], r["component"]): r for r in got}
    assert len(rows) == len(got) == n * k
    for j in range(k):
        mine = np.array([rows[i, j + 1]["whitened"] for i in ids])
        mine *= np.sign(mine @ w[:, j])
        np.testing.assert_allclose(mine, w[:, j], atol=1e-6)
        assert all(abs(rows[i, j + 1]["explained"] / part[j] - 1) < 1e-9 for i in ids)
    for at, i in enumerate(ids):
        assert rows[i, 1]["deviation"] == sum((n * int(a) - int(b)) ** 2 for a, b in zip(x[at], s, strict=True))
    assert {r["n"] for r in got} == {n} and {r["identity_error"] for r in got}.pop() < 1e-9


def test_query_is_brute_force(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    got = W.op13_whitening(spark, sf_dir).collect()
    check(got, [r["vec_id"] for r in rows], np.array([r["embedding"] for r in rows], np.float64), 8)


def test_odd_rows(spark):
    rng = np.random.default_rng(3)
    good = [(i, [float(v) for v in rng.standard_normal(5)], "clash") for i in range(60)]
    bad = [(100, None, ""), (101, [], ""), (102, [1.0, None, 0.0, 0.0, 0.0], ""), (103, [float("nan")] * 5, ""), (104, [float("inf"), 0.0, 0.0, 0.0, 0.0], ""), (105, [1.0], "")]
    df = spark.createDataFrame(good + bad, "vec_id long, embedding array<double>, n string").withColumn("key", W.F.lit("x")).withColumn("whitened", W.F.lit("y"))
    for parts in (1, 20):
        check(W.whitening(df.repartition(parts), 3).collect(), [i for i, _, _ in good], np.array([v for _, v, _ in good]), 3)
    assert len(W.whitening(df, 9).collect()) == 60 * 5


def test_nothing_ties_and_repeats(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert W.whitening(make([])).count() == 0
    assert W.whitening(make([(1, [1.0, 2.0])] * 4)).count() == 0
    got = W.whitening(make([(None, [1.0, 0.0]), (2, [-1.0, 0.0]), (2, [-1.0, 0.0])])).collect()
    assert [r["component"] for r in got] == [1, 1, 1] and got[0]["explained"] == 1.0
    assert sorted(r["vec_id"] or 0 for r in got) == [0, 2, 2]
    wide = make([(i, [1e5 * (i % 3), 2e3 * (i % 2)]) for i in range(20)])
    assert W.whitening(wide).count() == 40
    with pytest.raises(Exception, match="too large"):
        W.whitening(make([(i, [1e6 * i]) for i in range(2000)])).count()
