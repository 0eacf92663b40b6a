import hashlib
import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from courtspark.llm.exact_dedup import exact_dedup
from courtspark.llm.mixing import mix, rates, with_cdf
from courtspark.llm.sharding import _room, shard

TEXTS = ["", None, "a", "a", "ab" * 50, "ab" * 50, "ab" * 49 + "ac", "é" * 37, "é" * 37, "😀x" * 11, "a", "x\ny\n", "ab" * 25, "ab" * 2000, "ab" * 2000]


@pytest.mark.parametrize(("block", "bits"), [(8192, 64), (4, 64), (3, 2)])
def test_exact_dedup_is_brute_force(docs, block, bits):
    got = {r["doc_id"]: r for r in exact_dedup(docs(TEXTS), block_chars=block, hash_bits=bits).collect()}
    groups = defaultdict(list)
    for i, t in enumerate(TEXTS):
        groups[t or ""].append(i)
    for t, ids in groups.items():
        for i in ids:
            r = got[i]
            assert (r["keep_id"], r["group_size"], r["kept"]) == (max(ids), len(ids), i == max(ids))
            assert r["text_sha256"] == hashlib.sha256(t.encode()).hexdigest()
    assert len(got) == len(TEXTS)


def test_exact_dedup_of_repeated_rows_null_ids_and_nothing(docs):
    rows = [(3, "t"), (3, "t"), (1, "t"), (None, "u"), (None, "u")]
    got = sorted((str(r["doc_id"]), r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup(docs(rows)).collect())
    assert got == [("1", 3, 3, False), ("3", 3, 3, True), ("3", 3, 3, True), ("None", None, 2, True), ("None", None, 2, True)]
    assert exact_dedup(docs([])).count() == 0


def test_mix_rates_meet_targets(docs):
    df = docs([f"{'x' * (10 + i)}" for i in range(60)])
    per = {r["source"]: r for r in rates(df, {"s0": 1, "s1": 3}).collect()}
    assert per["s2"]["rate"] == 0 and per[None]["rate"] == 0
    total = sum(r["bytes"] for r in per.values())
    assert per["s0"]["rate"] * per["s0"]["bytes"] == pytest.approx(total / 4)
    assert per["s1"]["rate"] * per["s1"]["bytes"] == pytest.approx(total * 3 / 4)


def test_cdf_is_poisson(spark):
    row = with_cdf(spark.createDataFrame([(40.0,)], "rate double")).first()
    part, total = 40.0 / 3, 0.0
    for k, c in enumerate(row["cdf"]):
        total += math.exp(-part + k * math.log(part) - math.lgamma(k + 1))
        assert c == pytest.approx(total, abs=1e-9)


def test_mix_draws_poisson_counts_and_shuffles(docs, spark):
    df = spark.range(4000).selectExpr("id as doc_id", "concat('text ', id) as text", "if(id % 4 = 0, 'rare', 'big') as source", "'clash' as copy")
    got = mix(df, {"rare": 0.5, "big": 0.5})
    assert got.columns == ["doc_id", "text", "source", "copy", "order_key"]
    rows = got.collect()
    counts = Counter(r["doc_id"] for r in rows)
    rare = [counts[i] for i in range(0, 4000, 4)]
    mean = sum(rare) / len(rare)
    var = sum((c - mean) ** 2 for c in rare) / len(rare)
    rate = {r["source"]: r["rate"] for r in rates(df, {"rare": 0.5, "big": 0.5}).collect()}["rare"]
    assert mean == pytest.approx(rate, rel=0.1) and var == pytest.approx(rate, rel=0.2)
    assert sorted((r["doc_id"], r["copy"]) for r in rows) == sorted((i, k) for i, n in counts.items() for k in range(n))
    keys = [r["order_key"] for r in rows]
    assert keys == sorted(keys)
    assert sorted((r["doc_id"], r["copy"], r["order_key"]) for r in mix(df.repartition(7), {"rare": 0.5, "big": 0.5}).collect()) == sorted((r["doc_id"], r["copy"], r["order_key"]) for r in rows)


def test_mix_of_nulls_repeats_and_nothing(docs):
    df = docs([(1, None), (1, None), (None, "a b"), (2, "")])
    counts = Counter((r["doc_id"], r["text"]) for r in mix(df, alpha=1.0, budget=20.0).collect())
    assert counts[(1, None)] % 2 == 0
    assert mix(docs([])).count() == 0


def test_shards_are_level_whole_groups_and_gapless(docs):
    texts = [("t%d " % (i // 3)) * (1 + i % 50) for i in range(900)] + ["hot text"] * 700 + [None, ""]
    got = shard(docs(texts), shards=7).toPandas()
    assert len(got) == len(texts) and got["grown_shard"].isna().all() and set(got["law"]) == {"bytes"}
    sizes = got.groupby("shard")["size"].sum()
    assert len(sizes) == 7 and sizes.max() <= 1.03 * sizes.mean()
    for _, s in got.groupby("shard"):
        assert sorted(s["slot"]) == list(range(len(s)))
    by_text = got.assign(text=[texts[i] or "" for i in got["doc_id"]]).groupby("text")["shard"].nunique()
    assert by_text.max() == 1
    for i, s in zip(got["doc_id"], got["size"], strict=True):
        assert s == len((texts[i] or "").encode()) + 16


def test_a_group_above_a_share_fills_a_shard_alone(docs):
    texts = ["heavy" * 2000] * 30 + [f"light {i}" for i in range(400)]
    got = shard(docs(texts), shards=5).toPandas()
    heavy = set(got[got["doc_id"] < 30]["shard"])
    assert len(heavy) == 1 and not (set(got[got["doc_id"] >= 30]["shard"]) & heavy)
    rest = got[got["doc_id"] >= 30].groupby("shard")["size"].sum()
    assert len(rest) == 4 and rest.max() <= 1.1 * rest.min()


def test_few_rows_and_none(docs):
    assert shard(docs([])).count() == 0
    got = shard(docs([(1, "a"), (1, "a"), (None, None)])).toPandas()
    assert sorted(got["slot"]) in ([0, 0, 1], [0, 1, 2])
    assert shard(docs(["x"]).withColumn("doc_id", F.lit(None).cast("long"))).count() == 1


def test_room_levels_loads():
    assert _room([0, 0, 10], 6) == [3.0, 3.0, 0.0]
    assert _room([1, 2, 3], 6) == pytest.approx([3.0, 2.0, 1.0])
