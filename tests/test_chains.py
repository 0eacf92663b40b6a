"""Tracks that continue others, fragments hung on chains, samples at times: against plain restatements."""

import math
import random

import pandas as pd
import pytest

from courtspark.operators import repair as R
from courtspark.operators import segments as S
from courtspark.operators.components import chain_roots


def renamed(rows, pairs):
    """Rename in place, pair by pair: rows are (frame, track), pairs (old, new) in order."""
    rows, goal = list(rows), {}
    first = lambda t: first(goal[t]) if t in goal else t
    for old, new in pairs:
        goal[new] = first(old)
    for new, old in goal.items():
        if not {f for f, t in rows if t == new} & {f for f, t in rows if t == old}:
            rows = [(f, old if t == new else t) for f, t in rows]
    return sorted(rows)


@pytest.mark.parametrize("seed", range(3))
def test_switches_on_random_chains(spark, seed):
    rng = random.Random(seed)
    players, pairs, want = [], [], []
    for m in range(12):
        spans = {t: (a, a + rng.randrange(1, 12)) for t, a in ((t, rng.randrange(60)) for t in range(25))}
        rows = [(f, t) for t, (a, z) in spans.items() for f in range(a, z)]
        own = []
        for new in range(1, 25):
            if rng.random() < 0.8:
                own.append((rng.randrange(new), new, rng.randrange(40) + new / 64))
        own.sort(key=lambda p: (p[2], p[0], p[1]))
        players += [(f"m{m}", f, t) for f, t in rows]
        pairs += [(f"m{m}", *p) for p in own]
        want += [(f"m{m}", f, t) for f, t in renamed(rows, [(a, b) for a, b, _ in own])]
    p = spark.createDataFrame(players, "match_id string, frame_id int, track_id int")
    s = spark.createDataFrame(pairs, "match_id string, old_id int, new_id int, dist double")
    assert sorted(tuple(r) for r in R.merge_id_switches(p, s).select("match_id", "frame_id", "track_id").collect()) == sorted(want)
    assert R.merge_id_switches(p, s.limit(0)).count() == len(players)


def test_long_chain_has_one_root_and_a_cycle_is_an_error(spark):
    up = spark.createDataFrame([("m", k, k - 1) for k in range(1, 70)] + [("n", 2, 1)], "match_id string, node int, parent int")
    got = chain_roots(up, ["match_id"], "node", "parent").collect()
    assert {(r["match_id"], r["node"]): r["root"] for r in got} == {**{("m", k): 0 for k in range(1, 70)}, ("n", 2): 1}


def fragments(rng, matches, tracks, span):
    rows = []
    for m in range(matches):
        for t in range(tracks):
            a, x, y = rng.randrange(span), rng.uniform(0, 8), rng.uniform(0, 6)
            team = rng.choice(["A", "B", "unknown"])
            for f in range(a, a + rng.randrange(1, 14)):
                x, y = x + rng.uniform(-0.3, 0.5), y + rng.uniform(-0.2, 0.2)
                rows.append((f"m{m}", f, f / 8, t, team if rng.random() < 0.8 else "A", round(x * 16) / 16, round(y * 16) / 16))
    return rows


ROW = "match_id string, frame_id int, timestamp_s double, track_id int, team string, x double, y double"


@pytest.mark.parametrize(("seed", "span"), [(0, 400), (1, 60), (2, 1500)])
def test_stretches_give_the_chains_of_whole_matches(spark, seed, span):
    f = S.split_fragments(spark.createDataFrame(fragments(random.Random(seed), 4, 60, span), ROW)).cache()
    got = {(r["match_id"], r["track_id"], r["fragment"]): r["seg_id"] for r in S.stitch_fragments(f).collect()}
    pdf = f.toPandas().sort_values("frame_id")
    want = {}
    for m, own in pdf.groupby("match_id"):
        ends = []
        for (t, k), g in own.groupby(["track_id", "fragment"]):
            a, z = g.iloc[0], g.iloc[-1]
            ends.append((m, 0, t, k, a.timestamp_s, a.x, a.y, z.timestamp_s, z.x, z.y, S._commonest(list(g["team"])), list(g["team"][-S.TAIL :])))
        whole = pd.DataFrame(ends, columns=["match_id", "stretch", "track_id", "fragment", "t0", "x0", "y0", "t1", "x1", "y1", "team", "tail"])
        want |= {(r.match_id, r.track_id, r.fragment): r.chain for r in S._chains(whole).itertuples()}
    assert got == want and len(set(got.values())) > 20


@pytest.mark.parametrize("seed", range(2))
def test_positions_at_many_times(spark, seed):
    rng = random.Random(seed)
    rows = [("m", s, rng.randrange(0, 40) / 4, float(rng.randrange(9)), float(rng.randrange(9)), rng.randrange(100)) for s in range(6) for _ in range(rng.randrange(1, 30))]
    asked = [("m", rng.randrange(8), rng.choice([None, rng.randrange(-4, 48) / 4]), rng.randrange(3)) for _ in range(120)]
    segments = spark.createDataFrame(rows, "match_id string, seg_id int, timestamp_s double, x double, y double, frame_id int")
    times = spark.createDataFrame(asked, "match_id string, seg_id int, t double, tag int")
    got = S.position_at(segments, times, ("frame_id",))
    want = []
    for m, s, t, tag in set(asked):
        own = sorted(r[2:] for r in rows if r[1] == s)
        if own:
            want.append((m, s, t, tag, *next((r for r in own if t is not None and r[0] >= t), own[-1])))
    key = lambda r: tuple(-math.inf if v is None else v for v in r)
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(want, key=key)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner" not in plan and plan.count("Join LeftSemi") == 1


def test_displacement(spark):
    segments = spark.createDataFrame([("m", 1, 0.0, 0.0, 0.0), ("m", 1, 1.0, 3.0, 4.0), ("m", 1, 2.0, 6.0, 8.0)], "match_id string, seg_id int, timestamp_s double, x double, y double")
    spans = spark.createDataFrame([("m", 1, 0.5, 9.0), ("m", 1, -1.0, 0.25)], "match_id string, seg_id int, t0 double, t1 double")
    assert sorted(r["moved"] for r in S.displacement(segments, spans).collect()) == [5.0, 5.0]
