"""Whole matches scanned at a time: against the DataFrame forms of the same steps, and what their plans deal and write."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from plain_plays import least_total
from pyspark.sql import functions as F
from test_plays import ROW, random_match

from courtspark.operators import matches as M
from courtspark.operators import plays as P
from courtspark.operators import segments as S
from courtspark.plans import plays as plans
from courtspark.plans import registry
from courtspark.sources.shared import written
from courtspark.sources.views import Tables


@pytest.fixture(scope="module")
def played(spark, sf_dir):
    """Random matches, one of them with stamps that go back now and then and teams that are not known at all."""
    rng = random.Random(11)
    rows = [r for k in range(6) for r in random_match(rng, f"r{k}")]
    rows += [(m, f, t - (0.4 if f % 7 == 0 else 0.0), n, None if rng.random() < 0.1 else k, x, y) for m, f, t, n, k, x, y in random_match(rng, "back")]
    rows = spark.createDataFrame(rows, ROW).unionByName(Tables(spark, sf_dir).play_rows.where("match_id in ('p1', 'p7', 'p8')"))
    rows = written(rows, "rows")
    return rows, written(S.with_movement(S.build_segments(rows)), "seg"), written(S.attack_contexts(S.attack_hysteresis(S.attack_verdicts(rows))), "ctx")


def laid(rows):
    """Rows as arrays, and the names of their matches."""
    pdf = rows.toPandas()
    ids, m = np.unique(pdf["match_id"], return_inverse=True)
    teams = ["A", "B", "unknown", None]
    return M.rows_of(pa.array(ids.tolist()), m, *(pdf[c].to_numpy() for c in ("track_id", "frame_id", "timestamp_s")), teams, pdf["team"].map({t: k for k, t in enumerate(teams[:3])}).fillna(3).to_numpy(int), pdf["x"].to_numpy(), pdf["y"].to_numpy())


def near(*values):
    return tuple(round(v, 6) if isinstance(v, float) else v for v in values)


def events(df):
    of = lambda r: tuple(tuple(x) if isinstance(x, (list, tuple)) else x for x in r["roles"]) if r["roles"] else None
    measures = lambda r: tuple((k, round(v, 6)) for k, v in sorted(r["measures"].items())) if r["measures"] else None
    return Counter((*near(*(r[c] for c in P.EVENT if c not in ("seg_ids", "track_ids", "measures", "roles"))), tuple(r["seg_ids"]), tuple(r["track_ids"]), measures(r), of(r)) for r in df.collect())


def test_segments_and_contexts_of_many_matches(played):
    rows, seg, ctx = played
    r = laid(rows)
    g, c = M.segments_of(r), M.contexts_of(r)
    ids = r.ids.to_pylist()
    got = {(ids[g.m[s]], int(g.id[s]), f): near(r.teams[g.team[s]], int(g.track[s]), *e) for s, f, *e in zip(*(v.tolist() for v in (g.s, g.frame, g.t, g.x, g.y, g.vy, g.v, g.begun, g.ended, g.begun_frame, g.start[g.s], g.end[g.s])), strict=True)}
    want = {(r["match_id"], r["seg_id"], r["frame_id"]): near(r["team"], r["track_id"], *(r[n] for n in ("timestamp_s", "x", "y", "vy")), np.hypot(r["vx"], r["vy"]).item(), *(r[n] for n in ("move_start", "move_end", "move_start_frame", "seg_start", "seg_end"))) for r in seg.collect()}
    assert got == want and any(k[0] == "back" for k in got)
    held = {near(ids[m], z, r.teams[t], a, b) for m, z, t, a, b in zip(*(v.tolist() for v in (c.m, c.goal, c.team, c.start, c.end)), strict=True)}
    assert held == {near(x["match_id"], x["goal"], x["team"], x["start_s"], x["end_s"]) for x in ctx.collect()} and held


def test_plays_of_whole_matches_are_those_of_single_steps(spark, played):
    rows, seg, ctx = played
    moves = written(P.role_transitions(P.stable_runs(P.assign_roles(seg, ctx))), "moves")
    series = P.centroid_series(rows)
    found = written(M.scan(M.packed(rows), whole=True), "found")
    steps = (
        P.detect_swaps(seg, ctx, S.frame_positions(rows)), P.detect_run_ins(seg, ctx), P.detect_pushes(seg, ctx), P.detect_fast_breaks(series, ctx), P.detect_role_swaps(seg, moves), P.detect_role_runins(seg, moves),
    )
    for k, step in enumerate(steps):
        steady = "true" if k in (0, 3) else "match_id <> 'back'"  # the other steps leave open what holds if stamps go back
        got, want = events(found.where(f"source = {k}").where(steady)), events(step.where(steady))
        assert got == want and got, (k, list((got - want).items())[:2], list((want - got).items())[:2])
    assert found.where("source < 0").count() == ctx.count()
    one = found.where("source = 0").drop("source").withColumn("key", F.monotonically_increasing_id())
    one = written(one, "one")
    spans = one.select("match_id", "key", "t0", "t1", F.posexplode("seg_ids").alias("place", "seg_id"))
    drawn = {(r["key"], r["place"]): (r["track_id"], r["points"]) for r in S.trajectories(seg, spans).collect()}
    assert drawn == {(r["key"], k): (t["track_id"], t["points"]) for r in one.collect() for k, t in enumerate(r["tracks"])}


def test_matches_laid_end_to_end_do_not_mix(played):
    r = laid(played[0])
    known = lambda r: Counter(repr({k: v for k, v in e.items() if k not in ("m", "segs")} | {"m": r.ids[e["m"]].as_py()}) for e in M.plays_of(r, M.DETECTORS, True))
    apart = Counter()
    for k in range(len(r.ids)):
        own = r.m == k
        apart += known(M.rows_of(r.ids.slice(k, 1), r.m[own] - k, r.track[own], r.frame[own], r.t[own], r.teams, r.team[own], r.x[own], r.y[own]))
    assert known(r) == apart and len(apart) > 50


def test_rows_of_whole_matches_are_the_view(spark, sf_dir):
    t = Tables(spark, sf_dir)
    r = plans.play_rows(plans.whole_matches(t).toArrow().combine_chunks().to_batches()[0])
    ids, teams = np.array(r.ids.to_pylist()), np.array(r.teams, object)
    got = Counter(zip(ids[r.m].tolist(), r.frame.tolist(), r.t.tolist(), r.track.tolist(), teams[r.team].tolist(), r.x.tolist(), r.y.tolist(), strict=True))
    assert got == Counter(tuple(x) for x in t.play_rows.collect()) and got


@pytest.mark.parametrize("query", ["f3_detect_swaps", "f4_detect_run_ins", "f5_detect_pushes", "f13_detect_role_swaps", "f14_detect_role_runins"])
def test_play_rows_are_neither_dealt_nor_written(spark, sf_dir, query):
    """Line items are dealt twice, by order and by match; from there a task goes to the plays."""
    plan = registry.queries()[query](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2 and plan.count("FileScan") == 1 and "Join" not in plan


@pytest.mark.parametrize("name", ["events", "sequences"])
def test_analysis_deals_plays_only(spark, sf_dir, name):
    t = Tables(spark, sf_dir)
    plan = plans.analyzed(t)[("events", "sequences").index(name)]._jdf.queryExecution().executedPlan().toString()
    assert "lineitem" not in plan and "rows-" not in plan and "segments-" not in plan


def test_slots_of_few_players_have_the_least_total():
    rng = np.random.default_rng(8)
    for n in range(1, 9):
        cost = rng.integers(0, 6, (40, n, 6)).astype(float)
        for c, s in zip(cost, P.slots_of_least_total(cost), strict=True):
            used = [x for x in s if x >= 0]
            assert len(used) == len(set(used)) == min(n, 6)
            assert sum(c[p, x] for p, x in enumerate(s) if x >= 0) == least_total(c.tolist())


def test_no_rows_give_no_plays(spark):
    none = spark.createDataFrame([], ROW)
    assert M.scan(M.packed(none, 3), whole=True).count() == 0
    few = spark.createDataFrame([("m", f, f / 4, 1, "A", 1.0, 1.0) for f in range(3)], ROW)
    assert M.scan(M.packed(few), whole=True).count() == 0
