"""Scenarios of the operators whose results feed back on themselves, and plain restatements to compare with."""

import random

import pytest
from pyspark.sql import functions as F

from courtspark.functions.court import clock, zone_of
from courtspark.operators import detections as D
from courtspark.operators import islands as I
from courtspark.operators import mlprep as M
from courtspark.operators import phases as P
from courtspark.operators import repair as R
from courtspark.operators import segments as S
from courtspark.operators import stats as Q
from courtspark.operators import tables as T

READING = "match_id string, frame_number int, timestamp_sec double, game_time string, score_home int, score_away int"


def readings(spark, scores, match="m"):
    return spark.createDataFrame([(match, i, i / 4, f"0:{i:02d}" if i % 2 == 0 else None, *s) for i, s in enumerate(scores)], READING)


@pytest.mark.parametrize(
    ("scores", "goals"),
    [
        ([(0, 0), (0, 0), (0, 0)], []),
        ([(0, 0), (1, 0), (1, 1)], [(1, "home"), (2, "away")]),
        ([(0, 0), (5, 0), (1, 0)], [(2, "home")]),
        ([(2, 2), (1, 2), (3, 2)], [(2, "home")]),
        ([(0, 0), (1, 1), (0, 1)], [(2, "away")]),
        ([(0, 0), (None, 3), (1, 0), (None, None)], [(2, "home")]),
    ],
)
def test_goals(spark, scores, goals):
    assert sorted((r["frame_number"], r["team"]) for r in R.detect_goals(readings(spark, scores)).collect()) == goals


def plain_goals(scores):
    ref, out = None, []
    for i, (h, a) in enumerate(scores):
        if h is None or a is None:
            continue
        if ref and (h - ref[0], a - ref[1]) in ((1, 0), (0, 1)):
            out.append((i, "home" if h > ref[0] else "away"))
            ref = (h, a)
        ref = ref or (h, a)
    return out


def test_goals_of_random_scores(spark):
    rng = random.Random(1)
    many = {f"m{k}": [(rng.choice([None, 0, 1, 1, 2, 3]), rng.choice([0, 0, 1, 2])) for _ in range(25)] for k in range(30)}
    df = None
    for m, s in many.items():
        df = readings(spark, s, m) if df is None else df.unionByName(readings(spark, s, m))
    got = {}
    for r in R.detect_goals(df).collect():
        got.setdefault(r["match_id"], []).append((r["frame_number"], r["team"]))
    assert {m: sorted(g) for m, g in got.items()} == {m: g for m, s in many.items() if (g := plain_goals(s))}


def plain_hysteresis(rows, hold):
    out, team, goal, other, streak = [], None, None, None, 0
    for g, seen in rows:
        if g is None:
            team, goal, streak = None, None, 0
        elif g != goal:
            team, goal, streak = seen, g, 0
        elif team is None:
            team, streak = seen, 0
        elif seen is not None and seen != team:
            streak = streak + 1 if other == seen else 1
            if streak >= hold:
                team, streak = seen, 0
        else:
            streak = 0
        other = seen
        out.append(team)
    return out


def test_hysteresis_is_the_state_machine(spark):
    rng = random.Random(2)
    rows, want = [], {}
    for k in range(60):
        s = []
        for _ in range(40):
            g = rng.choice([0, 0, 0, 40, None]) if rng.random() < 0.2 or not s else s[-1][0]
            s.append((g, rng.choice(["A", "A", "B", None]) if g is not None else None))
        rows += [(k, i, g, t) for i, (g, t) in enumerate(s)]
        want[k] = plain_hysteresis(s, 3)
    df = spark.createDataFrame(rows, "k int, i int, goal int, seen string")
    got = {}
    for r in I.hysteresis(df, ["k"], "i", "goal", "seen", F.lit(3)).orderBy("k", "i").collect():
        got.setdefault(r["k"], []).append(r["label"])
    assert got == want


def test_merged_switches_follow_chains_and_skip_overlaps(spark):
    frames = {1: range(0, 10), 2: range(11, 20), 3: range(21, 30), 4: range(15, 25)}
    players = spark.createDataFrame([("m", f, t) for t, fs in frames.items() for f in fs], "match_id string, frame_id int, track_id int")
    pairs = spark.createDataFrame([("m", 2, 3, 1.0), ("m", 1, 2, 2.0), ("m", 2, 4, 3.0)], "match_id string, old_id int, new_id int, dist double")
    got = {r["track_id"]: r["n"] for r in R.merge_id_switches(players, pairs).groupBy("track_id").agg(F.count("*").alias("n")).collect()}
    assert got == {1: 28, 4: 10}


def track(points, tid=1, team="A"):
    return [("m", i, i / 8, tid, team, x, y) for i, x, y in points]


ROW = "match_id string, frame_id int, timestamp_s double, track_id int, team string, x double, y double"


@pytest.mark.parametrize(("jump", "team", "segments"), [(0.4, "A", 1), (6.0, "A", 2), (0.4, "B", 2), (0.4, "unknown", 1)])
def test_stitching(spark, jump, team, segments):
    rows = track([(i, 29 + i / 8, 6.0) for i in range(12)]) + track([(i, 29 + i / 8 + jump, 6.0) for i in range(14, 30)], 11, team)
    f = S.stitch_fragments(S.split_fragments(spark.createDataFrame(rows, ROW)))
    assert f.select("seg_id").distinct().count() == segments


def test_formations(spark):
    wall = [(7, 4 + 2.4 * i) for i in range(6)]
    cases = {1: wall, 2: [(x + 26, y) for x, y in wall], 3: wall[:3], 4: wall[:5] + [(13, 10)]}
    rows = [("m", k, "A", float(x), float(y), True) for k, ps in cases.items() for x, y in ps]
    df = spark.createDataFrame(rows, "match_id string, frame_id int, team string, court_x double, court_y double, defends_left boolean")
    got = {r["frame_id"]: r["formation"] for r in P.classify_formation(df).collect()}
    assert got[2] == "attack" and got[3] == "unknown" and got[1] != "unknown"


def test_upsert_and_split(spark):
    base = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, ver int")
    new = spark.createDataFrame([(2, "c", 1), (3, "d", 0)], "k int, v string, ver int")
    assert sorted(tuple(r) for r in T.upsert_latest(base, new, ["k"], "ver").collect()) == [(1, "a", 1), (2, "c", 1), (3, "d", 0)]
    s = M.train_val_split(spark.range(1003).withColumnRenamed("id", "k"), ["k"], 0.2)
    assert s.where("split = 'val'").count() == 200 and s.count() == 1003
    assert M.train_val_split(spark.range(0).withColumnRenamed("id", "k"), ["k"]).count() == 0


def test_columns(spark):
    r = spark.range(1).select(zone_of(F.lit(3.0), F.lit(10.0)).alias("a"), zone_of(F.lit(37.0), F.lit(2.0)).alias("b"), zone_of(F.lit(15.0), F.lit(None).cast("double")).alias("c"), clock(F.lit(3725.0)).alias("d"), clock(F.lit(-3.0)).alias("e")).first()
    assert tuple(r) == ("KL", "LA", "RM", "62:05", "00:00")


def test_augmented_shapes_stay_near_but_for_an_outlier(spark):
    own = [0.1, 0.2, -0.1, -0.2, 0.0, 0.3]
    v = spark.createDataFrame([("m", i, "A", own + [0.0] * 8, 3) for i in range(300)], "match_id string, frame_id int, team string, vector array<double>, n_valid int")
    rows = M.augment_formations(v).collect()
    points = [[tuple(r["vector"][i : i + 2]) for i in range(0, 14, 2)] for r in rows]
    there = [[p for p in ps if p != (0.0, 0.0)] for ps in points]
    assert len(rows) == 600 and {len(x) for x in there} == {2, 3} and 230 < sum(len(x) == 2 for x in there) < 370
    off = [[min((x - a) ** 2 + (y - b) ** 2 for a, b in zip(own[::2], own[1::2], strict=True)) ** 0.5 for x, y in ps] for ps in there]
    assert all(sum(d > 0.2 for d in ds) <= 1 for ds in off) and 30 < sum(any(d > 0.2 for d in ds) for ds in off) < 130
    assert len({tuple(p == (0.0, 0.0) for p in ps) for ps in points}) > 20
    assert {tuple(r["vector"]) for r in rows} == {tuple(r["vector"]) for r in M.augment_formations(v).collect()}


def test_sketches_of_matches_merge(spark):
    players = spark.range(60_000).selectExpr("concat('m', id % 7) as match_id", "cast(id % 911 as int) as track_id", "cast(id % 5003 as int) as frame_id", "if(id % 3 = 0, null, 1.0D) as court_x", "1.0D as court_y")
    sketches = Q.match_sketches(players)
    exact = players.groupBy("match_id").agg(F.count_distinct("track_id").alias("t"), F.count_distinct("frame_id").alias("f"), F.count_distinct(F.when(F.col("court_x").isNotNull(), F.col("frame_id"))).alias("c")).collect()
    bound = 4 * 1.04 / 2**6
    each = {r["match_id"]: r for r in Q.sketched_counts(sketches, ("match_id",)).collect()}
    for r in exact:
        g = each[r["match_id"]]
        assert all(abs(a / b - 1) < bound for a, b in ((g["tracks"], r["t"]), (g["player_frames"], r["f"]), (g["court_frames"], r["c"])))
    whole = Q.sketched_counts(sketches).first()
    assert abs(whole["tracks"] / sum(r["t"] for r in exact) - 1) < bound and abs(whole["court_frames"] / sum(r["c"] for r in exact) - 1) < bound


def test_rescoring_a_store(spark, tmp_path):
    folder = str(tmp_path)
    events = spark.createDataFrame([("m1", 0, "swap"), ("m1", 1, "push"), ("m2", 0, "swap"), ("m 3/x", 0, "push")], "match_id string, event_id int, play_type string")
    labels = spark.createDataFrame([("m1", 1, "confirmed"), ("m2", 0, "rejected"), ("m 3/x", 0, "confirmed")], "match_id string, event_id int, verdict string")
    T.write_tracking(events, folder, "play_events")
    T.write_tracking(labels, folder, "play_event_labels")
    schemas = {"play_events": events.schema, "play_event_labels": labels.schema}
    files = lambda m: {(f.name, f.stat().st_mtime_ns) for n in schemas for f in (tmp_path / n / f"match_id={m}").glob("*.parquet")}
    before = files("m2")
    new = spark.createDataFrame([("m1", 7, "run_in"), ("m2", 9, "left out")], "match_id string, event_id int, play_type string")
    for _ in range(2):
        T.rescore_store(spark, folder, {"play_events": new}, ["m1", "m 3/x"])
        held = T.read_tracking(spark, folder, schemas)
        assert sorted(tuple(r) for r in held["play_events"].select("match_id", "event_id", "play_type").collect()) == [("m1", 7, "run_in"), ("m2", 0, "swap")]
        assert [tuple(r) for r in held["play_event_labels"].select("match_id", "event_id").collect()] == [("m2", 0)]
        assert files("m2") == before != set()
    plan = held["play_events"].where("match_id = 'm2'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(match_id" in plan and "(match_id" in plan.split("PartitionFilters")[1].split("]")[0]
    T.rescore_store(spark, folder, {"play_events": new.limit(0)}, ["m1", "m2"])
    assert all(d.count() == 0 for d in T.read_tracking(spark, folder, schemas).values())


def test_knn_finds_its_own_shape(spark):
    refs = M.reference_formations(spark)
    own = refs.where("label not in ('attack', 'transition')").dropDuplicates(["label"]).selectExpr("label as want", "vector")
    got = M.knn_classify(own, refs, ["want"]).collect()
    assert len(got) == 5 and all(r["want"] == r["label"] for r in got)


def test_scoreboard_texts(spark):
    texts = ["7", "TVB 27 THW 21", "12:75 8", "7 TVB 27 THW", "08 09 12:30", ""]
    got = [(r["game_time"], r["score_home"], r["score_away"]) for r in D.parse_scoreboard(spark.createDataFrame([(t,) for t in texts], "text string")).collect()]
    assert got == [(None, 7, None), (None, 27, 21), (None, 8, None), (None, 27, None), ("12:30", 8, 9), (None, None, None)]
    seen = spark.createDataFrame([("m", 1, 0, "25:70 5 3"), ("m", 1, 1, "12:30 5 3"), ("m", 2, 0, "5 3"), ("m", 2, 1, "4")], "match_id string, frame_id int, ordinal int, text string")
    assert sorted((r["frame_id"], r["ordinal"], r["has_clock"]) for r in D.scoreboard_plausible(seen).collect()) == [(1, 1, True), (2, 0, False)]
