"""Play detectors against plain restatements on random matches, and on scripted scenes."""

import random
from collections import Counter, defaultdict

import numpy as np
import plain_plays as plain
import pytest

from courtspark.operators import mlprep as M
from courtspark.operators import plays as Y
from courtspark.operators import segments as S
from courtspark.sources.shared import written
from courtspark.sources.views import Tables

ROW = "match_id string, frame_id int, timestamp_s double, track_id int, team string, x double, y double"


def line(match, track, team, points, fps=10, until=None):
    """Samples of a walk along (t, x, y) points, standing at its ends."""
    end = until or points[-1][0]
    for f in range(int(end * fps) + 1):
        t = f / fps
        if t < points[0][0] and until is None:
            continue
        at = [np.interp(t, [p[0] for p in points], [p[i] for p in points]) for i in (1, 2)]
        yield (match, f, t, track, team, float(at[0]), float(at[1]))


def random_match(rng, match):
    rows, track = [], 0
    for team, slots in (("A", 6), ("B", 6)):
        for s in range(slots):
            t, points = 0.0, []
            while t < 24:
                depth, wide = (rng.uniform(5, 15), 7) if team == "A" else (rng.uniform(3, 7), 3)
                side = 40 - depth if rng.random() < 0.97 or match != "r1" else depth
                points.append((t, side, min(19.5, max(0.5, 2 + 3.2 * s + rng.uniform(-wide, wide)))))
                t += rng.uniform(0.7, 3)
            track += 1
            own = [r for r in line(match, track, team, points, 8, 24) if not (rng.random() < 0.03)]
            cut = rng.randrange(40, 150)
            own = [r for i, r in enumerate(own) if not cut <= i < cut + rng.randrange(2, 14)]
            rows += [(m, f, t, n + (100 if f > cut else 0), "unknown" if rng.random() < 0.04 else k, x, y) for m, f, t, n, k, x, y in own]
    if match == "r2":
        rows = [(*r[:5], 40 - r[5], r[6]) for r in rows]
    if match == "r3":  # all run over from the other half, so that a break ends in an attack
        rows = [(*r[:5], r[5] - 26 * max(0.0, 1 - r[2] / 8), r[6]) for r in rows]
    if match == "r4":  # too few defenders for a context
        rows = [r for r in rows if r[4] == "A" or r[3] % 100 in (7, 8)]
    return rows


@pytest.fixture(scope="module")
def played(spark, sf_dir):
    """Per match: segments, contexts, positions, centroid series as plain rows; and the same as DataFrames."""
    rng = random.Random(5)
    rows = spark.createDataFrame([r for k in range(6) for r in random_match(rng, f"r{k}")], ROW)
    rows = written(rows.unionByName(Tables(spark, sf_dir).play_rows.where("match_id in ('p0', 'p1', 'p2', 'p3', 'p4')")), "rows")
    seg = written(S.with_movement(S.build_segments(rows)), "seg")
    ctx = written(S.attack_contexts(S.attack_hysteresis(S.attack_verdicts(rows))), "ctx")
    series = written(Y.centroid_series(rows), "series")
    by = defaultdict(lambda: {"seg": defaultdict(list), "ctx": [], "pos": defaultdict(list), "series": defaultdict(list)})
    for r in seg.collect():
        by[r["match_id"]]["seg"][r["seg_id"]].append(r.asDict())
    for r in ctx.orderBy("start_s").collect():
        by[r["match_id"]]["ctx"].append(r.asDict())
    for r in rows.where("team <> 'unknown'").collect():
        by[r["match_id"]]["pos"][r["frame_id"], r["team"]].append((r["x"], r["y"]))
    for r in series.orderBy("frame_id").collect():
        by[r["match_id"]]["series"][r["team"]].append((r["timestamp_s"], r["x"], r["frame_id"]))
    for m in by.values():
        m["seg"] = [plain.Segment(v) for v in m["seg"].values()]
    return {"by": dict(by), "rows": rows, "seg": seg, "ctx": ctx, "series": series}


def found(df):
    return Counter((r["match_id"], r["play_type"], r["team"], r["start_frame"], r["end_frame"], round(r["t0"], 6), round(r["t1"], 6), round(r["confidence"], 6), tuple(r["seg_ids"]), r["goal_x"], r["variant"]) for r in df.collect())


def stated(played, detect):
    return Counter((m, *e[:4], *(round(float(v), 6) for v in e[4:7]), *e[7:]) for m, of in played["by"].items() for e in detect(of))


def test_movement_bounds(played):
    got = {(r["match_id"], r["seg_id"], r["frame_id"]): (r["move_start"], r["move_end"], r["move_start_frame"], r["move_end_frame"]) for r in played["seg"].collect()}
    want = {}
    for m, of in played["by"].items():
        for s in of["seg"]:
            for f, k in s.at_frame.items():
                a, b = s.begins(k), s.ends(k)
                want[m, s.id, f] = (s.t[a], s.t[b], s.rows[a]["frame_id"], s.rows[b]["frame_id"])
    assert got == want


def test_chains_of_fragments(spark, played):
    f = written(S.split_fragments(played["rows"]), "fragments")
    got = {(r["match_id"], r["track_id"], r["fragment"]): r["seg_id"] for r in S.stitch_fragments(f).select("match_id", "track_id", "fragment", "seg_id").distinct().collect()}
    held = defaultdict(list)
    for r in f.collect():
        held[r["match_id"], r["track_id"], r["fragment"]].append(r)
    want = {}
    for m in {k[0] for k in held}:
        ends = []
        for key in (k for k in held if k[0] == m):
            rows = sorted(held[key], key=lambda r: r["frame_id"])
            teams = [r["team"] for r in rows]
            a, b = rows[0], rows[-1]
            ends.append(({"t0": a["timestamp_s"], "x0": a["x"], "y0": a["y"], "t1": b["timestamp_s"], "x1": b["x"], "y1": b["y"], "teams": teams, "team": max(teams, key=lambda t: (teams.count(t), -teams.index(t)))}, key))
        ends.sort(key=lambda e: (e[0]["t0"], e[1][1:]))
        want |= dict(zip([k for _, k in ends], plain.chains([e for e, _ in ends]), strict=True))
    assert got == want
    assert len(set(want.values())) < len(want)


def test_swaps(played):
    got = found(Y.detect_swaps(played["seg"], played["ctx"], S.frame_positions(played["rows"])))
    assert got == stated(played, lambda m: plain.swaps(m["seg"], m["ctx"], m["pos"]))
    assert {k[-1] for k in got} == {"kreuzen", "positionswechsel"}


def test_run_ins(played):
    got = found(Y.detect_run_ins(played["seg"], played["ctx"]))
    assert got == stated(played, lambda m: plain.run_ins(m["seg"], m["ctx"])) and got


def test_pushes(played):
    got = found(Y.detect_pushes(played["seg"], played["ctx"]))
    assert got == stated(played, lambda m: plain.pushes(m["seg"], m["ctx"])) and got


def test_fast_breaks(played):
    got = found(Y.detect_fast_breaks(played["series"], played["ctx"]))
    assert got == stated(played, lambda m: [e for team, s in m["series"].items() for e in plain.breaks(s, team, m["ctx"])]) and got


def test_slots_have_the_least_total():
    rng = np.random.default_rng(3)
    for n in range(1, 9):
        cost = rng.uniform(0, 10, (20, n, 6))
        slots = Y.slots_of_least_total(cost)
        for c, s in zip(cost, slots, strict=True):
            used = [x for x in s if x >= 0]
            assert len(used) == len(set(used)) == min(n, 6)
            assert sum(c[p, x] for p, x in enumerate(s) if x >= 0) == pytest.approx(plain.least_total(c.tolist()))


def test_roles(played):
    got = defaultdict(dict)
    for r in Y.assign_roles(played["seg"], played["ctx"]).collect():
        got[r["match_id"], r["t"]][r["seg_id"]] = r["role"]
    want = {(m, t): costs for m, of in played["by"].items() for t, costs in plain.roles(of["seg"], of["ctx"]).items()}
    assert got.keys() == want.keys()
    for key, costs in want.items():
        own = {s: r for s, r in got[key].items() if r}
        assert got[key].keys() == costs.keys() and len(set(own.values())) == len(own)
        assert all(costs[s][r] <= 8 for s, r in own.items())
        if len(own) == min(6, len(costs)):
            assert sum(costs[s][r] for s, r in own.items()) == pytest.approx(plain.least_total([list(c.values()) for c in costs.values()]))


def test_exchanges_pair_each_transition_once(spark):
    t = [(0, "RL", "RM", 1.0, 2.0), (0, "RM", "RL", 8.0, 9.0), (1, "RM", "RL", 2.0, 3.0), (2, "RM", "RL", 1.5, 2.5), (3, "RL", "RM", 9.0, 10.0), (4, "KM", "RL", 1.0, 2.0), (5, "RM", "RL", 1.0, 2.0)]
    moves = spark.createDataFrame([("m", *x, x[-1] + 2.0) for x in t], "match_id string, seg_id int, from_role string, to_role string, end_s double, to_start_s double, to_end_s double")
    rows = [("m", s, s, "B" if s == 5 else "A", f, f / 4, 20.0, 10.0, 0.0, 0.0) for s in range(6) for f in range(60)]
    seg = S.with_movement(spark.createDataFrame(rows, "match_id string, seg_id int, track_id int, team string, frame_id int, timestamp_s double, x double, y double, vx double, vy double"))
    got = {(tuple(r["seg_ids"]), r["confidence"], r["t0"], r["t1"], r["start_frame"], r["end_frame"]) for r in Y.detect_role_swaps(seg, moves).collect()}
    assert got == {((0, 1), 0.75, 1.0, 3.0, 4, 12), ((0, 3), 0.75, 8.0, 10.0, 32, 40)}


def test_role_plays_meet_the_samples_once_a_pass(spark):
    moves = spark.createDataFrame([("m", 0, "RL", "RM", 1.0, 2.0, 4.0), ("m", 1, "RM", "RL", 2.0, 3.0, 5.0), ("m", 2, "RM", "KM", 2.0, 3.0, 5.0)], "match_id string, seg_id int, from_role string, to_role string, end_s double, to_start_s double, to_end_s double")
    rows = [("m", s, s, "A", f, f / 4, 20.0, 10.0, 0.0, 0.0) for s in range(3) for f in range(60)]
    seg = S.with_movement(spark.createDataFrame(rows, "match_id string, seg_id int, track_id int, team string, frame_id int, timestamp_s double, x double, y double, vx double, vy double"))
    for found, segs in ((Y.detect_role_swaps(seg, moves), [0, 1]), (Y.detect_role_runins(seg, moves), [2])):
        assert found._jdf.queryExecution().optimizedPlan().toString().count("LeftSemi") == 1
        assert [r["seg_ids"] for r in found.collect()] == [segs]


def test_dealt_segments_are_paired_in_place(spark):
    rows = [("m", s, s, "A", f, f / 4, 20.0 + s, 10.0 + (f - 30) * (0.1 if s else -0.1), 1.0, 0.5) for s in range(3) for f in range(60)]
    seg = S.with_movement(spark.createDataFrame(rows, "match_id string, seg_id int, track_id int, team string, frame_id int, timestamp_s double, x double, y double, vx double, vy double").repartition(3, "match_id"))
    found = Y.swap_candidates(seg)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert {(r["seg_id_a"], r["seg_id_b"]) for r in found.collect()} <= {(0, 1), (0, 2)}


@pytest.fixture(scope="module")
def scenes(spark):
    """One match a scene; the goal attacked is at x = 40."""
    wall = lambda m, end=10, team="B": [r for i in range(6) for r in line(m, 21 + i, team, [(0, 36.5, 4 + 2.5 * i)], until=end)]
    back = lambda m, without, end=10, ys=(3, 8, 12, 17): [r for y in ys if y not in without for r in line(m, 40 + y, "A", [(0, 29, y)], until=end)]
    walk = lambda m, n, team, *p, end=10: list(line(m, n, team, list(p), until=end))
    part = lambda m, n, *p: list(line(m, n, "A", list(p)))
    rows = []
    rows += wall("cross") + back("cross", (8,)) + walk("cross", 1, "A", (2, 29, 6), (5, 31.5, 13)) + walk("cross", 2, "A", (2, 29.5, 12.5), (5, 31, 5.5))
    rows += wall("behind") + back("behind", (12,)) + walk("behind", 1, "A", (3, 29, 10), (6, 31.5, 8)) + walk("behind", 2, "A", (3.5, 29.5, 13.5), (5.5, 30.5, 6.5))
    rows += wall("standing") + back("standing", (8,)) + walk("standing", 1, "A", (0, 29, 10)) + walk("standing", 2, "A", (3, 29.5, 14), (5, 30, 6))
    for m, both in (("push", True), ("single", False)):
        rows += wall(m) + back(m, (), ys=(3, 17)) + walk(m, 1, "A", (2, 29, 8), (4, 32.5, 8), (6, 32.5, 8)) + walk(m, 2, "A", (2, 29, 12), *([(4, 32.5, 12), (6, 32.5, 12)] if both else []))
    rows += wall("runin") + back("runin", (8,)) + walk("runin", 1, "A", (2, 29, 10), (5, 33.6, 10), (7, 33.6, 10))
    rows += wall("feint") + back("feint", (8,)) + walk("feint", 1, "A", (2, 29, 10), (5, 33.6, 10), (6.5, 29, 10))
    rows += wall("defender") + back("defender", (8,)) + walk("defender", 1, "B", (2, 29, 10), (5, 33.6, 10), (7, 33.6, 10))
    rows += wall("broken") + back("broken", (8,)) + walk("broken", 1, "A", (2, 29, 6), (5, 31.5, 13))
    rows += [r for r in part("broken", 2, (0, 29.5, 12.5), (2, 29.5, 12.5), (3.2, 30.1, 9.7))] + [r for r in part("broken", 12, (3.5, 30.25, 9.0), (5, 31, 5.5), (10, 31, 5.5))]
    for i, y in enumerate((4, 8, 12, 16)):
        rows += part("counter", 1 + i, (0, 8, y), (6, 30, y))[:-1]
    for i, y in enumerate((6, 10, 14)):
        rows += list(line("counter", 21 + i, "B", [(0, 20, y), (6, 28, y)]))[:-1]
    rows += [r for t, n in (("A", 0), ("B", 10)) for i, x in enumerate((5, 15, 25, 35)) for r in line("spread", n + i, t, [(0, x, 4 + 4 * i)], until=10)]
    return spark.createDataFrame(rows, ROW)


def test_scenes_give_their_plays(spark, scenes):
    empty = spark.createDataFrame([], "match_id string, timestamp_sec double")
    goals = spark.createDataFrame([("cross", 9.0)], "match_id string, timestamp_sec double")
    events, sequences = Y.analyze_match(scenes, goals, scenes.where("match_id in ('cross', 'push')").select("match_id"))
    events = events.cache()
    kinds = defaultdict(Counter)
    for r in events.collect():
        kinds[r["match_id"]][r["play_type"]] += 1
    assert [kinds[m]["kreuzen"] for m in ("cross", "behind", "standing", "broken")] == [1, 1, 0, 1]
    assert [kinds[m]["parallelstoss"] for m in ("push", "single")] == [1, 0]
    seg, ctx = S.with_movement(S.build_segments(scenes)), S.attack_contexts(S.attack_hysteresis(S.attack_verdicts(scenes)))
    held = Counter(r["match_id"] for r in Y.detect_run_ins(seg, ctx).collect())
    assert [held[m] for m in ("runin", "feint", "defender")] == [1, 0, 0] and kinds["runin"]["einlaeufer"] >= 1
    assert kinds["counter"]["tempogegenstoss"] == 1 and not kinds["spread"]
    one = {r["match_id"]: r for r in events.where("play_type in ('kreuzen', 'tempogegenstoss', 'parallelstoss')").collect()}
    assert one["cross"]["variant"] == "kreuzen" and one["behind"]["variant"] == "positionswechsel" and set(one["cross"]["track_ids"]) == {1, 2}
    assert one["cross"]["start_time_s"] <= 2.5 and one["cross"]["sequence_id"] == 0 and {len(t["points"]) for t in one["cross"]["tracks"]} == {25}
    assert one["counter"]["goal_x"] == 40 and one["counter"]["measures"]["distance_m"] >= 12 and one["counter"]["tracks"][0]["track_id"] == -1
    assert one["push"]["measures"]["approach_m"] >= 2
    seq = {r["match_id"]: r for r in sequences.where("sequence_id = 0").collect()}
    assert (seq["cross"]["outcome"], seq["push"]["outcome"], seq["runin"]["outcome"]) == ("goal", "no_goal", "unknown")
    assert seq["cross"]["event_count"] == sum(kinds["cross"].values()) and seq["cross"]["start_frame"] == 0 and "spread" not in seq
    assert [df.count() for df in Y.analyze_match(scenes.limit(0), empty, empty.select("match_id"))] == [0, 0]


def test_a_swap_without_a_context_needs_a_screen(spark):
    c = spark.createDataFrame([("m", "A", 5, 1.0, 30.0, 8.0, 31.0, 12.0)], "match_id string, team string, frame_id int, t_cross double, x_a double, y_a double, x_b double, y_b double")
    none = spark.createDataFrame([], "match_id string, goal double, team string, start_s double, end_s double")
    at = lambda *xs: S.frame_positions(spark.createDataFrame([("m", 5, "B", x, 10.0) for x in xs] + [("m", 5, "A", 39.0, 10.0)], "match_id string, frame_id int, team string, x double, y double"))
    assert [r["goal_x"] for r in Y.swap_goal(c, none, at(36.0, 37.0)).collect()] == [40.0]
    assert Y.swap_goal(c, none, at(36.0, 20.0)).count() == 0
    own = lambda team: spark.createDataFrame([("m", 40.0, team, 0.0, 3.0)], none.schema)
    assert Y.swap_goal(c, own("A"), at(20.0)).count() == 1 and Y.swap_goal(c, own("B"), at(36.0, 37.0)).count() == 0


def test_repeated_points_stay_repeated(spark):
    points = spark.createDataFrame([("m", 1.0), ("m", 1.0), ("m", 9.0)], "match_id string, timestamp_s double")
    ctx = spark.createDataFrame([("m", 40.0, "A", 0.0, 2.0), ("m", 0.0, "B", 2.0, 4.0)], "match_id string, goal double, team string, start_s double, end_s double")
    assert sorted((r["timestamp_s"], r["ctx_team"]) for r in S.context_at(points, ctx).collect()) == [(1.0, "A"), (1.0, "A"), (9.0, None)]


def test_nearest_shapes_by_plain_cosine(spark, sf_dir):
    samples = M.formation_samples(Tables(spark, sf_dir).players, 1, 2).limit(200).cache()
    refs = M.reference_formations(spark)
    assert refs.groupBy("label").count().count() == 7
    forms, shown = M.knn_formation_rows(samples, refs, ["match_id", "frame_id", "team"])
    held = [(r["label"], np.array(r["vector"])) for r in refs.collect()]
    got = {(r["match_id"], r["frame_id"], r["team"]): r["formation"] for r in forms.collect()}
    known = 0
    for r in samples.collect():
        label = got[r["match_id"], r["frame_id"], r["team"]]
        if r["n_valid"] < 4:
            assert label == "unknown"
            continue
        v = np.array(r["vector"])
        sims = sorted(((v @ w / ((np.linalg.norm(v) + 1e-8) * (np.linalg.norm(w) + 1e-8)), k) for k, w in held), reverse=True)
        near = Counter(k for s, k in sims if s >= sims[4][0] - 1e-9)
        assert label in near
        known += 1
    assert shown.count() == known
