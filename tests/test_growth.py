"""Steps that failed, or grew faster than their input, on larger tables."""

import math
import re

import pytest

from courtspark.operators import mlprep as M
from courtspark.operators import plays as P
from courtspark.operators import repair
from courtspark.operators import report as R
from courtspark.operators import segments as S
from courtspark.plans.reports import thousandths
from courtspark.sources import shared
from courtspark.sources.views import Tables


def test_cells_whose_density_was_rounded_away_have_no_share(spark):
    grid = spark.createDataFrame([("m", "A", 0, 0, 0.0), ("m", "B", 1, 0, 0.5), ("n", "A", 0, 0, 0.0)], "match_id string, team string, cell_x int, cell_y int, density double")
    rows = R.density_colour(grid).select("match_id", "cell_x", thousandths("opacity"), thousandths("share_a")).collect()
    got = {(r["match_id"], r["cell_x"]): (r["opacity"], r["share_a"]) for r in rows}
    assert got["m", 1] == (0.8, 0.0) and got["m", 0][0] == 0.0 and math.isnan(got["m", 0][1])
    assert all(map(math.isnan, got["n", 0]))


def test_switches_are_folded_in_numbered_parts_by_match(spark):
    players = spark.createDataFrame([(f"m{m}", f, 10 * c + f // 4) for m in range(30) for c in range(8) for f in range(12)], "match_id string, frame_id int, track_id int")
    pairs = [(f"m{m}", 10 * c + k, 10 * c + k + 1, 1.0 * k) for m in range(30) for c in range(8) for k in range(2)]
    switches = spark.createDataFrame(pairs, "match_id string, old_id int, new_id int, dist double")
    got = repair.merge_id_switches(players, switches, 3).groupBy("match_id", "track_id").count().collect()
    assert sorted((r["match_id"], r["track_id"], r["count"]) for r in got) == sorted((f"m{m}", 10 * c, 12) for m in range(30) for c in range(8))
    ring = spark.createDataFrame([("m0", 0, 1, 1.0), ("m0", 1, 0, 2.0)], switches.schema)
    with pytest.raises(Exception, match="cycle"):
        repair.merge_id_switches(players, ring).collect()


def test_nearest_references_vote_without_a_shuffle(spark):
    refs = spark.createDataFrame([("b", [1.0, 0.0]), ("b", [1.0, 0.0]), ("a", [1.0, 0.1]), ("a", [1.0, 0.1]), ("c", [0.0, 1.0])], "label string, vector array<double>")
    own = spark.createDataFrame([(k, [1.0, 0.05 * k]) for k in range(2500)] + [(-1, [0.0, 0.0])], "id int, vector array<double>")
    near = M.knn_classify(own, refs, ["id"], 4)
    assert "Exchange" not in near._jdf.queryExecution().toString()
    got = {r["id"]: r["label"] for r in near.collect()}
    assert len(got) == 2501 and got[0] == "b" and got[2] == "a" and got[-1] == "a"


def test_a_match_is_stitched_in_one_group(spark):
    rows = [(f"m{m}", f, f / 4, t, "A", t * 9.0, 1.0) for m in range(3) for t in range(4) for f in [*range(8), *range(40, 48)]]
    f = S.split_fragments(spark.createDataFrame(rows, "match_id string, frame_id int, timestamp_s double, track_id int, team string, x double, y double"))
    hung = S.stitch_fragments(f)
    assert "FlatMapGroupsInPandas" in hung._jdf.queryExecution().toString()
    assert "stretch" not in hung._jdf.queryExecution().toString()
    assert {(r["match_id"], r["seg_id"]) for r in hung.collect()} == {(f"m{m}", k) for m in range(3) for k in range(8)}


def test_parts_of_the_views_grow_with_the_tables(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(shared, "TASK_ROWS", 500)
    t = Tables(spark, sf_dir)
    n = -(-t.lineitem.count() // 500)
    dealt = lambda df: re.findall(r"hashpartitioning\((\w+)#\w+, (\d+)\), REPARTITION_BY_NUM", df._jdf.queryExecution().toString())
    assert n > 4 and t.parts() == n
    assert ("l_orderkey", str(n)) in dealt(t.players) and ("s", str(n)) in dealt(t.waypoints)


MOVES = "match_id string, seg_id int, track_id int, team string, frame_id int, timestamp_s double, x double, y double, vx double, vy double"


def test_role_changes_find_the_bounds_of_what_changes_only(spark):
    rows = [(f"m{m}", s, s, "A", f, f / 4, 20.0 + f * 0.3, 5.0 + s, 1.2 if f % 9 else 0.0, 0.0) for m in range(2) for s in range(3) for f in range(40)]
    segments = spark.createDataFrame(rows, MOVES)
    transitions = spark.createDataFrame([("m0", 1, "RM", "KM", 3.0, 3.5, 6.0), ("m0", 2, "RM", "RL", 3.0, 3.5, 6.0), ("m0", 0, "RL", "RM", 3.2, 3.6, 6.0)], "match_id string, seg_id int, from_role string, to_role string, end_s double, to_start_s double, to_end_s double")
    for detect in (P.detect_role_runins, P.detect_role_swaps):
        got, want = (detect(s, transitions).drop("measures").collect() for s in (segments, S.with_movement(segments)))
        assert got == want and len(got) == 1


def test_chains_find_their_rows_without_dealing_them_again(spark):
    rows = [(f"m{m}", f, f / 4, t, "A", t * 9.0, 1.0) for m in range(3) for t in range(4) for f in range(16)]
    dealt = spark.createDataFrame(rows, "match_id string, frame_id int, timestamp_s double, track_id int, team string, x double, y double").repartition(3, "match_id")
    plan = S.stitch_fragments(S.split_fragments(dealt))._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(match_id#\d+, track_id", plan) and len(re.findall("REPARTITION_BY_NUM", plan)) == 2


def test_breaks_are_scanned_many_series_at_a_time(spark):
    series = [(f"m{m}", "A", f, f / 4, min(2.0 + m + f * 1.5, 38.0)) for m in range(5) for f in range(30)]
    series = spark.createDataFrame(series, "match_id string, team string, frame_id int, timestamp_s double, x double")
    contexts = spark.createDataFrame([("m1", 0.0, "B", 5.0, 9.0), ("m2", 40.0, "A", 5.0, 9.0)], "match_id string, goal double, team string, start_s double, end_s double")
    found = P.detect_fast_breaks(series, contexts)
    assert "FlatMapGroups" not in found._jdf.queryExecution().toString()
    assert {(r["match_id"], r["start_frame"], r["end_frame"]) for r in found.collect()} == {("m0", 0, 24), ("m2", 0, 23), ("m3", 0, 22), ("m4", 0, 22)}


def test_both_ends_of_a_span_are_asked_at_once(spark):
    segments = spark.createDataFrame([("m", 1, 0.0, 0.0, 0.0), ("m", 1, 1.0, 3.0, 4.0)], "match_id string, seg_id int, timestamp_s double, x double, y double")
    spans = spark.createDataFrame([("m", 1, 0.0, 9.0), ("m", 1, None, 1.0), ("m", 2, 0.0, 1.0)], "match_id string, seg_id int, t0 double, t1 double")
    gone = S.displacement(segments, spans)
    plan = gone._jdf.queryExecution().optimizedPlan().toString()
    assert [r["moved"] for r in gone.collect()] == [5.0] and plan.count("Join LeftSemi") == 1 and "Join Inner" not in plan


def test_views_draw_each_number_once(spark):
    shapes = spark.createDataFrame([("m", 1, "A", [0.1, 0.2, -0.1, -0.3], 2)], "match_id string, frame_id int, team string, vector array<double>, n_valid int")
    views = M.augment_formations(shapes)
    assert "md5(" not in views._jdf.queryExecution().toString() and views.count() == 2
