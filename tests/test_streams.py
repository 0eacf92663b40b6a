"""Each stream gives what its batch operator gives."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.readwriter import DataFrameWriter

from courtspark.operators import phases as P
from courtspark.operators import repair as R
from courtspark.operators import segments as G
from courtspark.operators import tables as O
from courtspark.sources.views import Tables
from courtspark.streaming import streams as S


@pytest.fixture(scope="module")
def tables(spark, sf_dir):
    return Tables(spark, sf_dir)


def through(spark, df, tmp_path, name, build, parts=None):
    """Write ``df`` as files, read them as a stream, run ``build`` to the end, return the rows."""
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    (df if parts is None else df.repartitionByRange(parts[0], parts[1])).write.parquet(src)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = build(spark.readStream.schema(df.schema).parquet(src))
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(300)
    return spark.read.schema(stream.schema).parquet(out)


def rows(df, cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def in_batches(spark, parts, schema, tmp_path, build):
    """Each list of rows is a micro-batch; returns the result's rows and how many input rows came too late."""
    src, out = tmp_path / "in", str(tmp_path / "out")
    for k, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(src))
        done = {f for f in src.glob("*.parquet") if not f.name.startswith("b")}
        for f in done:
            f.rename(src / f"b{k:03d}.parquet")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = build(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src)))
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(400)
    late = sum(op["numRowsDroppedByWatermark"] for p in q.recentProgress for op in (p["stateOperators"] if isinstance(p, dict) else p.stateOperators) if op)
    return spark.read.schema(stream.schema).parquet(out), late


def dealt(df, seconds, jitter, batches, ahead):
    """Rows in order of time but for some seconds, in micro-batches, and one row of another match far ahead."""
    rng = random.Random(7)
    got = sorted(df.collect(), key=lambda r: r[seconds] + rng.random() * jitter)
    cut = [len(got) * k // batches for k in range(batches + 1)]
    return [*[[tuple(r) for r in got[a:z]] for a, z in zip(cut, cut[1:], strict=False)], [ahead]]


def timed(df, seconds):
    return S.event_time(df, seconds)


def far(df, **values):
    """A row of match ``far`` a year ahead."""
    at = df.select(F.max(F.col("ts")) + F.expr("interval 365 days")).first()[0]
    return tuple({"match_id": "far", "ts": at, **values}.get(c) for c in df.columns)


def test_goals_of_shuffled_readings(spark, tables, tmp_path):
    readings = timed(tables.scoreboard_readings, "timestamp_sec")
    parts = dealt(readings, "timestamp_sec", 50, 5, far(readings, frame_number=0, timestamp_sec=0.0, score_home=0, score_away=0))
    got, late = in_batches(spark, parts, readings.schema, tmp_path, lambda s: S.stream_goals(s, "60 seconds"))
    batch = R.detect_goals(tables.scoreboard_readings)
    assert late == 0 and rows(got, batch.columns) == rows(batch, batch.columns) != []


def test_late_readings_are_dropped_and_counted(spark, tmp_path):
    row = lambda f, h: ("m", f, float(f), None, h, 0)
    kind = "match_id string, frame_number int, timestamp_sec double, game_time string, score_home int, score_away int"
    df = timed(spark.createDataFrame([row(0, 0), row(10, 1), row(20, 2), row(15, 5), row(1000, 2), row(11, 3), row(1001, 3), row(9000, 3)], kind), "timestamp_sec")
    r = [tuple(x) for x in df.collect()]
    got, late = in_batches(spark, [[r[0], r[2], r[1]], [r[3], r[4]], [r[6]], [r[5]], [r[7]]], df.schema, tmp_path, lambda s: S.stream_goals(s, "10 seconds"))
    assert late == 1
    assert rows(got, ["frame_number", "team", "score_home"]) == [(10, "home", 1), (20, "home", 2), (1001, "home", 3)]


def test_cadence(spark, tables, tmp_path):
    got = through(spark, tables.frames, tmp_path, "cadence", S.stream_cadence_sample)
    assert rows(got, ["match_id", "frame_id"]) == rows(O.cadence_sample(tables.frames, 1.0), ["match_id", "frame_id"]) != []


def test_centroids_but_for_frames_behind_the_watermark(spark, tables, tmp_path):
    players = tables.players.join(tables.frames.select("match_id", "frame_id", "timestamp_s"), ["match_id", "frame_id"])
    got = through(spark, S.event_time(players), tmp_path, "centroids", lambda s: S.stream_team_centroids(s, "0 seconds", 1))
    cols = ["match_id", "frame_id", "team", "mean_x"]
    want, have = set(rows(P.team_centroids(tables.players, 1), cols)), set(rows(got, cols))
    assert have <= want and len(have) >= len(want) - 20


def test_status_changes(spark, tmp_path):
    log = spark.createDataFrame([("a", 1, "processing"), ("a", 2, "processing"), ("a", 3, "done"), ("b", 1, "unknown"), ("b", 2, "failed")], "match_id string, seq long, status string")
    got = through(spark, log, tmp_path, "status", S.stream_status_changes)
    assert rows(got, ["match_id", "seq", "status"]) == [("a", 1, "processing"), ("a", 3, "done"), ("b", 2, "failed")]


def test_possession_of_matches_that_stop(spark, tables, tmp_path):
    series = timed(P.carrier_series(tables.frames, tables.carriers).select("match_id", "frame_id", "timestamp_s", "team"), "timestamp_s")
    fps = tables.matches.selectExpr("match_id", "16.0D as fps")
    want = P.possession_phases(series, fps, 0.25, 0.5)
    cols = ["match_id", "phase_id", "team", "start_frame", "end_frame", "start_time_s", "end_time_s"]
    parts = dealt(series, "timestamp_s", 20, 4, far(series, frame_id=0, timestamp_s=0.0))
    got, late = in_batches(spark, parts, series.schema, tmp_path, lambda s: S.stream_possession(s, 16.0, 0.25, 0.5, "30 seconds", 10_000.0))
    assert late == 0 and rows(got, cols) == rows(want, cols) != []


def scripted(spark, rng, matches=3, seconds=90):
    """Play rows of six players a second: both teams near one goal for a while, then near the other, with doubt."""
    out = []
    for m in range(matches):
        goal, lead = 0.0, "A"
        for b in range(seconds):
            if rng.random() < 0.1:
                goal = rng.choice([0.0, 40.0, 20.0])
            if rng.random() < 0.3:
                lead = rng.choice("AB")
            for k in range(rng.choice([6, 6, 6, 6, 4])):
                team = "AB"[k % 2]
                off = 6 + 8 * (team == lead) * rng.random() + k / 8
                out.append((f"m{m}", b * 4 + k % 4, b + (k % 4) / 4, k, team, abs(goal - round(off * 8) / 8) if goal != 20 else 20.0 + k, 10.0))
    return spark.createDataFrame(out, "match_id string, frame_id int, timestamp_s double, track_id int, team string, x double, y double")


def test_attack_verdicts_and_contexts(spark, tmp_path):
    df = timed(scripted(spark, random.Random(3)), "timestamp_s")
    parts = dealt(df, "timestamp_s", 8, 4, far(df, frame_id=0, timestamp_s=0.0, team="A", x=1.0, y=1.0))
    verdicts, late = in_batches(spark, parts, df.schema, tmp_path / "v", lambda s: S.stream_attack_bins(s, "10 seconds").drop("ts"))
    want = G.attack_verdicts(df)
    cols = ["match_id", "bin", "goal", "ahead", "margin"]
    assert late == 0 and rows(verdicts.where("goal is not null"), cols) == rows(want.where("goal is not null"), cols) != []
    contexts, late = in_batches(spark, parts, df.schema, tmp_path / "c", lambda s: S.stream_attack_contexts(S.stream_attack_bins(s, "10 seconds")))
    whole = G.attack_contexts(G.attack_hysteresis(want))
    cols = ["match_id", "goal", "team", "start_s", "end_s"]
    assert late == 0 and rows(contexts, cols) == rows(whole, cols) and whole.count() > 6


@pytest.mark.parametrize("broken", [None, "players", "ball", "commits"])
def test_states_survive_a_broken_batch(spark, tables, tmp_path, monkeypatch, broken):
    states = O.frame_states(tables.frames, tables.players, tables.ball).where("match_id in ('m1', 'm2')")
    src, out, check = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")
    states.repartition(2).write.parquet(src)
    start = lambda: S.write_states(spark.readStream.schema(states.schema).option("maxFilesPerTrigger", 1).parquet(src), out, check).start()
    plain = DataFrameWriter.parquet

    def fails(self, path, *args, **kwargs):
        if f"/{broken}/batch=1" in path:
            raise OSError("the sink was killed")
        return plain(self, path, *args, **kwargs)

    if broken:
        monkeypatch.setattr(DataFrameWriter, "parquet", fails)
        with pytest.raises(Exception, match="killed"):
            start().awaitTermination(300)
        seen = S.read_states(spark, out)
        assert seen["frames"].select("batch").distinct().collect() == [(0,)]
        if broken != "players":
            assert seen["players"].select("batch").distinct().collect() == [(0,)]
        monkeypatch.setattr(DataFrameWriter, "parquet", plain)
    start().awaitTermination(300)
    for name, want in (("players", O.explode_players(states)), ("ball", O.explode_ball(states)), ("frames", O.frame_counters(states))):
        got = S.read_states(spark, out)[name]
        keys = ["match_id", "frame_id", "track_id"] if name == "players" else ["match_id", "frame_id"]
        assert rows(got, keys) == rows(want, keys) != []
    assert {p.name for p in (tmp_path / "out" / "players" / "batch=0").glob("match_id=*")} == {"match_id=m1", "match_id=m2"}
