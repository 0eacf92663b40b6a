"""Structured Streaming twins of the sequential operators; each gives what its batch operator gives."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.segments import verdict_aggregates, verdicts_of

EPOCH = "2000-01-01 00:00:00"


def event_time(df: DataFrame, seconds: str = "timestamp_s") -> DataFrame:
    """Adds ``ts``: match start plus the row's seconds."""
    return df.withColumn("ts", F.timestamp_micros((F.unix_micros(F.lit(EPOCH).cast("timestamp")) + F.floor(F.col(seconds) * 1_000_000)).cast("long")))


def stream_team_centroids(players: DataFrame, delay: str = "10 seconds", least: int = 3) -> DataFrame:
    """Mean x of each team and frame with enough players; a frame is emitted when the watermark passes it."""
    p = players.where("on_court and team in ('A', 'B') and court_x is not null").withWatermark("ts", delay)
    g = p.groupBy("match_id", "frame_id", "team", "ts").agg(F.avg("court_x").alias("mean_x"), F.count("*").alias("n"))
    return g.where(F.col("n") >= least).select("match_id", "frame_id", "team", "mean_x")


class _Ordered(StatefulProcessor):
    """Holds a match's rows until the watermark has passed them, then folds them in order of their place.

    A row sent twice replaces itself. Rows behind the watermark are dropped by Spark and counted in the query's
    progress. The fold sees rows that no later one can precede, so it gives what a sorted batch gives. Without a new
    row for ``idle_ms`` of event time after the last one the match counts as over: ``last`` says what is still open,
    and its state goes.
    """

    row, place, kind, out = "", "frame_id", "", ()
    idle_ms: int | None = None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.columns = [c.split()[0] for c in self.row.split(", ")]
        self.buffer = handle.getMapState("buffer", "at long, place long", self.row)
        self.state = handle.getValueState("state", f"at long, {self.kind}")

    def fold(self, key: tuple, state: tuple | None, rows: list[tuple]) -> tuple[tuple, list[tuple]]:
        """The state after ``rows`` (None at first), and what they bring out."""
        raise NotImplementedError

    def last(self, key: tuple, state: tuple) -> list[tuple]:
        return []

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        first = None
        for part in rows:
            at = part["ts"].astype("datetime64[us]").astype("int64").floordiv(1000)
            values = part[self.columns].astype(object).where(part[self.columns].notna(), None)
            for ms, place, value in zip(at, part[self.place], values.itertuples(index=False, name=None), strict=True):
                self.buffer.updateValue((int(ms), int(place)), value)
                first = int(ms) if first is None else min(first, int(ms))
        if first is not None:
            self.handle.registerTimer(first)
        yield pd.DataFrame([], columns=list(self.out))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        held = [(tuple(k), tuple(v)) for k, v in self.buffer.iterator()]
        ready = sorted((x for x in held if x[0][0] <= now), key=lambda x: x[0][1])
        at, *state = self.state.get() if self.state.exists() else (None,)
        out: list[tuple] = []
        if ready:
            state, out = self.fold(key, tuple(state) or None, [v for _, v in ready])
            at = max(k[0] for k, _ in ready)
            self.state.update((at, *state))
            for k, _ in ready:
                self.buffer.removeKey(k)
        if len(ready) < len(held):
            self.handle.registerTimer(min(k[0] for k, _ in held if k[0] > now))
        elif self.idle_ms is not None and at is not None:
            if at + self.idle_ms <= now:
                out = out + self.last(key, tuple(state))
                self.state.clear()
            else:
                self.handle.registerTimer(at + self.idle_ms)
        yield pd.DataFrame(out, columns=list(self.out))

    def close(self) -> None:
        pass


def _in_order(df: DataFrame, processor: _Ordered, delay: str, kind: str) -> DataFrame:
    of = df.withWatermark("ts", delay).groupBy("match_id")
    return of.transformWithStateInPandas(processor, kind, "Append", "EventTime")


def stream_attack_bins(rows: DataFrame, delay: str = "10 seconds", least: int = 3, near: float = 14.0) -> DataFrame:
    """Attack verdicts of one-second windows: bin, goal, team farther from it (``ahead``), margin; ``ts`` is the
    window's time.

    A window is emitted when the watermark passes its end. Windows with fewer than ``least`` players of a team are not
    emitted; in the batch form their bins have no goal.
    """
    p = rows.where("team in ('A', 'B')").withWatermark("ts", delay)
    g = p.groupBy("match_id", F.window("ts", "1 second")).agg(*verdict_aggregates())
    start = F.unix_micros("window.start") - F.unix_micros(F.lit(EPOCH).cast("timestamp"))
    of = g.withColumn("bin", F.floor(start / 1_000_000).cast("int")).withColumn("ts", F.window_time("window"))
    return verdicts_of(of, ["match_id", "bin", "ts"], least, near)


class _Contexts(_Ordered):
    """The open context of a match, and the stretch of bins at one goal that its verdicts stand in."""

    row, place = "bin int, goal double, ahead string, margin double", "bin"
    kind = "bin int, goal double, seen string, run int, team string, ctx_goal double, ctx_team string, ctx_from int, ctx_to int"
    out = ("match_id", "goal", "team", "start_s", "end_s")

    def __init__(self, strong: float, hold: int, pause_s: float, idle_ms: int):
        self.strong, self.hold, self.pause, self.idle_ms = strong, hold, pause_s, idle_ms

    def fold(self, key, state, rows):
        at, goal, seen, run, team, cg, ct, c0, c1 = state or (None,) * 9
        out = []
        for b, g, ahead, margin in rows:
            if g is None or g != goal or at is None or b != at + 1:
                seen, run, team = None, 0, None
            at, goal = b, g
            if g is None:
                continue
            clear = ahead if margin is not None and margin >= self.strong else None
            run = run + 1 if clear == seen else 1
            seen = clear
            if clear is not None and (team is None or run >= self.hold):
                team = clear
            if team is None:
                continue
            if cg is not None and (cg, ct) == (g, team) and b - c1 <= self.pause:
                c1 = b + 1
            else:
                if cg is not None:
                    out.append((key[0], cg, ct, float(c0), float(c1)))
                cg, ct, c0, c1 = g, team, b, b + 1
        return (at, goal, seen, run, team, cg, ct, c0, c1), out

    def last(self, key, state):
        cg, ct, c0, c1 = state[-4:]
        return [] if cg is None else [(key[0], cg, ct, float(c0), float(c1))]


def stream_attack_contexts(bins: DataFrame, strong: float = 1.0, hold: int = 2, pause_s: float = 2.0, idle_s: float = 60.0) -> DataFrame:
    """Attack contexts behind ``stream_attack_bins``: a second stateful operator over its verdicts.

    A bin that was not emitted has no goal and ends a stretch. A context comes out when another one follows, and when
    the match has had no verdict for ``idle_s`` of event time. Half-open, as in the batch form.
    """
    of = bins.select("match_id", "ts", "bin", "goal", "ahead", "margin").groupBy("match_id")
    return of.transformWithStateInPandas(_Contexts(strong, hold, pause_s, int(idle_s * 1000)), "match_id string, goal double, team string, start_s double, end_s double", "Append", "EventTime")


class _Goals(_Ordered):
    """The last accepted score of a match and the last clock that could be read."""

    row, place = "frame_number int, timestamp_sec double, game_time string, score_home int, score_away int", "frame_number"
    kind, out = "home int, away int, clock string", ("match_id", "frame_number", "timestamp_sec", "game_time", "team", "score_home", "score_away")

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def fold(self, key, state, rows):
        home, away, clock = state or (None, None, None)
        out = []
        for frame, seconds, time, h, a in rows:
            clock = clock if time is None else time
            goal = home is not None and (h - home, a - away) in ((1, 0), (0, 1))
            if goal:
                out.append((key[0], frame, seconds, clock, "home" if h > home else "away", h, a))
            if goal or home is None:
                home, away = h, a
        return (home, away, clock), out


def stream_goals(readings: DataFrame, delay: str = "10 seconds", idle_s: float = 7200.0) -> DataFrame:
    """Goals of readings with their event time ``ts``, which may arrive in any order within ``delay``.

    Readings wait until the watermark has passed them; later ones are dropped and counted. A reading without both
    scores takes no part. The state of a match is its waiting readings and one score, until it is idle.
    """
    of = readings.where("score_home is not null and score_away is not null").select("match_id", "ts", "frame_number", "timestamp_sec", "game_time", "score_home", "score_away")
    kind = "match_id string, frame_number int, timestamp_sec double, game_time string, team string, score_home int, score_away int"
    return _in_order(of, _Goals(int(idle_s * 1000)), delay, kind)


class _Cadence(StatefulProcessor):
    def __init__(self, interval: float):
        self.interval = interval

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("next", "next double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        nxt = self.state.get()[0] if self.state.exists() else float("-inf")
        out = []
        for r in pd.concat(list(rows)).sort_values(["timestamp_s", "frame_id"]).itertuples():
            if r.timestamp_s >= nxt:
                out.append((key[0], int(r.frame_id), float(r.timestamp_s)))
                nxt = r.timestamp_s + self.interval
        self.state.update((nxt,))
        yield pd.DataFrame(out, columns=["match_id", "frame_id", "timestamp_s"])

    def close(self) -> None:
        pass


def stream_cadence_sample(frames: DataFrame, interval: float = 1.0) -> DataFrame:
    of = frames.select("match_id", "frame_id", "timestamp_s").groupBy("match_id")
    return of.transformWithStateInPandas(_Cadence(interval), "match_id string, frame_id int, timestamp_s double", "Append", "None")


class _Status(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("status", "status string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        last, out = (self.state.get()[0] if self.state.exists() else None), []
        for r in pd.concat(list(rows)).sort_values("seq").itertuples():
            if r.status != last and r.status in ("processing", "done", "failed"):
                out.append((key[0], int(r.seq), r.status))
            last = r.status
        self.state.update((last,))
        yield pd.DataFrame(out, columns=["match_id", "seq", "status"])

    def close(self) -> None:
        pass


def stream_status_changes(statuses: DataFrame) -> DataFrame:
    """Statuses that differ from the match's last one."""
    of = statuses.select("match_id", "seq", "status").groupBy("match_id")
    return of.transformWithStateInPandas(_Status(), "match_id string, seq long, status string", "Append", "None")


class _Possession(_Ordered):
    """The open run of a match's ball-carrying team, and how many phases it has had."""

    row = "frame_id int, timestamp_s double, team string"
    kind = "team string, start_frame int, start_s double, last_frame int, last_s double, phases int"
    out = ("match_id", "phase_id", "team", "start_frame", "end_frame", "start_time_s", "end_time_s")

    def __init__(self, gap: int, least: int, idle_ms: int):
        self.gap, self.least, self.idle_ms = gap, least, idle_ms

    def fold(self, key, state, rows):
        team, f0, t0, f1, t1, n = state or (None, None, None, None, None, 0)
        out = []
        for frame, seconds, carrier in rows:
            carried = carrier if carrier in ("A", "B") else None
            if team and (carried not in (None, team) or (carried is None and frame - f1 > self.gap)):
                out += self.last(key, (team, f0, t0, f1, t1, n))
                n += f1 - f0 >= self.least
                team = None
            if carried:
                if team is None:
                    team, f0, t0 = carried, frame, seconds
                f1, t1 = frame, seconds
        return (team, f0, t0, f1, t1, n), out

    def last(self, key, state):
        team, f0, t0, f1, t1, n = state
        return [(key[0], n, team, f0, f1, t0, t1)] if team and f1 - f0 >= self.least else []


def stream_possession(series: DataFrame, fps: float = 25.0, least_s: float = 1.5, gap_s: float = 1.0, delay: str = "10 seconds", idle_s: float = 60.0) -> DataFrame:
    """Possession phases of frames with their event time ``ts`` and ball carrier's team (or null), in any order within
    ``delay``.

    A phase comes out when a later frame closes it: the other team has the ball, or nobody for longer than ``gap_s``;
    and when the match has had no frame for ``idle_s`` of event time, which also clears its state. A feed that pauses
    for longer than ``idle_s`` and goes on counts as a new match, with phases from 0.
    """
    of = series.select("match_id", "ts", "frame_id", "timestamp_s", "team")
    kind = "match_id string, phase_id int, team string, start_frame int, end_frame int, start_time_s double, end_time_s double"
    return _in_order(of, _Possession(int(gap_s * fps), int(least_s * fps), int(idle_s * 1000)), delay, kind)


STATE_TABLES = ("frames", "players", "ball")


def _committed(spark: SparkSession, folder: str, number: int) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/commits/batch={number}/_SUCCESS")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def write_states(states: DataFrame, folder: str, checkpoint: str):
    """Sink of nested frame states: three tables in files by batch and match, and a commit record behind them.

    A batch is three writes and then one record with its rows a table. ``read_states`` shows only recorded batches, so
    a batch that broke off between two writes is not seen in any table; run again, it replaces what it left. A batch
    that was recorded is not written again.
    """
    from ..operators.tables import explode_ball, explode_players, frame_counters

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if _committed(spark, folder, number):
            return
        batch.persist()
        rows = []
        for name, df in zip(STATE_TABLES, (frame_counters(batch), explode_players(batch), explode_ball(batch)), strict=True):
            df.write.mode("overwrite").partitionBy("match_id").parquet(f"{folder}/{name}/batch={number}")
            rows.append((name, df.count()))
        batch.unpersist()
        spark.createDataFrame(rows, "name string, n long").coalesce(1).write.mode("overwrite").parquet(f"{folder}/commits/batch={number}")

    return states.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def read_states(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of ``write_states``: all rows of recorded batches. Folders of other batches are pruned."""
    commits = spark.read.schema("name string, n long, batch long").parquet(f"{folder}/commits")
    out = {}
    for name in STATE_TABLES:
        held = commits.where((F.col("name") == name) & (F.col("n") > 0)).select("batch").distinct()
        out[name] = spark.read.option("basePath", f"{folder}/{name}").parquet(f"{folder}/{name}").join(F.broadcast(held), "batch", "left_semi")
    return out
