"""Movement segments and attack contexts from court positions (match_id, frame_id, timestamp_s, track_id, team, x, y)."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .islands import hysteresis, islands

TRACK = ["match_id", "track_id"]
SEG = ["match_id", "seg_id"]
#: Rows at a chain's end that tell its team.
TAIL = 15
#: A chain takes fragments up to so many seconds after its end.
HOLD_S = 0.7


def play_rows(players: DataFrame, frames: DataFrame, fps: DataFrame) -> DataFrame:
    """On-court, court-mapped players with their time: the frame's, else frame over fps."""
    p = players.where("on_court and court_x is not null").join(frames.select("match_id", "frame_id", "timestamp_s"), ["match_id", "frame_id"], "left").join(fps, "match_id")
    return p.select("match_id", "frame_id", F.coalesce("timestamp_s", F.col("frame_id") / F.col("fps")).alias("timestamp_s"), "track_id", "team", F.col("court_x").alias("x"), F.col("court_y").alias("y"))


def split_fragments(rows: DataFrame, max_gap_s: float = 1.0) -> DataFrame:
    """Adds ``fragment``, numbering a track's runs without a pause longer than ``max_gap_s``."""
    w = Window.partitionBy(*TRACK).orderBy("frame_id")
    return islands(rows, TRACK, "frame_id", F.col("timestamp_s") - F.lag("timestamp_s").over(w) > max_gap_s, "fragment")


def majority_team(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The commonest team of each group; ties go to the team seen first."""
    n = rows.groupBy(*keys, "team").agg(F.count("*").alias("n"), F.min("frame_id").alias("first"))
    return n.groupBy(*keys).agg(F.max(F.struct("n", (-F.col("first")).alias("f"), "team")).alias("b")).select(*keys, F.col("b.team").alias("team"))


def stitch_fragments(fragments: DataFrame) -> DataFrame:
    """Adds ``seg_id``: fragments are hung on the chain that ended just before, in order of start.

    A chain takes a fragment 0 to 0.7 s after its last point and within min(1 + 2.5 gap, 2.5) m, if their teams do
    not clash and no other chain is nearly as close (0.8 m). A chain's team is the commonest of its last 15 rows. Each
    choice moves a chain's end, so a match's fragments are taken in turn. The chains come back as one list for each
    match, in which a row finds its own by its fragment's place; so rows that come dealt by match are not dealt again.
    """
    cols = [*TRACK, "fragment", "frame_id", "timestamp_s", "x", "y", "team"]
    chains = fragments.select(*cols).groupBy("match_id").applyInPandas(_stitched, "match_id string, chains array<int>")
    place = F.dense_rank().over(Window.partitionBy("match_id").orderBy("track_id", "fragment")) - 1
    return fragments.withColumn("_place", place).join(chains, "match_id").withColumn("seg_id", F.get("chains", F.col("_place"))).drop("_place", "chains")


def _commonest(teams: list[str]) -> str:
    return max(dict.fromkeys(teams), key=teams.count)


def _stitched(rows: pd.DataFrame) -> pd.DataFrame:
    """The chains of a match's fragments, in order of their tracks and numbers."""
    names = ["track_id", "fragment", "frame_id", "timestamp_s", "x", "y"]
    track, fragment, _, t, x, y = c = [rows[n].to_numpy() for n in names]
    teams = rows["team"].to_numpy()
    order = np.lexsort((pd.factorize(teams, sort=True)[0], *c[::-1]))
    track, fragment, t, x, y, teams = (v[order] for v in (track, fragment, t, x, y, teams))
    start = np.flatnonzero(np.concatenate(([True], (np.diff(track) != 0) | (np.diff(fragment) != 0))))
    ends = np.append(start[1:], len(rows))
    of = np.repeat(np.arange(len(start)), ends - start)
    by_time = np.lexsort((y, x, t, of))
    first, last = by_time[start], by_time[ends - 1]
    held = [teams[i:j].tolist() for i, j in zip(start.tolist(), ends.tolist(), strict=True)]
    turn = np.lexsort((fragment[start], track[start], t[first]))
    at = [v[k][turn].tolist() for k in (first, last) for v in (t, x, y)]
    chains = np.empty(len(turn), np.int32)
    chains[turn] = _hung(zip(*at, (_commonest(held[k]) for k in turn.tolist()), (held[k][-TAIL:] for k in turn.tolist()), strict=True))
    return pd.DataFrame({"match_id": rows["match_id"].to_numpy()[:1], "chains": [chains]})


def _hung(ends: Iterable[tuple]) -> list[int]:
    """The chain of each of a match's fragments, which come in order of their starts: t0, x0, y0, t1, x1, y1, team, tail."""
    open_: dict[int, tuple] = {}
    chain: list[int] = []
    n = 0
    for t0, x0, y0, t1, x1, y1, team, last in ends:
        open_ = {k: c for k, c in open_.items() if t0 - c[0] <= HOLD_S}
        near = []
        for k, (t, x, y, _, common) in open_.items():
            gap, d = t0 - t, ((x0 - x) ** 2 + (y0 - y) ** 2) ** 0.5
            if 0 < gap and d <= min(1.0 + 2.5 * gap, 2.5) and {common, team} != {"A", "B"}:
                near.append((d, k))
        near.sort()
        tail = list(last)
        if near and (len(near) == 1 or near[1][0] - near[0][0] >= 0.8):
            k = near[0][1]
            tail = (open_[k][3] + tail)[-TAIL:]
        else:
            k, n = n, n + 1
        open_[k] = (t1, x1, y1, tail, _commonest(tail))
        chain.append(k)
    return chain


def _chains(ends: pd.DataFrame) -> pd.DataFrame:
    """The chain of each of a match's fragments, numbered in order of their starts."""
    ends = ends.sort_values(["t0", "track_id", "fragment"])
    columns = (ends[c].tolist() for c in ("t0", "x0", "y0", "t1", "x1", "y1", "team", "tail"))
    return ends[["match_id", "track_id", "fragment"]].assign(chain=_hung(zip(*columns, strict=True)))


def smooth(rows: DataFrame, keys: list[str], cols: list[str], half: int = 2) -> DataFrame:
    """Centred moving averages that shrink at the ends; series of one or two points stay."""
    w = Window.partitionBy(*keys).orderBy("frame_id")
    n = F.count("*").over(Window.partitionBy(*keys))
    return rows.withColumns({c: F.when(n <= 2, F.col(c)).otherwise(F.avg(c).over(w.rowsBetween(-half, half))) for c in cols})


def central_velocity(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Adds vx, vy: differences between the neighbours, or the point itself at an end."""
    w = Window.partitionBy(*keys).orderBy("frame_id")
    near = lambda c: (F.coalesce(F.lead(c).over(w), F.col(c)), F.coalesce(F.lag(c).over(w), F.col(c)))
    (t1, t0), (x1, x0), (y1, y0) = near("timestamp_s"), near("x"), near("y")
    return rows.withColumns({"vx": F.when(t1 > t0, (x1 - x0) / (t1 - t0)).otherwise(0.0), "vy": F.when(t1 > t0, (y1 - y0) / (t1 - t0)).otherwise(0.0)})


def build_segments(rows: DataFrame, stitch: bool = True) -> DataFrame:
    """Rows of segments that last: seg_id, smoothed x and y, velocities, the segment's team and commonest track."""
    f = split_fragments(rows)
    s = stitch_fragments(f) if stitch else f.withColumn("seg_id", (F.col("track_id") * 1000 + F.col("fragment")).cast("int"))
    whole = Window.partitionBy(*SEG)
    span = F.max("timestamp_s").over(whole) - F.min("timestamp_s").over(whole)
    s = s.withColumns({"_n": F.count("*").over(whole), "_span": span}).where("_n >= 5 and _span >= 1.0")
    for c in ("track_id", "team"):
        same = Window.partitionBy(*SEG, c)
        votes = F.struct(F.count("*").over(same).alias("n"), (-F.min("frame_id").over(same)).alias("f"), F.col(c).alias("of"))
        s = s.withColumn(f"_{c}", votes)
    common = {c: F.max(f"_{c}").over(whole)["of"] for c in ("track_id", "team")}
    s = s.select(*SEG, "frame_id", "timestamp_s", "x", "y", *[v.alias(c) for c, v in common.items()])
    return central_velocity(smooth(s, SEG, ["x", "y"]), SEG)


def verdict_aggregates() -> list[Column]:
    """What a verdict needs of the A and B rows of one bin."""
    own = lambda t, c: F.when(F.col("team") == t, c)
    return [
        F.sort_array(F.collect_list("x")).alias("xs"), *[F.count_if(F.col("team") == t).alias(f"n_{t}") for t in "AB"],
        *[F.avg(own(t, F.abs(F.col("x") - z))).alias(f"d_{t}_{z}") for t in "AB" for z in (0, 40)],
    ]


def _verdict(near: float) -> list[Column]:
    mid = F.element_at("xs", F.floor(F.size("xs") / 2).cast("int") + 1)
    goal = F.when(mid < near, 0.0).when(mid > 40 - near, 40.0)
    a, b = F.when(goal == 0, F.col("d_A_0")).otherwise(F.col("d_A_40")), F.when(goal == 0, F.col("d_B_0")).otherwise(F.col("d_B_40"))
    return [goal.alias("goal"), F.when(goal.isNotNull(), F.when(a > b, "A").otherwise("B")).alias("ahead"), F.when(goal.isNotNull(), F.abs(a - b)).alias("margin")]


def _enough(least: int) -> Column:
    return (F.col("n_A") >= least) & (F.col("n_B") >= least)


def verdicts_of(bins: DataFrame, keys: list[str], least: int = 3, near: float = 14.0) -> DataFrame:
    """Goal, team farther from it and margin, from ``verdict_aggregates`` by bin; bins with too few rows go."""
    return bins.where(_enough(least)).select(*keys, *_verdict(near))


def attack_verdicts(rows: DataFrame, bin_s: float = 1.0, least: int = 3, near: float = 14.0) -> DataFrame:
    """Per bin of time: the goal that the players are near, the team farther from it, and by how much.

    Rows are gathered once; the bins without rows before one that has some are laid out with it.
    """
    p = rows.select("match_id", "team", F.floor(F.col("timestamp_s") / bin_s).cast("int").alias("bin"), F.when(F.col("team").isin("A", "B"), F.col("x")).alias("x")).where("bin >= 0")
    g = p.groupBy("match_id", "bin").agg(*verdict_aggregates()).withColumn("xs", F.when(_enough(least), F.col("xs")))
    before = F.coalesce(F.lag("bin").over(Window.partitionBy("match_id").orderBy("bin")), F.lit(-1))
    v = g.select("match_id", "bin", *_verdict(near), before.alias("before")).withColumn("at", F.explode(F.sequence(F.col("before") + 1, "bin")))
    own = F.col("at") == F.col("bin")
    return v.select("match_id", F.col("at").alias("bin"), *[F.when(own, F.col(c)).alias(c) for c in ("goal", "ahead", "margin")])


def attack_hysteresis(verdicts: DataFrame, strong: float = 1.0, hold: int = 2) -> DataFrame:
    """The attacking team of each bin: clear evidence opens it, and ``hold`` clear bins of the other team turn it."""
    v = verdicts.withColumn("seen", F.when(F.col("margin") >= strong, F.col("ahead")))
    return hysteresis(v, ["match_id"], "bin", "goal", "seen", F.lit(hold), "team").select("match_id", "bin", "goal", "team")


def attack_contexts(bins: DataFrame, bin_s: float = 1.0, pause_s: float = 2.0) -> DataFrame:
    """Half-open intervals of equal goal and team, joined over pauses of up to ``pause_s``."""
    b = bins.where("goal is not null and team is not null")
    w = Window.partitionBy("match_id").orderBy("bin")
    pause = F.col("bin") * bin_s - (F.lag("bin").over(w) + 1) * bin_s > pause_s
    other = (F.lag("goal").over(w) != F.col("goal")) | (F.lag("team").over(w) != F.col("team"))
    r = islands(b, ["match_id"], "bin", pause | other)
    return r.groupBy("match_id", "island").agg(F.first("goal").alias("goal"), F.first("team").alias("team"), (F.min("bin") * bin_s).alias("start_s"), ((F.max("bin") + 1) * bin_s).alias("end_s")).drop("island")


def context_at(points: DataFrame, contexts: DataFrame, at: str = "timestamp_s") -> DataFrame:
    """Points with the context that holds them, if any, as ctx_goal and ctx_team.

    Contexts of a match never overlap, so each point meets at most one; they are joined by the second. Repeated points
    stay repeated.
    """
    seconds = F.explode(F.sequence(F.floor("start_s"), F.floor("end_s")))
    c = contexts.select(F.col("match_id").alias("_match"), seconds.alias("_second"), F.col("start_s").alias("_from"), F.col("end_s").alias("_to"), F.col("goal").alias("ctx_goal"), F.col("team").alias("ctx_team"))
    inside = (F.col("match_id") == F.col("_match")) & (F.floor(at) == F.col("_second")) & (F.col(at) >= F.col("_from")) & (F.col(at) < F.col("_to"))
    return points.join(c, inside, "left").drop("_match", "_second", "_from", "_to")


def frame_positions(rows: DataFrame) -> DataFrame:
    """Where each team's players stand in each frame: match_id, frame_id, team (A or B), positions (x, y)."""
    at = F.sort_array(F.collect_list(F.struct("x", "y")))
    return rows.where("team in ('A', 'B')").groupBy("match_id", "frame_id", "team").agg(at.alias("positions"))


def goal_distance(x: Column, y: Column, goal: Column) -> Column:
    """Distance to the middle of a goal."""
    return F.sqrt((x - goal) * (x - goal) + (y - 10) * (y - 10))


def speed() -> Column:
    return F.sqrt(F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy"))


def movement_bounds(segments: DataFrame, rest: float = 0.8, reach_s: float = 3.0) -> DataFrame:
    """Adds where a sample's movement begins and ends: move_start, move_end (times) and their frames.

    From a sample the walk goes on to the next one while that is faster than ``rest`` and within ``reach_s`` seconds.
    The walk back thus ends at the later of two samples: the last one, up to here, that follows a slow sample (or
    none), and the first one within reach; the walk on mirrors it.
    """
    w = Window.partitionBy(*SEG).orderBy("frame_id")
    back = Window.partitionBy(*SEG).orderBy(F.desc("frame_id"))
    ms, reach = F.round(F.col("timestamp_s") * 1000).cast("long"), int(reach_s * 1000)
    by_ms = Window.partitionBy(*SEG).orderBy("_ms")
    fast = speed() >= rest
    so_far, ahead = w.rowsBetween(Window.unboundedPreceding, 0), back.rowsBetween(Window.unboundedPreceding, 0)
    s = segments.withColumns({"_ms": ms, "_begins": ~F.coalesce(F.lag(fast).over(w), F.lit(False)), "_ends": ~F.coalesce(F.lead(fast).over(w), F.lit(False))})
    for col, out in (("timestamp_s", ""), ("frame_id", "_frame")):
        start = F.greatest(F.last(F.when(F.col("_begins"), F.col(col)), ignorenulls=True).over(so_far), F.min(col).over(by_ms.rangeBetween(-reach, 0)))
        end = F.least(F.last(F.when(F.col("_ends"), F.col(col)), ignorenulls=True).over(ahead), F.max(col).over(by_ms.rangeBetween(0, reach)))
        s = s.withColumns({f"move_start{out}": start, f"move_end{out}": end})
    return s.drop("_ms", "_begins", "_ends")


def with_movement(segments: DataFrame) -> DataFrame:
    """Segments with their first and last time (seg_start, seg_end) and their movement bounds."""
    whole = Window.partitionBy(*SEG)
    return movement_bounds(segments.withColumns({"seg_start": F.min("timestamp_s").over(whole), "seg_end": F.max("timestamp_s").over(whole)}))


def position_at(segments: DataFrame, times: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """Each segment's first sample at or after a time, else its last: times (match_id, seg_id, t) with seen_s, x, y and
    the columns named in ``also`` there. Repeated times count once; a null time takes the last sample.

    Samples and times of a segment are merged in one falling order, in which the sample seen last before a time is the
    one wanted, so no time meets every sample.
    """
    cols, asked = ["x", "y", *also], [c for c in times.columns if c not in SEG]
    times = times.distinct()
    sample = F.struct("timestamp_s", *cols)
    s = segments.join(times.select(*SEG).distinct(), SEG, "left_semi").select(*SEG, F.col("timestamp_s").alias("_at"), F.lit(0).alias("_asked"), sample.alias("_sample"), F.lit(None).cast(times.select(F.struct(*asked)).schema[0].dataType).alias("_row"))
    q = times.select(*SEG, F.coalesce("t", F.lit(float("inf"))).alias("_at"), F.lit(1).alias("_asked"), F.lit(None).cast(s.schema["_sample"].dataType).alias("_sample"), F.struct(*asked).alias("_row"))
    w = Window.partitionBy(*SEG)
    falling = w.orderBy(F.desc("_at"), "_asked", F.desc("_sample")).rowsBetween(Window.unboundedPreceding, 0)
    p = F.coalesce("_seen", "_last")
    both = s.unionByName(q).withColumns({"_seen": F.last("_sample", ignorenulls=True).over(falling), "_last": F.max("_sample").over(w)}).where("_asked = 1")
    both = both.where(p.isNotNull())
    return both.select(*[c if c in SEG else F.col(f"_row.{c}").alias(c) for c in times.columns], p["timestamp_s"].alias("seen_s"), *[p[c].alias(c) for c in cols])


def displacement(segments: DataFrame, spans: DataFrame) -> DataFrame:
    """Straight distance between a segment's positions at t0 and t1: spans (match_id, seg_id, t0, t1), which differ.

    Both ends are asked at once, so the samples are gone through once.
    """
    ends = F.explode(F.array(F.struct(F.lit(0).alias("end"), F.col("t0").alias("t")), F.struct(F.lit(1).alias("end"), F.col("t1").alias("t"))))
    times = spans.where("t0 is not null and t1 is not null").select(*SEG, "t0", "t1", ends.alias("e")).select(*SEG, "t0", "t1", "e.end", "e.t")
    at = lambda k: F.max(F.when(F.col("end") == k, F.struct("x", "y"))).alias(f"p{k}")
    j = position_at(segments, times).groupBy(*SEG, "t0", "t1").agg(at(0), at(1)).where("p0 is not null and p1 is not null")
    dx, dy = F.col("p1.x") - F.col("p0.x"), F.col("p1.y") - F.col("p0.y")
    return j.select(*SEG, "t0", "t1", F.sqrt(dx * dx + dy * dy).alias("moved"))


def trajectories(segments: DataFrame, spans: DataFrame | None = None, most: int = 25) -> DataFrame:
    """Segments as at most ``most`` evenly chosen points [t, x, y], rounded to centimetres: whole ones, or what lies in
    ``spans`` (match_id, seg_id, t0, t1 and further columns, which stay)."""
    r = lambda c: F.floor(F.col(c) * 100 + 0.5).cast("double") / 100.0
    keys = [*SEG, "track_id"]
    if spans is not None:
        segments = segments.select(*keys, "timestamp_s", "x", "y").join(spans, SEG).where(F.col("timestamp_s").between(F.col("t0"), F.col("t1")))
        keys += [c for c in spans.columns if c not in SEG]
    g = segments.groupBy(*keys).agg(F.array_sort(F.collect_list(F.array(r("timestamp_s"), r("x"), r("y")))).alias("ps"))
    n = F.size("ps")
    chosen = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.get("ps", F.bround(i * (n - 1) / (most - 1)).cast("int")))
    return g.select(*keys, F.when(n > most, chosen).otherwise(F.col("ps")).alias("points"))
