"""Play events from segments and contexts.

Detectors take segments with their movement bounds (``segments.with_movement``) and return events of one shape:
``EVENT`` columns, with exact times t0 and t1, the segments that take part, and measures by name.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.shared import written
from .islands import changed, in_intervals, islands
from .scans import bound, pushes_taken, run_ins_taken, runs
from .segments import context_at, displacement, goal_distance, position_at, smooth, speed, with_movement

SEG = ["match_id", "seg_id"]
ROLES_HELD = "array<struct<track_id: int, from_role: string, to_role: string>>"
EVENT = ("match_id", "play_type", "team", "start_frame", "end_frame", "t0", "t1", "confidence", "seg_ids", "track_ids", "goal_x", "variant", "measures", "roles")
#: Names of plays and variants in results: fixed values.
SWAP, RUN_IN, PUSH, BREAK = "kreuzen", "einlaeufer", "parallelstoss", "tempogegenstoss"
SCISSORS, SEQUENTIAL = "kreuzen", "positionswechsel"


def measured(**of: Column) -> Column:
    """Numbers of an event by name."""
    return F.create_map(*[x for k, v in of.items() for x in (F.lit(k), v.cast("double"))])


def event(found: DataFrame, play_type: str, segs: list[str], tracks: list[str], measures: Column, variant: Column | None = None, roles: Column | None = None) -> DataFrame:
    """Detections in the common shape; ``segs`` and ``tracks`` name the columns of those that take part."""
    ids = lambda cols: F.array(*cols).cast("array<int>")
    none = F.lit(None)
    made = {"play_type": F.lit(play_type), "seg_ids": ids(segs), "track_ids": ids(tracks), "measures": measures, "variant": (none if variant is None else variant).cast("string"), "roles": (none if roles is None else roles).cast(ROLES_HELD)}
    return found.withColumns(made | ({} if "goal_x" in found.columns else {"goal_x": none.cast("double")})).select(*EVENT)


def team_pairs(segments: DataFrame, overlap_s: float) -> DataFrame:
    """Samples of two team mates in the same frames: columns of either segment end in _a and _b, seg_id_a < seg_id_b.

    A frame's samples of a team, a dozen at most, are brought together once and paired there. Segments that come dealt
    by match (``dealt``) are paired in place, and so are windows over the pairs.
    """
    cols = ["seg_id", "track_id", "x", "y", "vx", "vy", "seg_start", "seg_end", "move_start", "move_end"]
    s = segments.where("team in ('A', 'B')").select("match_id", "team", "frame_id", F.struct("timestamp_s", *cols, speed().alias("v")).alias("_s"))
    g = s.groupBy("match_id", "team", "frame_id").agg(F.collect_list("_s").alias("_b")).where(F.size("_b") > 1)
    side = lambda x: [F.col(f"_{x}.{c}").alias(f"{c}_{x}") for c in (*cols, "v")]
    shared = F.least("_a.seg_end", "_b.seg_end") - F.greatest("_a.seg_start", "_b.seg_start")
    p = g.select("match_id", "team", "frame_id", "_b", F.explode("_b").alias("_a")).select("match_id", "team", "frame_id", "_a", F.explode("_b").alias("_b"))
    p = p.where((F.col("_a.seg_id") < F.col("_b.seg_id")) & (F.col("_a.track_id") != F.col("_b.track_id")) & (shared >= overlap_s))
    return p.select("match_id", "team", "frame_id", F.col("_a.timestamp_s").alias("timestamp_s"), *side("a"), *side("b")).withColumn("dy", F.col("y_a") - F.col("y_b"))


PAIR = ["match_id", "seg_id_a", "seg_id_b"]


def swap_candidates(segments: DataFrame, around_s: float = 2.0, apart: float = 1.5, fast: float = 1.0, near: float = 4.0, window_s: float = 3.5) -> DataFrame:
    """Flips of the lateral order of two team mates who run, pass closely, and are clearly apart before and after.

    A flip is seen against the pair's frame before. A pair's samples are packed by bins of ``window_s``, and only flips
    fast and near enough look at the samples of their bin and the two beside it; there the separations and the frames
    of the event's window are found. Nothing but the samples is shuffled, and not even those if they come dealt by match.
    """
    p = team_pairs(segments, 0.8)
    w = Window.partitionBy(*PAIR).orderBy("frame_id")
    dx, dy = F.col("x_a") - F.col("x_b"), F.col("dy")
    p = p.withColumns({"dy0": F.lag("dy").over(w), "t_before": F.lag("timestamp_s").over(w), "distance": F.sqrt(dx * dx + dy * dy)})
    flip = (F.col("dy0") * dy < 0) & (F.greatest("v_a", "v_b") >= fast) & (F.col("distance") <= near)
    tc = (F.col("t_before") + F.col("timestamp_s")) / 2
    t0, t1 = F.least("move_start_a", "move_start_b"), F.greatest("move_end_a", "move_end_b")
    kept = ["team", "frame_id", "timestamp_s", "distance", *[f"{c}_{x}" for x in "ab" for c in ("track_id", "x", "y", "vy", "v")], "dy0", "dy"]
    of = F.struct(*kept, tc.alias("t_cross"), F.greatest(t0, tc - window_s).alias("t0"), F.least(t1, tc + window_s).alias("t1"))
    p = p.select(*PAIR, F.struct("timestamp_s", "frame_id", "dy").alias("sample"), F.when(flip, of).alias("flip"))

    at = lambda t, seen: F.struct(F.floor(t / window_s).alias("bin"), F.lit(seen).alias("seen"))
    places = F.filter(F.array(at(F.col("sample.timestamp_s"), True), at(F.col("flip.t_cross"), False)), lambda q: q["bin"].isNotNull())
    b = p.select(*PAIR, "sample", "flip", F.explode(places).alias("q")).groupBy(*PAIR, F.col("q.bin").alias("bin"))
    b = b.agg(F.collect_list(F.when(F.col("q.seen"), F.col("sample"))).alias("samples"), F.collect_list(F.when(~F.col("q.seen"), F.col("flip"))).alias("flips"))
    beside = Window.partitionBy(*PAIR).orderBy("bin").rangeBetween(-1, 1)
    f = b.withColumn("around", F.flatten(F.collect_list("samples").over(beside))).where(F.size("flips") > 0).select(*PAIR, "around", F.explode("flips").alias("f"))

    t_cross = F.col("f.t_cross")
    apart_by = lambda side, fits: F.array_max(F.transform(F.filter("around", lambda q: fits(q["timestamp_s"]) & (q["dy"] * side > 0)), lambda q: F.abs(q["dy"])))
    frames = F.transform(F.filter("around", lambda q: q["timestamp_s"].between(F.col("f.t0"), F.col("f.t1"))), lambda q: q["frame_id"])
    f = f.withColumns({
        "sep_before": apart_by(F.col("f.dy0"), lambda t: (t >= t_cross - around_s) & (t < t_cross)), "sep_after": apart_by(F.col("f.dy"), lambda t: (t > t_cross) & (t <= t_cross + around_s)),
        "start_frame": F.coalesce(F.array_min(frames), "f.frame_id"), "end_frame": F.coalesce(F.array_max(frames), "f.frame_id"),
    })
    return f.where((F.col("sep_before") >= apart) & (F.col("sep_after") >= apart)).select(*PAIR, "f.*", "sep_before", "sep_after", "start_frame", "end_frame").drop("dy0", "dy")


def swap_goal(candidates: DataFrame, contexts: DataFrame, positions: DataFrame, zone: tuple[float, float] = (4.0, 17.0), screen: int = 2) -> DataFrame:
    """Candidates with the goal they attack (goal_x): the context's, if it is their team's attack; without a context
    the goal of their half, if ``screen`` opponents stand closer to it than both. Both must be in the ``zone``."""
    c = context_at(candidates, contexts, "t_cross").withColumn("goal_x", F.coalesce("ctx_goal", F.when(F.col("x_a") + F.col("x_b") < 40, 0.0).otherwise(40.0)))
    d = [goal_distance(F.col(f"x_{s}"), F.col(f"y_{s}"), F.col("goal_x")) for s in "ab"]
    c = c.where(d[0].between(*zone) & d[1].between(*zone) & (F.col("ctx_team").isNull() | (F.col("ctx_team") == F.col("team"))))
    opponents = positions.select("match_id", "frame_id", F.when(F.col("team") == "A", "B").otherwise("A").alias("team"), "positions")
    closer = F.filter("positions", lambda p: goal_distance(p["x"], p["y"], F.col("goal_x")) < F.least(*d))
    c = c.join(opponents, ["match_id", "frame_id", "team"], "left").where(F.col("ctx_team").isNotNull() | (F.size(closer) >= screen))
    return c.drop("positions", "ctx_goal", "ctx_team")


def detect_swaps(segments: DataFrame, contexts: DataFrame, positions: DataFrame, rearm_s: float = 1.0, moved: float = 1.0) -> DataFrame:
    """Position swaps of two attackers who both move ``moved`` metres in the event; of a pair's flips closer than
    ``rearm_s`` to the last one taken, none counts."""
    c = written(swap_goal(swap_candidates(segments), contexts, positions), "swap-candidates")
    spans = lambda s: c.select("match_id", F.col(f"seg_id_{s}").alias("seg_id"), "t0", "t1")
    gone = displacement(segments, spans("a").unionByName(spans("b")).distinct())
    for s in "ab":
        c = c.join(gone.select("match_id", F.col("seg_id").alias(f"seg_id_{s}"), "t0", "t1", F.col("moved").alias(f"moved_{s}")), ["match_id", f"seg_id_{s}", "t0", "t1"])
    c = c.where(F.least("moved_a", "moved_b") >= moved)
    scissors = (F.least("v_a", "v_b") >= 1.2) & (F.col("vy_a") * F.col("vy_b") < 0) & (F.col("distance") <= 2.5)
    sure = 0.45 + 0.2 * F.least(F.lit(1.0), F.greatest("v_a", "v_b") / 3) + 0.15 * F.least(F.lit(1.0), F.least("sep_before", "sep_after") / 3) + F.when(scissors, 0.15).otherwise(0.0)
    c = c.withColumns({"confidence": F.least(F.lit(0.95), sure), "scissors": scissors})
    kept = ["team", "start_frame", "end_frame", "t0", "t1", "confidence", "goal_x", "scissors", "distance", "track_id_a", "track_id_b"]
    g = c.groupBy(*PAIR).agg(F.array_sort(F.collect_list(F.struct("timestamp_s", "t_cross", F.struct(*kept).alias("of")))).alias("flips"))
    taken = F.lit(float("-inf"))
    free = F.aggregate(F.transform("flips", lambda f: F.struct(f["timestamp_s"], f["t_cross"])), F.struct(taken.alias("next"), F.array().cast("array<boolean>").alias("out")),
                       lambda a, f: F.struct(F.when(f["timestamp_s"] >= a["next"], f["t_cross"] + rearm_s).otherwise(a["next"]).alias("next"), F.concat(a["out"], F.array(f["timestamp_s"] >= a["next"])).alias("out")), lambda a: a["out"])
    e = g.withColumn("_free", free).select(*PAIR, F.inline(F.arrays_zip("flips", "_free"))).where("_free").select(*PAIR, "flips.t_cross", "flips.of.*")
    variant = F.when(F.col("scissors"), SCISSORS).otherwise(SEQUENTIAL)
    return event(e, SWAP, ["seg_id_a", "seg_id_b"], ["track_id_a", "track_id_b"], measured(cross_time_s=F.col("t_cross"), pair_distance_m=F.col("distance")), variant)


RUN_IN_SCAN = "match_id string, team string, seg_id int, track_id int, start_frame int, end_frame int, t0 double, t1 double, confidence double, goal_x double, start_dist_m double, end_dist_m double"


def detect_run_ins(segments: DataFrame, contexts: DataFrame) -> DataFrame:
    """Runs of an attacker from the back line (9.5 to 17 m) to within 7.5 m of the goal, held there for a second.

    Contexts are met in Spark; the scan, whose steps depend on where the last run ended, takes the segments of one team
    and match one after another, and only those that are in their attack far enough out and come near a goal.
    """
    s = context_at(segments.where("team in ('A', 'B')"), contexts).withColumn("goal_x", F.when(F.col("ctx_team") == F.col("team"), F.col("ctx_goal")))
    d = {g: goal_distance(F.col("x"), F.col("y"), F.lit(g)) for g in (0.0, 40.0)}
    s = s.withColumns({"d0": d[0.0], "d40": d[40.0]})
    own = F.when(F.col("goal_x") == 0, F.col("d0")).otherwise(F.col("d40"))
    whole = Window.partitionBy(*SEG)
    far, near = F.max(F.when(F.col("goal_x").isNotNull(), own)).over(whole), F.min(F.least("d0", "d40")).over(whole)
    rows = s.withColumns({"far": far, "near": near}).where("far > 9.5 and near < 7.5")
    rows = rows.select(*SEG, "team", "track_id", "frame_id", "timestamp_s", "goal_x", "d0", "d40", "move_start", "move_start_frame")
    e = rows.groupBy("match_id", "team").applyInPandas(_run_ins, RUN_IN_SCAN)
    return event(e, RUN_IN, ["seg_id"], ["track_id"], measured(start_dist_m=F.col("start_dist_m"), end_dist_m=F.col("end_dist_m")))


def _run_ins(pdf: pd.DataFrame) -> pd.DataFrame:
    c = {n: v.to_numpy() for n, v in pdf.sort_values(["seg_id", "frame_id"]).items()}
    lo, hi = runs(c["seg_id"])
    s, t, goal = np.repeat(np.arange(len(lo)), hi - lo), c["timestamp_s"], c["goal_x"]
    i, end, far, near, sure = run_ins_taken(t, goal, np.stack([c["d0"], c["d40"]]), s, hi[s])
    of = (c[n][i] for n in ("match_id", "team", "seg_id", "track_id", "move_start_frame"))
    return pd.DataFrame(dict(zip((n.split()[0] for n in RUN_IN_SCAN.split(", ")), (*of, c["frame_id"][end], c["move_start"][i], t[end], sure, goal[i], far, near), strict=True)))


PUSH_SCAN = "match_id string, team string, seg_id_a int, seg_id_b int, track_id_a int, track_id_b int, t0 double, t1 double, confidence double, goal_x double, approach_m double, start_frame int, end_frame int"


def detect_pushes(segments: DataFrame, contexts: DataFrame) -> DataFrame:
    """Two attackers side by side (1.5 to 8 m apart, 7 to 17 m out) who both near the goal by 2 m within 2.5 s, each at
    1.2 m a second at some time, in the order they began.

    Pairs and contexts are formed in Spark, and pairs without a place to start dropped; the scan, whose steps depend on
    where the last push ended, takes the pairs of one team and match one after another.
    """
    p = team_pairs(segments, 1.0)
    p = context_at(p, contexts).withColumn("goal_x", F.when(F.col("ctx_team") == F.col("team"), F.col("ctx_goal")))
    p = p.withColumns({f"d{g:.0f}_{s}": goal_distance(F.col(f"x_{s}"), F.col(f"y_{s}"), F.lit(g)) for g in (0.0, 40.0) for s in "ab"})
    own = lambda s: F.when(F.col("goal_x") == 0, F.col(f"d0_{s}")).otherwise(F.col(f"d40_{s}"))
    start = F.col("goal_x").isNotNull() & own("a").between(7, 17) & own("b").between(7, 17) & F.abs("dy").between(1.5, 8)
    p = p.withColumn("start", start)
    whole = Window.partitionBy(*PAIR)
    able = {"_n": F.count("*"), "_any": F.max("start"), "_va": F.max("v_a"), "_vb": F.max("v_b")}
    p = p.withColumns({c: a.over(whole) for c, a in able.items()}).where("_n >= 5 and _any and _va >= 1.2 and _vb >= 1.2")
    cols = ["frame_id", "timestamp_s", "dy", "start", "goal_x", "d0_a", "d0_b", "d40_a", "d40_b", "v_a", "v_b", "move_start_a", "move_start_b", "move_end_a", "move_end_b"]
    e = p.select(*PAIR, "team", "track_id_a", "track_id_b", *cols).groupBy("match_id", "team").applyInPandas(_pushes, PUSH_SCAN)
    return event(e, PUSH, ["seg_id_a", "seg_id_b"], ["track_id_a", "track_id_b"], measured(approach_m=F.col("approach_m")))


def _pushes(pdf: pd.DataFrame) -> pd.DataFrame:
    c = {n: v.to_numpy() for n, v in pdf.sort_values(["seg_id_a", "seg_id_b", "frame_id"]).items()}
    lo, hi = runs(c["seg_id_a"], c["seg_id_b"])
    of, t, frame = np.repeat(np.arange(len(lo)), hi - lo), c["timestamp_s"], c["frame_id"]
    d = np.stack([[c[f"d{z}_{s}"] for z in (0, 40)] for s in "ab"])
    k, last, gain, pace = pushes_taken(t, c["dy"], (c["goal_x"] == 40).astype(int), c["start"].astype(bool), d, (c["v_a"], c["v_b"]), of, lo[of], hi[of])
    t0 = np.maximum(np.minimum(c["move_start_a"][last], c["move_start_b"][last]), t[k] - 3.0)
    t1 = np.minimum(np.maximum(c["move_end_a"][last], c["move_end_b"][last]), t[last] + 3.0)
    sure = np.minimum(0.95, 0.45 + 0.2 * np.minimum(1.0, gain / 4) + 0.15 * np.minimum(1.0, pace / 3))
    i, j = bound(lo[of[k]], hi[of[k]], lambda q: t[q] < t0), bound(lo[of[k]], hi[of[k]], lambda q: t[q] <= t1) - 1
    who = (c[n][k] for n in ("match_id", "team", "seg_id_a", "seg_id_b", "track_id_a", "track_id_b"))
    cols = (*who, t0, t1, sure, c["goal_x"][k], gain, frame[np.where(i <= j, i, k)], frame[np.where(i <= j, j, last)])
    return pd.DataFrame(dict(zip((n.split()[0] for n in PUSH_SCAN.split(", ")), cols, strict=True)))


def centroid_series(rows: DataFrame, least: int = 3) -> DataFrame:
    """Smoothed mean x of each team by frame, where enough players are seen; series of five points at least."""
    g = rows.where("team in ('A', 'B')").groupBy("match_id", "team", "frame_id", "timestamp_s").agg(F.avg("x").alias("x"), F.count("*").alias("n")).where(F.col("n") >= least)
    long = F.count("*").over(Window.partitionBy("match_id", "team"))
    return smooth(g.withColumn("_n", long).where("_n >= 5").drop("_n", "n"), ["match_id", "team"], ["x"])


def attacking_after(points: DataFrame, contexts: DataFrame, at: str = "timestamp_s", wait_s: float = 4.0) -> DataFrame:
    """Adds next_team and next_goal: those of the first attack that ends after a time, if it begins up to ``wait_s``
    after it; null otherwise.

    Contexts are laid among the points by their ends, and each point takes the next one: a union and one window
    instead of a range join.
    """
    end = contexts.select("match_id", F.col("end_s").alias(at), F.struct("start_s", F.col("team").alias("t"), F.col("goal").alias("g")).alias("_next"))
    both = points.withColumn("_point", F.lit(1)).unionByName(end.withColumn("_point", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy("match_id").orderBy(F.desc(at), F.desc("_point")).rowsBetween(Window.unboundedPreceding, 0)
    p = both.withColumn("_next", F.last("_next", ignorenulls=True).over(w)).where("_point = 1")
    soon = F.col("_next.start_s") <= F.col(at) + wait_s
    return p.withColumns({"next_team": F.when(soon, F.col("_next.t")), "next_goal": F.when(soon, F.col("_next.g"))}).drop("_next", "_point")


BREAK_SCAN = "match_id string, team string, start_frame int, end_frame int, t0 double, t1 double, confidence double, goal_x double, distance_m double, mean_speed_ms double"


def detect_fast_breaks(series: DataFrame, contexts: DataFrame) -> DataFrame:
    """Runs of a team's centroid over the middle at 2 m a second or more, 12 m in up to 10 s, after which the first
    attack within 4 s is that team's on that goal, or none is seen.

    What comes after each sample is found in Spark; the scan takes many series at a time, laid end to end.
    """
    own = lambda goal: F.col("next_team").isNull() | (F.col("next_team") == F.col("team")) & F.coalesce(F.col("next_goal") == goal, F.lit(False))
    sample = F.struct("frame_id", "timestamp_s", "x", own(40.0).alias("right"), own(0.0).alias("left"))
    s = attacking_after(series, contexts).groupBy("match_id", "team").agg(F.sort_array(F.collect_list(sample)).alias("s"))
    e = s.select("match_id", "team", "s.frame_id", "s.timestamp_s", "s.x", "s.right", "s.left").mapInArrow(_breaks, BREAK_SCAN)
    return event(e, BREAK, [], [], measured(distance_m=F.col("distance_m"), mean_speed_ms=F.col("mean_speed_ms")))


def _run_ends(t: np.ndarray, tempo: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """From each sample, the last fast sample before the run pauses for more than 0.6 s or the series breaks (after the
    samples in ``apart``); the sample itself where no run begins in time."""
    at = np.arange(len(t))
    fast = np.setdiff1d(np.flatnonzero(tempo >= 2.0), apart)
    if not len(fast):
        return at
    part = np.searchsorted(apart, fast)
    over = np.append((np.diff(part) != 0) | (t[fast[1:]] - t[fast[:-1] + 1] > 0.6), True)
    end = fast[np.flatnonzero(over)[np.searchsorted(np.flatnonzero(over), np.arange(len(fast)))]] + 1
    k = np.searchsorted(fast, at)
    near = np.minimum(k, len(fast) - 1)
    begins = (k < len(fast)) & (part[near] == np.searchsorted(apart, at)) & (t[fast[near]] - t <= 0.6)
    return np.where(begins, end[near], at)


def _breaks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Breaks of series that come as lists of their samples in order."""
    for b in batches:
        f, t, x, *free = (b.column(k).flatten().to_numpy(zero_copy_only=False) for k in range(2, 7))
        sizes = pc.list_value_length(b.column(2)).to_numpy()
        i, end, sure, to, gone, pace = breaks_in(sizes, t, x, *free)
        who = [b.column(k).take(pa.array(np.repeat(np.arange(len(sizes)), sizes)[i])) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays([*who, *map(pa.array, (f[i].astype(np.int32), f[end].astype(np.int32), t[i], t[end], sure, to, gone, pace))], [c.split()[0] for c in BREAK_SCAN.split(", ")])


def breaks_in(sizes: np.ndarray, t: np.ndarray, x: np.ndarray, right: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, ...]:
    """Breaks of series laid end to end, and whether a break that ends at a sample may go right or left: first and last
    sample, confidence, goal, metres, metres a second."""
    dt = np.diff(t)
    tempo = np.divide(np.diff(x), dt, out=np.zeros(len(dt)), where=dt > 0)
    apart = np.unique(np.concatenate((np.flatnonzero((dt <= 0) | (dt > 1.2)), np.cumsum(sizes) - 1)))
    hits = []
    for sign, to, free in ((1, 40.0, right), (-1, 0.0, left)):
        end = _run_ends(t, sign * tempo, apart)
        gone, took = sign * (x[end] - x), t[end] - t
        pace = np.divide(gone, took, out=np.zeros(len(t)), where=took > 0)
        ok = np.flatnonzero((sign * (x - 20) < 0) & (gone >= 12) & (took > 0) & (took <= 10) & (sign * (x[end] - 20) > 2) & (pace <= 7) & free[end])
        hits += zip(ok.tolist(), end[ok].tolist(), gone[ok].tolist(), pace[ok].tolist(), repeat(to))
    taken, last = [], -1
    for hit in sorted(hits):
        if hit[0] > last:
            taken.append(hit)
            last = hit[1]
    i, end, gone, pace, to = (np.array(v) for v in zip(*taken, strict=True)) if taken else (np.empty(0, d) for d in (int, int, float, float, float))
    return i, end, np.minimum(0.95, 0.5 + 0.2 * np.minimum(1.0, pace / 4) + 0.2 * gone / 30), to, gone, pace


#: Attack positions as (depth from the goal, lateral offset to the attacker's right): fixed values.
SLOTS = {"LA": (3.0, -8.0), "RL": (10.5, -4.5), "RM": (11.5, 0.0), "RR": (10.5, 4.5), "RA": (3.0, 8.0), "KM": (6.0, 0.0)}
PIVOT = "KM"
BACK = [r for r in SLOTS if r != PIVOT]


def role_slot(role: str, goal_x: float) -> tuple[float, float]:
    """Where a role stands on the court in an attack on a goal; left is the attacker's, facing the goal."""
    depth, right = SLOTS[role]
    return (depth, 10.0 - right) if goal_x == 0 else (40.0 - depth, 10.0 + right)


def role_template(spark: SparkSession) -> DataFrame:
    """The twelve places of the six roles: goal_x, role, x, y."""
    return spark.createDataFrame([(g, r, *role_slot(r, g)) for g in (0.0, 40.0) for r in SLOTS], "goal_x double, role string, x double, y double")


def assign_roles(segments: DataFrame, contexts: DataFrame, bin_s: float = 0.5, most: float = 8.0) -> DataFrame:
    """Roles of the attacking team's segments in the middle of each half second: match_id, seg_id, t, role.

    Each bin's players take the six slots so that the distances add up to the least; one beyond ``most`` metres of its
    slot, or without one, has a null role. A sample stands for the bins between the sample before and itself, so
    players and contexts meet on bin numbers.
    """
    middle = lambda b: (b + 0.5) * bin_s
    number = lambda c: c / bin_s - 0.5
    c = contexts.select("match_id", "team", F.col("goal").alias("goal_x"), F.explode(F.sequence(F.ceil(number(F.col("start_s"))), F.ceil(number(F.col("end_s"))) - 1)).alias("bin"))
    w = Window.partitionBy(*SEG).orderBy("frame_id")
    first = F.coalesce(F.floor(number(F.lag("timestamp_s").over(w))) + 1, F.ceil(number(F.col("timestamp_s"))))
    s = segments.where("team in ('A', 'B')").select(*SEG, "team", "x", "y", first.alias("b0"), F.floor(number(F.col("timestamp_s"))).alias("b1")).where("b0 <= b1")
    s = s.select(*SEG, "team", "x", "y", F.explode(F.sequence("b0", "b1")).alias("bin")).join(c, ["match_id", "team", "bin"])
    far = lambda at: F.sqrt((F.col("x") - at[0]) * (F.col("x") - at[0]) + (F.col("y") - at[1]) * (F.col("y") - at[1]))
    costs = F.when(F.col("goal_x") == 0, F.array(*[far(role_slot(r, 0.0)) for r in SLOTS])).otherwise(F.array(*[far(role_slot(r, 40.0)) for r in SLOTS]))
    g = s.groupBy("match_id", "bin").agg(F.sort_array(F.collect_list(F.struct("seg_id", costs.alias("costs")))).alias("players"))
    g = g.withColumn("slot", _least_total(F.flatten(F.transform("players", lambda p: p["costs"]))))
    p = g.select("match_id", middle(F.col("bin")).alias("t"), F.inline(F.arrays_zip(F.col("players.seg_id").alias("seg_id"), F.col("players.costs").alias("costs"), "slot")))
    role = F.when(F.get("costs", "slot") <= most, F.get(F.array(*[F.lit(r) for r in SLOTS]), F.col("slot")))
    return p.select("match_id", "seg_id", "t", role.alias("role"))


def _least_total(costs: Column) -> Column:
    """The slot (or -1) of each player of a bin, with the least total cost: an exact subset recursion over 64 sets.

    A bin's costs come as one list, player after player.
    """

    @F.pandas_udf("array<int>")
    def matched(bins: pd.Series) -> pd.Series:
        held, out = bins.to_numpy(), np.empty(len(bins), object)
        size = np.array([len(b) for b in held], int)
        for n in np.unique(size):
            at = np.flatnonzero(size == n)
            cost = np.concatenate(held[at]).reshape(len(at), n // len(SLOTS), len(SLOTS))
            for i, row in zip(at.tolist(), slots_of_least_total(cost).astype(np.int32), strict=True):
                out[i] = row
        return pd.Series(out, index=bins.index)

    return matched(costs)


def slots_of_least_total(cost: np.ndarray) -> np.ndarray:
    """For each of several bins, players by slots of costs: each player's slot, -1 where slots run out."""
    bins, n, k = cost.shape
    if n <= k:
        return _all_placed(cost)
    sets = np.arange(1 << k)
    held = np.array([bin(x).count("1") for x in sets])
    best, steps = np.where(sets == 0, 0.0, np.inf) * np.ones((bins, 1)), []
    for p in range(n):
        ways = np.concatenate([best[:, None, :], np.full((bins, k, len(sets)), np.inf)], axis=1)
        for r in range(k):
            with_r = sets[sets >> r & 1 == 1]
            ways[:, r + 1, with_r] = best[:, with_r ^ (1 << r)] + cost[:, p, r, None]
        steps.append(ways.argmin(axis=1))
        best = ways.min(axis=1)
    at = np.where(held == min(n, k), best, np.inf).argmin(axis=1)
    out = np.empty((bins, n), int)
    for p in range(n - 1, -1, -1):
        out[:, p] = steps[p][np.arange(bins), at] - 1
        at = np.where(out[:, p] >= 0, at ^ (1 << np.maximum(out[:, p], 0)), at)
    return out


def _all_placed(cost: np.ndarray) -> np.ndarray:
    """The same where no player is left over: after p players only sets of p slots have to be looked at."""
    bins, n, k = cost.shape
    best, steps = {0: np.zeros(bins)}, []
    for p in range(n):
        then, step = {}, np.zeros((bins, 1 << k), np.int8)
        for x in (x for x in range(1 << k) if x.bit_count() == p + 1):
            for r in (r for r in range(k) if x >> r & 1):
                total = best[x ^ 1 << r] + cost[:, p, r]
                if x not in then:
                    then[x], step[:, x] = total, r
                    continue
                less = total < then[x]
                then[x] = np.where(less, total, then[x])
                step[less, x] = r
        best = then
        steps.append(step)
    sets = np.array(list(best))
    at = sets[np.array([best[x] for x in best]).argmin(axis=0)]
    out = np.empty((bins, n), int)
    for p in range(n - 1, -1, -1):
        out[:, p] = steps[p][np.arange(bins), at]
        at = at ^ 1 << out[:, p]
    return out


def stable_runs(timeline: DataFrame, least_s: float = 0.9, gap_s: float = 1.5) -> DataFrame:
    """Runs of one role of a segment over its timeline (match_id, seg_id, t, role); null roles are not kept."""
    w = Window.partitionBy(*SEG).orderBy("t")
    r = islands(timeline, SEG, "t", changed("role", SEG, "t") | (F.col("t") - F.lag("t").over(w) > gap_s))
    g = r.groupBy(*SEG, "island", "role").agg(F.min("t").alias("start_s"), F.max("t").alias("end_s"))
    return g.where(F.col("role").isNotNull() & (F.col("end_s") - F.col("start_s") >= least_s)).drop("island")


def role_transitions(runs: DataFrame, gap_s: float = 3.0) -> DataFrame:
    """Consecutive runs of a segment in different roles, at most ``gap_s`` apart."""
    w = Window.partitionBy(*SEG).orderBy("start_s")
    n = runs.withColumns({"to_role": F.lead("role").over(w), "to_start_s": F.lead("start_s").over(w), "to_end_s": F.lead("end_s").over(w)})
    return n.where((F.col("to_role") != F.col("role")) & (F.col("to_start_s") - F.col("end_s") <= gap_s)).select(*SEG, F.col("role").alias("from_role"), "to_role", "end_s", "to_start_s", "to_end_s")


def _seen(df: DataFrame, segments: DataFrame, *asked: tuple[str, str, str, str]) -> DataFrame:
    """``df``, whose rows differ, with columns of segments as they are at times: each asks (segment, time, column, new name).

    All questions of all rows meet the samples in one pass, and ``df`` is written: a pass has several uses of it, so
    passes after one another would else repeat all that is before them.
    """
    df = written(df, "asked")
    each = F.array(*[F.struct(F.lit(k).alias("ask"), F.col(seg).alias("seg_id"), F.col(at).alias("t")) for k, (seg, at, _, _) in enumerate(asked)])
    times = df.select("match_id", F.struct(*df.columns).alias("of"), F.explode(each).alias("q")).select("match_id", "of", "q.*")
    p = position_at(segments, times, tuple(dict.fromkeys(c for _, _, c, _ in asked)))
    g = p.groupBy("of").agg(*[F.max(F.when(F.col("ask") == k, F.struct(F.col(c).alias("v")))).alias(new) for k, (_, _, c, new) in enumerate(asked)]).dropna()
    return g.select("of.*", *[F.col(f"{new}.v").alias(new) for *_, new in asked])


def _moving(segments: DataFrame, asked: DataFrame) -> DataFrame:
    """The ``asked`` ones of segments, with their movement bounds, which are only found for these where they are missing."""
    mine = segments.join(asked.select(*SEG).distinct(), SEG, "left_semi")
    return mine if "move_start" in segments.columns else with_movement(mine)


def exchanged(seg: list[int], source: list, to: list, left: list[float], settled: list[float]) -> list[tuple[int, int, float]]:
    """Transitions between the same two roles, in order of segment and time, each with the first later one the other way
    by another segment, and the confidence."""
    mid, free, out = [(a + b) / 2 for a, b in zip(left, settled, strict=True)], [True] * len(seg), []
    for i in range(len(seg)):
        j = next((j for j in range(i + 1, len(seg)) if free[j] and seg[j] != seg[i] and source[j] == to[i] and abs(mid[j] - mid[i]) <= 3.0), None) if free[i] else None
        if j is not None:
            free[i] = free[j] = False
            out.append((i, j, 0.75 if abs(mid[i] - mid[j]) <= 1.5 else 0.6))
    return out


def _exchanges(pdf: pd.DataFrame) -> pd.DataFrame:
    rows = pdf.sort_values(["seg_id", "end_s"])
    seg, source, to, left, settled = (rows[c].tolist() for c in ("seg_id", "from_role", "to_role", "end_s", "to_start_s"))
    who = (rows["match_id"].iloc[0], rows["team"].iloc[0])
    out = [(*who, seg[i], seg[j], source[i], to[i], left[i], settled[i], left[j], settled[j], sure) for i, j, sure in exchanged(seg, source, to, left, settled)]
    return pd.DataFrame(out, columns=[c.split()[0] for c in EXCHANGE.split(", ")])


EXCHANGE = "match_id string, team string, seg_id_a int, seg_id_b int, from_role string, to_role string, leave_a double, settle_a double, leave_b double, settle_b double, confidence double"


def detect_role_swaps(segments: DataFrame, transitions: DataFrame) -> DataFrame:
    """Two team mates who exchange back roles within 3 s of each other; each transition counts once.

    Only transitions between the same two roles compete, so these are taken in turn, in the order of segments.
    """
    back = written(transitions.where(F.col("from_role").isin(BACK) & F.col("to_role").isin(BACK)), "back-transitions")
    who = segments.join(back.select(*SEG).distinct(), SEG, "left_semi").select(*SEG, "team", "track_id").distinct()
    back = back.join(who.drop("track_id"), SEG)
    back = back.withColumns({"_r0": F.least("from_role", "to_role"), "_r1": F.greatest("from_role", "to_role")})
    e = back.groupBy("match_id", "team", "_r0", "_r1").applyInPandas(_exchanges, EXCHANGE)
    bounds = [(f"seg_id_{s}", at.format(s), col, new.format(s)) for s in "ab" for at, col, new in (("leave_{}", "move_start", "t0_{}"), ("settle_{}", "move_end", "t1_{}"))]
    e = written(e, "exchanges")
    mine = written(_moving(segments, reduce(DataFrame.unionByName, [e.select("match_id", F.col(f"seg_id_{s}").alias("seg_id")) for s in "ab"])), "moving")
    who = mine.select(*SEG, "team", "track_id").distinct()
    e = _seen(e, mine, *bounds)
    for s in "ab":
        e = e.join(who.select("match_id", F.col("seg_id").alias(f"seg_id_{s}"), F.col("track_id").alias(f"track_id_{s}")), ["match_id", f"seg_id_{s}"])
    e = e.withColumns({"t0": F.least("t0_a", "t0_b"), "t1": F.greatest("t1_a", "t1_b")})
    e = _seen(e, mine, ("seg_id_a", "t0", "frame_id", "start_frame"), ("seg_id_a", "t1", "frame_id", "end_frame"))
    held = lambda t, a, b: F.struct(F.col(t).alias("track_id"), F.col(a).alias("from_role"), F.col(b).alias("to_role"))
    roles = F.array(held("track_id_a", "from_role", "to_role"), held("track_id_b", "to_role", "from_role"))
    return event(e, SWAP, ["seg_id_a", "seg_id_b"], ["track_id_a", "track_id_b"], F.lit(None).cast("map<string, double>"), F.lit("rollentausch"), roles)


def detect_role_runins(segments: DataFrame, transitions: DataFrame, hold_s: float = 1.2) -> DataFrame:
    """Segments that change from a back role to the pivot's and keep that for ``hold_s``."""
    e = written(transitions.where(F.col("from_role").isin(BACK) & (F.col("to_role") == PIVOT) & (F.col("to_end_s") - F.col("to_start_s") >= hold_s)), "pivots")
    mine = written(_moving(segments, e), "moving")
    e = e.join(mine.select(*SEG, "team", "track_id", "seg_end").distinct(), SEG)
    e = _seen(e, mine, ("seg_id", "end_s", "move_start", "t0"), ("seg_id", "to_start_s", "move_end", "t1"))
    e = e.withColumn("t1", F.greatest("t1", F.least(F.col("to_start_s") + 1.0, "seg_end"))).withColumn("confidence", F.lit(0.65))
    e = _seen(e, mine, ("seg_id", "t0", "frame_id", "start_frame"), ("seg_id", "t1", "frame_id", "end_frame"))
    return event(e, RUN_IN, ["seg_id"], ["track_id"], F.lit(None).cast("map<string, double>"), F.lit("rollenwechsel"), F.array(F.struct("track_id", "from_role", "to_role")))


def merge_events(events: DataFrame, pause_s: float = 1.0, order: tuple[str, ...] = ("event_id",)) -> DataFrame:
    """Events of a type and team that follow within ``pause_s`` as one, numbered by start.

    It has the start of the first, the latest end, the best confidence, the details of the (first) event that has it,
    and all tracks in order of appearance. ``order`` breaks ties of starts; details and tracks are merged where the
    events have them.
    """
    keys = ["match_id", "play_type", "team"]
    by = ["start_time_s", *order]
    w = Window.partitionBy(*keys).orderBy(*by)
    top = F.max("end_time_s").over(w.rowsBetween(Window.unboundedPreceding, -1))
    r = islands(events, keys, by, F.col("start_time_s") > top + pause_s).withColumn("_place", F.row_number().over(w))
    details = [c for c in ("goal_x", "variant", "measures", "roles", "tracks") if c in events.columns]
    best = F.struct("confidence", (-F.col("_place")).alias("p"))
    aggs = [F.min_by("start_frame", "_place").alias("start_frame"), F.max("end_frame").alias("end_frame"), F.min("start_time_s").alias("start_time_s"), F.max("end_time_s").alias("end_time_s"), F.max("confidence").alias("confidence"), F.count("*").alias("merged")]
    aggs += [F.max_by(F.struct(*details), best).alias("_details")] if details else []
    aggs += [F.array_distinct(F.flatten(F.array_sort(F.collect_list(F.struct("_place", "track_ids")))["track_ids"])).alias("track_ids")] if "track_ids" in events.columns else []
    g = r.groupBy(*keys, "island").agg(*aggs)
    g = g.select("*", "_details.*").drop("_details") if details else g
    rank = F.row_number().over(Window.partitionBy("match_id").orderBy("start_time_s", "play_type", "team", "island")) - 1
    return g.withColumn("event_id", rank.cast("long")).drop("island")


def attack_sequences(contexts: DataFrame, goals: DataFrame, readings: DataFrame, least_s: float = 4.0, after_s: float = 6.0) -> DataFrame:
    """Long contexts numbered in order, with their outcome: unknown without a scoreboard, else goal or no_goal."""
    c = contexts.where(F.col("end_s") - F.col("start_s") >= least_s)
    c = c.withColumn("sequence_id", (F.row_number().over(Window.partitionBy("match_id").orderBy("start_s")) - 1).cast("long"))
    seen = readings.select("match_id", F.lit(True).alias("read")).distinct()
    late = c.select("match_id", "sequence_id", F.col("start_s").alias("_from"), (F.col("end_s") + after_s).alias("_to"))
    hit = in_intervals(goals.select("match_id", "timestamp_sec"), late, ["match_id"], "timestamp_sec", "_from", "_to", 10).select("match_id", "sequence_id", F.lit(True).alias("hit")).distinct()
    j = c.join(seen, "match_id", "left").join(hit, ["match_id", "sequence_id"], "left")
    return j.withColumn("outcome", F.when(F.col("read").isNull(), "unknown").when(F.col("hit"), "goal").otherwise("no_goal")).drop("read", "hit")


def link_events(events: DataFrame, sequences: DataFrame, lead_s: float = 2.0, width: int = 10) -> DataFrame:
    """Each event's sequence: the first of its team that it touches, or that begins up to ``lead_s`` after its end.

    Events and sequences are laid out over bins of ``width`` seconds and meet there.
    """
    bins = lambda a, b: F.explode(F.sequence(F.floor(a / width), F.floor(b / width))).alias("bin")
    e = events.select("match_id", "event_id", "team", "start_time_s", "end_time_s", bins(F.col("start_time_s"), F.col("end_time_s") + lead_s))
    s = sequences.select("match_id", "team", F.col("start_time_s").alias("s0"), F.col("end_time_s").alias("s1"), "sequence_id", bins(F.col("start_time_s"), F.col("end_time_s")))
    met = e.join(s, ["match_id", "team", "bin"]).where((F.col("end_time_s") >= F.col("s0") - lead_s) & (F.col("start_time_s") <= F.col("s1")))
    first = met.groupBy("match_id", "event_id").agg(F.min("sequence_id").alias("sequence_id"))
    return events.select("match_id", "event_id").join(first, ["match_id", "event_id"], "left")


def analyze_match(rows: DataFrame, goals: DataFrame, readings: DataFrame, parts: int | None = None) -> tuple[DataFrame, DataFrame]:
    """All plays and attack sequences of many matches: (events, sequences).

    rows: match_id, frame_id, timestamp_s, track_id, team, x, y, which are dealt by match over ``parts`` partitions, where
    that is given; goals: match_id, timestamp_sec; readings: the matches with a scoreboard.
    """
    from .matches import packed, scan

    return analyze(scan(packed(rows, parts), whole=True), goals, readings)


def analyze(found: DataFrame, goals: DataFrame, readings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events and sequences from what ``matches.scan`` finds in whole matches: events carry their details, tracks and
    sequence; sequences their frames, outcome and event_count. Plays are few, and written, since they have several uses."""
    found = written(found, "plays")
    key = F.row_number().over(Window.partitionBy("match_id").orderBy("source", "t0", "seg_ids", "t1"))
    events = found.where("source >= 0").withColumn("key", key)
    rest = [c for c in events.columns if c not in ("t0", "t1", "confidence")]
    events = events.select(*rest, *[F.round(c, 3).alias(n) for c, n in (("t0", "start_time_s"), ("t1", "end_time_s"), ("confidence", "confidence"))])
    merged = written(merge_events(events, order=("source", "key")), "events")
    c = found.where("source < 0").select("match_id", "goal_x", "team", F.col("t0").alias("start_s"), F.col("t1").alias("end_s"), "start_frame", "end_frame")
    c = attack_sequences(c, goals, readings).withColumnsRenamed({"start_s": "start_time_s", "end_s": "end_time_s"})
    sequences = written(c.select("match_id", "sequence_id", "goal_x", "team", "start_time_s", "end_time_s", "outcome", "start_frame", "end_frame"), "sequences")
    events = merged.join(link_events(merged, sequences), ["match_id", "event_id"])
    counts = events.groupBy("match_id", "sequence_id").agg(F.count("*").alias("event_count"))
    return events, sequences.join(counts, ["match_id", "sequence_id"], "left").withColumn("event_count", F.coalesce("event_count", F.lit(0)).cast("long"))
