"""Track repair: ghosts, id switches, gaps, velocities, possession, goals, throws."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.court import distance
from ..sources.shared import written
from .islands import in_intervals

FRAME = ["match_id", "frame_id"]
TRACK = ["match_id", "track_id"]


def _centred(players: DataFrame) -> DataFrame:
    return players.withColumn("cx", (F.col("bbox_x1") + F.col("bbox_x2")) / 2).withColumn("cy", (F.col("bbox_y1") + F.col("bbox_y2")) / 2)


def ghost_assignments(players: DataFrame, threshold: int = 10, max_dist: float = 150.0) -> DataFrame:
    """Each ghost detection with the stable track it is taken for, null where it is dropped.

    A ghost's track has fewer frames than ``threshold``. Candidates are stable tracks not in that frame; the nearest
    mean position within ``max_dist`` wins (ties: lowest id). A stable track takes one ghost a frame, the lowest
    track id; the others are dropped. Ghosts meet the mean positions of stable tracks, of which there is one a track,
    in cells of ``max_dist``: a mean is known in its own cell and the eight around it.
    """
    tracks = _centred(players).groupBy(*TRACK).agg(F.count_distinct("frame_id").alias("n"), F.avg("cx").alias("mx"), F.avg("cy").alias("my"))
    cell = lambda c: F.floor(F.col(c) / max_dist)
    near = lambda c: F.explode(F.sequence(cell(c) - 1, cell(c) + 1))
    stable = tracks.where(F.col("n") >= threshold).withColumnRenamed("track_id", "target").withColumn("gx", near("mx")).withColumn("gy", near("my")).drop("n")
    ghosts = _centred(players.join(tracks.where(F.col("n") < threshold), TRACK, "left_semi")).select(*FRAME, "track_id", "cx", "cy", cell("cx").alias("gx"), cell("cy").alias("gy"))
    pairs = ghosts.join(stable, ["match_id", "gx", "gy"]).withColumn("dist", distance(F.col("cx"), F.col("cy"), F.col("mx"), F.col("my"))).where(F.col("dist") <= max_dist)
    present = players.select(*FRAME, F.col("track_id").alias("target"))
    pairs = pairs.join(present, [*FRAME, "target"], "left_anti")
    nearest = pairs.groupBy(*FRAME, "track_id").agg(F.min(F.struct("dist", "target")).alias("b")).select(*FRAME, "track_id", F.col("b.target").alias("target"))
    winner = nearest.groupBy(*FRAME, "target").agg(F.min("track_id").alias("track_id"))
    return ghosts.select(*FRAME, "track_id").join(winner, [*FRAME, "track_id"], "left")


def filter_ghosts(players: DataFrame, threshold: int = 10, max_dist: float = 150.0) -> DataFrame:
    """Players with ghosts renamed to their stable track or dropped."""
    a = ghost_assignments(players, threshold, max_dist).withColumn("_ghost", F.lit(True))
    j = players.join(a, [*FRAME, "track_id"], "left")
    return j.where(F.col("_ghost").isNull() | F.col("target").isNotNull()).withColumn("track_id", F.coalesce("target", "track_id")).drop("target", "_ghost")


def detect_id_switches(players: DataFrame, max_gap: int = 8, max_dist: float = 100.0) -> DataFrame:
    """New tracks that start where an old one ended: old_id, new_id, dist; the nearest old track of each new one."""
    c = _centred(players)
    ends = c.groupBy(*TRACK).agg(
        F.min("frame_id").alias("first"), F.max("frame_id").alias("last"),
        F.min_by(F.struct("cx", "cy"), "frame_id").alias("a"), F.max_by(F.struct("cx", "cy"), "frame_id").alias("b"),
    )
    top = players.groupBy("match_id").agg(F.max("frame_id").alias("top"))
    old = ends.join(top, "match_id").where(F.col("last") < F.col("top") - max_gap).select("match_id", F.col("track_id").alias("old_id"), "last", F.col("b.cx").alias("ox"), F.col("b.cy").alias("oy"))
    old = old.withColumn("first", F.explode(F.sequence(F.col("last") + 1, F.col("last") + max_gap)))
    new = ends.select("match_id", "first", F.col("track_id").alias("new_id"), F.col("a.cx").alias("nx"), F.col("a.cy").alias("ny"))
    pairs = old.join(new, ["match_id", "first"]).where("old_id <> new_id").withColumn("dist", distance(F.col("ox"), F.col("oy"), F.col("nx"), F.col("ny"))).where(F.col("dist") <= max_dist)
    return pairs.groupBy("match_id", "new_id").agg(F.min(F.struct("dist", "old_id")).alias("b")).select("match_id", F.col("b.old_id").alias("old_id"), "new_id", F.col("b.dist").alias("dist"))


def merge_id_switches(players: DataFrame, switches: DataFrame, parts: int | None = None) -> DataFrame:
    """Rename new tracks to the first track of the chain they continue, unless the two then share a frame.

    Pairs count nearest first. A new track's target is found by following the pairs before its own, skipped ones too;
    then the new tracks are renamed in that order, and one that shares a frame with what its target has become stays.
    An earlier renaming changes later tests, so a match's pairs are folded together, with the distinct frames of their
    tracks, and only a mapping comes back. Of several pairs of one new track the nearest counts. A cycle is an error.
    The folding is dealt by match over ``parts`` partitions, where that is given.
    """
    best = F.min(F.struct("dist", "old_id")).alias("b")
    pairs = switches.where("old_id <> new_id").groupBy("match_id", "new_id").agg(best).select("match_id", "new_id", F.col("b.old_id").alias("old_id"), F.col("b.dist").alias("dist"))
    pairs = written(pairs, "switches")
    ids = pairs.select("match_id", F.explode(F.array("old_id", "new_id")).alias("track_id")).distinct()
    spans = players.select(*FRAME, "track_id").join(ids, TRACK).groupBy(*TRACK).agg(F.collect_set("frame_id").alias("frames"))

    def merge(pairs: pd.DataFrame, tracks: pd.DataFrame) -> pd.DataFrame:
        held = {t: set(f) for t, f in zip(tracks["track_id"], tracks["frames"], strict=True)}
        target: dict[int, int] = {}
        for old, new in pairs.sort_values(["dist", "old_id", "new_id"])[["old_id", "new_id"]].itertuples(index=False):
            while old in target:
                old = target[old]
            if old == new:
                raise ValueError("the chains form a cycle")
            target[new] = old
        moved: dict[int, int] = {}
        for new, old in target.items():
            small, large = sorted((held.get(new, set()), held.get(old, set())), key=len)
            if small.isdisjoint(large):
                large |= small
                held[old], held[new], moved[new] = large, set(), old
        out = []
        for track in moved:
            to = track
            while to in moved:
                to = moved[to]
            out.append((pairs["match_id"].iloc[0], track, to))
        return pd.DataFrame(out, columns=["match_id", "track_id", "to"])

    spans = spans.toDF(*spans.columns)  # its own column ids: both sides stem from the same rows
    if parts:
        pairs, spans = pairs.repartition(parts, "match_id"), spans.repartition(parts, "match_id")
    mapping = pairs.groupBy("match_id").cogroup(spans.groupBy("match_id")).applyInPandas(merge, "match_id string, track_id int, to int")
    return players.join(mapping, TRACK, "left").withColumn("track_id", F.coalesce("to", "track_id")).drop("to")


def interpolate_tracks(players: DataFrame, frames: DataFrame) -> DataFrame:
    """Adds a row for every frame between a track's first and last that lacks one.

    Values are linear in the frame's ordinal among the match's frames; boxes are rounded half to even; team and
    on_court are carried forward; court values stay null before the track's first and hold the last one after it.
    """
    w = Window.partitionBy("match_id").orderBy("frame_id")
    grid = frames.select(*FRAME).withColumn("ord", F.row_number().over(w))
    life = players.groupBy(*TRACK).agg(F.min("frame_id").alias("lo"), F.max("frame_id").alias("hi"))
    lived = in_intervals(grid, life, ["match_id"], "frame_id", "lo", "hi", 64).select(*FRAME, "ord", "track_id")
    gaps = lived.join(players.select(*FRAME, "track_id"), [*FRAME, "track_id"], "left_anti")
    rows = players.join(grid, FRAME).withColumn("_own", F.lit(True)).unionByName(gaps.withColumn("_own", F.lit(False)), allowMissingColumns=True)
    t = Window.partitionBy(*TRACK).orderBy("ord")
    back = t.rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*TRACK).orderBy(F.desc("ord")).rowsBetween(Window.unboundedPreceding, 0)  # running, where a frame to the end is quadratic

    def filled(c: str):
        at = F.when(F.col(c).isNotNull(), F.col("ord"))
        v0, v1 = F.last(c, ignorenulls=True).over(back), F.last(c, ignorenulls=True).over(ahead)
        o0, o1 = F.last(at, ignorenulls=True).over(back), F.last(at, ignorenulls=True).over(ahead)
        return F.when(v0.isNull(), None).when(v1.isNull() | (o1 == o0), v0).otherwise(v0 + (v1 - v0) * (F.col("ord") - o0) / (o1 - o0))

    linear = ["pixel_foot_x", "pixel_foot_y", "confidence", "court_x", "court_y"]
    boxes = ["bbox_x1", "bbox_y1", "bbox_x2", "bbox_y2"]
    out = {c: F.when(F.col("_own"), F.col(c)).otherwise(filled(c)) for c in linear}
    out |= {c: F.when(F.col("_own"), F.col(c)).otherwise(F.bround(filled(c)).cast("int")) for c in boxes}
    out |= {c: F.last(c, ignorenulls=True).over(back) for c in ("team", "on_court")}
    out |= {"velocity_x": F.coalesce("velocity_x", F.lit(0.0)), "velocity_y": F.coalesce("velocity_y", F.lit(0.0)), "has_ball": F.coalesce("has_ball", F.lit(False))}
    return rows.withColumns(out).withColumnRenamed("_own", "observed").drop("ord")


def compute_velocities(players: DataFrame, fps: DataFrame) -> DataFrame:
    """Court metres a second since the track's row before; 0 where any value is missing."""
    w = Window.partitionBy(*TRACK).orderBy("frame_id")
    j = players.drop("fps").join(fps.select("match_id", "fps"), "match_id", "left")
    v = lambda c: F.coalesce((F.col(c) - F.lag(c).over(w)) / (F.col("frame_id") - F.lag("frame_id").over(w)) * F.col("fps"), F.lit(0.0))
    return j.withColumns({"velocity_x": v("court_x"), "velocity_y": v("court_y")}).drop("fps")


def ball_carriers(players: DataFrame, ball: DataFrame) -> DataFrame:
    """The player nearest to the ball in each frame (ties: lowest track)."""
    b = ball.where("court_x is not null").select(*FRAME, F.col("court_x").alias("bx"), F.col("court_y").alias("by"))
    p = players.where("court_x is not null").join(b, FRAME)
    dx, dy = F.col("court_x") - F.col("bx"), F.col("court_y") - F.col("by")
    return p.groupBy(*FRAME).agg(F.min(F.struct((dx * dx + dy * dy).alias("d"), "track_id")).alias("b")).select(*FRAME, F.col("b.track_id").alias("track_id"))


def mark_ball_carrier(players: DataFrame, ball: DataFrame) -> DataFrame:
    """Sets ``has_ball`` for the nearest player; flags already set stay."""
    c = ball_carriers(players, ball).withColumn("_c", F.lit(True))
    return players.join(c, [*FRAME, "track_id"], "left").withColumn("has_ball", F.coalesce("has_ball", F.lit(False)) | F.col("_c").isNotNull()).drop("_c")


GOAL = "frame_number int, timestamp_sec double, game_time string, team string, score_home int, score_away int"


def detect_goals(readings: DataFrame) -> DataFrame:
    """Goals: exactly one side one up on the last accepted reading. Other changes are outliers and not accepted.

    What counts depends on what was accepted before, so a match's readings are folded in order: only readings whose
    score differs from the row before take part, since a repeated score neither scores nor changes the reference.
    """
    w = Window.partitionBy("match_id").orderBy("frame_number")
    r = readings.where("score_home is not null and score_away is not null")
    r = r.withColumn("game_time", F.last("game_time", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    same = (F.col("score_home") == F.lag("score_home").over(w)) & (F.col("score_away") == F.lag("score_away").over(w))
    r = r.withColumn("_same", F.coalesce(same, F.lit(False))).where(~F.col("_same"))
    rows = r.groupBy("match_id").agg(F.array_sort(F.collect_list(F.struct("frame_number", "timestamp_sec", "game_time", "score_home", "score_away"))).alias("rows"))
    event = "array<struct<frame_number:int,timestamp_sec:double,game_time:string,team:string,score_home:int,score_away:int>>"
    start = F.struct(F.lit(None).cast("int").alias("h"), F.lit(None).cast("int").alias("a"), F.array().cast(event).alias("out"))

    def step(acc, x):
        dh, da = x["score_home"] - acc["h"], x["score_away"] - acc["a"]
        goal = ((dh == 1) & (da == 0)) | ((dh == 0) & (da == 1))
        made = F.struct(x["frame_number"].alias("frame_number"), x["timestamp_sec"].alias("timestamp_sec"), x["game_time"].alias("game_time"), F.when(dh == 1, "home").otherwise("away").alias("team"), x["score_home"].alias("score_home"), x["score_away"].alias("score_away"))
        first = F.struct(x["score_home"].alias("h"), x["score_away"].alias("a"), acc["out"].alias("out"))
        scored = F.struct(x["score_home"].alias("h"), x["score_away"].alias("a"), F.concat(acc["out"], F.array(made)).alias("out"))
        return F.when(acc["h"].isNull(), first).when(goal, scored).otherwise(acc)

    return rows.select("match_id", F.explode(F.aggregate("rows", start, step, lambda acc: acc["out"])).alias("g")).select("match_id", "g.*")


def goalkeeper_centres(players: DataFrame) -> DataFrame:
    """One goalkeeper a frame, the largest box (ties: lowest track): centre in pixels."""
    area = (F.col("bbox_x2") - F.col("bbox_x1")) * (F.col("bbox_y2") - F.col("bbox_y1"))
    g = _centred(players.where("class_name = 'goalkeeper'")).withColumn("area", area)
    best = F.max(F.struct("area", (-F.col("track_id")).alias("t"), "cx", "cy")).alias("b")
    return g.groupBy(*FRAME).agg(best).select(*FRAME, F.col("b.cx").alias("gk_x"), F.col("b.cy").alias("gk_y"))


def detect_throws(players: DataFrame, ball: DataFrame, lookahead: int = 8, min_reduction: float = 30.0, monotonic: bool = True) -> DataFrame:
    """Ball carriers after whom the ball nears the goalkeeper: distance before, least within ``lookahead`` frames."""
    gap = ball.join(goalkeeper_centres(players), FRAME).select(*FRAME, distance(F.col("pixel_x"), F.col("pixel_y"), F.col("gk_x"), F.col("gk_y")).alias("d"))
    start = players.where("has_ball and court_x is not null").join(gap, FRAME).select(*FRAME, "track_id", F.col("d").alias("init"))
    ahead = start.withColumn("off", F.explode(F.sequence(F.lit(1), F.lit(lookahead)))).withColumn("at", F.col("frame_id") + F.col("off"))
    later = gap.select("match_id", F.col("frame_id").alias("at"), "d")
    seq = ahead.join(later, ["match_id", "at"]).groupBy(*FRAME, "track_id", "init").agg(F.min("d").alias("least"), F.transform(F.array_sort(F.collect_list(F.struct("off", "d"))), lambda s: s["d"]).alias("ds"))
    n = F.size("ds")
    falls = F.size(F.filter(F.zip_with(F.slice("ds", 1, F.greatest(n - 1, F.lit(0))), F.slice("ds", 2, F.greatest(n - 1, F.lit(0))), lambda a, b: b < a), lambda x: x))
    ok = F.col("init") - F.col("least") >= min_reduction
    if monotonic:
        ok = ok & (n >= 2) & (falls >= F.greatest(F.lit(1), F.floor((n - 1) * 6 / 10)))
    return seq.where(ok).select(*FRAME, "track_id", F.col("init").alias("start_distance"), F.col("least").alias("least_distance"))
