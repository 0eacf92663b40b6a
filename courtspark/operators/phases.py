"""Formations, possession and team phases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.court import distance
from .islands import changed, hysteresis, islands, runs_with_gaps

FRAME = ["match_id", "frame_id"]
TEAM = [*FRAME, "team"]
ACTIONS = ("pass", "shot", "dribble", "hold")


def defending_side(players: DataFrame) -> DataFrame:
    """Per frame and team whether it defends the left goal: mean x of its players on court under the centre line."""
    return players.where("on_court and team in ('A', 'B')").groupBy(*TEAM).agg(F.avg("court_x").alias("mean_x")).select(*TEAM, (F.coalesce("mean_x", F.lit(20.0)) < 20).alias("defends_left"))


def classify_formation(positions: DataFrame) -> DataFrame:
    """Formation of each (frame, team) from positions (court_x, court_y) and the side it defends."""
    own, opp = F.when(F.col("defends_left"), 0.0).otherwise(40.0), F.when(F.col("defends_left"), 40.0).otherwise(0.0)
    d, a = distance(F.col("court_x"), F.col("court_y"), own, F.lit(10.0)), distance(F.col("court_x"), F.col("court_y"), opp, F.lit(10.0))
    p = positions.withColumn("d", d).withColumn("a", a)
    close = F.col("d") <= 14
    g = p.groupBy(*TEAM).agg(
        F.count("court_x").alias("n"), F.count_if(F.col("a") <= 14).alias("far_up"), F.count_if(F.col("d") < 20).alias("back"), F.count_if(close).alias("near"),
        (F.max(F.when(close, F.col("court_y"))) - F.min(F.when(close, F.col("court_y")))).alias("spread"), F.array_sort(F.collect_list(F.when(close, F.col("d")))).alias("ds"),
    )
    m = F.greatest(F.size("ds") - 1, F.lit(0))
    gap = F.coalesce(F.array_max(F.zip_with(F.slice("ds", 2, m), F.slice("ds", 1, m), lambda x, y: x - y)), F.lit(0.0))
    label = (
        F.when(F.col("n") < 4, "unknown").when(F.col("far_up") >= F.col("n") - 1, "attack").when(F.col("back") < F.col("n") - 2, "transition").when(F.col("near") < 4, "transition")
        .when((F.col("spread") <= 10) & (gap <= 2), "6-0").when((gap >= 3) & (F.col("near") >= 5), "5-1").otherwise("4-2")
    )
    return g.select(*TEAM, label.alias("formation"))


def label_formations(players: DataFrame, stride: int = 5) -> DataFrame:
    """Both teams' formation on every ``stride``-th frame that has a court-mapped player of either team."""
    known = players.where("team in ('A', 'B')")
    frames = known.where((F.col("frame_id") % stride == 0) & F.col("court_x").isNotNull()).select(*FRAME).distinct()
    both = frames.withColumn("team", F.explode(F.array(F.lit("A"), F.lit("B"))))
    pos = known.where("on_court and court_x is not null").select(*TEAM, "court_x", "court_y")
    side = both.join(defending_side(players), TEAM, "left").withColumn("defends_left", F.coalesce("defends_left", F.lit(False)))
    return classify_formation(side.join(pos, TEAM, "left"))


def formation_scenes(formations: DataFrame, fps: DataFrame, stride: int = 5, least: int = 25) -> DataFrame:
    """Runs of equal known labels of a team that last: scene_id counts per match over teams in order."""
    r = islands(formations, ["match_id", "team"], "frame_id", changed("formation", ["match_id", "team"], "frame_id"))
    s = r.groupBy("match_id", "team", "island").agg(F.first("formation").alias("formation"), F.min("frame_id").alias("start_frame"), F.max("frame_id").alias("end_frame"))
    s = s.where((F.col("formation") != "unknown") & (F.col("end_frame") - F.col("start_frame") + stride >= least)).join(fps, "match_id")
    t = lambda c: F.floor(c / F.col("fps") * 1000 + 0.5).cast("double") / 1000.0
    rank = F.row_number().over(Window.partitionBy("match_id").orderBy("team", "start_frame")) - 1
    return s.select("match_id", rank.cast("long").alias("scene_id"), "team", "formation", "start_frame", "end_frame", t(F.col("start_frame")).alias("start_time_s"), t(F.col("end_frame") + stride).alias("end_time_s"))


def carrier_series(frames: DataFrame, carriers: DataFrame) -> DataFrame:
    return frames.select(*FRAME, "timestamp_s").join(carriers.select(*FRAME, "team"), FRAME, "left")


def _kept(runs: DataFrame, min_s: float) -> DataFrame:
    k = runs.where(F.col("end_frame") - F.col("start_frame") >= F.floor(F.col("fps") * min_s))
    rank = F.row_number().over(Window.partitionBy("match_id").orderBy("start_frame")) - 1
    return k.withColumn("phase_id", rank.cast("long")).drop("fps")


def possession_phases(series: DataFrame, fps: DataFrame, min_s: float = 1.5, gap_s: float = 1.0) -> DataFrame:
    """Phases of one team in possession, bridging pauses of up to ``gap_s`` seconds."""
    s = series.join(fps, "match_id").withColumn("team", F.when(F.col("team").isin("A", "B"), F.col("team")))
    return _kept(runs_with_gaps(s, ["match_id", "fps"], "frame_id", "team", F.floor(F.col("fps") * gap_s)), min_s)


def team_centroids(players: DataFrame, least: int = 3) -> DataFrame:
    p = players.where("on_court and team in ('A', 'B') and court_x is not null")
    return p.groupBy(*TEAM).agg(F.avg("court_x").alias("mean_x"), F.count("*").alias("n")).where(F.col("n") >= least).drop("n")


def phase_evidence(frames: DataFrame, centroids: DataFrame) -> DataFrame:
    """Per frame: the attacked goal where both teams are near one, and the offence where it is clear."""
    side = lambda t, c: centroids.where(F.col("team") == t).select(*FRAME, F.col("mean_x").alias(c))
    j = frames.select(*FRAME, "timestamp_s").join(side("A", "a"), FRAME, "left").join(side("B", "b"), FRAME, "left")
    mid = (F.col("a") + F.col("b")) / 2
    goal = F.when(mid < 20, 0.0).otherwise(40.0)
    da, db = F.abs(F.col("a") - goal), F.abs(F.col("b") - goal)
    on = F.coalesce(F.abs(mid - goal) <= 15, F.lit(False))
    return j.select(*FRAME, "timestamp_s", F.when(on, goal).alias("goal"), F.when(on & (F.abs(da - db) >= 1.5), F.when(da > db, "A").otherwise("B")).alias("seen_team"))


def phase_hysteresis(evidence: DataFrame, fps: DataFrame, hold_s: float = 0.5) -> DataFrame:
    e = evidence.join(fps, "match_id")
    return hysteresis(e, ["match_id"], "frame_id", "goal", "seen_team", F.greatest(F.lit(1), F.floor(F.col("fps") * hold_s)), "offense_team").drop("fps")


def team_phases(frames: DataFrame, players: DataFrame, fps: DataFrame, min_s: float = 3.0, gap_s: float = 2.0, least: int = 3, hold_s: float = 0.5) -> DataFrame:
    """Attack phases from team centroids: evidence, hysteresis, merged runs."""
    labels = phase_hysteresis(phase_evidence(frames, team_centroids(players, least)), fps, hold_s)
    s = labels.select(*FRAME, "timestamp_s", F.col("offense_team").alias("team")).join(fps, "match_id")
    k = _kept(runs_with_gaps(s, ["match_id", "fps"], "frame_id", "team", F.floor(F.col("fps") * gap_s)), min_s)
    return k.withColumnRenamed("team", "offense_team").withColumn("defense_team", F.when(F.col("offense_team") == "A", "B").otherwise("A")).withColumn("phase_type", F.lit("attack"))


def action_candidates(players: DataFrame, window: int = 25) -> DataFrame:
    return players.where(F.col("has_ball") & F.col("court_x").isNotNull() & (F.col("frame_id") >= window - 1))


def predicted_action(p: DataFrame) -> DataFrame:
    """The likeliest action; ties go to the first of pass, shot, dribble, hold."""
    top = F.greatest(*[F.col(f"{a}_prob") for a in ACTIONS])
    best: Column = F.lit(None)
    for a in reversed(ACTIONS):
        best = F.when(F.col(f"{a}_prob") == top, a).otherwise(best)
    return p.withColumn("predicted_action", best)
