"""Match statistics, heat maps and listings, over all matches at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.court import ZONES, half_of, half_up, team_bucket, zone_of
from .islands import in_intervals

FRAME = ["match_id", "frame_id"]


def _rate(n: Column, total: Column) -> Column:
    return F.when(total > 0, half_up(n / total * 100, 1)).otherwise(0.0)


def match_stats(matches: DataFrame, players: DataFrame, ball: DataFrame, approximate: bool = False) -> DataFrame:
    """Tracks, frames with players, frames with court positions, ball rows, their rates and the duration; distinct
    counts from sketches on request."""
    court = F.col("court_x").isNotNull() & F.col("court_y").isNotNull()
    p = sketched_counts(match_sketches(players), ("match_id",)) if approximate else players.groupBy("match_id").agg(F.count_distinct("track_id").alias("tracks"), F.count_distinct("frame_id").alias("player_frames"), F.count_distinct(F.when(court, F.col("frame_id"))).alias("court_frames"))
    b = ball.groupBy("match_id").agg(F.count("*").alias("ball_rows"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    j = matches.join(p, "match_id", "left").join(b, "match_id", "left").select("match_id", "total_frames", F.coalesce(F.nullif("fps", F.lit(0.0)), F.lit(25.0)).alias("fps"), *map(zero, ("tracks", "player_frames", "court_frames", "ball_rows")))
    t = F.col("total_frames")
    return j.withColumns({"player_rate": _rate(F.col("player_frames"), t), "court_rate": _rate(F.col("court_frames"), t), "ball_rate": _rate(F.col("ball_rows"), t), "duration_s": half_up(t / F.col("fps"), 1)})


def match_sketches(players: DataFrame, lg_k: int = 12) -> DataFrame:
    """Per match mergeable sketches of distinct tracks, frames with players and frames with court positions.

    They count (match, track) and (match, frame), so sketches of several matches merge into the sum over them without
    another pass over the rows. The relative error is about 1.04 / sqrt(2 ** lg_k).
    """
    court = F.col("court_x").isNotNull() & F.col("court_y").isNotNull()
    of = lambda c, where=None: F.hll_sketch_agg(F.xxhash64("match_id", c) if where is None else F.when(where, F.xxhash64("match_id", c)), lg_k)
    return players.groupBy("match_id").agg(of("track_id").alias("tracks"), of("frame_id").alias("player_frames"), of("frame_id", court).alias("court_frames"))


def sketched_counts(sketches: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Approximate distinct counts of sketches merged by ``keys``; over all matches without keys."""
    cols = ("tracks", "player_frames", "court_frames")
    g = sketches.groupBy(*keys).agg(*[F.hll_union_agg(c, True).alias(c) for c in cols])
    return g.select(*keys, *[F.hll_sketch_estimate(c).alias(c) for c in cols])


def possession_share(players: DataFrame) -> DataFrame:
    g = players.where("has_ball").groupBy("match_id").agg(F.count("*").alias("n"), F.count_if(F.col("team") == "A").alias("a"), F.count_if(F.col("team") == "B").alias("b"))
    return g.select("match_id", half_up(F.col("a") / F.col("n") * 100, 1).alias("possession_a"), half_up(F.col("b") / F.col("n") * 100, 1).alias("possession_b"))


def player_stats(players: DataFrame, matches: DataFrame, n: int = 25) -> DataFrame:
    """The tracks of a match with most rows (ties: lowest id): team of the first row, confidence, distance covered."""
    speed = F.sqrt(F.col("velocity_x") * F.col("velocity_x") + F.col("velocity_y") * F.col("velocity_y"))
    g = players.groupBy("match_id", "track_id").agg(F.min_by("team", "frame_id").alias("team"), F.count("*").alias("rows"), F.avg("confidence").alias("conf"), F.sum(F.floor(speed * 1000 + 0.5)).alias("mm"))
    rank = F.row_number().over(Window.partitionBy("match_id").orderBy(F.desc("rows"), "track_id"))
    g = g.withColumn("_rn", rank).where(F.col("_rn") <= n).join(matches.select("match_id", F.coalesce(F.nullif("fps", F.lit(0.0)), F.lit(25.0)).alias("fps")), "match_id")
    return g.select("match_id", "track_id", "team", "rows", half_up(F.col("conf") * 100, 1).alias("confidence"), half_up(F.col("mm") / 1000.0 / F.col("fps"), 1).alias("distance_m"))


def _zone_grid(matches: DataFrame) -> DataFrame:
    grid = F.explode(F.array(*[F.struct(F.lit(h).alias("half"), F.lit(z).alias("zone")) for h in ("left", "right") for z in ZONES]))
    return matches.select("match_id", grid.alias("g")).select("match_id", "g.*")


def zone_counts(players: DataFrame, matches: DataFrame) -> DataFrame:
    """Rows per half, zone and team bucket; all zones of a match present. One pass feeds all zone reports."""
    x, y = F.col("court_x"), F.col("court_y")
    b = team_bucket(F.col("team"))
    g = players.where(x.isNotNull()).groupBy("match_id", half_of(x).alias("half"), zone_of(x, y).alias("zone")).agg(*[F.count_if(b == t).alias(t.lower()) for t in "ABU"])
    j = _zone_grid(matches).join(g, ["match_id", "half", "zone"], "left")
    return j.select("match_id", "half", "zone", *[F.coalesce(c, F.lit(0)).alias(c) for c in "abu"])


def zone_intensity(players: DataFrame, matches: DataFrame) -> DataFrame:
    """Each zone's rows as a percentage of the busiest zone of its half."""
    total = F.col("a") + F.col("b") + F.col("u")
    z = zone_counts(players, matches).withColumn("n", total)
    top = F.max("n").over(Window.partitionBy("match_id", "half"))
    return z.select("match_id", "half", "zone", F.when(top > 0, half_up(F.col("n") / top * 100, 1)).otherwise(0.0).alias("intensity"))


def _in_court(players: DataFrame) -> DataFrame:
    return players.where(F.col("court_x").between(0, 40) & F.col("court_y").between(0, 20))


def sample_points(players: DataFrame, every: int = 100, n: int = 12_000) -> DataFrame:
    """Positions on every ``every``-th frame, the first ``n`` of a match by frame and track."""
    rank = F.row_number().over(Window.partitionBy("match_id").orderBy("frame_id", "track_id"))
    s = _in_court(players).where(F.col("frame_id") % every == 0).withColumn("_rn", rank).where(F.col("_rn") <= n)
    return s.select(*FRAME, "track_id", "court_x", "court_y", team_bucket(F.col("team")).alias("team"))


def court_points(players: DataFrame) -> DataFrame:
    """All positions inside the court."""
    return _in_court(players).select(*FRAME, "track_id", "court_x", "court_y", team_bucket(F.col("team")).alias("team"))


def heatmap_points(
    players: DataFrame, matches: DataFrame, phases: DataFrame, phase_id: int | None = None, tracks: list[int] | None = None, perspective: str = "both",
    window: tuple[float, float] | None = None, every: int = 100, n: int = 12_000, width: int = 250,
) -> DataFrame:
    """Points of a match's density map: positions on every ``every``-th frame, the first ``n`` of a match.

    ``phase_id`` keeps one phase of each match; ``perspective`` (offense, defense) the team in that role, in the phase
    or, without one, in whatever phase covers the frame; ``tracks`` some tracks. A ``window`` of seconds is taken in
    frames: of the match, or, clamped to the phase, in proportion of its frames to its duration.
    """
    p = _in_court(players).where(F.col("frame_id") % every == 0)
    p = p.where(F.col("track_id").isin(tracks)) if tracks else p
    side = {"offense": "offense_team", "defense": "defense_team"}.get(perspective)
    if window and phase_id is None:
        m = matches.select("match_id", "total_frames", F.coalesce(F.nullif("fps", F.lit(0.0)), F.lit(25.0)).alias("fps"))
        low, high = F.greatest(F.lit(0), F.floor(F.col("fps") * window[0])), F.least(F.col("total_frames"), F.floor(F.col("fps") * window[1]))
        p = p.join(m, "match_id").where(F.col("frame_id").between(low, high))
    if phase_id is not None or side:
        h = phases if phase_id is None else phases.where(F.col("phase_id") == phase_id)
        h = h.withColumns({"low": F.col("start_frame"), "high": F.col("end_frame")})
        if window and phase_id is not None:
            frames, seconds = F.col("end_frame") - F.col("start_frame"), F.col("end_time_s") - F.col("start_time_s")
            at = lambda s: F.floor(F.col("start_frame") + (s - F.col("start_time_s")) * (frames / seconds))
            cut = (frames > 0) & (seconds > 0)
            first, last = at(F.greatest(F.lit(window[0]), "start_time_s")), at(F.least(F.lit(window[1]), "end_time_s"))
            h = h.withColumns({"low": F.when(cut, F.greatest("low", first)).otherwise(F.col("low")), "high": F.when(cut, F.least("high", last)).otherwise(F.col("high"))})
        p = in_intervals(p, h.where("low <= high").select("match_id", "offense_team", "defense_team", "low", "high"), ["match_id"], "frame_id", "low", "high", width)
        p = p.where(F.col("team") == F.col(side)) if side else p
    rank = F.row_number().over(Window.partitionBy("match_id").orderBy("frame_id", "track_id"))
    return p.withColumn("_rn", rank).where(F.col("_rn") <= n).select(*FRAME, "track_id", "court_x", "court_y", team_bucket(F.col("team")).alias("team"))


def phase_points(players: DataFrame, phases: DataFrame, every: int = 4, width: int = 250) -> DataFrame:
    """Positions within team phases, with the phase and whether the player's team is its offence or defence."""
    p = _in_court(players).where(F.col("frame_id") % every == 0).select(*FRAME, "track_id", "court_x", "court_y", team_bucket(F.col("team")).alias("team"))
    j = in_intervals(p, phases.select("match_id", "phase_id", "offense_team", "defense_team", "start_frame", "end_frame"), ["match_id"], "frame_id", "start_frame", "end_frame", width)
    role = F.when(F.col("team") == F.col("offense_team"), "offense").when(F.col("team") == F.col("defense_team"), "defense")
    return j.select(*FRAME, "track_id", "court_x", "court_y", "team", "phase_id", role.alias("perspective"))


def window_points(players: DataFrame, matches: DataFrame, start_s: float, end_s: float) -> DataFrame:
    """Positions of a time window, in frames: max(0, int(start fps)) to min(total, int(end fps))."""
    m = matches.select("match_id", "total_frames", F.coalesce(F.nullif("fps", F.lit(0.0)), F.lit(25.0)).alias("fps"))
    j = _in_court(players).join(m, "match_id")
    low, high = F.greatest(F.lit(0), F.floor(F.col("fps") * start_s)), F.least(F.col("total_frames"), F.floor(F.col("fps") * end_s))
    return j.where(F.col("frame_id").between(low, high)).select(*FRAME, "track_id", "court_x", "court_y", team_bucket(F.col("team")).alias("team"))


def available_tracks(players: DataFrame, matches: DataFrame) -> DataFrame:
    """Each track with its commonest team (ties: first label), the span of that team's rows and their number."""
    g = _in_court(players).groupBy("match_id", "track_id", team_bucket(F.col("team")).alias("team")).agg(F.min("frame_id").alias("first"), F.max("frame_id").alias("last"), F.count("*").alias("points"))
    rank = F.row_number().over(Window.partitionBy("match_id", "track_id").orderBy(F.desc("points"), "team"))
    j = g.withColumn("_rn", rank).where("_rn = 1").join(matches.select("match_id", F.coalesce(F.nullif("fps", F.lit(0.0)), F.lit(25.0)).alias("fps")), "match_id")
    return j.select("match_id", "track_id", "team", "points", half_up(F.col("first") / F.col("fps"), 1).alias("first_s"), half_up(F.col("last") / F.col("fps"), 1).alias("last_s"))


def scoreboard(readings: DataFrame) -> DataFrame:
    return readings.where("game_time is not null")


def scoreboard_summary(readings: DataFrame, goals: DataFrame) -> DataFrame:
    """Per match: number of readings, last full score with its clock, number of goals and the last goal's frame."""
    both = F.col("score_home").isNotNull() & F.col("score_away").isNotNull()
    last = F.max_by(F.struct("score_home", "score_away", "game_time"), F.when(both, F.col("frame_number")))
    r = readings.groupBy("match_id").agg(F.count("*").alias("readings"), last.alias("s"))
    g = goals.groupBy("match_id").agg(F.count("*").alias("goals"), F.max("frame_number").alias("last_goal_frame"))
    return r.join(g, "match_id", "left").select("match_id", "readings", "s.score_home", "s.score_away", "s.game_time", F.coalesce("goals", F.lit(0)).alias("goals"), "last_goal_frame")


def formations_with_source(embedded: DataFrame, ruled: DataFrame) -> DataFrame:
    """Embedding labels of matches that have any, rule labels of the others."""
    e = embedded.withColumn("source", F.lit("embedding"))
    return e.unionByName(ruled.join(embedded.select("match_id").distinct(), "match_id", "left_anti").withColumn("source", F.lit("rules")))


def formation_counts(formations: DataFrame) -> DataFrame:
    """Label counts per team, with the dominant one (ties: seen first)."""
    g = formations.groupBy("match_id", "team", "formation").agg(F.count("*").alias("n"), F.min("frame_id").alias("first"))
    rank = F.row_number().over(Window.partitionBy("match_id", "team").orderBy(F.desc("n"), "first", "formation"))
    return g.select("match_id", "team", "formation", "n", (rank == 1).alias("dominant"))


def formation_summary(formations: DataFrame) -> DataFrame:
    """One row per team: map from label to count, and the dominant label."""
    entries = F.array_sort(F.collect_list(F.struct("formation", "n")))
    return formation_counts(formations).groupBy("match_id", "team").agg(F.map_from_entries(entries).alias("formations"), F.max(F.when(F.col("dominant"), F.col("formation"))).alias("dominant"))


def plays_query(events: DataFrame, sequences: DataFrame, labels: DataFrame) -> DataFrame:
    o = sequences.select("match_id", "sequence_id", "outcome")
    return events.join(o, ["match_id", "sequence_id"], "left").join(labels.select("match_id", "event_id", "verdict"), ["match_id", "event_id"], "left")


def play_summary(events: DataFrame, sequences: DataFrame) -> DataFrame:
    """Per play type and team: plays, mean confidence, rated and scoring attacks, success."""
    j = events.join(sequences.select("match_id", "sequence_id", "outcome"), ["match_id", "sequence_id"], "left")
    distinct = lambda c: F.count_distinct(F.when(c, F.col("sequence_id")))
    g = j.groupBy("match_id", "play_type", "team").agg(F.count("*").alias("plays"), half_up(F.avg("confidence"), 3).alias("confidence"), distinct(F.col("outcome").isin("goal", "no_goal")).alias("rated"), distinct(F.col("outcome") == "goal").alias("goals"))
    return g.withColumn("success", F.when(F.col("rated") > 0, half_up(F.col("goals") / F.col("rated"), 3)))


def match_duration(matches: DataFrame) -> DataFrame:
    """``MM:SS`` of whole seconds, minutes not wrapped."""
    s = F.floor(F.col("total_frames") / F.coalesce(F.nullif("fps", F.lit(0.0)), F.lit(1.0))).cast("long")
    return matches.select("match_id", F.format_string("%02d:%02d", F.floor(s / 60).cast("long"), s % 60).alias("duration"))
