"""Report tables over the statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.court import blank_to_null, clock, half_of, report_bucket, zone_of
from .stats import _zone_grid

SPREADS = {"LA": 0.96, "RL": 1.09, "RM": 1.3, "RR": 1.09, "RA": 0.96, "KL": 0.78}


def zone_distribution(points: DataFrame, matches: DataFrame) -> DataFrame:
    """Points per half, zone and bucket, zeros kept, with the zone's share of the match."""
    x, y = F.col("court_x"), F.col("court_y")
    g = points.groupBy("match_id", half_of(x).alias("half"), zone_of(x, y).alias("zone")).pivot("team", ["A", "B", "U"]).count()
    j = _zone_grid(matches).join(g, ["match_id", "half", "zone"], "left").fillna(0, ["A", "B", "U"]).withColumn("total", F.col("A") + F.col("B") + F.col("U"))
    return j.select("match_id", "half", "zone", F.col("A").alias("a"), F.col("B").alias("b"), F.col("U").alias("u"), "total")


def busiest_zones(distribution: DataFrame, n: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("match_id").orderBy(F.desc("total"), "half", "zone"))
    return distribution.where("total > 0").withColumn("place", rank.cast("long")).where(F.col("place") <= n).select("match_id", "place", "half", "zone", "total")


def team_totals(points: DataFrame) -> DataFrame:
    return points.groupBy("match_id", "team").agg(F.count("*").alias("points"))


def zone_tiles(intensity: DataFrame, counts: DataFrame) -> DataFrame:
    """Intensity and counts of each zone: total, share, whether anything happened, and the tile's fill."""
    j = intensity.join(counts, ["match_id", "half", "zone"]).withColumn("total", F.col("a") + F.col("b") + F.col("u"))
    every = F.sum("total").over(Window.partitionBy("match_id"))
    fill = F.floor(F.col("intensity") * 0.94 + 6 + 0.5).cast("long")
    return j.select("match_id", "half", "zone", "total", F.when(every > 0, F.col("total") / every).otherwise(0.0).alias("share"), (F.col("total") > 0).alias("active"), fill.alias("fill"), (fill >= 62).alias("inverted"))


def density_grid(points: DataFrame, cell_m: float = 1.0, reach: int = 3, digits: int = 6) -> DataFrame:
    """Density of each team on a grid: every point stamps a truncated Gaussian on the cells around it.

    A stamp's radius is 1.2 spreads of its zone; its peak falls with the team's number of points. Stamps compose as
    1 - prod(1 - alpha), an aggregate that is summed as logarithms, so partial sums combine before the shuffle. Only
    cells within ``reach`` of a point are laid out. Points that come dealt by match are counted and stamped in place.
    """
    spread: Column = F.lit(1.0)
    zone = zone_of(F.col("court_x"), F.col("court_y"))
    for z, s in SPREADS.items():
        spread = F.when(zone == z, s).otherwise(spread)
    p = points.withColumns({"n": F.count("*").over(Window.partitionBy("match_id", "team")), "radius": spread * 1.2})
    p = p.withColumn("peak", F.least(F.lit(0.6), F.greatest(F.lit(0.015), F.lit(120.0) / F.col("n"))))
    for c, size in (("x", 40), ("y", 20)):
        at = F.floor(F.col(f"court_{c}") / cell_m).cast("int")
        last = int(size / cell_m) - 1
        p = p.withColumn(f"cell_{c}", F.explode(F.sequence(F.greatest(F.lit(0), F.least(at, F.lit(last)) - reach), F.least(F.lit(last), F.greatest(at, F.lit(0)) + reach))))
    dx, dy = (F.col("cell_x") + 0.5) * cell_m - F.col("court_x"), (F.col("cell_y") + 0.5) * cell_m - F.col("court_y")
    r2 = (dx * dx + dy * dy) / (F.col("radius") * F.col("radius"))
    rim = F.exp(F.lit(-1 / (2 * 0.35 * 0.35)))
    alpha = F.col("peak") * F.greatest(F.lit(0.0), (F.exp(-r2 / (2 * 0.35 * 0.35)) - rim) / (1 - rim))
    g = p.withColumn("alpha", alpha).where("alpha > 0").groupBy("match_id", "team", "cell_x", "cell_y").agg(F.sum(F.log1p(-F.col("alpha"))).alias("s"))
    s = 10.0**digits
    return g.select("match_id", "team", "cell_x", "cell_y", (F.floor((1 - F.exp("s")) * s + 0.5).cast("double") / s).alias("density"))


def density_colour(grid: DataFrame) -> DataFrame:
    """Each cell's opacity against the busiest cell, and team A's share of it; NaN where all there is was rounded to 0."""
    part = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(float("nan")))
    cells = grid.groupBy("match_id", "cell_x", "cell_y").agg(F.sum("density").alias("total"), F.sum(F.when(F.col("team") == "A", F.col("density")).otherwise(0.0)).alias("a"))
    v = part(F.col("total"), F.max("total").over(Window.partitionBy("match_id")))
    opacity = F.when(v <= 0.04, 0.0).otherwise(0.1 + 0.7 * F.pow((v - 0.04) / 0.96, F.lit(0.6)))
    return cells.select("match_id", "cell_x", "cell_y", opacity.alias("opacity"), part(F.col("a"), F.col("total")).alias("share_a"))


def formation_table(counts: DataFrame) -> DataFrame:
    """Formation shares without attack, transition and unknown; dominant recomputed over the rest."""
    c = counts.withColumn("formation", F.trim("formation")).where(~F.lower("formation").isin("attack", "transition", "unknown") & (F.col("n") > 0))
    w = Window.partitionBy("match_id", "team")
    place = F.row_number().over(w.orderBy(F.desc("n"), "formation"))
    return c.select("match_id", "team", "formation", "n", (F.col("n") / F.sum("n").over(w)).alias("share"), place.cast("long").alias("place"), (place == 1).alias("dominant"))


def play_type_table(summary: DataFrame) -> DataFrame:
    """Play types with teams folded: total, share of all plays, rated and scoring attacks, success, mean confidence."""
    g = summary.groupBy("match_id", "play_type").agg(F.sum("plays").alias("plays"), F.sum("rated").alias("rated"), F.sum("goals").alias("goals"), (F.sum(F.floor(F.col("confidence") * 1000 + 0.5) * F.col("plays")) / F.sum("plays") / 1000.0).alias("confidence"))
    return g.withColumns({"share": F.col("plays") / F.sum("plays").over(Window.partitionBy("match_id")), "success": F.when(F.col("rated") > 0, F.col("goals") / F.col("rated"))})


def key_figures(stats: DataFrame, share: DataFrame) -> DataFrame:
    """Nulls, not zeros, for a match without frames; what neither team held of the ball."""
    j = stats.join(share, "match_id", "left")
    some = F.col("total_frames") > 0
    a, b = F.col("possession_a"), F.col("possession_b")
    rest = F.greatest(F.lit(0.0), F.floor((100 - a - b) * 10 + 0.5).cast("double") / 10)
    return j.select("match_id", *[F.when(some, F.col(c)).alias(c) for c in ("tracks", "player_rate", "court_rate", "ball_rate")], F.when(a + b > 0, rest).alias("unassigned"))


def track_table(stats: DataFrame, key: str = "rows", descending: bool = True) -> DataFrame:
    """Tracks with their place in a sorted table; ties by id in either direction."""
    order = F.desc(key) if descending else F.asc(key)
    place = F.row_number().over(Window.partitionBy("match_id").orderBy(order, "track_id"))
    return stats.select("match_id", place.cast("long").alias("place"), "track_id", report_bucket(F.col("team")).alias("bucket"), key)


def track_buckets(tracks: DataFrame, selected: list[int]) -> DataFrame:
    b = report_bucket(F.col("team"))
    return tracks.groupBy("match_id", b.alias("bucket")).agg(F.count("*").alias("tracks"), F.count_if(F.col("track_id").isin(selected)).alias("selected"))


def match_titles(catalog: DataFrame, meta: DataFrame) -> DataFrame:
    j = catalog.join(meta, "match_id", "left")
    return j.select("match_id", "status", "display_name", "file_name", F.coalesce(blank_to_null(F.col("display_name")), blank_to_null(F.col("file_name")), "match_id").alias("title"))


def match_search(titles: DataFrame, text: str) -> DataFrame:
    """Matches with the text in any field, in order of title."""
    q = text.strip().lower()
    hit = F.lit(False)
    for c in ("match_id", "display_name", "file_name", "title"):
        hit = hit | F.coalesce(F.lower(c).contains(q), F.lit(False))
    return titles.where(hit).orderBy("title", "match_id")


def match_list_summary(durations: DataFrame) -> DataFrame:
    """Number of matches and their minutes, from ``MM:SS``."""
    parts = F.split("duration", ":")
    s = F.sum(parts[0].cast("long") * 60 + parts[1].cast("long"))
    return durations.agg(F.count("*").alias("matches"), F.floor(s / 60 + 0.5).cast("long").alias("minutes"))


def timeline_items(goals: DataFrame, phases: DataFrame, plays: DataFrame, scenes: DataFrame) -> DataFrame:
    """Four lanes on one axis: lane, id, start and end in seconds, label, team."""
    item = lambda lane, key, start, end, label, team: [F.lit(lane).alias("lane"), F.concat(F.lit(f"{lane}-"), F.col(key).cast("string")).alias("id"), F.col(start).alias("start_s"), F.col(end).alias("end_s"), F.col(label).alias("label"), F.col(team).alias("team")]
    return (
        goals.select("match_id", *item("goal", "frame_number", "timestamp_sec", "timestamp_sec", "game_time", "team"))
        .unionByName(phases.select("match_id", *item("phase", "phase_id", "start_time_s", "end_time_s", "phase_type", "offense_team")))
        .unionByName(plays.select("match_id", *item("play", "event_id", "start_time_s", "end_time_s", "play_type", "team")))
        .unionByName(scenes.select("match_id", *item("formation", "scene_id", "start_time_s", "end_time_s", "formation", "team")))
    )


def time_bars(items: DataFrame, durations: DataFrame) -> DataFrame:
    """Items as percent of the match: left edge and width, at least 0.8 wide and inside the bar."""
    d = F.col("seconds")
    width = F.least(F.lit(100.0), F.greatest(F.lit(0.8), (F.col("end_s") - F.col("start_s")) / d * 100))
    left = F.least(F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("start_s") / d * 100)), 100 - width)
    return items.join(durations, "match_id").where(d > 0).select("match_id", "lane", "id", left.alias("left_pct"), width.alias("width"))


def phase_at(times: DataFrame, phases: DataFrame) -> DataFrame:
    """The phase that covers a time: the last to start at or before it, if it has not ended."""
    from .islands import as_of

    e = phases.select("match_id", F.col("start_time_s").alias("t"), F.struct("phase_id", "end_time_s").alias("p"))
    e = e.groupBy("match_id", "t").agg(F.max("p").alias("p"))
    j = as_of(times, e, ["match_id"], "t", "p", "p")
    return j.withColumn("phase_id", F.when(F.col("t") < F.col("p.end_time_s"), F.col("p.phase_id"))).drop("p")


def interval_durations(intervals: DataFrame) -> DataFrame:
    return intervals.withColumn("seconds", F.greatest(F.lit(0.0), F.col("end_time_s") - F.col("start_time_s")))


def final_score(summary: DataFrame) -> DataFrame:
    s = F.concat(F.col("score_home").cast("string"), F.lit(":"), F.col("score_away").cast("string"))
    return summary.select("match_id", s.alias("score"))


def team_names(matches: DataFrame) -> DataFrame:
    return matches.select("match_id", F.coalesce(blank_to_null(F.col("team_a_name")), F.lit("A")).alias("team_a"), F.coalesce(blank_to_null(F.col("team_b_name")), F.lit("B")).alias("team_b"))


def play_listing(events: DataFrame) -> DataFrame:
    hundredths = F.floor(F.col("confidence") * 100 + 0.5).cast("long")
    line = F.concat_ws(" ", F.concat(clock(F.col("start_time_s")), F.lit("-"), clock(F.col("end_time_s"))), "play_type", "team", hundredths.cast("string"))
    return events.select("match_id", "event_id", line.alias("line"))


def plays_by_type(events: DataFrame) -> DataFrame:
    return events.groupBy("match_id", "play_type").agg(F.count("*").alias("plays"))


def sparse_selection(points: DataFrame, matches: DataFrame, least: int = 10) -> DataFrame:
    n = points.groupBy("match_id").agg(F.count("*").alias("n"))
    j = matches.select("match_id").join(n, "match_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return j.select("match_id", F.col("n").alias("points"), (F.col("n") == 0).alias("empty"), (F.col("n") < least).alias("sparse"))


def nearest_in_time(a: DataFrame, b: DataFrame) -> DataFrame:
    """For each item of ``a`` the item of ``b`` whose start is nearest (ties: the earlier): two as-of windows."""
    both = a.select("match_id", F.col("id"), F.col("start_s").alias("t"), F.lit(1).alias("own"), F.lit(None).cast("string").alias("other")).unionByName(
        b.select("match_id", F.lit(None).cast("string").alias("id"), F.col("start_s").alias("t"), F.lit(0).alias("own"), F.col("id").alias("other"))
    )
    w = Window.partitionBy("match_id").orderBy("t", "own", "other")
    o = F.when(F.col("own") == 0, F.struct("t", "other"))
    j = both.withColumn("before", F.last(o, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("after", F.last(o, ignorenulls=True).over(Window.partitionBy("match_id").orderBy(F.desc("t"), F.desc("own"), F.desc("other")).rowsBetween(Window.unboundedPreceding, -1)))
    pick = F.when(F.col("before").isNull() | (F.col("after.t") - F.col("t") < F.col("t") - F.col("before.t")), F.col("after")).otherwise(F.col("before"))
    return j.where("own = 1").select("match_id", "id", pick["other"].alias("nearest"), F.abs(pick["t"] - F.col("t")).alias("apart_s"))


def density_points(points: DataFrame, portrait: bool = False, margin_m: float = 1.5, px: float = 20.0) -> DataFrame:
    """Points on the drawing surface: pixels, and the stamp's radius from the zone's spread."""
    spread: Column = F.lit(1.0)
    for z, s in SPREADS.items():
        spread = F.when(zone_of(F.col("court_x"), F.col("court_y")) == z, s).otherwise(spread)
    x, y = (F.col("court_x") + margin_m) * px, (20.0 - F.col("court_y") + margin_m) * px
    return points.select("match_id", "frame_id", "track_id", (y if portrait else x).alias("px"), (x if portrait else y).alias("py"), F.floor(spread * 1.2 * px + 0.5).cast("long").alias("radius"))


def play_trajectories(events: DataFrame) -> DataFrame:
    """Tracks of events' details with two points at least: from and to in seconds, the goal's end, whether it is a
    team's centroid (track -1)."""
    t = events.select("match_id", "event_id", F.col("details.goal_x").alias("goal_x"), F.explode("details.tracks").alias("tr")).where(F.size("tr.points") >= 2)
    ends = [F.element_at("tr.points", 1)[0].alias("from_s"), F.element_at("tr.points", -1)[0].alias("to_s")]
    return t.select("match_id", "event_id", F.col("tr.track_id").alias("track_id"), *ends, F.size("tr.points").alias("n_points"), F.when(F.col("goal_x") < 20, "left").otherwise("right").alias("goal_end"), (F.col("tr.track_id") == -1).alias("centroid"))
