"""Queries over report tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.court import clock
from ..operators import report as P
from ..operators import stats as S
from ..operators import tables as O
from .statistics import BUCKET, COUNT_F, COUNTS, INSIDE, INTENSITY, SHARE, STATS, SUMMARY, TRACKS, ZONE

POINTS = f"pn AS (SELECT match_id, frame_id, track_id, court_x, court_y, {BUCKET} AS team FROM {{players}} WHERE {INSIDE})"
PN_ZONE = f"pz AS (SELECT match_id, half, {ZONE} AS zone, team FROM (SELECT *, CASE WHEN court_x < 20 THEN 'left' ELSE 'right' END AS half, CASE WHEN court_x < 20 THEN court_x ELSE 40 - court_x END AS u, CASE WHEN court_x < 20 THEN court_y ELSE 20 - court_y END AS v FROM pn))"
DIST = f"""{POINTS}, {PN_ZONE}, gd AS (SELECT match_id, half, zone FROM {{matches}} CROSS JOIN (VALUES ('left'), ('right')) h(half) CROSS JOIN (VALUES ('LA'), ('RL'), ('RM'), ('RR'), ('RA'), ('KL')) z(zone)),
di AS (SELECT gd.match_id, gd.half, gd.zone, count(*) FILTER (team = 'A') AS a, count(*) FILTER (team = 'B') AS b, count(*) FILTER (team = 'U') AS u, count(team) AS total FROM gd LEFT JOIN pz USING (match_id, half, zone) GROUP BY ALL)"""
SPREAD = "CASE zone WHEN 'LA' THEN 0.96e0 WHEN 'RL' THEN 1.09e0 WHEN 'RM' THEN 1.3e0 WHEN 'RR' THEN 1.09e0 WHEN 'RA' THEN 0.96e0 ELSE 0.78e0 END"
DENSITY = f"""{POINTS}, nn AS (SELECT match_id, team, count(*) AS n FROM pn GROUP BY ALL), pz AS (SELECT *, {ZONE} AS zone FROM (SELECT *, CASE WHEN court_x < 20 THEN court_x ELSE 40 - court_x END AS u, CASE WHEN court_x < 20 THEN court_y ELSE 20 - court_y END AS v FROM pn)),
st AS (SELECT match_id, team, cx AS cell_x, cy AS cell_y, least(0.6e0, greatest(0.015e0, 120e0 / n)) AS peak, ((cx + 0.5 - court_x) * (cx + 0.5 - court_x) + (cy + 0.5 - court_y) * (cy + 0.5 - court_y)) / ({SPREAD} * 1.2e0 * {SPREAD} * 1.2e0) AS r2
 FROM pz JOIN nn USING (match_id, team) JOIN range(0, 40) xs(cx) ON abs(least(floor(court_x), 39) - cx) <= 3 JOIN range(0, 20) ys(cy) ON abs(least(floor(court_y), 19) - cy) <= 3),
al AS (SELECT *, peak * greatest(0, (exp(-r2 / 0.245e0) - exp(-1 / 0.245e0)) / (1 - exp(-1 / 0.245e0))) AS alpha FROM st), dg AS (SELECT match_id, team, cell_x, cell_y, floor((1 - exp(sum(ln(1 - alpha)))) * 1000 + 0.5) / 1000e0 AS density FROM al WHERE alpha > 0 GROUP BY ALL)"""
TITLES = """me AS (SELECT match_id, arg_max(display_name, seq) FILTER (display_name IS NOT NULL) AS display_name, arg_max(file_name, seq) FILTER (file_name IS NOT NULL) AS file_name FROM {meta_updates} GROUP BY match_id),
ti AS (SELECT match_id, status, display_name, file_name, coalesce(nullif(trim(display_name), ''), nullif(trim(file_name), ''), match_id) AS title FROM {statuses} LEFT JOIN me USING (match_id))"""
ITEMS = """it AS (SELECT match_id, 'phase' AS lane, 'phase-' || phase_id AS id, start_time_s AS start_s, end_time_s AS end_s, phase_type AS label, offense_team AS team FROM {team_phases}
 UNION ALL SELECT match_id, 'play', 'play-' || event_id, start_time_s, end_time_s, play_type, team FROM {play_events}
 UNION ALL SELECT match_id, 'goal', 'goal-' || frame_number, timestamp_sec, timestamp_sec, game_time, CASE WHEN score_home > score_away THEN 'home' ELSE 'away' END FROM {scoreboard_readings} WHERE score_home IS NOT NULL)"""
CLOCK = "(CASE WHEN {s} // 60 < 10 THEN '0' ELSE '' END || {s} // 60 || ':' || lpad(cast({s} % 60 AS varchar), 2, '0'))"


def points(t):
    return S.court_points(t.players)


def thousandths(c):
    """A column rounded to thousandths; NaN, which has no whole number below it, stays."""
    return F.when(F.isnan(c), F.col(c)).otherwise(F.floor(F.col(c) * 1000 + 0.5 + 1e-9) / 1000).alias(c)


def titles(t):
    return P.match_titles(t.statuses, O.merge_meta(t.meta_updates, ["display_name", "file_name"]))


def items(t):
    goals = t.scoreboard_readings.where("score_home is not null").withColumn("team", F.when(F.col("score_home") > F.col("score_away"), "home").otherwise("away"))
    none = t.team_phases.limit(0).selectExpr("match_id", "phase_id as scene_id", "offense_team as team", "'' as formation", "start_time_s", "end_time_s")
    return P.timeline_items(goals, t.team_phases, t.play_events, none)


PLANS = {
    "h1_zone_distribution": (lambda t: P.zone_distribution(points(t), t.matches), f"WITH {DIST} SELECT * FROM di"),
    "h2_busiest_zones": (lambda t: P.busiest_zones(P.zone_distribution(points(t), t.matches), 3), f"WITH {DIST} SELECT match_id, place, half, zone, total FROM (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY total DESC, half, zone) AS place FROM di WHERE total > 0) WHERE place <= 3"),
    "h3_team_totals": (lambda t: P.team_totals(points(t)), f"WITH {POINTS} SELECT match_id, team, count(*) AS points FROM pn GROUP BY ALL"),
    "h4_zone_tiles": (
        lambda t: P.zone_tiles(S.zone_intensity(t.players, t.matches), S.zone_counts(t.players, t.matches)),
        f"WITH {INTENSITY}, tl AS (SELECT match_id, half, zone, a + b + u AS total, (a + b + u) / sum(a + b + u) OVER (PARTITION BY match_id) AS share, a + b + u > 0 AS active, cast(floor(intensity * 0.94e0 + 6 + 0.5) AS bigint) AS fill FROM zi JOIN zc USING (match_id, half, zone)) SELECT *, fill >= 62 AS inverted FROM tl",
    ),
    "h6_density_grid": (lambda t: P.density_grid(points(t).repartition(t.parts(), "match_id"), digits=3), f"WITH {DENSITY} SELECT match_id, team, cast(cell_x AS int) AS cell_x, cast(cell_y AS int) AS cell_y, density FROM dg"),
    "h7_density_colour": (
        lambda t: P.density_colour(P.density_grid(points(t).repartition(t.parts(), "match_id"), digits=3)).select("match_id", "cell_x", "cell_y", thousandths("opacity"), thousandths("share_a")),
        f"""WITH {DENSITY}, c AS (SELECT match_id, cell_x, cell_y, sum(density) AS total, sum(CASE WHEN team = 'A' THEN density ELSE 0 END) AS a FROM dg GROUP BY ALL), v AS (SELECT *, total / max(total) OVER (PARTITION BY match_id) AS v FROM c)
 SELECT match_id, cast(cell_x AS int) AS cell_x, cast(cell_y AS int) AS cell_y, floor(CASE WHEN v <= 0.04 THEN 0 ELSE 0.1 + 0.7 * pow((v - 0.04e0) / 0.96e0, 0.6e0) END * 1000 + 0.5 + 1e-9) / 1000e0 AS opacity, floor(a / total * 1000 + 0.5 + 1e-9) / 1000e0 AS share_a FROM v""",
    ),
    "h8_formation_table": (
        lambda t: P.formation_table(S.formation_counts(t.formation_labels)),
        f"WITH {COUNT_F}, r AS (SELECT match_id, team, formation, n, n / sum(n) OVER (PARTITION BY match_id, team) AS share, row_number() OVER (PARTITION BY match_id, team ORDER BY n DESC, formation) AS place FROM fd WHERE formation NOT IN ('attack', 'transition', 'unknown')) SELECT *, place = 1 AS dominant FROM r",
    ),
    "h9_play_type_table": (
        lambda t: P.play_type_table(S.play_summary(t.play_events, t.attack_sequences)),
        f"WITH {SUMMARY}, g AS (SELECT match_id, play_type, cast(sum(plays) AS bigint) AS plays, cast(sum(rated) AS bigint) AS rated, cast(sum(goals) AS bigint) AS goals, sum(floor(confidence * 1000 + 0.5) * plays) / sum(plays) / 1000e0 AS confidence FROM pl GROUP BY ALL) SELECT *, plays / sum(plays) OVER (PARTITION BY match_id) AS share, CASE WHEN rated > 0 THEN goals / rated END AS success FROM g",
    ),
    "h11_key_figures": (
        lambda t: P.key_figures(S.match_stats(t.matches, t.players.repartition(t.parts(), "match_id"), t.ball), S.possession_share(t.players)),
        f"WITH {STATS}, {SHARE} SELECT match_id, CASE WHEN total_frames > 0 THEN tracks END AS tracks, CASE WHEN total_frames > 0 THEN player_rate END AS player_rate, CASE WHEN total_frames > 0 THEN court_rate END AS court_rate, CASE WHEN total_frames > 0 THEN ball_rate END AS ball_rate, CASE WHEN possession_a + possession_b > 0 THEN greatest(0, floor((100 - possession_a - possession_b) * 10 + 0.5) / 10e0) END AS unassigned FROM ms LEFT JOIN sh USING (match_id)",
    ),
    "h12_team_bucket": (
        lambda t: t.matches.select("match_id", P.report_bucket(F.col("team_a_name")).alias("a"), P.report_bucket(F.lower(F.col("team_b_name"))).alias("b")),
        "SELECT match_id, CASE WHEN coalesce(upper(trim(team_a_name)), '') IN ('', 'UNKNOWN') THEN 'U' ELSE upper(trim(team_a_name)) END AS a, CASE WHEN coalesce(upper(trim(team_b_name)), '') IN ('', 'UNKNOWN') THEN 'U' ELSE upper(trim(team_b_name)) END AS b FROM {matches}",
    ),
    "h13_track_table": (
        lambda t: P.track_table(S.player_stats(t.players, t.matches), "distance_m"),
        f"WITH {TRACKS} SELECT match_id, row_number() OVER (PARTITION BY match_id ORDER BY distance_m DESC, track_id) AS place, track_id, CASE WHEN team IN ('A', 'B') THEN team ELSE 'U' END AS bucket, distance_m FROM ps",
    ),
    "h14_track_buckets": (lambda t: P.track_buckets(S.player_stats(t.players, t.matches), [1, 3, 5]), f"WITH {TRACKS} SELECT match_id, CASE WHEN team IN ('A', 'B') THEN team ELSE 'U' END AS bucket, count(*) AS tracks, count(*) FILTER (track_id IN (1, 3, 5)) AS selected FROM ps GROUP BY ALL"),
    "h15_match_search": (lambda t: P.match_search(titles(t), " M1"), f"WITH {TITLES} SELECT * FROM ti WHERE contains(lower(match_id), 'm1') OR contains(lower(display_name), 'm1') OR contains(lower(file_name), 'm1') OR contains(lower(title), 'm1')"),
    "h16_match_list_summary": (lambda t: P.match_list_summary(S.match_duration(t.matches)), "SELECT count(*) AS matches, cast(floor(sum(floor(total_frames / coalesce(nullif(fps, 0), 1e0))) / 60 + 0.5) AS bigint) AS minutes FROM {matches}"),
    "h17_timeline_items": (items, f"WITH {ITEMS} SELECT * FROM it"),
    "h18_phase_at": (
        lambda t: P.phase_at(t.frames.selectExpr("match_id", "frame_id", "timestamp_s as t"), t.team_phases).select("match_id", "frame_id", "t", "phase_id"),
        "SELECT f.match_id, f.frame_id, f.timestamp_s AS t, CASE WHEN f.timestamp_s < p.end_time_s THEN phase_id END AS phase_id FROM {frames} f ASOF LEFT JOIN {team_phases} p ON p.match_id = f.match_id AND f.timestamp_s >= p.start_time_s",
    ),
    "h19_time_bars": (
        lambda t: P.time_bars(items(t), t.matches.select("match_id", (F.col("total_frames") / 32).alias("seconds"))),
        f"WITH {ITEMS}, w AS (SELECT it.*, total_frames / 32e0 AS d, least(100, greatest(0.8e0, (end_s - start_s) / (total_frames / 32e0) * 100)) AS width FROM it JOIN {{matches}} USING (match_id)) SELECT match_id, lane, id, least(greatest(0, least(100, start_s / d * 100)), 100 - width) AS left_pct, width FROM w",
    ),
    "h20_interval_durations": (lambda t: P.interval_durations(t.team_phases).select("match_id", "phase_id", "seconds"), "SELECT match_id, phase_id, greatest(0, end_time_s - start_time_s) AS seconds FROM {team_phases}"),
    "h21_final_score": (
        lambda t: P.final_score(t.scoreboard_readings),
        "SELECT match_id, score_home || ':' || score_away AS score FROM {scoreboard_readings}",
    ),
    "h22_team_names": (lambda t: P.team_names(t.matches), "SELECT match_id, coalesce(nullif(trim(team_a_name), ''), 'A') AS team_a, coalesce(nullif(trim(team_b_name), ''), 'B') AS team_b FROM {matches}"),
    "h23_format_clock": (
        lambda t: t.scoreboard_readings.select("match_id", "frame_number", clock(F.col("timestamp_sec") * 8 - 100).alias("clock")),
        f"SELECT match_id, frame_number, {CLOCK.format(s='greatest(0, cast(floor(timestamp_sec * 8 - 100) AS bigint))')} AS clock FROM {{scoreboard_readings}}",
    ),
    "h24_nearest_in_time": (
        lambda t: P.nearest_in_time(items(t).where("lane = 'play'"), items(t).where("lane = 'phase'")),
        f"WITH {ITEMS} SELECT match_id, id, nearest, apart_s FROM (SELECT a.match_id, a.id, b.id AS nearest, abs(b.start_s - a.start_s) AS apart_s, row_number() OVER (PARTITION BY a.match_id, a.id ORDER BY abs(b.start_s - a.start_s), b.start_s) AS rn FROM it a JOIN it b ON b.match_id = a.match_id AND b.lane = 'phase' WHERE a.lane = 'play') WHERE rn = 1",
    ),
    "h25_sparse_selection": (lambda t: P.sparse_selection(points(t).where("team = 'A' and court_x < 4"), t.matches), f"WITH {POINTS}, n AS (SELECT match_id, count(*) AS n FROM pn WHERE team = 'A' AND court_x < 4 GROUP BY ALL) SELECT match_id, coalesce(n, 0) AS points, coalesce(n, 0) = 0 AS empty, coalesce(n, 0) < 10 AS sparse FROM {{matches}} LEFT JOIN n USING (match_id)"),
    "h26_play_listing": (
        lambda t: P.play_listing(t.play_events),
        f"SELECT match_id, event_id, {CLOCK.format(s='cast(floor(start_time_s) AS bigint)')} || '-' || {CLOCK.format(s='cast(floor(end_time_s) AS bigint)')} || ' ' || play_type || ' ' || team || ' ' || cast(floor(confidence * 100 + 0.5) AS bigint) AS line FROM {{play_events}}",
    ),
    "h27_plays_by_type": (lambda t: P.plays_by_type(t.play_events), "SELECT match_id, play_type, count(*) AS plays FROM {play_events} GROUP BY ALL"),
}
