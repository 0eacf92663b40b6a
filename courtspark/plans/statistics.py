"""Queries over match statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import repair as R
from ..operators import stats as S
from .tracking import GOALS

FPS25 = "coalesce(nullif(fps, 0), 25e0)"
UP = "floor({x} * 10 + 0.5) / 10e0"
#: Zones by turned coordinates: u, v are x, y of the left half, or of the right half turned by 180 degrees.
TURNED = "SELECT *, CASE WHEN court_x < 20 THEN 'left' ELSE 'right' END AS half, CASE WHEN court_x < 20 THEN court_x ELSE 40 - court_x END AS u, CASE WHEN court_x < 20 THEN court_y ELSE 20 - court_y END AS v, CASE WHEN team IN ('A', 'B') THEN team ELSE 'U' END AS bucket FROM {players} WHERE court_x IS NOT NULL"
ZONE = "CASE WHEN u < 7 AND v BETWEEN 5 AND 15 THEN 'KL' WHEN u < 12 AND v >= 15 THEN 'LA' WHEN u < 12 AND v <= 5 THEN 'RA' WHEN v > 12 THEN 'RL' WHEN v < 8 THEN 'RR' ELSE 'RM' END"
COUNTS = f"""tu AS ({TURNED}), zn AS (SELECT match_id, half, {ZONE} AS zone, bucket FROM tu), gd AS (SELECT match_id, half, zone FROM {{matches}} CROSS JOIN (VALUES ('left'), ('right')) h(half) CROSS JOIN (VALUES ('LA'), ('RL'), ('RM'), ('RR'), ('RA'), ('KL')) z(zone)),
zc AS (SELECT gd.match_id, gd.half, gd.zone, count(*) FILTER (bucket = 'A') AS a, count(*) FILTER (bucket = 'B') AS b, count(*) FILTER (bucket = 'U') AS u FROM gd LEFT JOIN zn USING (match_id, half, zone) GROUP BY ALL)"""
INTENSITY = f"{COUNTS}, zi AS (SELECT match_id, half, zone, CASE WHEN max(a + b + u) OVER w > 0 THEN floor((a + b + u) / max(a + b + u) OVER w * 100 * 10 + 0.5) / 10e0 ELSE 0e0 END AS intensity FROM zc WINDOW w AS (PARTITION BY match_id, half))"
BUCKET = "CASE WHEN team IN ('A', 'B') THEN team ELSE 'U' END"
INSIDE = "court_x BETWEEN 0 AND 40 AND court_y BETWEEN 0 AND 20"
STATS = f"""p AS (SELECT match_id, count(DISTINCT track_id) AS tracks, count(DISTINCT frame_id) AS player_frames, count(DISTINCT CASE WHEN court_x IS NOT NULL AND court_y IS NOT NULL THEN frame_id END) AS court_frames FROM {{players}} GROUP BY match_id),
b AS (SELECT match_id, count(*) AS ball_rows FROM {{ball}} GROUP BY match_id),
ms AS (SELECT m.match_id, total_frames, {FPS25} AS fps, coalesce(tracks, 0) AS tracks, coalesce(player_frames, 0) AS player_frames, coalesce(court_frames, 0) AS court_frames, coalesce(ball_rows, 0) AS ball_rows,
 {UP.format(x='(coalesce(player_frames, 0) / total_frames * 100)')} AS player_rate, {UP.format(x='(coalesce(court_frames, 0) / total_frames * 100)')} AS court_rate, {UP.format(x='(coalesce(ball_rows, 0) / total_frames * 100)')} AS ball_rate, {UP.format(x=f'(total_frames / {FPS25})')} AS duration_s
 FROM {{matches}} m LEFT JOIN p USING (match_id) LEFT JOIN b USING (match_id))"""
SHARE = f"sh AS (SELECT match_id, {UP.format(x='(count(*) FILTER (team = $$A$$) / count(*) * 100)')} AS possession_a, {UP.format(x='(count(*) FILTER (team = $$B$$) / count(*) * 100)')} AS possession_b FROM {{players}} WHERE has_ball GROUP BY match_id)".replace("$$", "'")
TRACKS = f"""pt AS (SELECT match_id, track_id, arg_min(team, frame_id) AS team, count(*) AS rows, avg(confidence) AS conf, sum(floor(sqrt(velocity_x * velocity_x + velocity_y * velocity_y) * 1000 + 0.5)) AS mm FROM {{players}} GROUP BY ALL),
ps AS (SELECT match_id, track_id, team, rows, {UP.format(x='(conf * 100)')} AS confidence, {UP.format(x=f'(mm / 1000e0 / {FPS25})')} AS distance_m FROM (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY rows DESC, track_id) AS rn FROM pt) JOIN {{matches}} USING (match_id) WHERE rn <= 25)"""
COUNT_F = "fc AS (SELECT match_id, team, formation, count(*) AS n, min(frame_id) AS first FROM {formation_labels} GROUP BY ALL), fd AS (SELECT match_id, team, formation, n, row_number() OVER (PARTITION BY match_id, team ORDER BY n DESC, first, formation) = 1 AS dominant FROM fc)"
SUMMARY = """pl AS (SELECT e.match_id, play_type, e.team, count(*) AS plays, floor(avg(confidence) * 1000 + 0.5) / 1000e0 AS confidence, count(DISTINCT e.sequence_id) FILTER (outcome IN ('goal', 'no_goal')) AS rated, count(DISTINCT e.sequence_id) FILTER (outcome = 'goal') AS goals FROM {play_events} e LEFT JOIN {attack_sequences} s ON s.match_id = e.match_id AND s.sequence_id = e.sequence_id GROUP BY ALL)"""
LABELS = "lb AS (SELECT match_id, event_id, verdict FROM (SELECT *, row_number() OVER (PARTITION BY match_id, event_id ORDER BY labeled_at DESC, coalesce(verdict, '') DESC) AS rn FROM {play_event_labels}) WHERE rn = 1 AND verdict IS NOT NULL)"


def labels(t):
    from ..operators.tables import apply_labels

    return apply_labels(t.play_event_labels)


def goals(t):
    return R.detect_goals(t.scoreboard_readings)


def flat_summary(t):
    m = S.formation_summary(t.formation_labels)
    return m.select("match_id", "team", "dominant", F.size("formations").alias("kinds"), F.element_at("formations", "6-0").alias("n_60"))


PLANS = {
    "g1_match_stats": (lambda t: S.match_stats(t.matches, t.players.repartition(t.parts(), "match_id"), t.ball), f"WITH {STATS} SELECT * FROM ms"),
    "g1_sketched_counts": (lambda t: S.sketched_counts(S.match_sketches(t.players)), None),
    "g2_possession_share": (lambda t: S.possession_share(t.players), f"WITH {SHARE} SELECT * FROM sh"),
    "g3_player_stats": (lambda t: S.player_stats(t.players, t.matches), f"WITH {TRACKS} SELECT * FROM ps"),
    "g4_zone_of": (
        lambda t: t.players.where("court_x is not null").select("match_id", "frame_id", "track_id", S.half_of(F.col("court_x")).alias("half"), S.zone_of(F.col("court_x"), F.col("court_y")).alias("zone")),
        f"WITH tu AS ({TURNED}) SELECT match_id, frame_id, track_id, half, {ZONE} AS zone FROM tu",
    ),
    "g5_zone_intensity": (lambda t: S.zone_intensity(t.players, t.matches), f"WITH {INTENSITY} SELECT * FROM zi"),
    "g6_zone_counts_by_team": (lambda t: S.zone_counts(t.players, t.matches), f"WITH {COUNTS} SELECT * FROM zc"),
    "g7_sample_points": (
        lambda t: S.sample_points(t.players),
        f"SELECT match_id, frame_id, track_id, court_x, court_y, {BUCKET} AS team FROM (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY frame_id, track_id) AS rn FROM {{players}} WHERE {INSIDE} AND frame_id % 100 = 0) WHERE rn <= 12000",
    ),
    "g8_phase_points": (
        lambda t: S.phase_points(t.players, t.team_phases),
        f"SELECT p.match_id, frame_id, track_id, court_x, court_y, {BUCKET} AS team, phase_id, CASE WHEN {BUCKET} = offense_team THEN 'offense' WHEN {BUCKET} = defense_team THEN 'defense' END AS perspective FROM {{players}} p JOIN {{team_phases}} h ON h.match_id = p.match_id AND frame_id BETWEEN start_frame AND end_frame WHERE {INSIDE} AND frame_id % 4 = 0",
    ),
    "g8_window_points": (
        lambda t: S.window_points(t.players, t.matches, 1.3, 4.7),
        f"SELECT p.match_id, frame_id, track_id, court_x, court_y, {BUCKET} AS team FROM {{players}} p JOIN {{matches}} m USING (match_id) WHERE {INSIDE} AND frame_id BETWEEN greatest(0, floor({FPS25} * 1.3e0)) AND least(total_frames, floor({FPS25} * 4.7e0))",
    ),
    "g8_heatmap_phase": (
        lambda t: S.heatmap_points(t.players, t.matches, t.team_phases, phase_id=8, perspective="defense", window=(2.5, 3.2)),
        f"""WITH h AS (SELECT *, greatest(start_frame, floor(start_frame + (greatest(2.5, start_time_s) - start_time_s) * ((end_frame - start_frame) / (end_time_s - start_time_s)))) AS low, least(end_frame, floor(start_frame + (least(3.2, end_time_s) - start_time_s) * ((end_frame - start_frame) / (end_time_s - start_time_s)))) AS high FROM {{team_phases}} WHERE phase_id = 8)
 SELECT p.match_id, frame_id, track_id, court_x, court_y, {BUCKET} AS team FROM {{players}} p JOIN h ON h.match_id = p.match_id AND frame_id BETWEEN low AND high AND p.team = defense_team WHERE {INSIDE} AND frame_id % 100 = 0""",
    ),
    "g8_heatmap_match": (
        lambda t: S.heatmap_points(t.players, t.matches, t.team_phases, tracks=[1, 2, 3, 4, 5], perspective="offense", window=(0.0, 21.5)),
        f"""SELECT match_id, frame_id, track_id, court_x, court_y, team FROM (SELECT p.match_id, frame_id, track_id, court_x, court_y, {BUCKET} AS team, row_number() OVER (PARTITION BY p.match_id ORDER BY frame_id, track_id) AS rn FROM {{players}} p JOIN {{matches}} m USING (match_id)
 JOIN {{team_phases}} h ON h.match_id = p.match_id AND frame_id BETWEEN start_frame AND end_frame AND p.team = offense_team WHERE {INSIDE} AND frame_id % 100 = 0 AND track_id <= 5 AND frame_id BETWEEN 0 AND least(total_frames, floor({FPS25} * 21.5e0))) WHERE rn <= 12000""",
    ),
    "g9_available_tracks": (
        lambda t: S.available_tracks(t.players, t.matches),
        f"""WITH g AS (SELECT match_id, track_id, {BUCKET} AS team, min(frame_id) AS f, max(frame_id) AS l, count(*) AS points FROM {{players}} WHERE {INSIDE} GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY match_id, track_id ORDER BY points DESC, team) AS rn FROM g)
 SELECT match_id, track_id, team, points, floor(f / {FPS25} * 10 + 0.5) / 10e0 AS first_s, floor(l / {FPS25} * 10 + 0.5) / 10e0 AS last_s FROM r JOIN {{matches}} USING (match_id) WHERE rn = 1""",
    ),
    "g10_scoreboard": (lambda t: S.scoreboard(t.scoreboard_readings), "SELECT * FROM {scoreboard_readings} WHERE game_time IS NOT NULL"),
    "g11_scoreboard_summary": (
        lambda t: S.scoreboard_summary(t.scoreboard_readings, goals(t)),
        f"""WITH RECURSIVE {GOALS}, l AS (SELECT match_id, count(*) AS readings, max(frame_number) FILTER (score_home IS NOT NULL AND score_away IS NOT NULL) AS f FROM {{scoreboard_readings}} GROUP BY match_id), g AS (SELECT match_id, count(*) AS goals, max(frame_number) AS last_goal_frame FROM gs WHERE goal IS NOT NULL GROUP BY match_id)
 SELECT l.match_id, readings, score_home, score_away, game_time, coalesce(goals, 0) AS goals, last_goal_frame FROM l LEFT JOIN {{scoreboard_readings}} x ON x.match_id = l.match_id AND x.frame_number = f LEFT JOIN g ON g.match_id = l.match_id""",
    ),
    "g12_goals": (lambda t: goals(t).select("match_id", "frame_number", "team", "score_home", "score_away"), f"WITH RECURSIVE {GOALS} SELECT match_id, frame_number, goal AS team, h AS score_home, a AS score_away FROM gs WHERE goal IS NOT NULL"),
    "g13_formations_with_source": (
        lambda t: S.formations_with_source(t.formation_labels.join(t.matches.where("team_a_name is not null").select("match_id"), "match_id", "left_semi").where("formation <> 'unknown'"), t.formation_labels),
        "WITH e AS (SELECT * FROM {formation_labels} WHERE formation <> 'unknown' AND match_id IN (SELECT match_id FROM {matches} WHERE team_a_name IS NOT NULL)) SELECT *, 'embedding' AS source FROM e UNION ALL SELECT *, 'rules' AS source FROM {formation_labels} WHERE match_id NOT IN (SELECT match_id FROM e)",
    ),
    "g14_formation_summary": (flat_summary, f"WITH {COUNT_F} SELECT match_id, team, any_value(formation) FILTER (dominant) AS dominant, cast(count(*) AS int) AS kinds, any_value(n) FILTER (formation = '6-0') AS n_60 FROM fd GROUP BY match_id, team"),
    "g14_formation_counts": (lambda t: S.formation_counts(t.formation_labels), f"WITH {COUNT_F} SELECT * FROM fd"),
    "g15_scenes_query": (
        lambda t: _scenes(t).where("formation = '6-0' and team = 'A'").select("match_id", "formation", "start_frame", "end_frame"),
        """WITH c AS (SELECT *, CASE WHEN formation = lag(formation) OVER (PARTITION BY match_id, team ORDER BY frame_id) THEN 0 ELSE 1 END AS n FROM {formation_labels}), i AS (SELECT *, sum(n) OVER (PARTITION BY match_id, team ORDER BY frame_id) AS isl FROM c)
 SELECT match_id, formation, min(frame_id) AS start_frame, max(frame_id) AS end_frame FROM i WHERE formation = '6-0' AND team = 'A' GROUP BY match_id, formation, isl HAVING max(frame_id) - min(frame_id) + 5 >= 25""",
    ),
    "g16_plays_query": (
        lambda t: S.plays_query(t.play_events, t.attack_sequences, labels(t)).select("match_id", "event_id", "play_type", "team", "sequence_id", "outcome", "verdict"),
        f"WITH {LABELS} SELECT e.match_id, e.event_id, play_type, e.team, e.sequence_id, outcome, verdict FROM {{play_events}} e LEFT JOIN {{attack_sequences}} s ON s.match_id = e.match_id AND s.sequence_id = e.sequence_id LEFT JOIN lb ON lb.match_id = e.match_id AND lb.event_id = e.event_id",
    ),
    "g17_play_summary": (lambda t: S.play_summary(t.play_events, t.attack_sequences), f"WITH {SUMMARY} SELECT *, CASE WHEN rated > 0 THEN floor(goals / rated * 1000 + 0.5) / 1000e0 END AS success FROM pl"),
    "g18_attacks_query": (lambda t: t.attack_sequences.where("outcome <> 'unknown'"), "SELECT * FROM {attack_sequences} WHERE outcome <> 'unknown'"),
    "g19_team_phases_query": (lambda t: t.team_phases.where("offense_team = 'A' and phase_type = 'attack'"), "SELECT * FROM {team_phases} WHERE offense_team = 'A' AND phase_type = 'attack'"),
    "g20_match_duration": (
        lambda t: S.match_duration(t.matches),
        "SELECT match_id, lpad(cast(cast(floor(s / 60) AS bigint) AS varchar), cast(greatest(2, length(cast(cast(floor(s / 60) AS bigint) AS varchar))) AS integer), '0') || ':' || lpad(cast(s % 60 AS varchar), 2, '0') AS duration FROM (SELECT match_id, cast(floor(total_frames / coalesce(nullif(fps, 0), 1e0)) AS bigint) AS s FROM {matches})",
    ),
}


def _scenes(t):
    from ..operators.phases import formation_scenes
    from .tracking import fps

    return formation_scenes(t.formation_labels, fps(t))
