"""Queries over track repair, formations, possession and phases."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import phases as P
from ..operators import repair as R
from ..operators import tables as O
from ..sources.shared import written
from .maintenance import sql_view

FPS = "fps AS (SELECT match_id, coalesce(nullif(fps, 0), 30e0) AS fps FROM {matches})"
#: Short tracks and long ones, with jumps: tracks of one match are cut into pieces of varying length.
TRACKS = """SELECT match_id, frame_id, track_id * 100 + cast(floor(frame_id / CASE WHEN track_id % 3 = 0 THEN 9 ELSE 60 END) AS int) AS track_id, bbox_x1, bbox_y1, bbox_x2, bbox_y2 FROM {players}"""
CENTRED = "(bbox_x1 + bbox_x2) / 2 AS cx, (bbox_y1 + bbox_y2) / 2 AS cy"


def fps(t):
    return t.matches.selectExpr("match_id", "coalesce(nullif(fps, 0), 30.0D) as fps")


def tracks(t):
    return sql_view(t, TRACKS)


def merged(t):
    held = written(tracks(t), "tracks")
    return R.merge_id_switches(held, R.detect_id_switches(held, 8, 400.0), t.parts())


def series(t):
    return P.carrier_series(t.frames, t.carriers)


def runs_sql(series: str, team: str, gap: str, least: str) -> str:
    """Runs of a team as in the operators' rule, over (match_id, frame_id, timestamp_s, team, fps)."""
    return f"""
q AS (SELECT *, last_value(CASE WHEN {team} IS NOT NULL THEN frame_id END IGNORE NULLS) OVER w AS lf, last_value({team} IGNORE NULLS) OVER w AS lt,
  lag(frame_id) OVER v AS pf, lag({team}) OVER v AS pt FROM {series} WINDOW v AS (PARTITION BY match_id ORDER BY frame_id), w AS (PARTITION BY match_id ORDER BY frame_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
r AS (SELECT *, sum(CASE WHEN lt IS NULL OR lt <> {team} OR (pt IS NULL AND pf - lf > floor(fps * {gap})) THEN 1 ELSE 0 END) OVER (PARTITION BY match_id ORDER BY frame_id) AS run FROM q WHERE {team} IS NOT NULL),
g AS (SELECT match_id, run, any_value({team}) AS team, min(frame_id) AS start_frame, max(frame_id) AS end_frame, min(timestamp_s) AS start_time_s, max(timestamp_s) AS end_time_s, any_value(fps) AS fps FROM r GROUP BY match_id, run),
k AS (SELECT match_id, team, start_frame, end_frame, start_time_s, end_time_s, row_number() OVER (PARTITION BY match_id ORDER BY start_frame) - 1 AS phase_id FROM g WHERE end_frame - start_frame >= floor(fps * {least}))"""


GHOSTS = f"""
t AS ({TRACKS}), n AS (SELECT match_id, track_id, count(DISTINCT frame_id) AS n FROM t GROUP BY ALL), c AS (SELECT t.*, {CENTRED}, n FROM t JOIN n USING (match_id, track_id)),
s AS (SELECT match_id, track_id AS target, avg(cx) AS mx, avg(cy) AS my FROM c WHERE n >= 10 GROUP BY ALL), gh AS (SELECT match_id, frame_id, track_id, cx, cy FROM c WHERE n < 10),
p AS (SELECT gh.match_id, frame_id, track_id, target, sqrt((cx - mx) * (cx - mx) + (cy - my) * (cy - my)) AS dist FROM gh JOIN s USING (match_id)),
o AS (SELECT * FROM p WHERE dist <= 150 AND NOT EXISTS (SELECT 1 FROM t WHERE t.match_id = p.match_id AND t.frame_id = p.frame_id AND t.track_id = p.target)),
b AS (SELECT match_id, frame_id, track_id, target FROM (SELECT *, row_number() OVER (PARTITION BY match_id, frame_id, track_id ORDER BY dist, target) AS rn FROM o) WHERE rn = 1),
a AS (SELECT gh.match_id, gh.frame_id, gh.track_id, w.target FROM gh LEFT JOIN (SELECT match_id, frame_id, target, min(track_id) AS track_id FROM b GROUP BY ALL) w ON w.match_id = gh.match_id AND w.frame_id = gh.frame_id AND w.track_id = gh.track_id)"""

LINEAR = """coalesce({c}, v0 + (v1 - v0) * (ord - o0) / (o1 - o0), v0)"""
INTERPOLATED = """
grid AS (SELECT match_id, frame_id, row_number() OVER (PARTITION BY match_id ORDER BY frame_id) AS ord FROM {frames}),
life AS (SELECT match_id, track_id, min(frame_id) AS lo, max(frame_id) AS hi FROM {players} GROUP BY ALL),
al AS (SELECT g.match_id, g.frame_id, g.ord, l.track_id, p.court_x, p.bbox_x1, p.team, p.track_id IS NOT NULL AS observed FROM life l JOIN grid g ON g.match_id = l.match_id AND g.frame_id BETWEEN lo AND hi LEFT JOIN {players} p ON p.match_id = g.match_id AND p.frame_id = g.frame_id AND p.track_id = l.track_id),
x AS (SELECT *, last_value(court_x IGNORE NULLS) OVER b AS v0, last_value(CASE WHEN court_x IS NOT NULL THEN ord END IGNORE NULLS) OVER b AS o0, first_value(court_x IGNORE NULLS) OVER f AS v1, first_value(CASE WHEN court_x IS NOT NULL THEN ord END IGNORE NULLS) OVER f AS o1,
  last_value(bbox_x1 IGNORE NULLS) OVER b AS b0, last_value(CASE WHEN observed THEN ord END IGNORE NULLS) OVER b AS p0, first_value(bbox_x1 IGNORE NULLS) OVER f AS b1, first_value(CASE WHEN observed THEN ord END IGNORE NULLS) OVER f AS p1, last_value(team IGNORE NULLS) OVER b AS team2
  FROM al WINDOW b AS (PARTITION BY match_id, track_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY match_id, track_id ORDER BY ord ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""

GOALS = """
gr AS (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY frame_number) AS i, last_value(game_time IGNORE NULLS) OVER (PARTITION BY match_id ORDER BY frame_number ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS clock FROM {scoreboard_readings} WHERE score_home IS NOT NULL AND score_away IS NOT NULL),
gs(match_id, i, h, a, goal, frame_number, timestamp_sec, clock) AS (SELECT match_id, i, score_home, score_away, cast(NULL AS varchar), frame_number, timestamp_sec, clock FROM gr WHERE i = 1
 UNION ALL SELECT r.match_id, r.i, CASE WHEN g THEN r.score_home ELSE s.h END, CASE WHEN g THEN r.score_away ELSE s.a END, CASE WHEN g THEN CASE WHEN r.score_home > s.h THEN 'home' ELSE 'away' END END, r.frame_number, r.timestamp_sec, r.clock
 FROM gs s JOIN gr r ON r.match_id = s.match_id AND r.i = s.i + 1, LATERAL (SELECT (r.score_home - s.h = 1 AND r.score_away = s.a) OR (r.score_home = s.h AND r.score_away - s.a = 1) AS g))"""

KEEPER = "gk AS (SELECT match_id, frame_id, cx AS gk_x, cy AS gk_y FROM (SELECT *, (bbox_x1 + bbox_x2) / 2 AS cx, (bbox_y1 + bbox_y2) / 2 AS cy, row_number() OVER (PARTITION BY match_id, frame_id ORDER BY (bbox_x2 - bbox_x1) * (bbox_y2 - bbox_y1) DESC, track_id) AS rn FROM {players} WHERE class_name = 'goalkeeper') WHERE rn = 1)"

SIDES = "sd AS (SELECT match_id, frame_id, team, coalesce(avg(court_x), 20) < 20 AS defends_left FROM {players} WHERE on_court AND team IN ('A', 'B') GROUP BY ALL)"
FORMATIONS = f"""{SIDES}, fr AS (SELECT DISTINCT match_id, frame_id FROM {{players}} WHERE team IN ('A', 'B') AND frame_id % 5 = 0 AND court_x IS NOT NULL), tm AS (SELECT match_id, frame_id, team FROM fr CROSS JOIN (VALUES ('A'), ('B')) v(team)),
ps AS (SELECT tm.match_id, tm.frame_id, tm.team, p.court_x AS x, p.court_y AS y, coalesce(defends_left, false) AS dl FROM tm LEFT JOIN sd USING (match_id, frame_id, team) LEFT JOIN (SELECT * FROM {{players}} WHERE on_court AND court_x IS NOT NULL) p ON p.match_id = tm.match_id AND p.frame_id = tm.frame_id AND p.team = tm.team),
ds AS (SELECT *, sqrt((x - CASE WHEN dl THEN 0 ELSE 40 END) * (x - CASE WHEN dl THEN 0 ELSE 40 END) + (y - 10) * (y - 10)) AS d, sqrt((x - CASE WHEN dl THEN 40 ELSE 0 END) * (x - CASE WHEN dl THEN 40 ELSE 0 END) + (y - 10) * (y - 10)) AS a FROM ps),
gp AS (SELECT match_id, frame_id, team, max(gap) AS gap FROM (SELECT *, d - lag(d) OVER (PARTITION BY match_id, frame_id, team ORDER BY d) AS gap FROM ds WHERE d <= 14) GROUP BY ALL),
fc AS (SELECT match_id, frame_id, team, count(x) AS n, count(*) FILTER (a <= 14) AS up, count(*) FILTER (d < 20) AS back, count(*) FILTER (d <= 14) AS near, max(y) FILTER (d <= 14) - min(y) FILTER (d <= 14) AS spread FROM ds GROUP BY ALL),
fl AS (SELECT fc.match_id, fc.frame_id, fc.team, CASE WHEN n < 4 THEN 'unknown' WHEN up >= n - 1 THEN 'attack' WHEN back < n - 2 THEN 'transition' WHEN near < 4 THEN 'transition' WHEN spread <= 10 AND coalesce(gap, 0) <= 2 THEN '6-0' WHEN coalesce(gap, 0) >= 3 AND near >= 5 THEN '5-1' ELSE '4-2' END AS formation FROM fc LEFT JOIN gp USING (match_id, frame_id, team))"""

CENTROIDS = "ce AS (SELECT match_id, frame_id, team, avg(court_x) AS mean_x FROM {players} WHERE on_court AND team IN ('A', 'B') AND court_x IS NOT NULL GROUP BY ALL HAVING count(*) >= 1)"
EVIDENCE = f"""{CENTROIDS}, ab AS (SELECT f.match_id, f.frame_id, f.timestamp_s, a.mean_x AS a, b.mean_x AS b, (a.mean_x + b.mean_x) / 2 AS m FROM {{frames}} f LEFT JOIN ce a ON a.match_id = f.match_id AND a.frame_id = f.frame_id AND a.team = 'A' LEFT JOIN ce b ON b.match_id = f.match_id AND b.frame_id = f.frame_id AND b.team = 'B'),
gl AS (SELECT *, CASE WHEN m < 20 THEN 0e0 ELSE 40e0 END AS g FROM ab), ev AS (SELECT match_id, frame_id, timestamp_s, CASE WHEN abs(m - g) <= 15 THEN g END AS goal, CASE WHEN abs(m - g) <= 15 AND abs(abs(a - g) - abs(b - g)) >= 1.5 THEN CASE WHEN abs(a - g) > abs(b - g) THEN 'A' ELSE 'B' END END AS seen_team FROM gl)"""
#: The state machine itself, frame by frame: (goal, team, run of the opposite) carried along.
MACHINE = f"""{FPS}, {EVIDENCE}, nu AS (SELECT ev.*, row_number() OVER (PARTITION BY match_id ORDER BY frame_id) AS i, greatest(1, floor(fps * 0.125)) AS hold FROM ev JOIN fps USING (match_id)),
st(match_id, i, goal, team, other, streak) AS (
 SELECT match_id, i, goal, CASE WHEN goal IS NOT NULL THEN seen_team END, cast(NULL AS varchar), cast(0 AS bigint) FROM nu WHERE i = 1
 UNION ALL SELECT n.match_id, n.i, n.goal,
  CASE WHEN n.goal IS NULL THEN NULL WHEN s.goal IS DISTINCT FROM n.goal OR s.team IS NULL THEN n.seen_team WHEN n.seen_team <> s.team AND CASE WHEN s.other = n.seen_team THEN s.streak ELSE 0 END + 1 >= n.hold THEN n.seen_team ELSE s.team END,
  n.seen_team,
  CASE WHEN n.goal IS NULL OR s.goal IS DISTINCT FROM n.goal THEN 0 WHEN s.team IS NOT NULL AND n.seen_team <> s.team THEN CASE WHEN s.other = n.seen_team THEN s.streak ELSE 0 END + 1 ELSE 0 END
 FROM st s JOIN nu n ON n.match_id = s.match_id AND n.i = s.i + 1)"""

PLANS = {
    "c1_filter_ghosts": (
        lambda t: R.filter_ghosts(tracks(t)).select("match_id", "frame_id", "track_id", "bbox_x1"),
        f"WITH {GHOSTS} SELECT t.match_id, t.frame_id, coalesce(a.target, t.track_id) AS track_id, bbox_x1 FROM t LEFT JOIN a ON a.match_id = t.match_id AND a.frame_id = t.frame_id AND a.track_id = t.track_id WHERE a.track_id IS NULL OR a.target IS NOT NULL",
    ),
    "c2_detect_id_switches": (
        lambda t: R.detect_id_switches(tracks(t), 8, 400.0),
        f"""WITH t AS ({TRACKS}), c AS (SELECT *, {CENTRED} FROM t), e AS (SELECT match_id, track_id, min(frame_id) AS f, max(frame_id) AS l, arg_min(cx, frame_id) AS ax, arg_min(cy, frame_id) AS ay, arg_max(cx, frame_id) AS bx, arg_max(cy, frame_id) AS by FROM c GROUP BY ALL),
 m AS (SELECT match_id, max(frame_id) AS top FROM t GROUP BY ALL), p AS (SELECT o.match_id, o.track_id AS old_id, n.track_id AS new_id, sqrt((o.bx - n.ax) * (o.bx - n.ax) + (o.by - n.ay) * (o.by - n.ay)) AS dist FROM e o JOIN m USING (match_id) JOIN e n ON n.match_id = o.match_id AND n.f - o.l BETWEEN 1 AND 8 AND n.track_id <> o.track_id WHERE o.l < top - 8)
 SELECT match_id, old_id, new_id, dist FROM (SELECT *, row_number() OVER (PARTITION BY match_id, new_id ORDER BY dist, old_id) AS rn FROM p WHERE dist <= 400) WHERE rn = 1""",
    ),
    "c3_merge_id_switches": (lambda t: merged(t).select("match_id", "frame_id", "track_id", "bbox_x1"), None),
    "c4_interpolate_tracks": (
        lambda t: R.interpolate_tracks(t.players, t.frames).select("match_id", "frame_id", "track_id", "observed", "court_x", "bbox_x1", "team"),
        f"""WITH {INTERPOLATED} SELECT match_id, frame_id, track_id, observed, CASE WHEN observed THEN court_x WHEN v0 IS NULL THEN NULL WHEN v1 IS NULL OR o1 = o0 THEN v0 ELSE v0 + (v1 - v0) * (ord - o0) / (o1 - o0) END AS court_x,
 CASE WHEN observed THEN bbox_x1 ELSE cast(round_even(b0 + (b1 - b0) * (ord - p0) / (p1 - p0), 0) AS int) END AS bbox_x1, team2 AS team FROM x""",
    ),
    "c5_compute_velocities": (
        lambda t: R.compute_velocities(t.players, fps(t)).select("match_id", "frame_id", "track_id", "velocity_x", "velocity_y"),
        f"WITH {FPS} SELECT match_id, frame_id, track_id, coalesce((court_x - lag(court_x) OVER w) / (frame_id - lag(frame_id) OVER w) * fps, 0e0) AS velocity_x, coalesce((court_y - lag(court_y) OVER w) / (frame_id - lag(frame_id) OVER w) * fps, 0e0) AS velocity_y FROM {{players}} JOIN fps USING (match_id) WINDOW w AS (PARTITION BY match_id, track_id ORDER BY frame_id)",
    ),
    "c6_mark_ball_carrier": (
        lambda t: R.mark_ball_carrier(t.players, t.ball).select("match_id", "frame_id", "track_id", "has_ball"),
        """WITH d AS (SELECT p.match_id, p.frame_id, p.track_id, row_number() OVER (PARTITION BY p.match_id, p.frame_id ORDER BY (p.court_x - b.court_x) * (p.court_x - b.court_x) + (p.court_y - b.court_y) * (p.court_y - b.court_y), p.track_id) AS rn
 FROM {players} p JOIN {ball} b ON b.match_id = p.match_id AND b.frame_id = p.frame_id WHERE p.court_x IS NOT NULL AND b.court_x IS NOT NULL)
 SELECT p.match_id, p.frame_id, p.track_id, p.has_ball OR d.rn IS NOT NULL AS has_ball FROM {players} p LEFT JOIN d ON d.rn = 1 AND d.match_id = p.match_id AND d.frame_id = p.frame_id AND d.track_id = p.track_id""",
    ),
    "c7_detect_goals": (
        lambda t: R.detect_goals(t.scoreboard_readings),
        f"WITH RECURSIVE {GOALS} SELECT match_id, frame_number, timestamp_sec, clock AS game_time, goal AS team, h AS score_home, a AS score_away FROM gs WHERE goal IS NOT NULL",
    ),
    "c8_goalkeeper_centres": (lambda t: R.goalkeeper_centres(t.players), f"WITH {KEEPER} SELECT * FROM gk"),
    "c9_detect_throws": (
        lambda t: R.detect_throws(t.players, t.ball),
        f"""WITH {KEEPER}, d AS (SELECT b.match_id, b.frame_id, sqrt((pixel_x - gk_x) * (pixel_x - gk_x) + (pixel_y - gk_y) * (pixel_y - gk_y)) AS d FROM {{ball}} b JOIN gk ON gk.match_id = b.match_id AND gk.frame_id = b.frame_id),
 s AS (SELECT p.match_id, p.frame_id, p.track_id, d FROM {{players}} p JOIN d ON d.match_id = p.match_id AND d.frame_id = p.frame_id WHERE has_ball AND court_x IS NOT NULL),
 a AS (SELECT s.*, l.d AS later, l.d < lag(l.d) OVER (PARTITION BY s.match_id, s.frame_id, s.track_id ORDER BY l.frame_id) AS falls FROM s JOIN d l ON l.match_id = s.match_id AND l.frame_id BETWEEN s.frame_id + 1 AND s.frame_id + 8)
 SELECT match_id, frame_id, track_id, d AS start_distance, min(later) AS least_distance FROM a GROUP BY match_id, frame_id, track_id, d HAVING d - min(later) >= 30 AND count(*) >= 2 AND count(*) FILTER (falls) >= greatest(1, (count(*) - 1) * 6 // 10)""",
    ),
    "d1_classify_formation": (
        lambda t: P.classify_formation(t.players.where("team in ('A', 'B') and court_x is not null").withColumn("defends_left", F.col("team") == "A").withColumn("frame_id", F.floor(F.col("frame_id") / 3).cast("int"))),
        """WITH d AS (SELECT match_id, frame_id // 3 AS frame_id, team, court_x AS x, court_y AS y, CASE team WHEN 'A' THEN 0 ELSE 40 END AS o FROM {players} WHERE team IN ('A', 'B') AND court_x IS NOT NULL), e AS (SELECT *, sqrt((x - o) * (x - o) + (y - 10) * (y - 10)) AS d, sqrt((x - 40 + o) * (x - 40 + o) + (y - 10) * (y - 10)) AS a FROM d),
 g AS (SELECT match_id, frame_id, team, max(gap) AS gap FROM (SELECT *, d - lag(d) OVER (PARTITION BY match_id, frame_id, team ORDER BY d) AS gap FROM e WHERE d <= 14) GROUP BY ALL),
 c AS (SELECT match_id, frame_id, team, count(*) AS n, count(*) FILTER (a <= 14) AS up, count(*) FILTER (d < 20) AS back, count(*) FILTER (d <= 14) AS near, max(y) FILTER (d <= 14) - min(y) FILTER (d <= 14) AS spread FROM e GROUP BY ALL)
 SELECT c.match_id, c.frame_id, c.team, CASE WHEN n < 4 THEN 'unknown' WHEN up >= n - 1 THEN 'attack' WHEN back < n - 2 THEN 'transition' WHEN near < 4 THEN 'transition' WHEN spread <= 10 AND coalesce(gap, 0) <= 2 THEN '6-0' WHEN coalesce(gap, 0) >= 3 AND near >= 5 THEN '5-1' ELSE '4-2' END AS formation FROM c LEFT JOIN g USING (match_id, frame_id, team)""",
    ),
    "d2_defending_side": (lambda t: P.defending_side(t.players), f"WITH {SIDES} SELECT * FROM sd"),
    "d3_label_formations": (lambda t: P.label_formations(t.players), f"WITH {FORMATIONS} SELECT * FROM fl"),
    "d4_formation_scenes": (
        lambda t: P.formation_scenes(t.formation_labels, fps(t)),
        f"""WITH {FPS}, c AS (SELECT *, CASE WHEN formation = lag(formation) OVER (PARTITION BY match_id, team ORDER BY frame_id) THEN 0 ELSE 1 END AS n FROM {{formation_labels}}), i AS (SELECT *, sum(n) OVER (PARTITION BY match_id, team ORDER BY frame_id) AS isl FROM c),
 s AS (SELECT match_id, team, formation, min(frame_id) AS start_frame, max(frame_id) AS end_frame FROM i GROUP BY match_id, team, formation, isl) SELECT match_id, row_number() OVER (PARTITION BY match_id ORDER BY team, start_frame) - 1 AS scene_id, team, formation, start_frame, end_frame,
 floor(start_frame / fps * 1000 + 0.5) / 1000e0 AS start_time_s, floor((end_frame + 5) / fps * 1000 + 0.5) / 1000e0 AS end_time_s FROM s JOIN fps USING (match_id) WHERE formation <> 'unknown' AND end_frame - start_frame + 5 >= 25""",
    ),
    "d5_carrier_series": (series, "SELECT f.match_id, f.frame_id, f.timestamp_s, c.team FROM {frames} f LEFT JOIN {carriers} c ON c.match_id = f.match_id AND c.frame_id = f.frame_id"),
    "d6_possession_phases": (
        lambda t: P.possession_phases(series(t), fps(t), 0.25, 0.25),
        f"WITH {FPS}, s AS (SELECT f.match_id, f.frame_id, f.timestamp_s, c.team, fps FROM {{frames}} f JOIN fps USING (match_id) LEFT JOIN {{carriers}} c ON c.match_id = f.match_id AND c.frame_id = f.frame_id), {runs_sql('s', 'team', '0.25', '0.25')} SELECT * FROM k",
    ),
    "d7_team_centroids": (lambda t: P.team_centroids(t.players, 2), "SELECT match_id, frame_id, team, avg(court_x) AS mean_x FROM {players} WHERE on_court AND team IN ('A', 'B') AND court_x IS NOT NULL GROUP BY ALL HAVING count(*) >= 2"),
    "d8_phase_evidence": (lambda t: P.phase_evidence(t.frames, P.team_centroids(t.players, 1)), f"WITH {EVIDENCE} SELECT * FROM ev"),
    "d9_phase_hysteresis": (
        lambda t: P.phase_hysteresis(P.phase_evidence(t.frames, P.team_centroids(t.players, 1)), fps(t), 0.125).select("match_id", "frame_id", "goal", "seen_team", "offense_team"),
        f"WITH RECURSIVE {MACHINE} SELECT nu.match_id, nu.frame_id, nu.goal, nu.seen_team, st.team AS offense_team FROM nu JOIN st ON st.match_id = nu.match_id AND st.i = nu.i",
    ),
    "d10_team_phases": (
        lambda t: P.team_phases(t.frames, t.players, fps(t), 0.1, 0.1, 1, 0.125).select("match_id", "phase_id", "offense_team", "defense_team", "phase_type", "start_frame", "end_frame", "start_time_s", "end_time_s"),
        f"WITH RECURSIVE {MACHINE}, s AS (SELECT nu.match_id, nu.frame_id, nu.timestamp_s, st.team, fps FROM nu JOIN st ON st.match_id = nu.match_id AND st.i = nu.i JOIN fps ON fps.match_id = nu.match_id), {runs_sql('s', 'team', '0.1', '0.1')} SELECT match_id, phase_id, team AS offense_team, CASE team WHEN 'A' THEN 'B' ELSE 'A' END AS defense_team, 'attack' AS phase_type, start_frame, end_frame, start_time_s, end_time_s FROM k",
    ),
    "d11_action_candidates": (lambda t: P.action_candidates(t.players).select("match_id", "frame_id", "track_id", "court_x"), "SELECT match_id, frame_id, track_id, court_x FROM {players} WHERE has_ball AND court_x IS NOT NULL AND frame_id >= 24"),
    "d12_predicted_action": (
        lambda t: P.predicted_action(sql_view(t, PROBABILITIES)).select("match_id", "frame_id", "track_id", "predicted_action"),
        "SELECT match_id, frame_id, track_id, CASE greatest(pass_prob, shot_prob, dribble_prob, hold_prob) WHEN pass_prob THEN 'pass' WHEN shot_prob THEN 'shot' WHEN dribble_prob THEN 'dribble' ELSE 'hold' END AS predicted_action FROM (SELECT match_id, frame_id, track_id, (frame_id + track_id) % 5 / 8e0 AS pass_prob, (frame_id * 3 + track_id) % 7 / 8e0 AS shot_prob, (frame_id * 5 + track_id) % 6 / 8e0 AS dribble_prob, track_id % 4 / 8e0 AS hold_prob FROM {players})",
    ),
}

PROBABILITIES = "SELECT match_id, frame_id, track_id, (frame_id + track_id) % 5 / 8e0 AS pass_prob, (frame_id * 3 + track_id) % 7 / 8e0 AS shot_prob, (frame_id * 5 + track_id) % 6 / 8e0 AS dribble_prob, track_id % 4 / 8e0 AS hold_prob FROM {players}"
