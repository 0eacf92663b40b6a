"""Queries over table maintenance and detections."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import detections as D
from ..operators import tables as O
from ..sources.shared import shared_dir

HOMOGRAPHY = {"h11": "0.03125e0", "h12": "0e0", "h13": "-4e0", "h21": "0e0", "h22": "0.015625e0", "h23": "2e0", "h31": "0e0", "h32": "0e0", "h33": "1e0"}
CALIBRATIONS = f"SELECT match_id, frame_id, {', '.join(f'{v} AS {k}' if k != 'h13' else '-4e0 + frame_id % 3 AS h13' for k, v in HOMOGRAPHY.items())} FROM {{frames}} WHERE frame_id % 7 = 3"
OCR = """SELECT match_id, frame_number AS frame_id, CASE frame_number % 5 WHEN 0 THEN concat('HOME ', cast(frame_number % 40 AS string), ' AWAY ', cast(frame_number % 33 AS string), ' ', cast(frame_number % 60 AS string), ':', cast(10 + frame_number % 60 AS string))
 WHEN 1 THEN concat(cast(frame_number % 40 AS string), ' - ', cast(frame_number % 31 AS string)) WHEN 2 THEN concat('TOR ', cast(frame_number % 28 AS string)) WHEN 3 THEN concat('12:', cast(frame_number % 90 AS string), ' ', cast(frame_number % 7 AS string), ' ', cast(frame_number % 9 AS string)) ELSE cast(frame_number % 50 AS string) END AS text FROM {scoreboard_readings}"""
RANKED = "SELECT match_id, frame_id, track_id, class_name, confidence, row_number() OVER (PARTITION BY match_id, frame_id{by} ORDER BY confidence DESC, track_id) AS rn FROM {{players}}"
KEYPOINTS = """SELECT match_id, frame_id, track_id AS court_id, confidence AS court_confidence, l AS keypoint, (track_id * 3 + l * 5 + frame_id) % 8 / 8e0 AS visibility,
 (frame_id * 7 + l * 11) % 64 * 1e0 AS x, (frame_id * 5 + l * 13) % 32 * 1e0 AS y FROM {players} CROSS JOIN (SELECT DISTINCT track_id AS l FROM {players})"""
SEEN = "SELECT match_id, frame_id, track_id, confidence FROM {players}"


def sql_view(t, text):
    """A text in both engines' SQL over the views."""
    import re

    return t.spark.sql(text, **{n: getattr(t, n) for n in dict.fromkeys(re.findall(r"\{([a-z]\w*)\}", text))})


def states(t):
    return O.frame_states(t.frames, t.players, t.ball)


def delta(t):
    return sql_view(t, DELTA)


DELTA = "SELECT match_id, frame_id, track_id, team, confidence, 2 AS version FROM {players} WHERE frame_id % 3 = 0 UNION ALL SELECT match_id, frame_id, 90 AS track_id, 'A' AS team, 0.5e0 AS confidence, 2 AS version FROM {frames}"
BASE = "SELECT match_id, frame_id, track_id, team, confidence - 1 AS confidence, 1 AS version FROM {players}"
META = "SELECT match_id, arg_max(display_name, seq) FILTER (display_name IS NOT NULL) AS display_name, arg_max(file_name, seq) FILTER (file_name IS NOT NULL) AS file_name FROM {meta_updates} GROUP BY match_id"

RESCORED = ["m1", "m4"]


def store(t, *names):
    """The views' rows as a store by match; its folder and the tables' schemas."""
    folder = f"{shared_dir(t.spark)}/courtspark/store-{uuid.uuid4().hex}"
    for n in names:
        O.write_tracking(getattr(t, n), folder, n)
    return folder, {n: getattr(t, n).schema for n in names}


def one_match(t):
    folder, schemas = store(t, "players")
    return O.read_tracking(t.spark, folder, schemas)["players"].where("match_id = 'm2'").select("match_id", "frame_id", "track_id", "team")


def rescored(t):
    """Two matches rescored in a store: one has half as many events with other numbers, the other none."""
    folder, schemas = store(t, "play_events", "play_event_labels")
    new = t.play_events.where("event_id % 2 = 0 and match_id <> 'm4'").withColumn("event_id", F.col("event_id") + 100)
    O.rescore_store(t.spark, folder, {"play_events": new}, RESCORED)
    held = O.read_tracking(t.spark, folder, schemas)
    events = held["play_events"].select(F.lit("event").alias("kind"), "match_id", "event_id", F.col("play_type").alias("value"))
    return events.unionByName(held["play_event_labels"].select(F.lit("label").alias("kind"), "match_id", "event_id", F.col("verdict").alias("value")))


PLANS = {
    "a1_read_tracking": (one_match, "SELECT match_id, frame_id, track_id, team FROM {players} WHERE match_id = 'm2'"),
    "a2_explode_players": (lambda t: O.explode_players(states(t)).select("match_id", "frame_id", "track_id", "court_x", "velocity_x", "has_ball"), "SELECT match_id, frame_id, track_id, court_x, 0e0 AS velocity_x, false AS has_ball FROM {players}"),
    "a2_explode_ball": (lambda t: O.explode_ball(states(t)).select("match_id", "frame_id", "court_x", "pixel_x"), "SELECT match_id, frame_id, court_x, pixel_x FROM {ball} SEMI JOIN {frames} USING (match_id, frame_id)"),
    "a3_frame_counters": (lambda t: O.frame_counters(states(t)), "SELECT match_id, frame_id, timestamp_s, player_count, on_court_count FROM {frames}"),
    "a4_upsert_latest": (
        lambda t: O.upsert_latest(sql_view(t, BASE), delta(t), ["match_id", "frame_id", "track_id"], "version"),
        f"WITH b AS ({BASE}), d AS ({DELTA}) SELECT * FROM d UNION ALL SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.match_id = b.match_id AND d.frame_id = b.frame_id AND d.track_id = b.track_id)",
    ),
    "a5_apply_labels": (
        lambda t: O.apply_labels(t.play_event_labels),
        "SELECT match_id, event_id, verdict, labeled_at FROM (SELECT *, row_number() OVER (PARTITION BY match_id, event_id ORDER BY labeled_at DESC, coalesce(verdict, '') DESC) AS rn FROM {play_event_labels}) WHERE rn = 1 AND verdict IS NOT NULL",
    ),
    "a6_rescore_overwrite": (
        lambda t: O.rescore_overwrite(sql_view(t, BASE), delta(t), t.matches.where("match_id in ('m1', 'm4')")),
        f"WITH b AS ({BASE}), d AS ({DELTA}) SELECT * FROM b WHERE match_id NOT IN ('m1', 'm4') UNION ALL SELECT * FROM d WHERE match_id IN ('m1', 'm4')",
    ),
    "a6_rescore_store": (
        rescored,
        """SELECT 'event' AS kind, match_id, event_id, play_type AS value FROM {play_events} WHERE match_id NOT IN ('m1', 'm4')
 UNION ALL SELECT 'event', match_id, event_id + 100, play_type FROM {play_events} WHERE match_id = 'm1' AND event_id % 2 = 0
 UNION ALL SELECT 'label', match_id, event_id, verdict FROM {play_event_labels} WHERE match_id NOT IN ('m1', 'm4')""",
    ),
    "a7_hide_matches": (lambda t: O.hide_matches(t.matches, t.statuses.where("status = 'failed'")), "SELECT * FROM {matches} WHERE match_id NOT IN (SELECT match_id FROM {statuses} WHERE status = 'failed')"),
    "a8_match_catalog": (
        lambda t: O.match_catalog(t.matches, t.statuses.where("match_id <> 'm6'")),
        """SELECT coalesce(m.match_id, s.match_id) AS match_id, coalesce(video_path, '') AS video_path, coalesce(fps, 0e0) AS fps, coalesce(total_frames, 0) AS total_frames,
 CASE WHEN m.match_id IS NOT NULL AND (status IS NULL OR status IN ('unknown', 'processing')) THEN 'done' ELSE status END AS status FROM {matches} m FULL JOIN (SELECT * FROM {statuses} WHERE match_id <> 'm6') s ON m.match_id = s.match_id""",
    ),
    "a9_merge_meta": (lambda t: O.merge_meta(t.meta_updates, ["display_name", "file_name"]), META),
    "a10_conform_schema": (
        lambda t: O.conform_schema(t.play_events.drop("sequence_id", "confidence"), T.StructType.fromDDL("match_id string, event_id long, play_type string, confidence double, sequence_id int")),
        "SELECT match_id, cast(event_id AS bigint) AS event_id, play_type, cast(NULL AS double) AS confidence, cast(NULL AS int) AS sequence_id FROM {play_events}",
    ),
    "a11_resolve_fps": (lambda t: O.resolve_fps(t.matches, t.frames), "SELECT m.match_id, coalesce(any_value(fps), CASE WHEN max(frame_id) > 0 AND max(timestamp_s) > 0 THEN max(frame_id) / max(timestamp_s) END, 30e0) AS fps FROM {matches} m LEFT JOIN {frames} f ON f.match_id = m.match_id GROUP BY m.match_id"),
    "a12_stride_sample": (lambda t: O.stride_sample(t.frames, 5), "SELECT * FROM {frames} WHERE frame_id % 5 = 0"),
    "a13_even_sample": (lambda t: O.even_sample(t.matches, t.frames, 50), "SELECT f.* FROM {frames} f JOIN {matches} m ON m.match_id = f.match_id WHERE frame_id % greatest(1, total_frames // 50) = 0"),
    "a14_cadence_sample": (
        lambda t: O.cadence_sample(t.frames, 1.0),
        """WITH RECURSIVE pick(match_id, frame_id, timestamp_s) AS (
 SELECT match_id, min(frame_id), min(timestamp_s) FROM {frames} GROUP BY match_id
 UNION ALL SELECT p.match_id, f.frame_id, f.timestamp_s FROM pick p, LATERAL (SELECT min(frame_id) AS frame_id, min(timestamp_s) AS timestamp_s FROM {frames} f WHERE f.match_id = p.match_id AND f.timestamp_s >= p.timestamp_s + 1) f WHERE f.frame_id IS NOT NULL)
SELECT * FROM pick""",
    ),
    "a15_decode_details": (
        lambda t: t.play_events.select("match_id", "event_id", F.when(F.col("event_id") % 4 == 0, "{bad").otherwise(F.format_string('{"goal_x": 40.0, "tracks": [{"track_id": %d, "points": [[0.5, 1.0, 2.0]]}]}', "event_id")).alias("details"))
        .withColumn("d", O.decode_details(F.col("details")))
        .select("match_id", "event_id", "d.goal_x", F.col("d.tracks")[0]["track_id"].alias("track_id"), F.col("d.tracks")[0]["points"][0][1].alias("x")),
        "SELECT match_id, event_id, CASE WHEN event_id % 4 <> 0 THEN 40e0 END AS goal_x, CASE WHEN event_id % 4 <> 0 THEN event_id END AS track_id, CASE WHEN event_id % 4 <> 0 THEN 1e0 END AS x FROM {play_events}",
    ),
    "a16_known_matches": (lambda t: O.known_matches(t.statuses.select("match_id"), t.matches), "SELECT match_id, match_id IN (SELECT match_id FROM {matches}) AS known FROM {statuses}"),
    "a17_status_transitions": (
        lambda t: O.status_transitions(t.statuses.where("match_id <> 'm1'").withColumn("status", F.when(F.col("match_id") == "m2", "done").otherwise(F.col("status"))), t.statuses),
        "SELECT match_id, status, was FROM (SELECT s.match_id, s.status, CASE WHEN s.match_id = 'm1' THEN NULL WHEN s.match_id = 'm2' THEN 'done' ELSE s.status END AS was FROM {statuses} s) WHERE status IN ('processing', 'done', 'failed') AND status IS DISTINCT FROM was",
    ),
    "b1_bbox_geometry": (
        lambda t: D.bbox_geometry(t.players).select("match_id", "frame_id", "track_id", "centre_x", "centre_y", "foot_x", "foot_y", "width", "height", "area"),
        "SELECT match_id, frame_id, track_id, (bbox_x1 + bbox_x2) / 2 AS centre_x, (bbox_y1 + bbox_y2) / 2 AS centre_y, (bbox_x1 + bbox_x2) / 2 AS foot_x, cast(bbox_y2 AS double) AS foot_y, bbox_x2 - bbox_x1 AS width, bbox_y2 - bbox_y1 AS height, (bbox_x2 - bbox_x1) * (bbox_y2 - bbox_y1) AS area FROM {players}",
    ),
    "b2_clean_detections": (lambda t: D.clean_detections(t.players, 3).select("match_id", "frame_id", "track_id"), f"SELECT match_id, frame_id, track_id FROM ({RANKED.format(by='')}) WHERE rn <= 3"),
    "b3_role_caps": (
        lambda t: D.role_caps(t.players, {"goalkeeper": 1, "referee": 0}).select("match_id", "frame_id", "track_id", "class_name"),
        f"SELECT match_id, frame_id, track_id, class_name FROM ({RANKED.format(by=', class_name')}) WHERE class_name = 'player' OR class_name = 'goalkeeper' AND rn <= 1",
    ),
    "b4_best_ball": (lambda t: D.best_ball(sql_view(t, SEEN)).select("match_id", "frame_id", "confidence"), "SELECT match_id, frame_id, max(confidence) AS confidence FROM {players} GROUP BY match_id, frame_id"),
    "b5_valid_keypoints": (
        lambda t: D.valid_keypoints(sql_view(t, KEYPOINTS), 2).select("match_id", "frame_id", "court_id", "keypoint", "x", "y"),
        f"WITH k AS ({KEYPOINTS}), b AS (SELECT match_id, frame_id, court_id FROM (SELECT *, row_number() OVER (PARTITION BY match_id, frame_id ORDER BY court_confidence DESC, court_id DESC) AS rn FROM k) WHERE rn = 1 AND court_confidence >= 0.25), v AS (SELECT k.* FROM k JOIN b USING (match_id, frame_id, court_id) WHERE visibility > 0.5 AND x > 0 AND y > 0) SELECT match_id, frame_id, court_id, keypoint, x, y FROM (SELECT *, count(*) OVER (PARTITION BY match_id, frame_id) AS n FROM v) WHERE n >= 2",
    ),
    "b6_keypoint_correspondences": (
        lambda t: D.keypoint_correspondences(sql_view(t, KEYPOINTS), t.region.select(F.col("r_regionkey").cast("int").alias("keypoint"), (F.col("r_regionkey") * 10.0).alias("ref_x"), (F.col("r_regionkey") * 5.0).alias("ref_y"))).select("match_id", "frame_id", "court_id", "keypoint", "ref_x", "ref_y"),
        f"SELECT match_id, frame_id, court_id, keypoint, keypoint * 10e0 AS ref_x, keypoint * 5e0 AS ref_y FROM ({KEYPOINTS}) WHERE keypoint IN (SELECT r_regionkey FROM region)",
    ),
    "b7_project_to_court": (
        lambda t: D.project_to_court(t.players, sql_view(t, CALIBRATIONS)).select("match_id", "frame_id", "track_id", "court_x", "court_y"),
        f"""WITH c AS ({CALIBRATIONS}), m AS (SELECT p.match_id, p.frame_id, track_id, (h11 * pixel_foot_x + h12 * pixel_foot_y + h13) / (h31 * pixel_foot_x + h32 * pixel_foot_y + h33) AS x, (h21 * pixel_foot_x + h22 * pixel_foot_y + h23) / (h31 * pixel_foot_x + h32 * pixel_foot_y + h33) AS y
 FROM {{players}} p LEFT JOIN c ON c.match_id = p.match_id AND c.frame_id = p.frame_id) SELECT match_id, frame_id, track_id, CASE WHEN x BETWEEN -2 AND 42 AND y BETWEEN -2 AND 22 THEN x END AS court_x, CASE WHEN x BETWEEN -2 AND 42 AND y BETWEEN -2 AND 22 THEN y END AS court_y FROM m""",
    ),
    "b8_carry_calibration": (
        lambda t: D.carry_calibration(t.frames, sql_view(t, CALIBRATIONS)).select("match_id", "frame_id", "h11", "h13"),
        f"WITH c AS ({CALIBRATIONS}) SELECT f.match_id, f.frame_id, h11, h13 FROM {{frames}} f ASOF LEFT JOIN c ON c.match_id = f.match_id AND f.frame_id >= c.frame_id",
    ),
    "b9_reprojection_quality": (
        lambda t: D.reprojection_quality(t.players.select("match_id", "frame_id", F.col("pixel_foot_x").alias("x"), F.col("pixel_foot_y").alias("y"), F.col("court_x").alias("ref_x"), F.col("pixel_foot_y").alias("_y"), (F.col("pixel_foot_y") / 64 + 2).alias("ref_y")).where("ref_x is not null"), sql_view(t, CALIBRATIONS), 16.0),
        f"""WITH c AS ({CALIBRATIONS}), e AS (SELECT p.match_id, p.frame_id, sqrt((h11 * pixel_foot_x + h13 - court_x) * (h11 * pixel_foot_x + h13 - court_x)) AS error FROM {{players}} p JOIN c ON c.match_id = p.match_id AND c.frame_id = p.frame_id WHERE court_x IS NOT NULL)
 SELECT match_id, frame_id, count(*) AS points, count(*) FILTER (error <= 16) AS inliers, count(*) FILTER (error <= 16) / count(*) AS inlier_ratio, avg(error) FILTER (error <= 16) AS mean_error, quantile_cont(error, 0.5) FILTER (error <= 16) AS median_error FROM e GROUP BY match_id, frame_id""",
    ),
    "b10_parse_scoreboard": (
        lambda t: D.parse_scoreboard(sql_view(t, OCR)),
        rf"""WITH o AS ({OCR}), p AS (SELECT *, nullif(regexp_extract(text, '\b(\d{{1,2}}:[0-5]\d)\b', 1), '') AS game_time, regexp_replace(text, '\d{{1,2}}:\d{{2}}', ' ', 'g') AS rest FROM o),
 n AS (SELECT *, regexp_extract_all(rest, '[A-Za-z]+\s*(\d{{1,2}})\b', 1) AS named, regexp_extract_all(rest, '\b(\d{{1,2}})\b', 1) AS free FROM p), w AS (SELECT *, CASE WHEN len(named) >= 1 THEN named ELSE free END AS two FROM n)
 SELECT match_id, frame_id, text, game_time, cast(two[1] AS int) AS score_home, cast(two[2] AS int) AS score_away FROM w""",
    ),
    "b11_scoreboard_plausible": (
        lambda t: D.scoreboard_plausible(sql_view(t, OCR).withColumn("ordinal", F.col("frame_id") % 100).withColumn("frame_id", F.floor(F.col("frame_id") / 100).cast("int"))).select("match_id", "frame_id", "ordinal", "has_clock"),
        rf"""WITH o AS (SELECT match_id, frame_id % 100 AS ordinal, frame_id // 100 AS frame_id, text FROM ({OCR})), p AS (SELECT *, regexp_matches(text, '\b\d{{1,2}}:[0-5]\d\b') AS has_clock, len(regexp_extract_all(regexp_replace(text, '\d{{1,2}}:\d{{2}}', ' ', 'g'), '\b(\d{{1,2}})\b', 1)) AS n FROM o)
 SELECT match_id, frame_id, ordinal, has_clock FROM (SELECT *, row_number() OVER (PARTITION BY match_id, frame_id ORDER BY has_clock DESC, ordinal) AS rn FROM p WHERE n >= 2) WHERE rn = 1""",
    ),
}
