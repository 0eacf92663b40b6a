"""Tracking tables derived from the given tables, each as one SQL text that Spark and DuckDB both run.

A text names its inputs in braces. ``VIEWS`` is ordered: a view only uses given tables and views above it. All
coordinates are multiples of 1/256 and all confidences of 1/64, so sums and means are exact in either engine. A match
takes a bounded range of keys, so that larger tables hold more matches, not longer ones.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from .shared import task_parts

GIVEN = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings")


def match(key: str, span: int) -> str:
    """The match of a key: eight matches share each ``span`` keys in turn."""
    return f"concat('m', cast(8 * cast(floor({key} / {span}) AS bigint) + {key} % 8 AS string))"


VIEWS = {
    "keys": """
SELECT l_orderkey AS o, l_linenumber AS l, min(l_partkey) AS p, min(l_suppkey) AS s, min(l_returnflag) AS flag
FROM {lineitem} GROUP BY l_orderkey, l_linenumber""",
    "players": f"""
SELECT {match("o", 8192)} AS match_id, cast(floor(o % 8192 / 8) AS int) AS frame_id, l AS track_id,
  CASE flag WHEN 'A' THEN 'A' WHEN 'R' THEN 'B' ELSE 'unknown' END AS team,
  CASE WHEN p % 11 = 0 THEN NULL ELSE (p * 7 + o * 3) % 336 / 8e0 - 1e0 END AS court_x,
  CASE WHEN p % 11 = 0 THEN NULL ELSE (p * 5 + o * 11) % 176 / 8e0 - 1e0 END AS court_y,
  (p * 13 + o) % 1920 * 1e0 AS pixel_foot_x, (p * 17 + o * 3) % 1080 * 1e0 AS pixel_foot_y,
  (p % 17 - 8) / 8e0 AS velocity_x, (s % 17 - 8) / 8e0 AS velocity_y, (p * 3 + o) % 64 / 64e0 AS confidence,
  p % 13 <> 0 AS on_court, (p + o) % 9 = 0 AS has_ball,
  cast((p * 13 + o) % 1920 - 20 AS int) AS bbox_x1, cast((p * 17 + o * 3) % 1080 - 80 AS int) AS bbox_y1,
  cast((p * 13 + o) % 1920 + 20 AS int) AS bbox_x2, cast((p * 17 + o * 3) % 1080 AS int) AS bbox_y2,
  CASE WHEN p % 7 = 0 THEN 'goalkeeper' WHEN p % 7 = 1 THEN 'referee' ELSE 'player' END AS class_name
FROM {{keys}}""",
    "frames": """
SELECT match_id, frame_id, frame_id / 32e0 AS timestamp_s, cast(count(*) AS int) AS player_count,
  cast(sum(CASE WHEN on_court THEN 1 ELSE 0 END) AS int) AS on_court_count FROM {players} GROUP BY match_id, frame_id""",
    "ball": f"""
SELECT {match("o_orderkey", 8192)} AS match_id, cast(floor(o_orderkey % 8192 / 8) AS int) AS frame_id,
  CASE WHEN min(o_custkey) % 7 = 0 THEN NULL ELSE (min(o_custkey) * 5 + o_orderkey * 3) % 336 / 8e0 - 1e0 END AS court_x,
  CASE WHEN min(o_custkey) % 7 = 0 THEN NULL ELSE (min(o_custkey) * 3 + o_orderkey) % 176 / 8e0 - 1e0 END AS court_y,
  (min(o_custkey) * 11 + o_orderkey) % 1920 * 1e0 AS pixel_x, (min(o_custkey) * 7 + o_orderkey * 5) % 1080 * 1e0 AS pixel_y,
  min(o_custkey) % 64 / 64e0 AS confidence FROM {{orders}} WHERE o_orderkey % 5 <> 0 GROUP BY o_orderkey""",
    "matches": """
SELECT match_id, concat('/videos/', match_id, '.mp4') AS video_path,
  CASE WHEN match_id = 'm3' THEN NULL WHEN match_id = 'm5' THEN 0e0 ELSE 32e0 END AS fps,
  cast(max(frame_id) + 1 AS int) AS total_frames, CASE WHEN match_id IN ('m1', 'm2') THEN ' Lions ' WHEN match_id = 'm4' THEN ' ' END AS team_a_name,
  CASE WHEN match_id IN ('m1', 'm6') THEN 'Bears' END AS team_b_name FROM {frames} GROUP BY match_id""",
    "scoreboard_readings": f"""
SELECT match_id, n AS frame_number, n / 4e0 AS timestamp_sec,
  CASE WHEN n % 6 = 0 THEN NULL ELSE concat(cast(cast(floor(n / 60) AS bigint) AS string), ':', cast(10 + n % 50 AS string)) END AS game_time,
  cast(CASE WHEN n % 11 = 0 THEN NULL WHEN n % 13 = 0 THEN 77 ELSE floor(n / 160) END AS int) AS score_home,
  cast(CASE WHEN n % 11 = 0 THEN NULL ELSE floor((n + 57) / 230) END AS int) AS score_away
FROM (SELECT concat('m', cast(8 * cast(floor(event_id / 8192) AS bigint) + user_id % 8 AS string)) AS match_id, cast(event_id % 8192 AS int) AS n FROM {{events}}) e""",
    "carriers": """
SELECT match_id, frame_id, min(team) AS team FROM {players}
WHERE has_ball AND team IN ('A', 'B') AND frame_id % 24 < 15 GROUP BY match_id, frame_id""",
    "formation_labels": """
SELECT match_id, frame_id, team, CASE WHEN x % 5 = 0 THEN 'unknown' WHEN frame_id % 60 < 35 THEN '6-0' WHEN x % 3 = 0 THEN '5-1' ELSE '4-2' END AS formation
FROM (SELECT match_id, frame_id, team, cast(sum(track_id) AS bigint) AS x FROM {players} WHERE team <> 'unknown' AND frame_id % 5 = 0 GROUP BY match_id, frame_id, team)""",
    "play_events": f"""
SELECT match_id, event_id, CASE n % 4 WHEN 0 THEN 'swap' WHEN 1 THEN 'run_in' WHEN 2 THEN 'push' ELSE 'fast_break' END AS play_type,
  CASE WHEN n % 3 = 0 THEN 'A' ELSE 'B' END AS team, cast(c * 3 AS int) AS start_frame, cast(c * 3 + n * 4 AS int) AS end_frame,
  c * 3 / 32e0 AS start_time_s, (c * 3 + n * 4) / 32e0 AS end_time_s, (32 + n) / 64e0 AS confidence,
  cast(CASE WHEN c % 5 = 0 THEN NULL ELSE floor(c / 40) END AS int) AS sequence_id
FROM (SELECT {match("c_custkey", 1024)} AS match_id, c_custkey % 1024 AS c, cast(floor(c_custkey % 1024 / 8) AS int) AS event_id, c_nationkey AS n FROM {{customer}}) e""",
    "attack_sequences": """
SELECT match_id, sequence_id, min(team) AS team, CASE WHEN sequence_id % 2 = 0 THEN 0e0 ELSE 40e0 END AS goal_x,
  min(start_frame) AS start_frame, max(end_frame) AS end_frame, min(start_time_s) AS start_time_s, max(end_time_s) AS end_time_s,
  CASE sequence_id % 3 WHEN 0 THEN 'goal' WHEN 1 THEN 'no_goal' ELSE 'unknown' END AS outcome, count(*) AS event_count
FROM {play_events} WHERE sequence_id IS NOT NULL GROUP BY match_id, sequence_id""",
    "play_event_labels": """
SELECT match_id, event_id, CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 3 = 1 THEN 'confirmed' ELSE 'rejected' END AS verdict,
  start_frame + 7 * (event_id % 2) AS labeled_at FROM {play_events} WHERE event_id % 2 = 0
UNION ALL SELECT match_id, event_id, 'confirmed' AS verdict, start_frame + 3 AS labeled_at FROM {play_events} WHERE event_id % 4 = 0""",
    "team_phases": f"""
SELECT match_id, phase_id, CASE WHEN n % 2 = 0 THEN 'A' ELSE 'B' END AS offense_team, CASE WHEN n % 2 = 0 THEN 'B' ELSE 'A' END AS defense_team, 'attack' AS phase_type,
  phase_id * 12 AS start_frame, phase_id * 12 + 2 + n % 9 AS end_frame, phase_id * 12 / 32e0 AS start_time_s, (phase_id * 12 + 2 + n % 9) / 32e0 AS end_time_s
FROM (SELECT {match("c_custkey", 1024)} AS match_id, cast(floor(c_custkey % 1024 / 8) AS int) AS phase_id, cast(c_nationkey AS int) AS n FROM {{customer}}) c""",
    # A supplier's line items in turn are the next second's places of six players a side. The sides take turns to
    # attack for twelve seconds, and run to the other goal in the first eight; where a player stands, what is not seen
    # and which labels are lost follows from the item.
    "places": """
SELECT k, tr, i, p, tr % 6 AS slot, q, (tr < 6) = (q % 2 = 0) AS attacks, 6 + (p * 7 + o) % 48 / 8e0 AS far, 4 + p % 16 / 8e0 AS near,
  CASE WHEN q = 0 OR i % 12 >= 7 THEN 1e0 ELSE (i % 12 + 1) / 8e0 END AS done, ((p * 5 + o * 3) % 80 - 40) / 8e0 AS wide, (o % 16 - 8) / 8e0 AS narrow
FROM (SELECT s AS k, o, p, cast(rn % 12 AS int) AS tr, cast(floor(rn / 12) AS int) AS i, cast(floor(rn / 144) AS int) AS q
  FROM (SELECT s, o, p, row_number() OVER (PARTITION BY s ORDER BY o, l) - 1 AS rn FROM {keys}) n) d""",
    "waypoints": """
SELECT k, tr, i, p, old + (new - old) * done AS x, y FROM (
  SELECT k, tr, i, p, done, CASE WHEN q % 2 = 0 THEN 40 - d1 ELSE d1 END AS new, CASE WHEN q % 2 = 0 THEN d0 ELSE 40 - d0 END AS old, y FROM (
    SELECT k, tr, i, p, q, done, CASE WHEN attacks THEN far ELSE near END AS d1, CASE WHEN attacks THEN near ELSE far END AS d0,
      CASE WHEN attacks THEN 1.5e0 + slot * 3.25e0 + wide ELSE 3 + slot * 2.75e0 + narrow END AS y FROM {places}) a) b""",
    "play_rows": """
SELECT concat('p', cast(k AS string)) AS match_id, i * 4 + f AS frame_id, (i * 4 + f) / 4e0 AS timestamp_s, tr + 1 + 20 * cast(floor(i / 17) AS int) AS track_id,
  CASE WHEN p % 23 = 0 THEN 'unknown' WHEN tr < 6 THEN 'A' ELSE 'B' END AS team, x + (nx - x) * f / 4e0 AS x, y + (ny - y) * f / 4e0 AS y
FROM (SELECT *, lead(x) OVER (PARTITION BY k, tr ORDER BY i) AS nx, lead(y) OVER (PARTITION BY k, tr ORDER BY i) AS ny FROM {waypoints}) w
CROSS JOIN (VALUES (0), (1), (2), (3)) v(f) WHERE nx IS NOT NULL AND p % 19 <> 0 AND NOT (p % 17 = 0 AND f IN (1, 2))""",
    "statuses": """
SELECT concat('m', cast(s_suppkey AS string)) AS match_id, min(CASE s_suppkey % 4 WHEN 0 THEN 'done' WHEN 1 THEN 'processing' WHEN 2 THEN 'failed' ELSE 'unknown' END) AS status
FROM {supplier} GROUP BY s_suppkey""",
    "meta_updates": """
SELECT concat('m', cast(8 * cast(floor(s_suppkey / 32) AS bigint) + s_suppkey % 8 AS string)) AS match_id, s_suppkey AS seq, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE concat('Match ', cast(s_suppkey AS string)) END AS display_name,
  CASE WHEN s_suppkey % 4 = 1 THEN concat('f', cast(s_suppkey AS string), '.mp4') END AS file_name FROM {supplier}""",
}

DEPENDS = {name: tuple(dict.fromkeys(re.findall(r"\{([a-z]\w*)\}", text))) for name, text in VIEWS.items()}


#: Inputs that a view takes dealt by a column over numbered partitions: a task's groups and windows then do not grow with
#: the tables, and those of later views that have the column among their keys work in place.
DEALT = {("keys", "lineitem"): "l_orderkey", ("places", "keys"): "s"}


def _order(names: tuple[str, ...]) -> list[str]:
    """The views that ``names`` need, inputs first."""
    want, out = list(names), []
    while want:
        n = want.pop()
        if n in VIEWS and n not in out:
            out.append(n)
            want += DEPENDS[n]
    return [n for n in VIEWS if n in out]


class Tables:
    """The given tables of a folder and the views over them, built when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._made, self._parts = spark, sf_dir, {}, None

    def parts(self) -> int:
        """Partitions for all line items: a line item is one player row at most."""
        if self._parts is None:
            self._parts = task_parts(self.spark, self.lineitem.count())
        return self._parts

    def _input(self, view: str, name: str) -> DataFrame:
        df = getattr(self, name)
        return df.repartition(self.parts(), DEALT[view, name]) if (view, name) in DEALT else df

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in (*GIVEN, *VIEWS):
            raise AttributeError(name)
        if name not in self._made:
            if name in VIEWS:
                self._made[name] = self.spark.sql(VIEWS[name], **{d: self._input(name, d) for d in DEPENDS[name]})
            else:
                self._made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._made[name]


def with_views(query: str) -> str:
    """``query`` with the views that it names in braces as common table expressions before it."""
    used = tuple(dict.fromkeys(re.findall(r"\{([a-z]\w*)\}", query)))
    bare = lambda text: re.sub(r"\{([a-z]\w*)\}", r"\1", text)
    ctes = ",\n".join(f"{n} AS ({bare(VIEWS[n])})" for n in _order(used))
    body = bare(query).strip()
    if not ctes:
        return body
    if m := re.match(r"WITH\s+(RECURSIVE\s+)?", body):
        return f"WITH {m[1] or ''}{ctes},\n{body[m.end() :]}"
    return f"WITH {ctes}\n{body}"
