"""Queries over model data and clustering."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import mlprep as M
from .maintenance import sql_view

LABELS = "SELECT match_id, frame_id, track_id, CASE (frame_id + track_id) % 5 WHEN 0 THEN 'pass' WHEN 1 THEN 'shot' WHEN 2 THEN 'dribble' WHEN 3 THEN 'hold' ELSE 'other' END AS action FROM {players} WHERE has_ball"
SAMPLES = f"sa AS (SELECT match_id, frame_id, track_id, action, cast(list_position(['pass', 'shot', 'dribble', 'hold'], action) - 1 AS int) AS label FROM ({LABELS}) SEMI JOIN {{frames}} USING (match_id, frame_id) WHERE frame_id >= 24 AND action <> 'other')"
PREDICTIONS = "SELECT match_id, frame_id, track_id, cast((frame_id + track_id) % 4 AS int) AS label, cast((frame_id * 3 + track_id) % 4 AS int) AS predicted FROM {players}"
WINDOWS = f"{SAMPLES}, wi AS (SELECT s.match_id, s.frame_id AS centre, s.track_id AS actor, cast(s.frame_id - o AS int) AS frame_id FROM sa s CROSS JOIN range(0, 25) r(o)), fw AS (SELECT wi.match_id, centre, actor, wi.frame_id, p.track_id, team, court_x, court_y, velocity_x, velocity_y FROM wi LEFT JOIN (SELECT * FROM {{players}} WHERE court_x IS NOT NULL) p ON p.match_id = wi.match_id AND p.frame_id = wi.frame_id)"
#: Embeddings in 1/64 steps, so that means are exact.
QUANTISED = "SELECT vec_id, label, list_transform(embedding, lambda v: floor(v * 64) / 64e0) AS v FROM embeddings"


def samples(t):
    return M.training_samples(sql_view(t, LABELS), t.frames)


def predictions(t):
    return sql_view(t, PREDICTIONS)


def vectors(t):
    return t.embeddings.select("vec_id", "label", F.transform("embedding", lambda v: F.floor(v.cast("double") * 64) / 64.0).alias("vector"))


def split_rows(t):
    return M.train_val_split(t.players.select("match_id", "frame_id", "track_id"), ["match_id", "frame_id", "track_id"])


def knn_rows(t):
    return M.knn_formation_rows(M.formation_samples(t.players, 1, 2), M.reference_formations(t.spark), ["match_id", "frame_id", "team"])


def whole_vectors(t):
    f = M.formation_samples(t.players, 1, 2)
    return f.select("match_id", "frame_id", "team", "n_valid", F.posexplode("vector").alias("i", "v"))


def views(t):
    """Both views of every shape, place by place."""
    v = M.augment_formations(M.formation_samples(t.players, 1, 2))
    at = v.select("match_id", "frame_id", "team", "view", "n_valid", "vector", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("place"))
    of = lambda i: F.floor(F.get("vector", i) * 1e6 + 0.5) / 1e6
    return at.select("match_id", "frame_id", "team", "view", "n_valid", "place", of(2 * F.col("place")).alias("x"), of(2 * F.col("place") + 1).alias("y"))


def _u(tag: str, i: str = "") -> str:
    return f"(cast('0x' || substr(md5(k || '|{tag}'{' || ' + chr(39) + '|' + chr(39) + ' || ' + i if i else ''}), 1, 13) AS bigint) / 4503599627370496e0)"


def _gauss(c: str) -> str:
    return f"sqrt(-2 * ln(1 - {_u('r' + c, 'i')})) * cos(2 * pi() * {_u('t' + c, 'i')}) * 0.025e0"


VIEWS_SQL = f"""WITH p AS (SELECT match_id, frame_id, team, track_id, court_x AS x, court_y AS y FROM {{players}} WHERE on_court AND team IN ('A', 'B') AND court_x IS NOT NULL),
 g AS (SELECT match_id, frame_id, team, avg(x) AS mx, avg(y) AS my, count(*) AS n, list(struct_pack(t := track_id, x := x, y := y) ORDER BY track_id) AS ps FROM p GROUP BY ALL HAVING count(*) >= 2),
 v AS (SELECT match_id, frame_id, team, cast(w AS int) AS view, cast(least(n, 7) AS int) AS n_valid, i, match_id || '|' || frame_id || '|' || team || '|' || w || '|0' AS k,
  CASE WHEN i >= n THEN 0e0 ELSE (ps[i + 1].x - mx) / 40 END AS x, CASE WHEN i >= n THEN 0e0 ELSE (ps[i + 1].y - my) / 20 END AS y FROM g CROSS JOIN range(0, 7) r(i) CROSS JOIN range(0, 2) s(w)),
 j AS (SELECT *, x + y <> 0 AS there, CASE WHEN {_u("scale?")} < 0.7e0 THEN 0.95e0 + 0.1e0 * {_u("scale")} ELSE 1e0 END AS f, CASE WHEN {_u("turn?")} < 0.5e0 THEN ({_u("turn")} * 2 - 1) * (3 * pi() / 180) ELSE 0e0 END AS a,
  x + {_gauss("x")} AS jx, y + {_gauss("y")} AS jy FROM v),
 o AS (SELECT *, jx * f * cos(a) - jy * f * sin(a) AS ox, jx * f * sin(a) + jy * f * cos(a) AS oy, row_number() OVER (PARTITION BY k, there ORDER BY i) - 1 AS r, count(*) FILTER (there) OVER (PARTITION BY k) AS c FROM j),
 d AS (SELECT *, there AND NOT ({_u("drop?")} < 0.5e0 AND c > 1 AND r = floor({_u("drop")} * c)) AS still FROM o),
 e AS (SELECT *, row_number() OVER (PARTITION BY k, still ORDER BY i) - 1 AS q, count(*) FILTER (still) OVER (PARTITION BY k) AS m FROM d),
 h AS (SELECT *, still AND {_u("out?")} < 0.2e0 AND m > 1 AND q = floor({_u("out")} * m) AS away FROM e)
 SELECT match_id, frame_id, team, view, n_valid, cast(row_number() OVER (PARTITION BY k ORDER BY {_u("place", "i")}, i) - 1 AS int) AS place,
  floor(CASE WHEN NOT still THEN 0e0 WHEN away THEN {_u("outx")} - 0.5e0 ELSE ox END * 1e6 + 0.5) / 1e6 AS x, floor(CASE WHEN NOT still THEN 0e0 WHEN away THEN {_u("outy")} - 0.5e0 ELSE oy END * 1e6 + 0.5) / 1e6 AS y FROM h"""


PLANS = {
    "i1_training_samples": (samples, f"WITH {SAMPLES} SELECT * FROM sa"),
    "i2_frame_windows": (lambda t: M.frame_windows(samples(t), t.players), f"WITH {WINDOWS} SELECT * FROM fw"),
    "i3_graph_nodes": (
        lambda t: M.graph_nodes(M.frame_windows(samples(t), t.players), t.ball),
        f"""WITH {WINDOWS} SELECT fw.match_id, centre, actor, fw.frame_id, track_id, fw.court_x, fw.court_y, velocity_x, velocity_y,
 sqrt((fw.court_x - coalesce(b.court_x, 20)) * (fw.court_x - coalesce(b.court_x, 20)) + (fw.court_y - coalesce(b.court_y, 10)) * (fw.court_y - coalesce(b.court_y, 10))) AS ball_distance, sqrt((fw.court_x - 40) * (fw.court_x - 40) + (fw.court_y - 10) * (fw.court_y - 10)) AS goal_distance,
 CASE WHEN track_id = actor THEN 1e0 ELSE 0e0 END AS is_actor, CASE WHEN team = 'A' THEN 1e0 ELSE 0e0 END AS team_a, CASE WHEN team = 'B' THEN 1e0 ELSE 0e0 END AS team_b, CASE WHEN team NOT IN ('A', 'B') THEN 1e0 ELSE 0e0 END AS team_other
 FROM fw LEFT JOIN {{ball}} b ON b.match_id = fw.match_id AND b.frame_id = fw.frame_id AND b.court_x IS NOT NULL WHERE track_id IS NOT NULL""",
    ),
    "i4_graph_edges": (
        lambda t: M.graph_edges(t.players, 2),
        """WITH e AS (SELECT a.match_id, a.frame_id, a.track_id AS src, b.track_id AS dst, b.court_x - a.court_x AS dx, b.court_y - a.court_y AS dy, a.team = b.team AS same_team FROM {players} a JOIN {players} b ON b.match_id = a.match_id AND b.frame_id = a.frame_id AND b.track_id <> a.track_id WHERE a.court_x IS NOT NULL AND b.court_x IS NOT NULL),
 d AS (SELECT *, sqrt(dx * dx + dy * dy) AS distance FROM e) SELECT match_id, frame_id, src, dst, dx, dy, distance, same_team FROM (SELECT *, row_number() OVER (PARTITION BY match_id, frame_id, src ORDER BY distance, dst) AS rn FROM d) WHERE rn <= 2""",
    ),
    "i5_formation_samples": (
        whole_vectors,
        """WITH p AS (SELECT match_id, frame_id, team, track_id, court_x AS x, court_y AS y FROM {players} WHERE on_court AND team IN ('A', 'B') AND court_x IS NOT NULL), g AS (SELECT match_id, frame_id, team, avg(x) AS mx, avg(y) AS my, count(*) AS n, list({'t': track_id, 'x': x, 'y': y} ORDER BY track_id) AS ps FROM p GROUP BY ALL HAVING count(*) >= 2)
 SELECT match_id, frame_id, team, cast(least(n, 7) AS int) AS n_valid, cast(i AS int) AS i, CASE WHEN i // 2 >= n THEN 0 WHEN i % 2 = 0 THEN (ps[i // 2 + 1].x - mx) / 40 ELSE (ps[i // 2 + 1].y - my) / 20 END AS v FROM g CROSS JOIN range(0, 14) r(i)""".replace("{'t': track_id, 'x': x, 'y': y}", "struct_pack(t := track_id, x := x, y := y)"),
    ),
    "i7_knn_classify": (lambda t: M.knn_classify(M.formation_samples(t.players, 1, 2), M.reference_formations(t.spark), ["match_id", "frame_id", "team"]), None),
    "d11b_knn_formations": (lambda t: knn_rows(t)[0], None),
    "d11b_knn_embeddings": (lambda t: knn_rows(t)[1], None),
    "i8_augment_formations": (views, VIEWS_SQL),
    "i9_train_val_split": (lambda t: split_rows(t).groupBy("split").agg(F.count("*").alias("n")), "SELECT 'val' AS split, cast(greatest(1, floor(count(*) * 0.2e0)) AS bigint) AS n FROM {players} UNION ALL SELECT 'train', count(*) - cast(greatest(1, floor(count(*) * 0.2e0)) AS bigint) FROM {players}"),
    "i10_accuracy": (lambda t: M.accuracy(predictions(t)), f"SELECT count(*) AS n, avg(CASE WHEN label = predicted THEN 1e0 ELSE 0e0 END) AS accuracy FROM ({PREDICTIONS})"),
    "i11_confusion_matrix": (lambda t: M.confusion_matrix(predictions(t)), f"SELECT label, count(*) FILTER (predicted = 0) AS p0, count(*) FILTER (predicted = 1) AS p1, count(*) FILTER (predicted = 2) AS p2, count(*) FILTER (predicted = 3) AS p3 FROM ({PREDICTIONS}) GROUP BY label"),
    "b12_scaled_features": (
        lambda t: M.scaled_features(vectors(t), 19, 2).select("vec_id", F.posexplode("vector").alias("i", "z")).select("vec_id", "i", (F.floor(F.col("z") * 1e6 + 0.5) / 1e6).alias("z")),
        f"WITH v AS (SELECT vec_id, cast(i AS int) AS i, v[i + 1] AS x FROM ({QUANTISED}) CROSS JOIN range(0, 21) r(i)), s AS (SELECT i, avg(x) AS m, stddev_pop(x) AS s FROM v GROUP BY i) SELECT vec_id, v.i, floor(CASE WHEN v.i >= 19 THEN x ELSE (x - m) / s END * 1e6 + 0.5) / 1e6 AS z FROM v JOIN s ON s.i = v.i",
    ),
    "b15_cluster_centroids": (
        lambda t: M.cluster_centroids(vectors(t)).select("label", "d", "mean", "size"),
        f"SELECT label, cast(d - 1 AS int) AS d, avg(v[d]) AS mean, count(*) AS size FROM ({QUANTISED}) CROSS JOIN range(1, 65) r(d) GROUP BY label, d",
    ),
    "b21_classify_team": (
        lambda t: M.nearest_centroid(vectors(t), M.cluster_centroids(vectors(t))).select("vec_id", "label"),
        f"""WITH v AS ({QUANTISED}), c AS (SELECT label, list(mean ORDER BY d) AS c FROM (SELECT label, d, avg(v[d]) AS mean FROM v CROSS JOIN range(1, 65) r(d) GROUP BY ALL) GROUP BY label)
 SELECT vec_id, arg_min(c.label, list_distance(v, c)) AS label FROM v CROSS JOIN c GROUP BY vec_id""",
    ),
}
