"""Queries over clusters, single positions and trajectories."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clusters as C
from ..operators import report as P
from ..operators import segments as S
from ..sources.shared import written
from .models import QUANTISED, vectors
from .plays import by_match
from .reports import POINTS, SPREAD, ZONE, points

#: Places in [0, 1] of clusters of very different size, from the suppliers.
PLACES = "SELECT label, count(*) AS size, avg(x) AS mean_x, stddev_pop(x) AS std_x FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 20 < 9 THEN 0 WHEN s_suppkey % 20 < 15 THEN 1 WHEN s_suppkey % 20 < 17 THEN 2 WHEN s_suppkey % 20 < 18 THEN 3 ELSE 4 END AS label, CASE WHEN s_suppkey % 20 = 17 THEN 0.0625e0 WHEN s_suppkey % 20 IN (15, 16) THEN 0.9375e0 ELSE s_nationkey / 32e0 END AS x FROM {supplier}) GROUP BY label"
COLOURS = "SELECT vec_id, (vec_id % 8) / 8e0 AS white, (vec_id % 5) / 5e0 AS dark, (vec_id % 7) / 7e0 AS colourful, vec_id % 8 AS peak FROM {embeddings}"
ROLE = "row_number() OVER (ORDER BY size DESC, label) AS r"


def places(t):
    from .maintenance import sql_view

    return C.with_parts(sql_view(t, PLACES))


def colours(t):
    from .maintenance import sql_view

    return sql_view(t, COLOURS).withColumn("hue", F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.when(i == F.col("peak"), 1.0).otherwise(0.5)))


def noisy(t):
    return vectors(t).withColumn("label", F.when(F.col("vec_id") % 10 == 0, -1).otherwise(F.col("label")))


def direct(t):
    """Unsmoothed segments, one per track."""
    return t.play_rows.select("match_id", F.col("track_id").alias("seg_id"), "track_id", "frame_id", "timestamp_s", "x", "y")


def spanned(t):
    """Those segments, written once and dealt by match, and a span of time of each."""
    d = by_match(t, written(direct(t), "direct"))
    return d, d.select("match_id", "seg_id").distinct().select("match_id", "seg_id", F.lit(1.03).alias("t0"), F.lit(7.7).alias("t1"))


def positions(t):
    d, spans = spanned(t)
    return S.position_at(d, spans.select("match_id", "seg_id", F.col("t1").alias("t")))


AT = "(SELECT min(struct_pack(t := timestamp_s, x := x, y := y)) FROM {{play_rows}} r WHERE r.match_id = s.match_id AND r.track_id = s.track_id AND timestamp_s >= {t})"
LAST = "(SELECT max(struct_pack(t := timestamp_s, x := x, y := y)) FROM {play_rows} r WHERE r.match_id = s.match_id AND r.track_id = s.track_id)"
TRACKS = "s AS (SELECT DISTINCT match_id, track_id FROM {play_rows})"
ENDS = f"{TRACKS}, en AS (SELECT match_id, track_id, coalesce({AT.format(t='1.03')}, {LAST}) AS a, coalesce({AT.format(t='7.7')}, {LAST}) AS b FROM s)".replace("{{", "{").replace("}}", "}")

PLANS = {
    "b13_cluster_kmeans": (lambda t: C.cluster_kmeans(vectors(t)).select("vec_id", "label"), None),
    "b14_silhouette": (lambda t: C.silhouette(vectors(t)), None),
    "b16_reassign_noise": (
        lambda t: C.reassign_noise(noisy(t)).select("vec_id", "label", (F.floor(F.col("prob") * 1e6 + 0.5) / 1e6).alias("prob")),
        f"""WITH v AS ({QUANTISED}), c AS (SELECT label, list(mean ORDER BY d) AS c FROM (SELECT label, d, avg(v[d]) AS mean FROM v CROSS JOIN range(1, 65) r(d) WHERE vec_id % 10 <> 0 GROUP BY ALL) GROUP BY label)
 , sp AS (SELECT label, stddev_pop(x) + 1e-8 AS spread FROM (SELECT label, unnest(v) AS x FROM v WHERE vec_id % 10 <> 0) GROUP BY label), nn AS (SELECT vec_id, arg_min(c.label, list_distance(v, c)) AS label, min(list_distance(v, c)) AS d FROM v CROSS JOIN c WHERE vec_id % 10 = 0 GROUP BY vec_id)
 SELECT vec_id, label, 1e0 AS prob FROM v WHERE vec_id % 10 <> 0 UNION ALL SELECT vec_id, nn.label, floor(least(1, greatest(0.05, 1 - d / (2 * spread))) * 1e6 + 0.5) / 1e6 AS prob FROM nn JOIN sp ON sp.label = nn.label""",
    ),
    "b17_assign_cluster_roles": (
        lambda t: C.assign_cluster_roles(places(t)),
        f"""WITH p AS ({PLACES}), q AS (SELECT *, size / sum(size) OVER () AS part, {ROLE} FROM p), k AS (SELECT *, CASE WHEN r > 2 AND std_x <= 0.12 AND part <= 0.15 THEN CASE WHEN mean_x <= 0.15 THEN 'left' WHEN mean_x >= 0.85 THEN 'right' END END AS side FROM q),
 f AS (SELECT *, row_number() OVER (PARTITION BY side ORDER BY size DESC, label) AS s FROM k) SELECT label, size, CASE WHEN r = 1 THEN 'team_a' WHEN r = 2 THEN 'team_b' WHEN side IS NOT NULL AND s = 1 THEN 'goalkeeper' ELSE 'referee' END AS role, CASE WHEN r = 1 THEN 'A' WHEN r = 2 THEN 'B' ELSE 'unknown' END AS team FROM f""",
    ),
    "b18_roles_by_size": (lambda t: C.roles_by_size(places(t)), f"SELECT label, size, (['team_a', 'team_b', 'referee', 'goalkeeper', 'goalkeeper', 'goalkeeper'])[r] AS role FROM (SELECT *, {ROLE} FROM ({PLACES}))"),
    "b19_jersey_colour": (
        lambda t: C.jersey_colour(colours(t)),
        f"SELECT vec_id, CASE WHEN white > 0.45 THEN 'white' WHEN dark > 0.5 AND colourful < 0.2 THEN 'dark' WHEN colourful < 0.15 THEN 'grey' ELSE 'hue ' || peak END AS colour, colourful > 0.2 AND white < 0.4 AND dark < 0.4 AND peak <= 2 AS orange FROM ({COLOURS})",
    ),
    "b22_features_2d": (lambda t: C.features_2d(vectors(t)), None),
    "e12_trajectories": (
        lambda t: S.trajectories(direct(t)).select("match_id", "seg_id", F.posexplode("points").alias("place", "p")).select("match_id", "seg_id", "place", F.col("p")[0].alias("t"), F.col("p")[1].alias("x"), F.col("p")[2].alias("y")),
        """WITH p AS (SELECT match_id, track_id AS seg_id, floor(timestamp_s * 100 + 0.5) / 100e0 AS t, floor(x * 100 + 0.5) / 100e0 AS x, floor(y * 100 + 0.5) / 100e0 AS y, row_number() OVER (PARTITION BY match_id, track_id ORDER BY timestamp_s) - 1 AS i, count(*) OVER (PARTITION BY match_id, track_id) AS n FROM {play_rows}),
 c AS (SELECT match_id, seg_id, n, cast(place AS int) AS place, CASE WHEN n > 25 THEN cast(round_even(place * (n - 1) / 24, 0) AS bigint) ELSE place END AS i FROM (SELECT DISTINCT match_id, seg_id, n FROM p) CROSS JOIN range(0, 25) r(place) WHERE place < n)
 SELECT c.match_id, c.seg_id, place, t, x, y FROM c JOIN p ON p.match_id = c.match_id AND p.seg_id = c.seg_id AND p.i = c.i""",
    ),
    "e15_position_at": (
        lambda t: positions(t).select("match_id", "seg_id", "seen_s", "x", "y"),
        f"WITH {ENDS} SELECT match_id, track_id AS seg_id, b.t AS seen_s, b.x AS x, b.y AS y FROM en",
    ),
    "e16_displacement": (
        lambda t: S.displacement(*spanned(t)).select("match_id", "seg_id", "moved"),
        f"WITH {ENDS} SELECT match_id, track_id AS seg_id, sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) AS moved FROM en",
    ),
    "h5_density_points": (
        lambda t: P.density_points(points(t)),
        f"WITH {POINTS}, pz AS (SELECT *, {ZONE} AS zone FROM (SELECT *, CASE WHEN court_x < 20 THEN court_x ELSE 40 - court_x END AS u, CASE WHEN court_x < 20 THEN court_y ELSE 20 - court_y END AS v FROM pn)) SELECT match_id, frame_id, track_id, (court_x + 1.5e0) * 20 AS px, (20 - court_y + 1.5e0) * 20 AS py, cast(floor({SPREAD} * 1.2e0 * 20 + 0.5) AS bigint) AS radius FROM pz",
    ),
    "h10_play_trajectories": (
        lambda t: P.play_trajectories(
            t.play_events.select("match_id", "event_id", F.struct(F.when(F.col("team") == "A", 40.0).otherwise(0.0).alias("goal_x"), F.array(F.struct((F.col("event_id") % 5 - 1).cast("int").alias("track_id"), F.transform(F.sequence(F.lit(1), F.col("event_id") % 4 + 1), lambda i: F.array(F.col("start_time_s") + i, F.lit(1.0), F.lit(2.0))).alias("points"))).alias("tracks")).alias("details"))
        ),
        "SELECT match_id, event_id, cast(event_id % 5 - 1 AS int) AS track_id, start_time_s + 1 AS from_s, start_time_s + event_id % 4 + 1 AS to_s, cast(event_id % 4 + 1 AS int) AS n_points, CASE WHEN team = 'A' THEN 'right' ELSE 'left' END AS goal_end, event_id % 5 = 0 AS centroid FROM {play_events} WHERE event_id % 4 >= 1",
    ),
}
