"""Tables for models: samples, windows, graphs, formation vectors, evaluation."""

from __future__ import annotations

import math
from functools import reduce
from hashlib import md5

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .phases import ACTIONS

FRAME = ["match_id", "frame_id"]
SAMPLE = ["match_id", "frame_id", "track_id"]
#: Vectors that meet all references at once.
KNN_ROWS = 1024

#: Shapes as (depth, lateral place) in parts of the court around the team's middle: fixed values.
SHAPES = {
    "6-0": [(0.0, -0.4), (0.0, -0.24), (0.0, -0.08), (0.0, 0.08), (0.0, 0.24), (0.0, 0.4)],
    "5-1": [(0.0, -0.35), (0.0, -0.175), (0.0, 0.0), (0.0, 0.175), (0.0, 0.35), (0.15, 0.0)],
    "4-2": [(-0.05, -0.3), (-0.05, -0.1), (-0.05, 0.1), (-0.05, 0.3), (0.12, -0.15), (0.12, 0.15)],
    "3-2-1": [(-0.1, -0.3), (-0.1, 0.0), (-0.1, 0.3), (0.05, -0.15), (0.05, 0.15), (0.2, 0.0)],
    "3-3": [(-0.1, -0.25), (-0.1, 0.0), (-0.1, 0.25), (0.1, -0.25), (0.1, 0.0), (0.1, 0.25)],
}
#: Shapes without a form: six players drawn from these ranges of depth and lateral place.
DRAWN = {"attack": ((0.1, 0.45), (-0.45, 0.45)), "transition": ((-0.4, 0.4), (-0.45, 0.45))}


def training_samples(labels: DataFrame, frames: DataFrame, window: int = 25) -> DataFrame:
    """Labelled frames with a full window before them, known actions only, with their class index."""
    classes = F.array_position(F.array(*map(F.lit, ACTIONS)), F.col("action")) - 1
    return labels.join(frames.select(*FRAME), FRAME).where((F.col("frame_id") >= window - 1) & F.col("action").isin(*ACTIONS)).withColumn("label", classes.cast("int"))


def frame_windows(samples: DataFrame, players: DataFrame, window: int = 25) -> DataFrame:
    """Each sample's last ``window`` frames with their court-mapped players; frames without any stay as one row."""
    w = samples.select("match_id", F.col("frame_id").alias("centre"), F.col("track_id").alias("actor")).withColumn("frame_id", F.explode(F.sequence(F.col("centre") - (window - 1), F.col("centre"))))
    p = players.where("court_x is not null").select(*FRAME, "track_id", "team", "court_x", "court_y", "velocity_x", "velocity_y")
    return w.join(p, FRAME, "left")


def graph_nodes(windows: DataFrame, ball: DataFrame) -> DataFrame:
    """Ten features a player: place, velocity, distance to ball (missing: the centre spot) and goal, actor, team."""
    b = ball.where("court_x is not null").select(*FRAME, F.col("court_x").alias("bx"), F.col("court_y").alias("by"))
    j = windows.where("track_id is not null").join(b, FRAME, "left")
    dx, dy = F.col("court_x") - F.coalesce("bx", F.lit(20.0)), F.col("court_y") - F.coalesce("by", F.lit(10.0))
    gx, gy = F.col("court_x") - 40.0, F.col("court_y") - 10.0
    one = lambda c: F.when(c, 1.0).otherwise(0.0)
    return j.select(
        "match_id", "centre", "actor", "frame_id", "track_id", "court_x", "court_y", "velocity_x", "velocity_y", F.sqrt(dx * dx + dy * dy).alias("ball_distance"), F.sqrt(gx * gx + gy * gy).alias("goal_distance"),
        one(F.col("track_id") == F.col("actor")).alias("is_actor"), one(F.col("team") == "A").alias("team_a"), one(F.col("team") == "B").alias("team_b"), one(~F.col("team").isin("A", "B")).alias("team_other"),
    )


def graph_edges(players: DataFrame, k: int = 5) -> DataFrame:
    """Directed edges to the ``k`` nearest players of the frame (ties: lowest id); a frame holds a dozen players."""
    p = players.where("court_x is not null")
    a = p.select(*FRAME, F.col("track_id").alias("src"), F.col("team").alias("ta"), F.col("court_x").alias("ax"), F.col("court_y").alias("ay"))
    b = p.select(*FRAME, F.col("track_id").alias("dst"), F.col("team").alias("tb"), F.col("court_x").alias("bx"), F.col("court_y").alias("by"))
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    e = a.join(b, FRAME).where("src <> dst").select(*FRAME, "src", "dst", dx.alias("dx"), dy.alias("dy"), F.sqrt(dx * dx + dy * dy).alias("distance"), (F.col("ta") == F.col("tb")).alias("same_team"))
    rank = F.row_number().over(Window.partitionBy(*FRAME, "src").orderBy("distance", "dst"))
    return e.withColumn("_rn", rank).where(F.col("_rn") <= k).drop("_rn")


def formation_samples(players: DataFrame, stride: int = 5, least: int = 4, size: int = 7) -> DataFrame:
    """Team shapes as vectors of ``size`` points: scaled, centred, by track, padded with zeros; n_valid points count."""
    p = players.where((F.col("frame_id") % stride == 0) & F.col("on_court") & F.col("team").isin("A", "B") & F.col("court_x").isNotNull())
    held = F.sort_array(F.collect_list(F.struct("track_id", F.col("court_x").alias("x"), F.col("court_y").alias("y"))))
    g = p.groupBy(*FRAME, "team").agg(held.alias("ps"), F.avg("court_x").alias("mx"), F.avg("court_y").alias("my")).where(F.size("ps") >= least)
    flat = F.flatten(F.transform(F.slice("ps", 1, size), lambda q: F.array((q["x"] - F.col("mx")) / 40, (q["y"] - F.col("my")) / 20)))
    n = F.least(F.size("ps"), F.lit(size))
    return g.select(*FRAME, "team", F.concat(flat, F.array_repeat(F.lit(0.0), 2 * size - 2 * n)).alias("vector"), n.alias("n_valid"))


def reference_formations(spark: SparkSession, per_class: int = 50, seed: int = 0) -> DataFrame:
    """``per_class`` vectors of each shape: label, vector; drawn shapes are drawn from ``seed``."""
    rng = np.random.default_rng(seed)
    held = {label: np.tile(np.array(shape).ravel(), (per_class, 1)) for label, shape in SHAPES.items()}
    for label, ranges in DRAWN.items():
        low, high = np.array(ranges).T
        held[label] = rng.uniform(low, high, (per_class, 6, 2)).reshape(per_class, -1)
    rows = [(label, [*map(float, v), 0.0, 0.0]) for label, vs in held.items() for v in vs]
    return spark.createDataFrame(rows, "label string, vector array<double>")


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def knn_classify(vectors: DataFrame, refs: DataFrame, keys: list[str], k: int = 5) -> DataFrame:
    """Majority label of the ``k`` most similar reference vectors (cosine); ties by summed similarity, then label.

    References are a small labelled table and go whole to every task, where a batch of vectors meets them as one table
    of products. Sums run over the dimensions in order, so a similarity is the same number in whatever batch it falls.
    """
    held = sorted((r["label"], list(r["vector"])) for r in refs.select("label", "vector").collect())
    labels = sorted({label for label, _ in held})
    of = np.array([labels.index(label) for label, _ in held])
    to = np.array([v for _, v in held], float)

    def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return reduce(np.add, (a[..., d] * b[..., d] for d in range(b.shape[-1])), 0.0)

    size = lambda v: np.sqrt(products(v, v)) + 1e-8
    norms = size(to)

    @F.pandas_udf("string")
    def voted(vectors: pd.Series) -> pd.Series:
        out = []
        for at in range(0, len(vectors), KNN_ROWS):
            v = np.stack(vectors.iloc[at : at + KNN_ROWS].to_numpy())
            minus = -(products(v[:, None, :], to[None]) / (size(v)[:, None] * norms))
            best = np.argsort(minus, axis=1, kind="stable")[:, :k]  # references are in order of their labels
            near, lost = of[best], np.take_along_axis(minus, best, axis=1)
            own = near[:, :, None] == np.arange(len(labels))
            votes, total = own.sum(axis=1), reduce(np.add, (np.where(own[:, i], lost[:, i, None], 0.0) for i in range(near.shape[1])), 0.0)
            rank = np.lexsort((np.broadcast_to(np.arange(len(labels)), votes.shape), total, -votes), axis=1)
            out += [labels[i] for i in rank[:, 0]]
        return pd.Series(out, index=vectors.index, dtype=object)

    return vectors.select(*keys, voted("vector").alias("label"))


def knn_formation_rows(samples: DataFrame, refs: DataFrame, keys: list[str], k: int = 5, least: int = 4) -> tuple[DataFrame, DataFrame]:
    """Formation labels by the nearest shapes: (formations, formation_embeddings).

    Every vector is labelled, ``unknown`` where fewer than ``least`` of its points are valid; the embeddings hold the
    known ones with their first two numbers.
    """
    near = knn_classify(samples.where(F.col("n_valid") >= least), refs, keys, k)
    rows = samples.join(near, keys, "left").withColumn("formation", F.coalesce("label", F.lit("unknown")))
    shown = rows.where("formation <> 'unknown'").select(*keys, "formation", F.col("vector")[0].cast("float").alias("emb_0"), F.col("vector")[1].cast("float").alias("emb_1"))
    return rows.select(*keys, "formation"), shown


#: What is drawn for a view, and for each of its places.
DRAWS, PLACE_DRAWS = ("scale?", "scale", "turn?", "turn", "drop?", "drop", "out?", "out", "outx", "outy"), ("rx", "tx", "ry", "ty", "place")


def _uniforms(key: Column, places: Column) -> Column:
    """A view's numbers in [0, 1), ``DRAWS`` and then ``PLACE_DRAWS`` place by place: of the md5 of key, name and place,
    joined by bars, the first 52 bits."""

    @F.pandas_udf("array<double>")
    def drawn(keys: pd.Series, places: pd.Series) -> pd.Series:
        names = {n: [f"|{d}".encode() for d in DRAWS] + [f"|{d}|{i}".encode() for i in range(n) for d in PLACE_DRAWS] for n in places.unique().tolist()}
        first = (b"".join(md5(k + name).digest()[:7] + b"\0" for name in names[n]) for k, n in zip(map(str.encode, keys), places.tolist(), strict=True))
        return pd.Series([(np.frombuffer(f, ">u8") >> np.uint64(12)) / 2.0**52 for f in first], index=keys.index, dtype=object)

    return drawn(key, places)


def augment_formations(samples: DataFrame, seed: int = 0, views: int = 2) -> DataFrame:
    """Noisy views of each shape, drawn by hash, so reruns agree and any engine with md5 draws the same.

    In turn: every point is jittered by 0.025; the shape is scaled by up to 5 % (seven in ten) and turned by up to 3
    degrees (one in two); one point is dropped (one in two) and one of the others put anywhere within half a court
    (one in five), each if more than one point is there; at last all places of the vector are shuffled. Padding,
    which is a place whose coordinates sum to zero, is only moved about.
    """
    s = samples.withColumn("view", F.explode(F.sequence(F.lit(0), F.lit(views - 1))))
    key = F.concat_ws("|", "match_id", F.col("frame_id").cast("string"), "team", F.col("view").cast("string"), F.lit(str(seed)))
    s = s.withColumn("_u", _uniforms(key, (F.size("vector") / 2).cast("int")))

    def u(tag: str, i: Column | None = None) -> Column:
        return F.get("_u", F.lit(DRAWS.index(tag)) if i is None else len(DRAWS) + len(PLACE_DRAWS) * i + PLACE_DRAWS.index(tag))

    def gauss(i: Column, c: str) -> Column:
        return F.sqrt(-2 * F.log(1 - u(f"r{c}", i))) * F.cos(2 * math.pi * u(f"t{c}", i)) * 0.025

    def jittered(i: Column) -> Column:
        x, y = F.get("vector", 2 * i), F.get("vector", 2 * i + 1)
        return F.struct(i.alias("i"), (x + y != 0).alias("there"), ((x + gauss(i, "x")) * F.col("_scale")).alias("x"), ((y + gauss(i, "y")) * F.col("_scale")).alias("y"))

    def turned(p: Column) -> Column:
        # Both new coordinates need both old ones, so these are drawn in a step before: once, not once for each use.
        return F.struct(p["i"].alias("i"), p["there"].alias("there"), (p["x"] * F.col("_cos") - p["y"] * F.col("_sin")).alias("x"), (p["x"] * F.col("_sin") + p["y"] * F.col("_cos")).alias("y"))

    one_of = lambda places, tag, part: F.coalesce(F.when((u(f"{tag}?") < part) & (F.size(places) > 1), F.get(places, F.floor(u(tag) * F.size(places)).cast("int"))), F.lit(-1))
    s = s.withColumns({"_scale": F.when(u("scale?") < 0.7, 0.95 + 0.1 * u("scale")).otherwise(1.0), "_angle": F.when(u("turn?") < 0.5, (u("turn") * 2 - 1) * (3 * math.pi / 180)).otherwise(0.0)})
    s = s.withColumns({"_cos": F.cos("_angle"), "_sin": F.sin("_angle")})
    s = s.withColumn("_points", F.transform(F.transform(F.sequence(F.lit(0), (F.size("vector") / 2).cast("int") - 1), jittered), turned))
    s = s.withColumn("_there", F.transform(F.filter("_points", lambda p: p["there"]), lambda p: p["i"]))
    s = s.withColumn("_drop", one_of(F.col("_there"), "drop", 0.5))
    s = s.withColumn("_out", one_of(F.filter("_there", lambda i: i != F.col("_drop")), "out", 0.2))

    def placed(p: Column) -> Column:
        gone, out = ~p["there"] | (p["i"] == F.col("_drop")), p["i"] == F.col("_out")
        at = lambda c: F.when(gone, 0.0).when(out, u(f"out{c}") - 0.5).otherwise(p[c])
        return F.struct(u("place", p["i"]).alias("place"), p["i"].alias("i"), at("x").alias("x"), at("y").alias("y"))

    shuffled = F.array_sort(F.transform("_points", placed))
    return s.select("match_id", "frame_id", "team", "view", F.flatten(F.transform(shuffled, lambda p: F.array(p["x"], p["y"]))).alias("vector"), "n_valid")


def train_val_split(samples: DataFrame, keys: list[str], frac: float = 0.2, seed: int = 0) -> DataFrame:
    """Adds ``split``: exactly max(1, int(n frac)) rows are ``val``, those with the least hashed keys.

    The cut is the hash at that rank, found from counts of hash ranges, so rows are never sorted in one task: the
    range that holds the cut is narrowed on until few rows are in it.
    """
    h = samples.withColumn("_h", F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 40)))
    n = h.count()
    need, low, width, before = max(1, int(n * frac)) if n else 0, 0, 1 << 40, 0
    while width > 1 and n:
        step = max(1, width >> 10)
        bins = h.where((F.col("_h") >= low) & (F.col("_h") < low + width)).groupBy(F.floor((F.col("_h") - low) / step).alias("b")).count().orderBy("b").collect()
        for r in bins:
            if before + r["count"] >= need:
                low, width = low + r["b"] * step, step
                break
            before += r["count"]
    tied = F.row_number().over(Window.partitionBy("_h").orderBy(*keys))
    val = (F.col("_h") < low) | ((F.col("_h") == low) & (tied <= need - before))
    return h.withColumn("split", F.when(val, "val").otherwise("train")).drop("_h")


def accuracy(predictions: DataFrame) -> DataFrame:
    return predictions.agg(F.count("*").alias("n"), F.coalesce(F.avg((F.col("label") == F.col("predicted")).cast("double")), F.lit(0.0)).alias("accuracy"))


def confusion_matrix(predictions: DataFrame, classes: int = 4) -> DataFrame:
    """A row for each true class with the counts of the predicted ones, zeros kept."""
    g = predictions.groupBy("label").agg(*[F.count_if(F.col("predicted") == c).alias(f"p{c}") for c in range(classes)])
    every = predictions.sparkSession.range(classes).select(F.col("id").cast("int").alias("label"))
    return every.join(g, "label", "left").fillna(0)


def scaled_features(vectors: DataFrame, dims: int, keep: int = 0) -> DataFrame:
    """Vectors with their first ``dims`` numbers as z-scores (population deviation), ``keep`` more as they are."""
    each = vectors.select("vec_id", F.posexplode(F.slice("vector", 1, dims)).alias("d", "v"))
    stats = each.groupBy("d").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    z = each.join(F.broadcast(stats), "d").select("vec_id", "d", F.when(F.col("s") > 0, (F.col("v") - F.col("m")) / F.col("s")).otherwise(0.0).alias("z"))
    g = z.groupBy("vec_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "z"))), lambda q: q["z"]).alias("z"))
    return vectors.join(g, "vec_id").withColumn("vector", F.concat("z", F.slice("vector", dims + 1, keep)) if keep else F.col("z")).drop("z")


def cluster_centroids(vectors: DataFrame, label: str = "label") -> DataFrame:
    """Per cluster and dimension: mean and population deviation, and the cluster's size."""
    e = vectors.select(label, F.posexplode("vector").alias("d", "v"))
    return e.groupBy(label, "d").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.count("*").alias("size"))


def nearest_centroid(vectors: DataFrame, centroids: DataFrame, label: str = "label") -> DataFrame:
    """Each vector's nearest centroid (ties: least label). Centroids are as few as clusters and are broadcast as one row."""
    packed = centroids.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "mean"))), lambda q: q["mean"]).alias("c"))
    held = packed.agg(F.collect_list(F.struct(F.col(label).alias("label"), "c")).alias("cs"))
    j = vectors.drop(label).crossJoin(F.broadcast(held))
    d = F.transform("cs", lambda c: F.struct(F.aggregate(F.zip_with("vector", c["c"], lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v).alias("d2"), c["label"].alias("label")))
    return j.withColumn("_n", F.array_min(d)).select("vec_id", F.col("_n.label").alias("label"), F.sqrt("_n.d2").alias("distance"))
