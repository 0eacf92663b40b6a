"""Clusters of colour features: fitting, quality, roles and colours."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .mlprep import cluster_centroids, nearest_centroid


def _featured(vectors: DataFrame) -> DataFrame:
    return vectors.withColumn("features", array_to_vector("vector"))


def cluster_kmeans(vectors: DataFrame, k: int = 5, seed: int = 42) -> DataFrame:
    """Each vector's cluster: vec_id, vector, label."""
    features = _featured(vectors.drop("label"))
    model = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="label").fit(features)
    return model.transform(features).select("vec_id", "vector", "label")


def silhouette(labelled: DataFrame) -> DataFrame:
    """Mean silhouette (squared Euclidean) of a labelling, as one row."""
    score = ClusteringEvaluator(featuresCol="features", predictionCol="label").evaluate(_featured(labelled))
    return labelled.agg(F.count("*").alias("n")).withColumn("silhouette", F.lit(score))


def features_2d(vectors: DataFrame) -> DataFrame:
    """The two principal components of each vector; their signs are arbitrary."""
    model = PCA(k=2, inputCol="features", outputCol="pca").fit(_featured(vectors))
    p = vector_to_array("pca")
    return model.transform(_featured(vectors)).select("vec_id", p[0].alias("pc1"), p[1].alias("pc2"))


def reassign_noise(labelled: DataFrame) -> DataFrame:
    """Vectors of label -1 go to the nearest centroid, with a confidence that falls with their distance against the
    deviation of all the cluster's numbers; others keep their label with confidence 1."""
    sure = labelled.where("label <> -1")
    centroids = cluster_centroids(sure)
    spread = sure.select("label", F.explode("vector").alias("v")).groupBy("label").agg((F.stddev_pop("v") + 1e-8).alias("spread"))
    noise = nearest_centroid(labelled.where("label = -1"), centroids).join(spread, "label")
    prob = F.least(F.lit(1.0), F.greatest(F.lit(0.05), 1 - F.col("distance") / (2 * F.col("spread"))))
    return sure.select("vec_id", "label", F.lit(1.0).alias("prob")).unionByName(noise.select("vec_id", "label", prob.alias("prob")))


def cluster_places(labelled: DataFrame, dim: int) -> DataFrame:
    """Per cluster: size, its part of all, mean and deviation of the place in dimension ``dim``."""
    g = labelled.groupBy("label").agg(F.count("*").alias("size"), F.avg(F.col("vector")[dim]).alias("mean_x"), F.stddev_pop(F.col("vector")[dim]).alias("std_x"))
    return with_parts(g)


def with_parts(places: DataFrame) -> DataFrame:
    """Adds each cluster's part of all; there are as few rows as clusters."""
    return places.withColumn("part", F.col("size") / F.sum("size").over(Window.partitionBy()))


def assign_cluster_roles(places: DataFrame) -> DataFrame:
    """Roles of clusters (a handful of rows): the two largest are teams A and B; of the others a small, still cluster
    at either end is a goalkeeper, the largest a side; the rest are referees. ``team`` is A, B or unknown."""
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("size"), "label"))
    p = places.withColumn("_r", rank)
    keeper = (F.col("_r") > 2) & (F.col("std_x") <= 0.12) & (F.col("part") <= 0.15) & ((F.col("mean_x") <= 0.15) | (F.col("mean_x") >= 0.85))
    p = p.withColumn("_side", F.when(keeper, F.when(F.col("mean_x") <= 0.15, "left").otherwise("right")))
    first = F.row_number().over(Window.partitionBy("_side").orderBy(F.desc("size"), "label")) == 1
    role = F.when(F.col("_r") == 1, "team_a").when(F.col("_r") == 2, "team_b").when(F.col("_side").isNotNull() & first, "goalkeeper").otherwise("referee")
    team = F.when(F.col("_r") == 1, "A").when(F.col("_r") == 2, "B").otherwise("unknown")
    return p.select("label", "size", role.alias("role"), team.alias("team"))


def roles_by_size(places: DataFrame) -> DataFrame:
    """Fallback roles by falling size: team A, team B, referee, three goalkeepers, then the cluster's own number."""
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("size"), "label"))
    names = F.array(*map(F.lit, ("team_a", "team_b", "referee", "goalkeeper", "goalkeeper", "goalkeeper")))
    return places.withColumn("_r", rank).select("label", "size", F.when(F.col("_r") <= 6, F.get(names, F.col("_r") - 1)).otherwise(F.concat(F.lit("cluster "), F.col("label").cast("string"))).alias("role"))


def jersey_colour(features: DataFrame) -> DataFrame:
    """Colour of a feature row (white, dark, colourful: parts of the jersey; hue: eight bins), and whether it is orange."""
    bin_ = F.array_position("hue", F.array_max("hue")).cast("int") - 1
    colour = F.when(F.col("white") > 0.45, "white").when((F.col("dark") > 0.5) & (F.col("colourful") < 0.2), "dark").when(F.col("colourful") < 0.15, "grey").otherwise(F.concat(F.lit("hue "), bin_.cast("string")))
    orange = (F.col("colourful") > 0.2) & (F.col("white") < 0.4) & (F.col("dark") < 0.4) & (bin_ <= 2)
    return features.select("vec_id", colour.alias("colour"), orange.alias("orange"))
