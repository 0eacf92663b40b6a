"""Connected components with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, table


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Every node of an undirected edge list with the smallest node it can reach: columns ``node``, ``component``.

    Alternates the large-star and small-star rewrites: each hangs neighbours on the least node seen, keeps
    connectivity, and after O(log^2 n) rounds every tree is a star. No step gathers a neighbourhood: the least
    neighbour is a partial aggregate. Of up to ``BROADCAST_ROWS`` edges it is broadcast to them; of more it is written
    and read back, so that the join of a hub's edges with it is one between plain shuffles, which adaptive execution
    splits.
    Edges with a null end and loops add nothing. Each round is written to the shared folder.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    e = table(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    few = e.count() <= BROADCAST_ROWS  # rounds never add edges
    held = (lambda df, what: F.broadcast(df)) if few else table
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = held(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = large if few else table(large, "large")
        low = held(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        hung = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = table(hung.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "star")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
