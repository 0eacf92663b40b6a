"""Roots of chains: which first track a chain of continued tracks goes back to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written


def chain_roots(parents: DataFrame, keys: list[str], node: str, parent: str, out: str = "root") -> DataFrame:
    """Every node with the last node on the way up from it: keys, node, ``out``. Each node has one parent.

    Pointers double: each round every node points where its pointer points, so chains of 2^k steps take k rounds.
    Each round is written. A cycle is an error.
    """
    p = written(parents.select(*keys, F.col(node).alias("_n"), F.col(parent).alias("_up")).where("_n is not null and _up is not null and _n <> _up"), "roots")
    for _ in range(64):
        up = p.select(*keys, F.col("_n").alias("_up"), F.col("_up").alias("_above"))
        p = written(p.join(up, [*keys, "_up"], "left").select(*keys, "_n", F.coalesce("_above", "_up").alias("_up"), F.col("_above").isNotNull().alias("_moved")), "roots")
        if p.where("_moved").isEmpty():
            return p.select(*keys, F.col("_n").alias(node), F.col("_up").alias(out))
        p = p.drop("_moved")
    raise ValueError("the chains form a cycle")
