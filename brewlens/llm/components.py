"""Connected components by alternating large and small stars, each round cut by a table in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brewlens.llm.common import stored


def _with_least(edges: DataFrame, name: str) -> DataFrame:
    """Each edge (u, v) with the least of u and its neighbours. The minima are combined before their exchange and
    stored, so that the join meets two plain scans and adaptive execution can split a node with many edges."""
    least = stored(edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), name)
    return edges.join(least, "u")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (u, v): root is the least node of its component."""
    current = stored(
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges"
    )
    before = None
    while True:
        state = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return current.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, "stars").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.where("u <> v").distinct(), "edges")
        small = _with_least(large, "stars")
        hung = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            small.select("u", F.col("m").alias("v"))
        )
        current = stored(hung.where("u <> v").distinct(), "edges")
