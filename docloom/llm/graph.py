"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _large(edges: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to the smallest node around it."""
    both = edges.union(edges.select("v", "u")).filter("u <> v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    least = written(least, "least")  # apart from the join, so that Spark can split a node with very many neighbours
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Each node links itself and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v")
    least = written(down.groupBy("u").agg(F.min("v").alias("m")), "least")
    linked = down.join(least, "u").select("v", "m").filter("v <> m").union(least.select("u", "m"))
    return linked.toDF("u", "v").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges (u, v) -> (node, component), component the smallest node reachable; nodes without another node are left out.

    Every round is written to the shared folder, so plans stay short and a lost executor costs no earlier round. The
    number of rounds grows with the logarithm of the longest path; stars take two."""
    edges = written(edges.filter("u <> v").distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        edges = written(_small(_large(edges)), "edges")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = state
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
