"""Connected components by alternating large-star and small-star.

Each round is a handful of aggregations and joins over saved edges; nothing is collected.  Smallest
neighbours are saved before they are joined back, so that both sides of the join are
shuffles and a node with millions of neighbours is split by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace


def _print(edges: DataFrame) -> tuple:
    at = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return at[0], at[1]


def _large(work: Workspace, edges: DataFrame, name: str) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = work.save(both.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m")).select("w", F.least("w", "m").alias("m")), f"{name}_low")
    out = both.filter("v > u").join(low, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    out = work.save(out.distinct(), f"{name}_large")
    work.drop(f"{name}_low")
    return out


def _small(work: Workspace, edges: DataFrame, name: str) -> DataFrame:
    low = work.save(edges.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("k")), f"{name}_low")
    own = low.select(F.col("w").alias("u"), F.col("m").alias("v"))
    rest = edges.join(low.filter("k > 1"), F.col("u") == F.col("w")).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    out = work.save(own.unionByName(rest).distinct(), f"{name}_small")
    work.drop(f"{name}_low")
    return out


def star_components(work: Workspace, links: DataFrame, name: str) -> DataFrame:
    """links (a, b) -> node, component (the smallest node that it reaches), for each node of a link."""
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    edges = work.save(edges, f"{name}_edges")
    before, turn, old = _print(edges), 0, f"{name}_edges"
    while before[0]:
        large = _large(work, edges, f"{name}{turn}")
        edges = _small(work, large, f"{name}{turn}")
        work.drop(f"{name}{turn}_large", old)
        old, turn = f"{name}{turn}_small", turn + 1
        now = _print(edges)
        if now == before:
            break
        before = now
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
