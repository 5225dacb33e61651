"""Connected components of a link table by alternating large-star and small-star steps.

Each step groups by node (map-side minima first) and joins back, so a node of very many links is a skewed join,
which Spark splits, never a collected list. (Kiveris et al. 2014.)
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import discard, materialize


def _least(both: DataFrame) -> DataFrame:
    return both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of every node that is in a link (a, b), root being the least node it reaches."""
    edges = materialize(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    checksum = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    seen = checksum(edges)
    for _ in range(rounds):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = both.join(_least(both), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(down).distinct()
        before, edges = edges, materialize(small.where("a <> b"), "edges")
        discard([before])
        now = checksum(edges)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b"), F.col("b"))).distinct()
