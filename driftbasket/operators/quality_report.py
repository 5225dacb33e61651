"""How well baskets agree with the exact scores of a sample of sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import kendall_tau_b
from ..graph import Graph
from ..scratch import materialize
from .exact import exact_multi_source


def sample_sources(baskets: DataFrame, graph: Graph, n: int, strict: bool, seed: str = "report") -> DataFrame:
    """(source): n sources by a seeded hash; strict leaves out sources without successors."""
    sources = baskets.select("source").distinct()
    if strict:
        sources = sources.join(graph.edges.select(F.col("src").alias("source")), "source", "left_semi")
    return sources.orderBy(F.md5(F.concat_ws(":", F.lit(seed), F.col("source").cast("string"))), "source").limit(n)


def benchmark_report(baskets: DataFrame, graph: Graph, testNodes: int = 200, strict: bool = True, seed: str = "report") -> DataFrame:  # noqa: N803
    """One row: jaccard_average, jaccard_min, kendall_average, kendall_min, average_map_size; all -1 if there is
    nothing to sample. Exact scores: 100 iterations, damping 0.85, tolerance 1e-4."""
    if testNodes <= 0:
        raise ValueError("testNodes must be positive")
    strange = baskets.select("source").distinct().join(graph.vertices.withColumnRenamed("id", "source"), "source", "left_anti").limit(1).collect()
    if strange:
        raise ValueError(f"node {strange[0][0]} in the provided map is not part of the provided graph")
    names = ["jaccard_average", "jaccard_min", "kendall_average", "kendall_min", "average_map_size"]
    sources = materialize(sample_sources(baskets, graph, testNodes, strict, seed), "sample")
    if sources.isEmpty():
        return baskets.sparkSession.createDataFrame([(-1.0,) * 5], ", ".join(f"{n} double" for n in names))
    own = materialize(baskets.join(sources, "source").select("source", "node", "score"), "own")
    exact = materialize(exact_multi_source(graph, sources), "exact")
    sizes = own.groupBy("source").agg(F.count("*").alias("size"))
    order = keep_ranked(exact).join(sizes, "source").where("rank <= size").select("source", "node", F.lit(1).alias("top"))
    held = own.join(order, ["source", "node"], "left").groupBy("source").agg(F.count("top").alias("both"))
    tops = order.groupBy("source").agg(F.count("*").alias("n_top"))
    both = F.coalesce("both", F.lit(0))
    overlap = sizes.join(tops, "source", "left").join(held, "source", "left").select("source", "size", (both / (F.col("size") + F.coalesce("n_top", F.lit(0)) - both)).alias("jaccard"))
    scored = own.join(exact.withColumnRenamed("score", "exact"), ["source", "node"], "left")
    # scores equal but for the order of additions are ties
    even = lambda c: F.floor(c * 1e10 + 0.501)
    pairs = scored.select("source", F.col("node").alias("item"), even(F.col("score")).alias("x"), even(F.coalesce("exact", F.lit(0.0))).alias("y"))
    per = overlap.join(kendall_tau_b(pairs), "source")
    return per.agg(F.avg("jaccard").alias(names[0]), F.least(F.lit(1.0), F.min("jaccard")).alias(names[1]), F.avg("kendall").alias(names[2]), F.least(F.lit(1.0), F.min("kendall")).alias(names[3]), F.avg("size").alias(names[4]))


def keep_ranked(scores: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    from .topk import rank_key

    return scores.withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy(rank_key(F.col("score")).desc(), "node")))
