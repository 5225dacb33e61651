"""Directed multigraphs as two DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Graph:
    """vertices(id) and edges(src, dst, pos): a bag of edges, `pos` the place in the source's successor list."""

    vertices: DataFrame
    edges: DataFrame

    @staticmethod
    def from_edges(edges: DataFrame, vertices: DataFrame | None = None) -> Graph:
        """Sources, targets and the given vertices together; targets without successors are dangling.
        Without a pos column the places follow dst."""
        if "pos" not in edges.columns:
            from pyspark.sql import Window

            edges = edges.withColumn("pos", F.row_number().over(Window.partitionBy("src").orderBy("dst")) - 1)
        ids = edges.select(F.col("src").alias("id")).union(edges.select("dst"))
        ids = ids if vertices is None else ids.union(vertices.select("id"))
        return Graph(ids.distinct(), edges.select("src", "dst", F.col("pos").cast("int").alias("pos")))

    @staticmethod
    def from_adjacency(spark: SparkSession, graph: dict) -> Graph:
        """node -> list of successors, in order, with repeats. Every successor must be a key."""
        kind = "string" if any(isinstance(k, str) for k in graph) else "long"
        edges = [(s, t, i) for s, ts in graph.items() for i, t in enumerate(ts)]
        out = Graph(spark.createDataFrame([(k,) for k in graph], f"id {kind}"), spark.createDataFrame(edges, f"src {kind}, dst {kind}, pos int"))
        out.validate()
        return out

    def validate(self) -> None:
        missing = self.edges.select(F.col("dst").alias("id")).union(self.edges.select("src")).join(self.vertices, "id", "left_anti").limit(1).collect()
        if missing:
            raise ValueError(f"edge endpoint {missing[0][0]} is not a node of the graph")

    def degrees(self) -> DataFrame:
        """(id, indegree, outdegree), parallel edges counted each."""
        into = self.edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("indegree"))
        out = self.edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("outdegree"))
        zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
        return self.vertices.join(into, "id", "left").join(out, "id", "left").select("id", zero("indegree"), zero("outdegree"))

    def predecessors(self) -> DataFrame:
        return self.edges.groupBy(F.col("dst").alias("id")).agg(F.sort_array(F.collect_list("src")).alias("predecessors"))

    def successors(self) -> DataFrame:
        ordered = F.sort_array(F.collect_list(F.struct("pos", "dst")))
        return self.edges.groupBy(F.col("src").alias("id")).agg(F.transform(ordered, lambda x: x["dst"]).alias("successors"))

    def dangling(self) -> DataFrame:
        return self.vertices.join(self.edges.select(F.col("src").alias("id")), "id", "left_anti")

    def weights(self, damping: float) -> DataFrame:
        """(src, dst, w): parallel edges merged, w = damping / outdegree for each of them."""
        out = self.edges.groupBy("src").agg(F.count("*").alias("n"))
        merged = self.edges.groupBy("src", "dst").agg(F.count("*").alias("m"))
        return merged.join(out, "src").select("src", "dst", (F.col("m") * F.lit(float(damping)) / F.col("n")).alias("w"))
