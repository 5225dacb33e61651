"""Edge lists as text: "node1, node2" a line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import Graph


def parse_edges(lines: DataFrame, mode: str = "FAILFAST") -> DataFrame:
    """(src, dst) of lines(value): a number at the start of each side of the first comma; spaces before it and
    anything after it are ignored, a line without comma is a self-loop. Other lines raise (FAILFAST) or are
    left out (PERMISSIVE)."""
    if mode not in ("FAILFAST", "PERMISSIVE"):
        raise ValueError("mode must be FAILFAST or PERMISSIVE")
    line = F.regexp_replace("value", "[\r\n]", "")
    comma = F.locate(",", line)
    number = lambda c: F.regexp_extract(c, r"^\s*([+-]?\d+)", 1).try_cast("int")
    left = F.when(comma > 0, F.substring(line, F.lit(1), comma - 1)).otherwise(line)
    right = F.when(comma > 0, F.substring(line, comma + 1, F.length(line))).otherwise(line)
    parsed = lines.select("value", number(left).alias("src"), number(right).alias("dst"))
    bad = F.col("src").isNull() | F.col("dst").isNull()
    if mode == "PERMISSIVE":
        return parsed.where(~bad).select("src", "dst")
    fail = F.raise_error(F.concat(F.lit("not an edge: "), F.col("value"))).cast("int")
    return parsed.select(F.when(bad, fail).otherwise(F.col("src")).alias("src"), "dst")


def read_edge_csv(spark: SparkSession, path: str, mode: str = "FAILFAST") -> Graph:
    """The graph of a file: repeated edges count once, targets are nodes too. No file: an empty graph."""
    from pyspark.errors import AnalysisException

    try:
        lines = spark.read.text(path)
    except AnalysisException:
        lines = spark.createDataFrame([], "value string")
    return Graph.from_edges(parse_edges(lines, mode).dropDuplicates(["src", "dst"]))
