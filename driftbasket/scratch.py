"""Tables that cut a lineage: written to the folder that all executors share, so that they survive lost ones."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; one of our own only where that is unset and all runs on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="scratch-"))
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back."""
    path = f"{scratch_root(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize_by(df: DataFrame, column: str, values: list, tag: str) -> list[DataFrame]:
    """As materialize(), in one pass: a table of the rows that have each of these values in `column`, without it."""
    path = f"{scratch_root(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.partitionBy(column).option("compression", "zstd").parquet(path)
    left = df.drop(column).schema
    spark = df.sparkSession
    there = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    folders = [f"{path}/{column}={str(v).lower() if isinstance(v, bool) else v}" for v in values]
    return [spark.read.schema(left).parquet(f) if there.exists(spark._jvm.org.apache.hadoop.fs.Path(f)) else spark.createDataFrame([], left) for f in folders]


def discard(tables: Iterable[DataFrame]) -> None:
    """Delete tables that materialize() has written and that nothing reads any more."""
    for t in tables:
        for folder in {f.rsplit("/", 1)[0] for f in t.inputFiles()}:
            path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
