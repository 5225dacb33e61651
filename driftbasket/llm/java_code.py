"""Java functions from sources in this package (../java_code.py)."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.types import DataType

from .. import java_code


def function(spark: SparkSession, name: str, returns: DataType) -> str:
    """The SQL name of the function of class `name`, from name.java beside this file."""
    return java_code.function(spark, __package__, name, returns)
