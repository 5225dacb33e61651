"""Java functions for Spark SQL from sources beside the modules that use them: the driver compiles them with Janino, which Spark brings, and
executors get them as a jar. For loops that go from step to step with state, which neither SQL nor numpy do in bulk."""

from __future__ import annotations

import os
import tempfile
import zipfile
import zlib
from importlib import resources

from pyspark.sql import SparkSession
from pyspark.sql.types import DataType


PACKAGE = "driftbasket"


def function(spark: SparkSession, package: str, name: str, returns: DataType, once: bool = False) -> str:
    """The SQL name of the function of class `name`, from name.java in `package`; compiled once a session.
    once: a plan may not call it anew for each place that reads its result."""
    source = resources.files(package).joinpath(f"{name}.java").read_text()
    own = f"{name}_{zlib.crc32((source + returns.json()).encode()):08x}"  # another source or result is another class
    sql_name = own.lower()
    if not spark.catalog.functionExists(sql_name):
        compiler = spark._jvm.org.codehaus.janino.SimpleCompiler()
        compiler.setParentClassLoader(spark._jvm.org.apache.spark.util.Utils.getContextOrSparkClassLoader())
        compiler.setSourceVersion(8)
        compiler.setTargetVersion(8)
        compiler.cook(source.replace(name, own))
        path = os.path.join(os.path.realpath(tempfile.mkdtemp()), f"{own}.jar")
        with zipfile.ZipFile(path, "w") as jar:
            for cls, code in dict(compiler.getBytecodes()).items():
                jar.writestr(cls.replace(".", "/") + ".class", bytes(code))
        spark._jsparkSession.sessionState().resourceLoader().addJar(path)
        made = spark._jvm.org.apache.spark.util.Utils.classForName(f"{PACKAGE}.{own}", True, False).getDeclaredConstructors()[0]
        instance = made.newInstance(spark.sparkContext._gateway.new_array(spark._jvm.Object, 0))
        returned = spark._jsparkSession.parseDataType(returns.json())
        if once:
            spark._jsparkSession.udf().register(sql_name, spark._jvm.org.apache.spark.sql.functions.udf(instance, returned).asNondeterministic())
        else:
            spark._jsparkSession.udf().register(sql_name, instance, returned)
    return sql_name
