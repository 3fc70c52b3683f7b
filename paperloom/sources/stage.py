"""Tables written once and read by column, and folders for files, where driver and executors share them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

KEY = "spark.checkpoint.dir"
_written: list[str] = []


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path in the folder that the session's ``spark.checkpoint.dir`` names.

    A local session that names no folder gets one of its own; any other must name one.
    """
    base = spark.conf.get(KEY, None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError(f"{KEY} must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="paperloom-")
        spark.conf.set(KEY, base)
    _written.append(f"{base.rstrip('/')}/paperloom/{label}-{uuid.uuid4().hex}")
    return _written[-1]


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in a fresh folder; what is a table already is left as it is."""
    if df._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation":
        return df
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def gathered(parts: list[DataFrame], label: str) -> DataFrame:
    """The union of DataFrames of one schema, each written by a job of its own: no plan holds more than one of them."""
    spark, path, schema = parts[0].sparkSession, scratch(parts[0].sparkSession, label), parts[0].schema
    for part in parts:
        part.write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Delete what this process has written to scratch paths; how many were there.  DataFrames that read them are of no use then."""
    gone = 0
    while _written:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_written.pop())
        gone += bool(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True))
    return gone
