"""Stored reports: many to a file, sorted by key, with an index of the keys that each file spans.

A put writes one batch of Parquet files under ``data`` and then its rows of the index, so a batch that
a crash left half written is one that no reader sees.  Keys are hashes of what they name, so equal keys
are equal reports, within a batch and between batches.  A read by keys goes to the index, opens the files
whose span holds a key, and finds the row group there by statistics and a Bloom filter.
"""

from __future__ import annotations

import uuid
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession, functions as F

INDEX = "file string, low string, high string, n bigint"
#: Reports of a file at most; keys that a read looks up in the index one by one.
PER_FILE, MOST_KEYS = 50_000, 1000


def put(reports: DataFrame, path: str, per_file: int = PER_FILE, batch: str | None = None) -> str:
    """Add reports (key, report) and return the batch's name; rows without a key aren't stored.

    The same ``batch`` put again replaces itself.
    """
    spark, batch = reports.sparkSession, batch or uuid.uuid4().hex
    rows = reports.where("key is not null").select("key", "report").dropDuplicates(["key"])
    dealt = rows.repartitionByRange("key").sortWithinPartitions("key").write.mode("overwrite")
    dealt = dealt.option("maxRecordsPerFile", per_file).option("parquet.bloom.filter.enabled#key", "true").option("parquet.bloom.filter.expected.ndv#key", per_file)
    dealt.parquet(f"{path}/data/{batch}")
    held = spark.read.schema("key string").parquet(f"{path}/data/{batch}").select("key", F.concat(F.lit(f"{batch}/"), F.col("_metadata.file_name")).alias("file"))
    spans = held.groupBy("file").agg(F.min("key").alias("low"), F.max("key").alias("high"), F.count("*").alias("n"))
    spans.coalesce(1).write.mode("overwrite").parquet(f"{path}/index/batch={batch}")
    return batch


def index(spark: SparkSession, path: str) -> DataFrame:
    """(file, low, high, n) of the store's files."""
    return spark.read.schema(INDEX).parquet(f"{path}/index").select("file", "low", "high", "n")


def _read(spark: SparkSession, path: str, files: list[str]) -> DataFrame:
    reader = spark.read.schema("key string, report string")
    return reader.parquet(*(f"{path}/data/{f}" for f in files)) if files else spark.createDataFrame([], "key string, report string")


def get(spark: SparkSession, path: str, keys: list[str] | None = None) -> DataFrame:
    """(key, report) of all reports, or of those of ``keys``, of which an unknown one has no row."""
    if keys is not None and len(keys) > MOST_KEYS:
        return lookup(spark.createDataFrame([(k,) for k in keys], "key string"), path)
    spans = index(spark, path)
    if keys is not None:
        spans = spans.where(reduce(or_, (F.lit(k).between(F.col("low"), F.col("high")) for k in keys), F.lit(False)))
    found = _read(spark, path, [r.file for r in spans.select("file").collect()])  # a row for some thousands of reports
    return (found if keys is None else found.where(F.col("key").isin(*keys))).dropDuplicates(["key"])


def lookup(keys: DataFrame, path: str) -> DataFrame:
    """(key, report) of the reports whose key is in ``keys`` (key), however many those are."""
    stored = get(keys.sparkSession, path)
    return stored.join(keys.select("key").distinct(), "key", "left_semi")


def compact(spark: SparkSession, path: str, per_file: int = PER_FILE) -> str:
    """Make one batch of all, each report once, and remove the others; readers find every report at any time."""
    before = [r.batch for r in spark.read.parquet(f"{path}/index").select("batch").distinct().collect()]
    new = put(get(spark, path), path, per_file)
    for folder in ("index/batch=", "data/"):
        for old in before:
            gone = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{folder}{old}")
            gone.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(gone, True)
    return new
