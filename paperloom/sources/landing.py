"""Other inputs: LaTeX sources, submissions as JSON, relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

CONTRIBUTION = (
    "contribution struct<id:bigint>, revisions array<struct<id:bigint,is_editor_revision:boolean,"
    "files:array<struct<filename:string,file_type:int,download_url:string>>,comments:array<struct<user:struct<id:bigint>>>>>, _corrupt_record string"
)
NOTIFICATION = "action string, contrib_id bigint, editable_type string, event string, revision_id bigint, _corrupt_record string"
QUEUE = "id bigint, event_id bigint, contribution_id bigint, revision_id bigint, requested timestamp, scan_start timestamp, scanned timestamp, failure_reason string"


def read_tex(spark: SparkSession, path: str) -> DataFrame:
    """(filename, content) of whole files."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("filename"), F.col("value").alias("content"))
    return raw


def read_contributions(spark: SparkSession, path: str) -> DataFrame:
    """Submissions from JSON lines; a bad line keeps its text in ``_corrupt_record``."""
    return spark.read.schema(CONTRIBUTION).option("mode", "PERMISSIVE").json(path)


def read_notifications(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(NOTIFICATION).option("mode", "PERMISSIVE").json(path)


def paper_list(json: DataFrame, column: str = "body") -> DataFrame:
    """(event_id, contribution_id) of an event's list of papers, an array of objects with an id."""
    return json.select("event_id", F.explode(F.from_json(column, "array<struct<id:bigint>>")).alias("p")).select("event_id", F.col("p.id").alias("contribution_id"))


def read_jdbc(spark: SparkSession, url: str, table: str, key: str | None = None, low: int = 0, high: int = 0, parts: int = 1, **options) -> DataFrame:
    """A table over JDBC, in ``parts`` ranges of ``key`` where one is given; filters reach the database."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if key:
        reader = reader.options(partitionColumn=key, lowerBound=low, upperBound=high, numPartitions=parts)
    return reader.load()


def jdbc_catalog(spark: SparkSession, name: str, url: str, driver: str, **options) -> None:
    """Make a database known as the catalog ``name``: ``spark.table("name.schema.table")`` reads its tables then.

    Filters, and the aggregates, limits and orders that the database's dialect knows, are done there.
    """
    wanted = {"url": url, "driver": driver, "pushDownAggregate": "true", "pushDownLimit": "true", "pushDownOffset": "true"} | options
    for key, value in wanted.items():
        spark.conf.set(f"spark.sql.catalog.{name}.{key}", value)
    spark.conf.set(f"spark.sql.catalog.{name}", "org.apache.spark.sql.execution.datasources.v2.jdbc.JDBCTableCatalog")


def read_objects(spark: SparkSession, path: str) -> DataFrame:
    """Stored objects with path, modificationTime, length and content."""
    return spark.read.format("binaryFile").load(path)
