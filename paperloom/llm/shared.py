"""Tables and files in the folder that driver and executors share, and identities of rows.

The folder is the session's ``spark.checkpoint.dir``.  A table written there cuts lineage and
survives the loss of any executor; only a local session that names no folder gets one of its own.
Intermediate tables stay until ``release`` is called, because the DataFrames returned are lazy.
"""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from contextlib import suppress
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession, functions as F

KEY = "spark.checkpoint.dir"
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder's URI, its scheme filled in from the cluster's default filesystem.

    Where the session names none, a local session gets a folder of its own and any other an error.
    """
    base = spark.conf.get(KEY, None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError(f"{KEY} must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="paperloom-")
        spark.conf.set(KEY, base)
    return (base if "://" in base else _hadoop(spark, base)[1]).rstrip("/")


def _hadoop(spark: SparkSession, uri: str):
    """(Hadoop filesystem, qualified URI) of a path."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(uri)
    files = path.getFileSystem(context._jsc.hadoopConfiguration())
    return files, files.makeQualified(path).toString()


def fresh_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/paperloom/{label}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def release(spark: SparkSession) -> int:
    """Delete every table and file folder this process has written to the shared folder; how many.

    DataFrames that read them are of no use afterwards.
    """
    gone = 0
    while _written:
        uri = _written.pop()
        gone += bool(_hadoop(spark, uri)[0].delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri), True))
    return gone


def materialise(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage ends here, and the driver drops what hung on it."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    tidy(spark)
    return spark.read.schema(df.schema).parquet(path)


#: Part of the driver's largest heap beyond which it is collected between jobs.
HEAP_PART = 0.4


def tidy(spark: SparkSession, part: float = HEAP_PART) -> bool:
    """Have the driver's JVM collect its garbage and shrink its heap, if it holds over ``part`` of the largest; whether it did.

    Jobs of many tasks leave events, plans and map statuses for which the heap grows to its bound, though
    little of it is live; Spark also deletes shuffle files only once their plans are collected.
    """
    jvm = spark.sparkContext._jvm
    heap = jvm.java.lang.Runtime.getRuntime()
    if heap.totalMemory() <= part * heap.maxMemory():
        return False
    gc.collect()  # plans that Python still holds
    jvm.System.gc()
    return True


def fresh_names(df: DataFrame, *wanted: str) -> list[str]:
    """Column names that ``df`` doesn't have, in any case, as near to ``wanted`` as may be."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def numbered(docs: DataFrame, label: str = "rows") -> tuple[DataFrame, str, str]:
    """(``docs`` and two columns more, their names): the file's hash and the place in it name a row.

    A table read from Parquet has both already; anything else is written first.  Decisions on slim
    tables come back to the rows by these, whatever ids the rows repeat or lack.
    """
    plain = docs._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation"
    if not plain or "_metadata" in (c.lower() for c in docs.columns) or not _is_parquet(docs):
        docs = materialise(docs, label)
    names = fresh_names(docs, "_file", "_at")
    return docs.select("*", F.xxhash64("_metadata.file_path").alias(names[0]), F.col("_metadata.row_index").alias(names[1])), *names


#: Words of 64 places that are broadcast at most; Spark takes some 60 bytes for each.
MOST_WORDS = 1 << 20


def at_places(rows: DataFrame, places: DataFrame, file: str, at: str, value: str | None = None, planes: int = 1, most_words: int = MOST_WORDS) -> DataFrame:
    """The rows whose place (file, at) is one of ``places``, each of them once; their ``value`` (1 to 2^planes - 1) comes along.

    Of 64 places each bit of their values makes a word.  The words are broadcast while they are
    ``most_words`` or fewer, and then no row is shuffled; beyond that the tables are joined.
    """
    own = [value] if value else []
    shift = lambda name, c, by: F.call_function(name, c, (by % 64).cast("int"))
    word, bit = F.floor(F.col(at) / 64), shift("shiftleft", F.lit(1).cast("bigint"), F.col(at))
    held, number, *bits = fresh_names(rows, "_held", "_word", *(f"_bits{p}" for p in range(planes)))
    level = F.col(value).cast("bigint") if value else F.lit(1).cast("bigint")
    words = places.groupBy(F.col(file).alias(held), word.alias(number)).agg(
        *(F.coalesce(F.bit_or(F.when(F.call_function("shiftright", level, F.lit(p)).bitwiseAND(F.lit(1).cast("bigint")) == 1, bit)), F.lit(0).cast("bigint")).alias(b) for p, b in enumerate(bits))
    )
    words = materialise(words, "places")
    if words.count() > most_words:
        return rows.join(places.select(file, at, *own), [file, at]).select(*rows.columns, *own)
    met = rows.join(F.broadcast(words), (F.col(file) == F.col(held)) & (word == F.col(number)))
    found = sum((shift("shiftrightunsigned", F.col(b), F.col(at)).bitwiseAND(F.lit(1).cast("bigint")) * (1 << p) for p, b in enumerate(bits)), F.lit(0).cast("bigint"))
    return met.where(found > 0).select(*(F.col(c) for c in rows.columns), *([found.cast("int").alias(value)] if value else []))


def _is_parquet(docs: DataFrame) -> bool:
    from pyspark.errors import AnalysisException

    try:
        return bool(docs.select("_metadata.row_index").columns)
    except AnalysisException:
        return False


#: Hadoop's schemes and Arrow's for the same store.
SCHEMES = {"s3a": "s3", "s3n": "s3", "s3": "s3", "gs": "gs", "hdfs": "hdfs", "viewfs": "viewfs", "abfs": "abfs", "abfss": "abfss", "wasb": "abfs", "wasbs": "abfss"}


def arrow_uri(uri: str) -> str:
    """The URI by which Arrow opens what Hadoop knows as ``uri``; ValueError for an unknown scheme."""
    parts = urlsplit(uri)
    if parts.scheme not in SCHEMES:
        raise ValueError(f"no way is known to write files to {parts.scheme}://")
    place = parts.netloc
    if parts.scheme.startswith("wasb"):
        place = place.replace(".blob.core.", ".dfs.core.")
    return f"{SCHEMES[parts.scheme]}://{place}{parts.path}"


def open_filesystem(uri: str):
    """(filesystem, path) of a URI, on driver or executor; a path without a scheme is a local one."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(arrow_uri(uri))


def put_file(folder: str, name: str, data: bytes) -> str:
    """Write ``folder/name`` whole or not at all; a task's retry replaces what its first try left."""
    filesystem, path = open_filesystem(folder)
    filesystem.create_dir(path, recursive=True)
    draft = f"{path}/.{name}.{uuid.uuid4().hex}"
    with filesystem.open_output_stream(draft) as out:
        out.write(data)
    filesystem.move(draft, f"{path}/{name}")
    return os.path.join(folder, name)


#: Rows of an Arrow batch of whole texts at most.
BATCH_ROWS = 1000
#: Bytes after which such a batch ends, however few its rows.
BATCH_BYTES = 1 << 21
BYTES_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> None:
    """From now on Spark gives Python ``rows`` rows or about ``size`` bytes at a time or fewer.

    A batch is held by the executor's JVM, which doubles its buffers as they grow, and by the Python
    worker: at Spark's 10 000 rows, texts of 5 kB take some 100 MB in each, for every core.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)
    held = spark.conf.get(BYTES_KEY, None)
    if not (held and held.strip("bB").isdigit() and 0 < int(held.strip("bB")) <= size):
        spark.conf.set(BYTES_KEY, size)


_kept: dict = {}


def kept(key, make):
    """``make()``, which this worker process keeps for its next tasks in place of whatever it kept before.

    Workers serve one stage after the other: what each of them left would add up, and a stage would
    run beside all that those before it (or the run before) had needed.
    """
    if key not in _kept:
        let_go()
        _kept[key] = make()
        trim()
    return _kept[key]


def let_go() -> None:
    """Drop what this worker process keeps; a stage that keeps nothing calls it where its tasks begin."""
    if _kept:
        _kept.clear()
        gc.collect()
        trim()


def trim() -> None:
    """Give memory that is free in this process back to the system, as far as its C library can; Arrow's, too."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError, TypeError):  # not in every C library
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches, rows: int = 512):
    """The batches in slices of a few rows, so that a worker holds few texts as Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def text_rows(batches, *names):
    """Tuples of the named columns over an iterator of Arrow batches."""
    for batch in slices(batches):
        yield from zip(*(batch.column(n).to_pylist() for n in names))


def arrow_batches(rows, schema, size: int = 4096, weight=None, limit: int = 1 << 25):
    """Arrow batches of an iterator of tuples, ``size`` rows or about ``limit`` weight at most."""
    import pyarrow as pa

    held, load = [], 0
    for row in rows:
        held.append(row)
        load += weight(row) if weight else 0
        if len(held) >= size or load >= limit:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, type=f.type) for c, f in zip(zip(*held), schema)], schema=schema
            )
            held, load = [], 0
    if held:
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, type=f.type) for c, f in zip(zip(*held), schema)], schema=schema
        )


def arrow_schema(df_schema):
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(df_schema)
