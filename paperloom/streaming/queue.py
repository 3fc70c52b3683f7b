"""The notification queue as a stream: files of JSON in, log and queue tables out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from paperloom.operators.routing import validate
from paperloom.sources.landing import NOTIFICATION


def notifications(spark: SparkSession, path: str) -> DataFrame:
    """Notifications from files; the time of a notification is its file's, the same whenever it is read."""
    return spark.readStream.schema(NOTIFICATION).json(path).withColumn("received", F.col("_metadata.file_modification_time"))


def first_in_window(valid: DataFrame, window: str = "24 hours") -> DataFrame:
    """Notifications not queued for the same submission within ``window``; state is dropped after it."""
    return valid.withWatermark("received", window).dropDuplicatesWithinWatermark(["event_id", "contrib_id"])


def start(stream: DataFrame, log_path: str, queue_path: str, checkpoint: str) -> StreamingQuery:
    """Append every batch to the log and the queue; a batch written twice replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        rows = validate(batch)
        rows.where("logged").drop("_corrupt_record").write.mode("overwrite").parquet(f"{log_path}/batch={number}")
        rows.where("queued").select("event_id", "contrib_id", "revision_id", "received").write.mode("overwrite").parquet(f"{queue_path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def start_guarded(stream: DataFrame, log_path: str, queue_path: str, checkpoint: str, window: str = "24 hours") -> list[StreamingQuery]:
    """Two queries over the notifications: all that are to be logged, and those to be queued, a submission once in ``window``.

    What has been queued is state that Spark keeps in the checkpoint and drops when the window is over.
    """
    rows = validate(stream).drop("_corrupt_record")
    queued = first_in_window(rows.where("queued"), window).select("event_id", "contrib_id", "revision_id", "received")
    out = []
    for name, kept, path in (("log", rows.where("logged"), log_path), ("queue", queued, queue_path)):
        out.append(kept.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{checkpoint}/{name}").trigger(availableNow=True).start())
    return out


class RunCounters(StreamingQueryListener):
    """What the batches of all queries did: (name or id, batch, rows, milliseconds) of each, and the errors that ended one."""

    def __init__(self):
        self.batches, self.errors = [], []

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        p = event.progress
        self.batches.append((p.name or str(p.id), p.batchId, p.numInputRows, p.batchDuration))

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        if event.exception:
            self.errors.append((str(event.id), event.exception))
