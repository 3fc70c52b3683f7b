"""Claims on queued items as keyed state: who holds an item, until when, and what became of it.

Events (id, at, kind, worker) are of kind claim, done or failed.  An item is held by one worker at most.
A claim lapses ``timeout`` after it was made, by a timer in event time, and the item can be claimed
again; what its worker says afterwards comes late.  Every event and every lapse is a row
(id, at, state, worker, attempt) of the result:

claimed (the item is the worker's now), refused (it is held, or done), done, waiting (given back),
late (by a worker who doesn't hold it) and lapsed.

State is kept by Spark in RocksDB and in the checkpoint, so a query that is stopped or crashes between
a claim and its end goes on with the claim where it was.  Its key is a shard, a class of items by hash:
each call between Spark and Python is paid once for a shard of a batch, not for each item.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

RESULT = "id bigint, at timestamp, state string, worker string, attempt int"
#: An item's state is at one place of all arrays.
_STATE = "id array<bigint>, held array<boolean>, ended array<boolean>, worker array<string>, until array<bigint>, attempt array<int>"
_NEW = (False, False, None, 0, 0)
#: Classes of items.  A checkpoint holds to the number that it began with.
SHARDS = 1024
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def step(state: tuple, at: int, kind: str, worker: str | None, timeout: int) -> tuple[tuple, list[tuple]]:
    """(state, rows (at, state, worker, attempt)) after an event; times in milliseconds.

    State is (held, ended, worker, until, attempt).
    """
    held, ended, owner, until, attempt = state
    rows = []
    if held and at >= until:
        rows.append((until, "lapsed", owner, attempt))
        held = False
    if kind == "claim":
        if held or ended:
            rows.append((at, "refused", worker, attempt))
        else:
            held, owner, until, attempt = True, worker, at + timeout, attempt + 1
            rows.append((at, "claimed", worker, attempt))
    elif held and owner == worker:
        held, ended = False, kind == "done"
        rows.append((at, "done" if ended else "waiting", worker, attempt))
    else:
        rows.append((at, "late", worker, attempt))
    return (held, ended, owner, until, attempt), rows


class Claims(StatefulProcessor):
    """The items of a shard; its one timer is that of the claim that lapses first."""

    def __init__(self, timeout_ms: int):
        self.timeout = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("claims", _STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import pandas as pd

        events = pd.concat(list(rows))
        events = events.assign(ms=events["at"].astype("int64") // (10**9 if "[s]" in str(events["at"].dtype) else 10**6 if "ns" in str(events["at"].dtype) else 10**3))
        events = events.sort_values(["id", "ms", "kind", "worker"])
        items, out = self._items(), []
        before = self._first(items)
        for item, ms, kind, worker in zip(*(events[c].tolist() for c in ("id", "ms", "kind", "worker"))):
            items[item], made = step(items.get(item, _NEW), ms, kind, worker, self.timeout)
            out += [(item, *row) for row in made]
        self._keep(items, before)
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        # Spark deletes the timer that it tells of; all claims that time has passed lapse with the first.
        now, items, out = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()), self._items(), []
        for item, (held, ended, owner, until, attempt) in items.items():
            if held and until <= now:
                items[item] = (False, ended, owner, until, attempt)
                out.append((item, until, "lapsed", owner, attempt))
        self._keep(items, None)
        yield self._frame(out)

    def close(self) -> None:
        pass

    def _items(self) -> dict[int, tuple]:
        if not self.value.exists():
            return {}
        number, *columns = self.value.get()
        return dict(zip(number, zip(*columns)))

    def _first(self, items) -> int | None:
        return min((until for held, _, _, until, _ in items.values() if held), default=None)

    def _keep(self, items, timer: int | None) -> None:
        """Put the items' state away; ``timer`` is the one that is set."""
        first = self._first(items)
        if timer is not None and timer != first:
            self.handle.deleteTimer(timer)
        if first is not None and timer != first:
            self.handle.registerTimer(first)
        self.value.update((list(items), *map(list, zip(*items.values()))))

    def _frame(self, rows):
        import pandas as pd

        item, at, state, worker, attempt = (list(x) for x in zip(*rows)) if rows else ([], [], [], [], [])
        return pd.DataFrame({"id": pd.Series(item, dtype="int64"), "at": pd.to_datetime(at, unit="ms"), "state": state, "worker": worker, "attempt": pd.Series(attempt, dtype="int32")})


def transitions(events: DataFrame, timeout_minutes: int = 60, delay: str = "10 minutes", shards: int = SHARDS) -> DataFrame:
    """The result's rows of a stream of events (id, at, kind, worker), which may come ``delay`` out of order; one of another kind is dropped."""
    known = events.where(F.col("kind").isin("claim", "done", "failed") & F.col("id").isNotNull() & F.col("at").isNotNull())
    timed = known.select(F.col("id").cast("bigint").alias("id"), "at", "kind", "worker").withWatermark("at", delay)
    sharded = timed.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards).cast("bigint")))
    return sharded.groupBy("shard").transformWithStateInPandas(Claims(timeout_minutes * 60_000), RESULT, "append", "eventtime")


def run(spark: SparkSession, events: DataFrame, out: str, checkpoint: str, timeout_minutes: int = 60, delay: str = "10 minutes") -> DataFrame:
    """Work off all events that there are, and read the rows that ``out`` holds then."""
    before = spark.conf.get(PROVIDER[0], None)
    spark.conf.set(*PROVIDER)
    try:
        made = transitions(events, timeout_minutes, delay)
        made.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(PROVIDER[0])
        else:
            spark.conf.set(PROVIDER[0], before)
    return spark.read.schema(RESULT).parquet(out)
