"""Claims as keyed state, and the packed store of reports."""

import random

import pytest
from pyspark.sql import functions as F

from paperloom.operators.queue import content_key
from paperloom.sources import reports
from paperloom.streaming import claims

MINUTE = 60_000


def test_steps_of_a_claim():
    def walk(*events):
        state, out = (False, False, None, 0, 0), []
        for at, kind, worker in events:
            state, rows = claims.step(state, at * MINUTE, kind, worker, 60 * MINUTE)
            out += [(t // MINUTE, s, w, n) for t, s, w, n in rows]
        return out

    assert walk((0, "claim", "a"), (10, "claim", "b"), (20, "done", "b"), (30, "done", "a"), (40, "claim", "b")) == [(0, "claimed", "a", 1), (10, "refused", "b", 1), (20, "late", "b", 1), (30, "done", "a", 1), (40, "refused", "b", 1)]
    assert walk((0, "claim", "a"), (60, "claim", "b"), (61, "done", "a"), (62, "failed", "b"), (63, "claim", "a")) == [(0, "claimed", "a", 1), (60, "lapsed", "a", 1), (60, "claimed", "b", 2), (61, "late", "a", 2), (62, "waiting", "b", 2), (63, "claimed", "a", 3)]


def test_one_worker_at_most_holds_an_item():
    rng = random.Random(3)
    for _ in range(300):
        state, holder, until = (False, False, None, 0, 0), None, 0
        for at in sorted(rng.randrange(400) for _ in range(12)):
            state, rows = claims.step(state, at * MINUTE, rng.choice(["claim", "claim", "done", "failed"]), rng.choice("abc"), 60 * MINUTE)
            for t, what, worker, _ in rows:
                if what == "claimed":
                    assert holder is None
                    holder, until = worker, t + 60 * MINUTE
                elif what in ("done", "waiting", "lapsed"):
                    assert holder == worker and t <= until
                    holder = None


def test_claims_outlive_a_crash(spark, tmp_path):
    schema = "id bigint, at timestamp, kind string, worker string"

    def arrive(n, *rows):
        spark.createDataFrame([(i, f"2024-01-01 {at}:00", kind, w) for i, at, kind, w in rows], "id bigint, at string, kind string, worker string").withColumn("at", F.col("at").cast("timestamp")).coalesce(1).write.parquet(str(tmp_path / "in" / f"batch={n}"))

    def work():
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        return sorted((r.id, f"{r.at:%H:%M}", r.state, r.worker, r.attempt) for r in claims.run(spark, stream, str(tmp_path / "out"), str(tmp_path / "checkpoint")).collect())

    arrive(1, (1, "10:00", "claim", "a"), (2, "10:05", "claim", "a"), (None, "10:06", "claim", "a"), (3, "10:06", "nap", "a"))
    assert work() == [(1, "10:00", "claimed", "a", 1), (2, "10:05", "claimed", "a", 1)]
    arrive(2, (1, "10:30", "done", "a"), (1, "10:31", "claim", "b"))
    # A run that fails in the middle of its batch: nothing of it counts, and the next one takes it up.
    spark.conf.set(*claims.PROVIDER)
    broken = claims.transitions(spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in")))

    def fails(batch, number):
        batch.count()
        raise RuntimeError("lost")

    q = broken.writeStream.foreachBatch(fails).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
    with pytest.raises(Exception, match="lost"):
        q.awaitTermination()
    spark.conf.unset(claims.PROVIDER[0])
    assert [x for x in work() if x[0] == 1] == [(1, "10:00", "claimed", "a", 1), (1, "10:30", "done", "a", 1), (1, "10:31", "refused", "b", 1)]
    # Time goes on: the other claim lapses by its timer, and the item can be had again.
    arrive(3, (9, "11:30", "claim", "c"))
    assert [x for x in work() if x[0] == 2] == [(2, "10:05", "claimed", "a", 1), (2, "11:05", "lapsed", "a", 1)]
    arrive(4, (2, "11:31", "claim", "b"), (2, "11:32", "done", "a"))
    assert [x[1:] for x in work() if x[0] == 2][2:] == [("11:31", "claimed", "b", 2), ("11:32", "late", "a", 2)]


def test_items_of_a_shard_keep_their_own_claims(spark, tmp_path):
    """Two shards for 60 items: claims that lapse in different batches, all by their shard's one timer."""
    rng, folder, events = random.Random(5), tmp_path / "in", []
    for batch in range(3):
        now = [(rng.randrange(60), batch * 120 + k, rng.choice(["claim", "claim", "done", "failed"]), rng.choice("ab")) for k in range(120)]
        events += now
        rows = spark.createDataFrame(now, "id bigint, m int, kind string, worker string")
        rows.selectExpr("id", "timestamp_seconds(1704067200 + m * 60) as at", "kind", "worker").coalesce(1).write.parquet(str(folder / f"batch={batch}"))
        stream = spark.readStream.schema("id bigint, at timestamp, kind string, worker string").option("recursiveFileLookup", "true").parquet(str(folder))
        before = spark.conf.get(claims.PROVIDER[0], None)
        spark.conf.set(*claims.PROVIDER)
        made = claims.transitions(stream, shards=2)
        assert "shard" in made._jdf.queryExecution().analyzed().toString()
        made.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start().awaitTermination()
        spark.conf.unset(claims.PROVIDER[0]) if before is None else spark.conf.set(claims.PROVIDER[0], before)
    wanted, states = [], {}
    for item, m, kind, worker in events:
        states[item], rows = claims.step(states.get(item, (False, False, None, 0, 0)), m * MINUTE, kind, worker, 60 * MINUTE)
        wanted += [(item, t // MINUTE, s, w, n) for t, s, w, n in rows]
    wanted += [(item, s[3] // MINUTE, "lapsed", s[2], s[4]) for item, s in states.items() if s[0] and s[3] // MINUTE <= 359 - 10]
    got = spark.read.schema(claims.RESULT).parquet(str(tmp_path / "out")).selectExpr("id", "(unix_seconds(at) - 1704067200) div 60 as m", "state", "worker", "attempt")
    assert sorted(map(tuple, got.collect())) == sorted(wanted) and sum(x[2] == "lapsed" for x in wanted) > 30


def test_reports_are_packed(spark, tmp_path):
    path = str(tmp_path / "store")
    made = spark.range(300_000).select(F.concat(F.lit('{"n": '), F.col("id"), F.lit("}")).alias("report")).withColumn("key", content_key(F.col("report")))
    reports.put(made, path, per_file=20_000)
    spans = sorted(map(tuple, reports.index(spark, path).collect()), key=lambda r: r[1])
    assert sum(r[3] for r in spans) == 300_000 and len(spans) < 300 and all(a[2] < b[1] for a, b in zip(spans, spans[1:]))
    key = made.where("report = '{\"n\": 777}'").first().key
    one = reports.get(spark, path, [key])
    assert len(one.inputFiles()) == 1 and [tuple(r) for r in one.collect()] == [(key, '{"n": 777}')]
    assert "PushedFilters: [In(key" in one._jdf.queryExecution().toString() or "EqualTo(key" in one._jdf.queryExecution().toString()
    some = made.where("hash(key) % 1000 = 0").select("key")
    assert reports.lookup(some, path).count() == some.count() > 100


def test_reports_in_batches(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = spark.createDataFrame([("{}",), ("{}",), ("[]",), (None,)], "report string").withColumn("key", content_key(F.col("report")))
    reports.put(rows, path, batch="first")
    reports.put(rows, path, batch="first")
    reports.put(rows.where("report = '[]'"), path)
    spark.range(1).selectExpr("'x' as key", "'half' as report").write.parquet(f"{path}/data/torn")  # a batch without an index is none
    want = {(r.key, r.report) for r in rows.where("key is not null").collect()}
    assert sorted(map(tuple, reports.get(spark, path).collect())) == sorted(want)
    key = next(k for k, r in want if r == "[]")
    assert [r.report for r in reports.get(spark, path, [key, "none.json"]).collect()] == ["[]"] and reports.get(spark, path, ["0"]).count() == 0 == reports.get(spark, path, []).count()
    assert reports.get(spark, path, [key, *(f"{i:040}.json" for i in range(1001))]).count() == 1
    reports.compact(spark, path)
    assert sorted(map(tuple, reports.get(spark, path).collect())) == sorted(want) and reports.index(spark, path).agg(F.sum("n")).first()[0] == 2
    reports.put(rows.limit(0), path)
    assert reports.get(spark, path).count() == 2
