"""A database as a catalog, counters of runs, and the guarded queue."""

import json
import time

from pyspark.sql import functions as F

from paperloom.operators import matching, queue, routing
from paperloom.sources import landing
from paperloom.streaming import queue as stream_queue

DERBY = ("jdbc:derby:memory:papers;create=true", "org.apache.derby.jdbc.EmbeddedDriver")


def test_catalogue_over_jdbc(spark):
    rows = [(i, f"P{i % 7}", i % 3, i % 2) for i in range(100)]
    df = spark.createDataFrame(rows, "id int, paper_id string, conference_id int, is_published int")
    df.write.format("jdbc").options(url=DERBY[0], driver=DERBY[1], dbtable="REFERENCE", createTableColumnTypes="paper_id VARCHAR(64)").mode("overwrite").save()
    landing.jdbc_catalog(spark, "papers", *DERBY)
    table = spark.table("papers.APP.REFERENCE")
    found = matching.lookup(table, "P3", 1)
    plan = found._jdf.queryExecution().toString()
    assert "PushedFilters: [paper_id IS NOT NULL" in plan and "paper_id = 'P3'" in plan and "conference_id = 1" in plan
    assert sorted(r.id for r in found.collect()) == [i for i, p, c, _ in rows if p == "P3" and c == 1]
    counted = table.where("is_published = 0").groupBy("conference_id").agg(F.count("*").alias("n"), F.max("id").alias("last"))
    plan = counted._jdf.queryExecution().toString()
    assert "PushedAggregates: [COUNT(*), MAX(id)]" in plan and "PushedGroupByExpressions: [conference_id]" in plan
    assert sorted(map(tuple, counted.collect())) == [(c, sum(r[2] == c and not r[3] for r in rows), max(r[0] for r in rows if r[2] == c and not r[3])) for c in range(3)]
    unpublished = queue.unpublished(table.withColumnRenamed("paper_id", "code"))
    assert [r.id for r in unpublished.collect()] == list(range(98, -1, -2))
    parts = landing.read_jdbc(spark, DERBY[0], "REFERENCE", "id", 0, 100, 4, driver=DERBY[1])
    assert parts.rdd.getNumPartitions() == 4 and sorted(map(tuple, parts.collect())) == rows


def test_discovery_is_counted_as_it_is_written(spark, tmp_path):
    found = spark.range(1000).selectExpr("1 as event_id", "id as contribution_id", "case when id % 5 < 2 then 'queue' when id % 5 = 2 then 'cache' else 'none' end as route")
    told = routing.write_discovered(found, str(tmp_path / "found"))
    counts = routing.discovery_counts(found).first().asDict()
    assert {k: told[k] for k in ("queue_items", "cached_items", "passed_over")} == {k: counts[k] for k in ("queue_items", "cached_items", "passed_over")} and told["duration"] > 0
    assert spark.read.parquet(str(tmp_path / "found")).count() == 1000
    empty = routing.write_discovered(found.limit(0), str(tmp_path / "none"))
    assert empty["queue_items"] == empty["passed_over"] == 0


def test_a_submission_is_queued_once_in_a_day(spark, tmp_path):
    (tmp_path / "in").mkdir()
    counters = stream_queue.RunCounters()
    spark.streams.addListener(counters)

    def arrive(n, *rows):
        (tmp_path / "in" / f"{n}.json").write_text("\n".join(json.dumps({"action": "create", "editable_type": "paper", "event": "indico-75"} | r) for r in rows))
        for q in stream_queue.start_guarded(stream_queue.notifications(spark, str(tmp_path / "in")), str(tmp_path / "log"), str(tmp_path / "queue"), str(tmp_path / "cp")):
            q.awaitTermination(90)
        return sorted(r.contrib_id for r in spark.read.parquet(str(tmp_path / "queue")).collect())

    try:
        assert arrive(1, {"contrib_id": 3}, {"contrib_id": 3}, {"contrib_id": 4}, {"contrib_id": 5, "action": "delete"}) == [3, 4]
        assert arrive(2, {"contrib_id": 4}, {"contrib_id": 6}) == [3, 4, 6]
        assert spark.read.parquet(str(tmp_path / "log")).count() == 6
        for _ in range(50):
            if sum(b[2] for b in counters.batches) >= 12:
                break
            time.sleep(0.2)
        assert sum(b[2] for b in counters.batches) == 12 and not counters.errors
    finally:
        spark.streams.removeListener(counters)
