import random

import pytest
from pyspark.sql import functions as F

from paperloom.operators import bloom, routing, spans

SPAN = "doc_id string, n long, start long, end long"


def drawn(rng, n, docs, high):
    return [(rng.choice(docs), k, a, a + rng.choice([0, 1, 3, 20, 90])) for k in range(n) for a in [rng.randint(0, high)]]


@pytest.mark.parametrize("width", [1, 7, 1 << 16])
def test_containment_is_as_all_pairs(spark, width):
    rng = random.Random(width)
    items, marks = drawn(rng, 400, ["a", "b", "c", None], 300), drawn(rng, 120, ["a", "b", "d", None], 300)
    items += [("a", 1000, None, 4), ("a", 1001, 9, 4), ("b", 1002, 5, None)]
    marks += [("a", 1000, None, 4), ("a", 1001, 9, 4)]
    i, m = spark.createDataFrame(items, SPAN), spark.createDataFrame(marks, SPAN)
    whole = lambda r: None not in r and r[2] <= r[3]
    of = lambda x, test: any(whole(x) and whole(y) and x[0] == y[0] and test(x, y) for y in marks)
    holds, starts = (lambda x, y: x[2] <= y[2] and y[3] <= x[3]), (lambda x, y: y[2] <= x[2] < y[3])
    assert {r.n: r.holds for r in spans.holds_any(i, m, width=width).collect()} == {x[1]: of(x, holds) for x in items}
    assert {r.n: r.inside for r in spans.starts_inside(i, m, width=width).collect()} == {x[1]: of(x, starts) for x in items}
    assert {r.n for r in spans.left_over(i, m, False, width).collect()} == {x[1] for x in items if not of(x, starts)}
    wanted = sorted((x[0], x[2], x[3], y[2], y[3]) for x in items for y in marks if whole(x) and whole(y) and x[0] == y[0] and holds(x, y))
    assert sorted(tuple(r) for r in spans.pairs(i, m, width).select("doc_id", "start", "end", "mark_start", "mark_end").collect()) == wanted


def test_pairs_come_block_by_block_and_take_little_room(spark, tmp_path):
    place = (F.col("id") * 7919 % 60_000).alias("start")
    i = spark.range(3000).select(F.lit("a").alias("doc_id"), place, (place + F.col("id") * 31 % 10_000).alias("end"))
    m = spark.range(3000).select(F.lit("a").alias("doc_id"), place, (place + F.col("id") * 17 % 1500).alias("end"))
    spans.pairs(i, m).write.parquet(str(tmp_path / "pairs"))
    found = spark.read.parquet(str(tmp_path / "pairs"))
    wanted = i.join(m.withColumnsRenamed({"start": "mark_start", "end": "mark_end"}), "doc_id").where("mark_start >= start and mark_end <= end").select(found.columns)
    total = lambda x: tuple(x.agg(F.count("*"), F.sum(F.xxhash64(*x.columns).cast("decimal(38)"))).first())
    assert total(found) == total(wanted)
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < 1.6 * found.count()


@pytest.mark.parametrize("block", [1, 3])
def test_blocks_hold_all_spans_and_a_long_one_takes_no_others_along(spark, block):
    rows = [("a", n % 40, n % 40 + (500 if n % 10 == 0 else 2)) for n in range(300)] + [(None, 1, 2), ("a", 9, 4), ("a", None, 4), ("a", 4, None)]
    cut = spans._blocks(spark.createDataFrame(rows, "doc_id string, start int, end int"), "x", 10, block).collect()
    assert sorted((r.doc_id, s.start, s.end) for r in cut for s in r._x) == sorted(rows[:300])
    assert all(len(r._x) <= block and {(s.start // 10, s.end // 10) for s in r._x} == {(r._stretch, r._last)} for r in cut)


def test_spans_keep_their_columns_repeats_and_empty_tables(spark):
    rows = [("a", 0, 1, 9, "x", 1), ("a", 0, 1, 9, "x", 1)]
    i = spark.createDataFrame(rows, SPAN + ", `_mark` string, `_stretch` int")
    m = spark.createDataFrame([("a", 0, 2, 3)], SPAN)
    assert [tuple(r) for r in spans.holds_any(i, m).collect()] == [r + (True,) for r in rows]
    assert [tuple(r) for r in spans.holds_any(i, m.limit(0)).collect()] == [r + (False,) for r in rows]
    assert spans.starts_inside(i.limit(0), m).count() == 0 and spans.pairs(i, m.limit(0)).count() == 0


def test_a_document_of_many_spans_goes_over_many_tasks(spark):
    i = spark.range(40_000).select(F.lit("big").alias("doc_id"), F.col("id").alias("n"), (F.col("id") * 50).alias("start"), (F.col("id") * 50 + 30).alias("end"))
    m = i.where("n % 7 = 0").select("doc_id", (F.col("start") + 5).alias("start"), (F.col("start") + 6).alias("end"))
    told = spans.holds_any(i, m)
    assert told.where("holds").count() == m.count() and told.where("holds and n % 7 > 0").count() == 0
    plan = told._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_anti_join_behind_a_filter_is_exact(spark):
    rows = spark.range(3000).select((F.col("id") % 40).alias("a"), F.when(F.col("id") % 11 > 0, F.col("id")).alias("b"), F.lit("x").alias("_word"))
    known = spark.range(0, 4000, 3).select((F.col("id") % 40).alias("a"), F.when(F.col("id") % 5 > 0, F.col("id")).alias("b"))
    exact = sorted(map(tuple, rows.join(known, ["a", "b"], "left_anti").select("a", "b", "_word").collect()), key=str)
    # One word for all keys has every bit set, so each whole key is a possible hit; no word at all is the plain join.
    for choice in ({}, {"words": 1}, {"most_words": 0}):
        assert sorted(map(tuple, bloom.anti_join(rows, known, ["a", "b"], **choice).collect()), key=str) == exact
    assert bloom.anti_join(rows, known.limit(0), ["a", "b"]).count() == 3000


def test_a_filter_passes_every_key_known_and_few_others(spark):
    keys = ["a", "b"]
    known = spark.range(20_000).select((F.col("id") % 9).alias("a"), F.col("id").alias("b"))
    words = bloom.words_for(20_000)
    built = bloom.build(known, keys, words)
    assert bloom.possible(known, keys, built, words).where("not _possible").count() == 0
    others = spark.range(100_000, 140_000).select((F.col("id") % 9).alias("a"), F.col("id").alias("b"))
    assert bloom.possible(others, keys, built, words).where("_possible").count() < 0.03 * 40_000


def test_discovery_shuffles_neither_revisions_nor_new_keys(spark):
    revision = "array<struct<id:int,files:array<struct<filename:string,file_type:int>>,comments:array<struct<user:struct<id:int>>>>>"
    rows = [(1, n, [(0, [("a.docx", 180)], [])]) for n in range(50)]
    given = spark.createDataFrame(rows, f"event_id int, contribution_id int, revisions {revision}")
    queued = given.where("contribution_id < 10").select("event_id", "contribution_id")
    found = routing.discover(given, queued, queued.limit(0), 7)
    assert sorted(r.contribution_id for r in found.collect()) == list(range(10, 50))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "bit_or" in plan and "BroadcastHashJoin" in plan
    assert not any("revisions" in line for line in plan.splitlines() if "Exchange" in line)
