"""Operators 11 to 13 against brute force on small fixtures."""

import hashlib
import math
import random
from itertools import accumulate
from zlib import crc32

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from paperloom.llm import importance, queries, runs, topk

SF = "/root/testdata/sf0.001"


# --- runs


def plain_runs(words, min_length, min_exponent):
    """Every period tried over the whole text; the smallest period of a stretch comes first."""
    seen = {}
    for p in range(1, len(words) // min_exponent + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            if j > i and j + p - i >= max(min_length, min_exponent * p):
                seen.setdefault((i, j + p), p)
            i = max(j, i + 1)
    return sorted(((s, e - s, p) for (s, e), p in seen.items()), key=lambda r: (r[0], r[2]))


WORDS = st.integers(1, 3).flatmap(lambda k: st.lists(st.integers(0, k), max_size=60)).flatmap(lambda w: st.sampled_from([w, w + w, w[:7] * 6 + w, w + w[:20] + w + w[5:]]))


@settings(max_examples=300, deadline=None)
@given(st.lists(WORDS, max_size=4), st.sampled_from([(2, 2), (6, 3), (24, 3), (1, 4)]))
def test_runs_are_those_of_brute_force(documents, bounds):
    assert runs.all_runs(documents, *bounds) == [plain_runs(d, *bounds) for d in documents]


def test_lpf_is_the_longest_earlier_factor():
    word = [random.Random(n).randrange(3) for n in range(200)]
    order, names = runs.factor_names(np.array(word))
    assert order.tolist() == sorted(range(200), key=lambda i: word[i:])
    lcp = np.zeros(200, np.int64)
    lcp[1:] = runs.common_after(names, order[:-1], order[1:])
    length, source = runs.previous_factors(order, lcp)
    for i in range(200):
        best = max((next((n for n in range(200 - i) if word[j + n] != word[i + n]), 200 - i) for j in range(i)), default=0)
        assert length[i] == best and (not best or (source[i] < i and word[source[i] : source[i] + best] == word[i : i + best]))


def plain_op11(doc_id, text):
    words = [w for w in (text or "").translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ") if w]
    n, h = len(words), crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = plain_runs(words, 24, 3)
    best = None
    for r in found:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    return (doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def test_op11_is_brute_force(spark):
    got = {r[0]: tuple(r) for r in queries.op11_runs(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert got == {r.doc_id: plain_op11(r.doc_id, r.text) for r in docs}
    assert sum(r[1] > 0 for r in got.values()) >= 8


def test_runs_edges(spark, tmp_path):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a " * 50), (4, "a " * 50), (None, "b c " * 30 + "end"), (5, "x y " * 24), (6, " ".join(f"w{i % 4000}" for i in range(30_000))), (7, "one two three")]
    df = spark.createDataFrame([(*r, "n", 3) for r in rows], "doc_id bigint, text string, runs string, n_words int")
    got = sorted(((r.doc_id or 0, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in runs.find_runs(df, 24, 3).collect()), key=str)
    assert [g[:3] for g in got if g[0] in (0, 4, 5)] == [(0, 61, [(0, 60, 2)]), (4, 50, [(0, 50, 1)]), (4, 50, [(0, 50, 1)]), (5, 24, [(0, 24, 1)])]
    assert {g[3] for g in got if g[0] in (0, 4, 5)} == {"b c end", "a", "x y"}
    assert [g[1:] for g in got if g[0] in (1, 2, 3)] == [(0, [], "")] * 3
    assert [(g[1], g[2], len(g[3].split())) for g in got if g[0] == 6] == [(30_000, [(0, 30_000, 4000)], 4000)]
    assert runs.find_runs(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        runs.all_runs([[1]], 2, 1)


# --- top k


def plain_topk(rows, every, k):
    """Rows: (id, whole numbers), no two equal."""
    out = []
    for name, q in rows:
        if name % every == 0:
            best = sorted((-sum(a * b for a, b in zip(q, c)), i) for i, c in rows if i != name and len(c) == len(q))[:k]
            out += [(name, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("shard, block", [(8192, 8192), (7, 2)])
def test_topk_is_brute_force(spark, shard, block):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, [math.floor(1024 * x) for x in r.embedding]) for r in table.collect()]
    got = topk.search(table, every=20, shard=shard, block=block)
    assert sorted(map(tuple, got.collect())) == plain_topk(rows, 20, 10)
    assert got.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]


def test_topk_edges(spark):
    same = [(i, [1.0, 2.0]) for i in range(40)]
    odd = [(50, None), (51, [1.0, None]), (52, [float("nan"), 1.0]), (53, [float("inf"), 1.0]), (None, [9.0, 9.0]), (60, [5.0]), (61, [4.0]), (70, [0.0, -0.0]), (7, [1.0, 2.0]), (80, [1e12, 1.0])]
    df = spark.createDataFrame([(*r, 1.5) for r in same + odd], "vec_id bigint, embedding array<double>, score double").withColumn("rank", F.lit("x"))
    got = {}
    for r in sorted(topk.search(df, every=20, k=3, shard=5, block=2).collect()):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    top = 1024 * 1024
    assert got[0] == [(80, 1024 * 1024 * 10**12 + 2 * top), (1, 5 * top), (2, 5 * top)] and got[20][1:] == [(0, 5 * top), (1, 5 * top)]
    assert got[60] == [(61, 20 * top)] and got[80][0] == (0, 1024 * 1024 * 10**12 + 2 * top)
    assert topk.search(df.limit(0)).count() == 0 and topk.search(df.where("vec_id = 60"), every=1).count() == 0
    huge = spark.createDataFrame([(0, [1e18]), (1, [1e18]), (2, [-1e18])], "vec_id bigint, embedding array<double>")
    assert [(r.vec_id, r.score) for r in topk.search(huge, k=2).orderBy("rank").collect()] == [(1, 2**63 - 1), (2, -(2**63))]


def test_wide_scores_stay_exact():
    rng = random.Random(4)
    q, c = (np.array([[rng.randrange(-(2**40), 2**40) for _ in range(5)] for _ in range(6)], float) for _ in range(2))
    assert topk.products(q, c).tolist() == [[max(-(2**63), min(2**63 - 1, sum(int(x) * int(y) for x, y in zip(a, b)))) for b in c] for a in q]
    scores = np.array([[3, 9, 9, -1], [0, 0, 0, 0]])
    assert topk.best_places(scores, 3).tolist() == topk.best_places(scores.astype(object), 3).tolist() == [[1, 2, 0], [0, 1, 2]]


# --- importance


def plain_features(text, buckets=10_000):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = "".join(c if c in "0123456789abcdefghijklmnopqrstuvwxyz" or ord(c) > 127 else " " for c in lower).split(" ")
    words = [w for w in words if w]
    return len(words), [crc32(" ".join(words[i : i + n]).encode()) % buckets for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def plain_op13(docs, target):
    told = [(d, *plain_features(t)) for d, t in docs]
    s, t = [0] * 10_000, [0] * 10_000
    for _, _, found in told:
        for b in found:
            s[b] += 1
    for text in target:
        for b in plain_features(text)[1]:
            t[b] += 1
    big_s, big_t = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + 10_000) / ((s[b] + 1) * (big_t + 10_000)))) for b in range(10_000)]
    rows = []
    for d, n, found in told:
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found)
        rows.append([d, n, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    fit = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0]))
    places = {id(r): i for i, r in enumerate(fit[: 5 * len(fit) // 100], 1)}
    return [(r[0], r[2], r[3], r[4], places.get(id(r))) for r in rows]


def test_op13_is_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = queries.op13_importance(spark, SF)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(plain_op13(docs, target), key=str)
    assert got.where("rank IS NOT NULL").count() > 3 and {k for _, k in got.dtypes} == {"bigint"}


def test_importance_edges(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(f"w{rng.randrange(50)}" for _ in range(30))) for i in range(100)]
    rows += [(200, None), (201, ""), (202, "A.b-C Été 9"), (None, "q " * 40), (7, rows[7][1]), (203, "long " * 30_000)]
    df = spark.createDataFrame([(*r, 1, "f") for r in rows], "doc_id bigint, text string, score int, rank string").repartition(5)
    target = spark.createDataFrame([("w1 w2 w3 w4",), (None,)], "text string")
    told = importance.resample(df, target).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert sorted(map(tuple, told), key=str) == sorted(plain_op13(rows, ["w1 w2 w3 w4", None]), key=str)
    kept = importance.drawn(df, target)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in told if r.rank)
    assert importance.resample(df.limit(0), target).count() == 0 and importance.resample(df, target.limit(0)).count() == len(rows)


def test_counts_add_up_over_partitions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    total = np.zeros(97, np.int64)
    for r in docs.collect():
        total += np.bincount(plain_features(r.text, 97)[1], minlength=97)
    assert importance.bucket_counts(docs.repartition(23), 97).tolist() == total.tolist()
    assert list(accumulate(importance.gains(total, total).tolist()))[-1] == 0
