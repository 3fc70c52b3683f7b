"""Operators 7 to 9 and the pipeline against plain versions on small fixtures."""

import hashlib
import json
import struct

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from paperloom.llm import ann, chat, warc

SF = "/root/testdata/sf0.001"


# --- chat

HOSTILE = st.lists(st.sampled_from(list("ab\\<>/|:[]sINSTYROLE \n") + ["[INST]", "</s>", "<<SYS>>", "<|image:0|>", "\\<", "<<ROLE:x>> "]), max_size=20).map("".join)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system"]), HOSTILE), HOSTILE), max_size=5))
def test_turns_round_trip(turns):
    text, spans, _ = chat.format_turns((role, [{"type": "text", "text": body}]) for role, body in turns)
    assert [(r, b) for r, b, _ in chat.parse_turns(text)] == turns
    assert [chat.unescape(text[a:b]) for a, b in spans] == [b for r, b in turns if r == "assistant"]


def test_parts_become_placeholders():
    parts = [{"type": "text", "text": "see <|image:9|> "}, {"type": "image", "ref": "a.png", "width": 28, "height": 15}, {"type": "audio", "ref": "b.wav", "duration_ms": 100}, {"type": "document", "ref": "c.pdf", "pages": 2}]
    text, spans, held = chat.format_turns([("user", parts), ("assistant", [{"text": "ok"}])])
    assert [(a.kind, a.ref, a.tokens) for a in held] == [("image", "a.png", 4), ("audio", "b.wav", 3), ("document", "c.pdf", 512)]
    assert chat.parse_turns(text)[0] == ("user", "see <|image:9|> ", [0, 1, 2]) and "<|image:0|><|audio:1|><|document:2|>" in text
    with pytest.raises(ValueError):
        chat.format_turns([("user", [{"type": "video"}])])
    for broken in ("[INST] a", "x", "[INST] a </s>", "<s> a[/INST] "):
        with pytest.raises(ValueError):
            chat.parse_turns(broken)


def test_conversations_edges(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (2, None, None, None), (2, 3, "tool", "t"), (3, 0, "user", "same"), (3, 0, "user", "same"), (None, 0, "user", ""), (4, 0, "assistant", "z" * 200_000)]
    df = spark.createDataFrame([(*r, "extra", "f") for r in rows], "conv_id bigint, turn bigint, role string, text string, content string, formatted string")
    found = {r.conv_id: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    assert {k: v.n_turns for k, v in found.items()} == {1: 2, 2: 2, 3: 2, None: 1, 4: 1}
    nameless = spark.createDataFrame([(None, 0, "user", "a"), (None, 0, "user", "a"), (None, 1, "assistant", "b")], "conv_id bigint, turn bigint, role string, text string")
    assert [(r.n_turns, r.loss_chars) for r in chat.read_back(chat.format_conversations(nameless)).orderBy("loss_chars").collect()] == [(1, 0), (1, 0), (1, 1)]
    assert found[1].turns_sha256 == hashlib.sha256(b"user\na\nassistant\nb\n").hexdigest() and found[4].loss_chars == 200_000
    parts = spark.createDataFrame([(1, 0, "user", json.dumps([{"type": "image", "ref": "r"}])), (1, 1, "user", None)], "conv_id bigint, turn bigint, role string, parts string").withColumnRenamed("x", "x")
    assert chat.format_conversations(parts, "parts").first().expanded_tokens == 1
    assert chat.read_back(chat.format_conversations(df.limit(0))).count() == 0


# --- warc


def test_archive_round_trip_and_damage():
    pages = [(i, f"http://x/{i}", f"<p>{i % 3}</p>".encode() * 50) for i in range(40)]
    records = [warc.build_record(i, u, p, warc.digest32(p), len(p), None if i < 3 else i % 3) for i, u, p in pages]
    data = warc.write_archive(records)
    assert struct.unpack_from("<I", data)[0] == 0x184D2A5D
    rows = [warc.page_row(r) for r in warc.read_archive(data)]
    assert [(r[0], r[1], r[2], r[3], r[4]) for r in rows] == [(i, len(p), warc.digest32(p), "response" if i < 3 else "revisit", None if i < 3 else i % 3) for i, _, p in pages]
    assert rows[1][5] == pages[1][2]
    size = struct.unpack_from("<I", data, 4)[0]
    extra = data[: 8 + size] + struct.pack("<II", 0x184D2A50, 3) + b"abc" + data[8 + size :]
    assert len(list(warc.read_archive(extra))) == 40
    flipped = bytearray(data)
    flipped[-20] ^= 255
    for broken in (data[:-3], data[8 + size :], b"", bytes(flipped)):
        with pytest.raises(warc.WarcError):
            list(warc.read_archive(broken))


def test_reading_takes_time_in_proportion():
    import time

    rng = np.random.default_rng(0)
    records = [warc.build_record(i, None, p, warc.digest32(p), len(p), None) for i, p in enumerate(rng.bytes(1100) for _ in range(12_000))]
    data, times = warc.write_archive(records), {}
    size = struct.unpack_from("<I", data, 4)[0]
    half = warc.write_archive(records[:3000])
    for name, archive, n in (("half", half, 3000), ("whole", data, 12_000)):
        began = time.process_time()
        assert sum(1 for _ in warc.read_archive(archive)) == n
        times[name] = time.process_time() - began
    assert times["whole"] < 8 * times["half"] and size
    for cut in (len(data) - 1, len(data) - 700, 8 + size + 5):
        with pytest.raises(warc.WarcError):
            list(warc.read_archive(data[:cut]))


@pytest.mark.parametrize("change", [(b"WARC/1.1", b"WARC/9.9"), (b"WARC-Date", b"WARC-Dote"), (b"hello", b"jello"), (b"\r\n\r\nhello", b"\r\n\r\nhello!")])
def test_bad_records(change):
    record = warc.build_record(1, None, b"hello", warc.digest32(b"hello"), 5, None)
    warc.page_row(warc.parse_record(record))
    with pytest.raises(warc.WarcError):
        warc.page_row(warc.parse_record(record.replace(*change)))


def test_pages_edges(spark):
    rows = [(5, "u", "same"), (3, None, "same"), (9, "a\r\nB: c", "same"), (1, "u", None), (2, "u", ""), (7, "u", "é" * 100_000), (7, "u", "é" * 100_000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id bigint, url string, html string, size int")
    found = sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_warcs(warc.write_warcs(df)).collect())
    d = lambda t: warc.digest32(t.encode())
    big = (7, 200_000, d("é" * 100_000), "response", None)
    assert found == [(1, 0, d(""), "response", None), (2, 0, d(""), "revisit", 1), (3, 4, d("same"), "response", None), (5, 4, d("same"), "revisit", 3), big, big, (9, 4, d("same"), "revisit", 3)]
    assert {r.record_type for r in warc.read_warcs(warc.write_warcs(df, min_bytes=5)).collect() if r.page_id == 2} == {"response"}
    bodies = {r.page_id: r.payload for r in warc.read_warcs(warc.write_warcs(df), payloads=True).collect()}
    assert bodies[3] == b"same" and bodies[5] is None
    assert warc.read_warcs(warc.write_warcs(df.limit(0))).count() == 0
    nameless = spark.createDataFrame([(None, "u", "same"), (3, "u", "same"), (4, "u", "same")], "page_id bigint, url string, html string")
    found = {(r.page_id, r.record_type, r.refers_to) for r in warc.read_warcs(warc.write_warcs(nameless)).collect()}
    assert found == {(None, "response", None), (3, "response", None), (4, "revisit", 3)}


# --- neighbours


def plain_nearest(rows, every, k):
    good = [(i, np.array(v, np.float64)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, q in good:
        if i % every == 0:
            scored = [(-float((q * v).sum() / np.sqrt((q * q).sum() * (v * v).sum())), j) for j, v in good if j != i and len(v) == len(q)]
            out[i] = [(j, -s) for s, j in sorted(scored)[:k]]
    return out


def test_neighbours_recall(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding)) for r in table.collect()]
    want = plain_nearest(rows, 50, 5)
    got = {}
    for r in ann.search(table).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert set(got) == set(want) and all(sorted(g) == [1, 2, 3, 4, 5] for g in got.values())
    hit = sum(len({j for j, _ in want[q]} & {j for j, _ in got[q].values()}) for q in want)
    assert hit >= 0.9 * 5 * len(want), hit / 5 / len(want)


def test_neighbours_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [2.0, 0.1]), (50, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [1.0, None]), (7, [nan, 1.0]), (100, [inf, 1.0]), (150, []), (8, [1.0, 2.0, 3.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id bigint, embedding array<float>, h int")
    got = {}
    for r in ann.search(df).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    assert {q: [i for _, i in sorted(v)] for q, v in got.items()} == {0: [1, 2, 3, 50], 50: [3, 0, 1, 2]}
    assert ann.search(df.limit(0)).count() == 0


def test_neighbours_of_repeated_rows(spark):
    rows = [(50, [1.0, 0.0])] * 7 + [(51, [1.0, 0.0]), (52, [0.0, 1.0])] + [(100, [0.0, 1.0]), (100, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = {}
    for r in ann.search(df, k=2).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    # [-1, 0] asks for 100; the other row of 100 is a candidate like any, and ties with 52.
    assert {q: sorted(v) for q, v in got.items()} == {50: [(1, 51, 1.0), (2, 52, 0.0)], 100: [(1, 52, 0.0), (2, 100, 0.0)]}


def recall_of(got, want):
    hits = {}
    for r in got:
        hits[r.query_id] = hits.get(r.query_id, 0) + (r.vec_id in {j for j, _ in want[r.query_id]})
    return sum(hits.values()) / sum(map(len, want.values()))


def test_neighbours_of_clustered_vectors_need_few_parts(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 32))
    x = (centres[rng.integers(40, size=4000)] + 0.35 * rng.normal(size=(4000, 32))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    notes = {}
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    want = {}
    for i in range(0, 4000, 50):
        s = unit @ unit[i]
        s[i] = -2
        want[i] = [(int(j), s[j]) for j in np.argsort(-s)[:5]]
    got = ann.search(df, notes=notes, block=64).collect()  # blocks so small that parts and queries are cut
    vectors, parts, visit = notes[32]
    assert (vectors, parts) == (4000, 32) and visit <= parts / 4
    assert recall_of(got, want) >= 0.9 and len(got) == 5 * len(want)


def test_neighbours_are_never_too_few(spark):
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(120, 4)))], "vec_id bigint, embedding array<double>")
    notes = {}
    rows = ann.search(df, every=10, k=30, recall=0.01, notes=notes).collect()
    assert notes[4][1] > 1 and len(rows) == 12 * 30


def test_parts_are_balanced():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(900, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = ann.balanced_parts(x, ann.neighbour_graph(x, 10), 6)
    assert np.bincount(side).max() <= 166
