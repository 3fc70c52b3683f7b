"""Operators 1 to 6 and 10 against plain versions on small fixtures."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import plain
import pytest
from hypothesis import given, settings, strategies as st

from paperloom.llm import langid, license, mixing, packing, quality, simhash, simple8b
from paperloom.llm.tokens import PieceEncoder

public_tokenizers = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs_of(spark, texts, source=lambda i: f"s{i % 3}", lang=lambda i: "en"):
    return spark.createDataFrame([(i, t, lang(i), source(i), len(t or "")) for i, t in enumerate(texts)], SCHEMA)


BIG = (1 << 62) + 1
EDGES = [None, "", "   ", "one", "One two", "a b c", "a b c", "A B C", "x " * 3000, "été à Noël", "😀 emoji 😀", "tab\tand\x0bvertical\x1cunit", "don't can't we'll", "<|endoftext|> plain"]


# --- simhash


def plain_fingerprint(text):
    import xxhash

    words = WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(prints):
    ids = sorted(prints)
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_simhash_matches_all_pairs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = docs.collect() + [(10_000 + i, t) for i, t in enumerate(EDGES)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumnRenamed("x", "x")
    found = {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(docs).collect()}
    prints = {i: plain_fingerprint(t) for i, t in rows}
    assert {i: f for i, (f, _) in found.items()} == prints
    assert {i: c for i, (_, c) in found.items()} == plain_components(prints)


def test_simhash_chains_and_empty(spark):
    base = 0x0123456789ABCDEF
    prints, value = [], base
    for bit in range(0, 40, 2):  # a chain: each link is two bits away, the ends are far apart
        prints.append(value)
        value ^= 3 << bit
    rng = random.Random(1)
    prints += [rng.getrandbits(64) for _ in range(200)]
    signed = sorted({p - (1 << 64) if p >> 63 else p for p in prints})
    df = spark.createDataFrame([(p,) for p in signed], "fp bigint")
    found = {r.node: r.root for r in simhash.connected(simhash.linked_pairs(df)).collect()}
    unsigned = {p: p % (1 << 64) for p in signed}
    whole = plain_components(unsigned)
    groups = Counter(whole.values())
    linked = {p for p in signed if groups[whole[p]] > 1}
    assert set(found) | set(found.values()) == linked
    for p in linked:
        assert (found.get(p, p) == found.get(whole[p], whole[p]))
    empty = spark.createDataFrame([], SCHEMA)
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).columns == empty.columns


def test_trie_pairs_are_exact_and_prune():
    rng = np.random.default_rng(2)
    values = np.unique(rng.integers(0, 1 << 12, 600, dtype=np.uint64) << np.uint64(20))
    bounds = [0, 100, 101, len(values)]
    i, j = simhash.trie_pairs(values, bounds, 2)
    want = {(a, b) for lo, hi in zip(bounds, bounds[1:]) for a in range(lo, hi) for b in range(a + 1, hi) if int(values[a] ^ values[b]).bit_count() <= 2}
    assert set(zip(i.tolist(), j.tolist())) == want


def test_keep_one_keeps_one_of_each_group(spark):
    docs = docs_of(spark, ["a b c d e f"] * 3 + ["quite another text here"] + [None, ""])
    kept = simhash.keep_one(docs.unionByName(docs))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 3, 4] and kept.columns == docs.columns


# --- mixing


plain_targets = plain.targets


@pytest.mark.parametrize("case", ["sf", "edges", "hot"])
def test_mixing_reaches_targets(spark, case):
    if case == "sf":
        docs = spark.read.parquet(f"{SF}/documents.parquet")
    elif case == "edges":
        docs = docs_of(spark, EDGES * 3, source=lambda i: (None, "b", "a", "é")[i % 4])
    else:
        docs = docs_of(spark, ["w " * (1 + i % 7) for i in range(900)], source=lambda i: "hot" if i % 3 else f"s{i % 5}")
    out = mixing.mix(docs).collect()
    assert len(out) == docs.count()
    size, taken, target = Counter(), Counter(), {}
    for r in out:
        assert 0 <= r.taken <= 2 * r['size'] and r.taken == r.copies * r['size']
        size[r.source] += r['size']
        taken[r.source] += r.taken
        target[r.source] = r.target
    words = {r.doc_id: len(WORD.findall(r.text or "")) for r in docs.collect()}
    assert all(r["size"] == words[r.doc_id] and r.source_size == size[r.source] for r in out)
    want = plain_targets(size)
    for s in target:
        assert target[s] == pytest.approx(want[s], rel=1e-9, abs=1e-9)
        own = [r['size'] for r in out if r.source == s and r['size']] or [0]
        coarse = max(own) / 2 if case == "edges" else min(own)
        assert abs(taken[s] - target[s]) <= max(coarse, 0.02 * target[s]), s
    again = {(r.doc_id, r.taken) for r in mixing.mix(docs).collect()}
    assert again == {(r.doc_id, r.taken) for r in out}


def test_apply_mix_repeats_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    copies = {r.doc_id: r.copies for r in mixing.mix(docs).collect()}
    got = Counter(r.doc_id for r in mixing.apply_mix(docs).select("doc_id").collect())
    assert got == Counter({i: c for i, c in copies.items() if c})
    assert mixing.apply_mix(docs).columns == docs.columns
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.apply_mix(docs.limit(0)).count() == 0


def test_mixing_is_native(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = mixing.mix(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# --- licences


def plain_scan(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    places = [(i, label) for phrase, label in license.BASE_PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    return len(words), len(places), min(places)[0] if places else None, max(places)[0] if places else None, ",".join(sorted({p[1] for p in places}))


def test_license_base_matches_brute_force(spark):
    texts = EDGES + ["CC BY cc by cc-by", "GNU General Public\nLicense; all rights reserved. All Rights Reserved", "cc bye accc by", "ÀCC BY", "cc　by", "by cc"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect() + [(10**6 + i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    found = {r.doc_id: r for r in license.licenses(df).collect()}
    assert len(found) == len(docs)
    for i, t in docs:
        r = found[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain_scan(t)
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))


@pytest.mark.parametrize("text, names, level", [
    ("MIT", ["mit"], 0), ("MIT OR GPL-3.0-only", ["mit", "gpl-3.0-only"], 0), ("MIT AND GPL-3.0-only", ["mit", "gpl-3.0-only"], 2),
    ("GPL-2.0-only WITH Classpath-exception-2.0", ["gpl-2.0-only"], 1), ("(MIT OR GPL-2.0) AND LGPL-2.1", ["mit", "gpl-2.0", "lgpl-2.1"], 1),
    ("MIT OR GPL-2.0 AND AGPL-3.0", ["gpl-2.0", "agpl-3.0", "mit"], 0), ("Apache-2.0 */ int main", ["apache-2.0"], 0),
])
def test_license_expressions(text, names, level):
    found = license.evaluate(text)
    assert sorted(found[0]) == sorted(names) and found[1] == level


@pytest.mark.parametrize("text", ["", "AND MIT", "MIT OR", "(MIT", "()", "WITH"])
def test_license_bad_expressions(text):
    with pytest.raises(license.ExpressionError):
        license.evaluate(text)
    row = license.scan(f"SPDX-License-Identifier: {text}\n".encode())
    assert row[-2:] == (1, 1)


def test_tags_count_where_they_are_spelled():
    tag = "SPDX-License-Identifier: MIT"
    assert license.scan(tag.encode())[8:] == (1, 0) and license.scan(f"x {tag}\n// spdx-license-identifier:Apache-2.0".encode())[8:] == (2, 0)
    # Neither counts, whatever other tags a text has.
    for other in ("xSPDX-License-Identifier: GPL-2.0", "SPDX License Identifier: GPL-2.0", "SPDX-License-Identifier GPL-2.0"):
        assert license.scan(other.encode())[8:] == (0, 0)
        assert license.scan(f"é {other}\n{tag}".encode())[5] == "mit"


def test_license_tags_without_number():
    lines = [f"{'é ' * (n % 3)}SPDX-License-Identifier: {('MIT', 'GPL-2.0-only OR', 'Apache-2.0')[n % 3]}\ncc by of it" for n in range(30_000)]
    row = license.scan("\n".join(lines).encode())
    assert row[8:] == (30_000, 10_000) and row[1] == 30_000 and {"mit", "apache-2.0", "cc-by"} <= set(row[5].split(","))


# --- quality


def plain_quality(text):
    text = text or ""
    words = WORD.findall(text)
    grams = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i, g in enumerate(zip(words, words[1:], words[2:])) if grams[g] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_quality_metrics_match_brute_force(spark):
    docs = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + EDGES + ["a b c a b c a b c", "x\nx\n\n \nx ", "é\r\né\r\n"]
    for t in docs:
        m = quality.measure(t)
        assert m[:5] == plain_quality(t)
        assert m[6:] == (sum(map(str.isupper, t or "")), sum(map(str.isalpha, t or "")))


def test_quality_cutoffs_hold_their_risk(spark):
    good = ["word%d " % (i % 97) + " ".join(f"w{i}x{k}" for k in range(60)) for i in range(800)]
    bad = [" ".join(f"w{i}x{k}###" for k in range(60)) for i in range(100)]
    docs = docs_of(spark, good + bad)
    labels = spark.createDataFrame([(i, int(i < 800), 0) for i in range(900)], "doc_id bigint, quality int, toxic int")
    kept = {r.doc_id: r.kept for r in quality.judge(docs, labels).collect()}
    assert sum(not kept[i] for i in range(800)) <= 16 and not any(kept[i] for i in range(800, 900))
    rows = {r.doc_id for r in quality.keep_good(docs, labels).collect()}
    assert rows == {i for i, k in kept.items() if k}
    few = quality.judge(docs, labels.limit(5))  # too few labels prove nothing
    assert all(r.kept == (not r.base_failed) for r in few.collect())
    assert quality.judge(docs.limit(0), labels).count() == 0


def test_quality_verdicts_are_those_of_a_plain_version(spark):
    rng = random.Random(8)
    docs, labels = [], []
    for i in range(2600):
        words = [f"w{rng.randrange(10**6)}" for _ in range(60)]
        junk = rng.random() < 0.25
        for at in rng.sample(range(60), rng.randrange(60) if junk else rng.random() < 0.01):
            words[at] = rng.choice(["###", "LOUD" + words[at].upper(), "same same same"])
        docs.append((i, " ".join(words), ("en", "de", None, "", "rare")[i % 5]))
        labels.append((i, int(not junk)))
    df = spark.createDataFrame([(i, t, s, "x", 0) for i, t, s in docs], SCHEMA)
    told = spark.createDataFrame(labels + [(0, 0), (None, 1), (10**7, 1)], "doc_id bigint, quality int")
    rules = plain.quality_cutoffs(docs, dict(labels) | {0: 0})
    assert len(rules) == 5 and all(rules.values())
    found = {r.doc_id: r.kept for r in quality.judge(df, told).collect()}
    assert found == {i: plain.quality_kept(t, rules[s]) for i, t, s in docs}
    assert {r.doc_id for r in quality.keep_good(df, told).collect()} == {i for i, k in found.items() if k}


def test_more_strata_than_any_bound(spark):
    good = [" ".join(f"w{i}x{k}" for k in range(60)) for i in range(400)]
    docs = spark.createDataFrame([(i * 1000 + s, t, f"s{s}", "x", 0) for s in range(70) for i, t in enumerate(good)], SCHEMA)
    labels = docs.selectExpr("doc_id", "1 as quality")
    assert quality.cutoffs(quality.metrics(docs), labels, epsilon=0.03).count() == 70


def test_binomial_limit():
    assert quality.upper_limit(0, 100, 0.05) == pytest.approx(1 - 0.05 ** (1 / 100), rel=1e-6)
    assert quality.upper_limit(5, 5, 0.05) == 1.0
    assert 0.05 < quality.upper_limit(3, 100, 0.05) < 0.09
    for k, n, p in ((0, 300, 0.02), (7, 400, 0.02), (150, 300, 0.5), (299, 300, 0.9), (300, 300, 0.1)):
        assert quality.binomial_tail(k, n, p) == pytest.approx(plain.tail(k, n, p), rel=1e-9)


# --- token ids


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_pieces_equal_whole_texts(spark, name):
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    plain, quick = Tokenizer.from_file(path), PieceEncoder(path, cache_size=50)
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(120).collect()] + EDGES[1:]
    texts += ["a  b   c\n\n d \n", " lead", "trail ", "x́y é ́z", "ΣΑΣ İI", "a b c", "it's 'the 're\n't", "1,234 5th ½ ²", "ÀÉÎ.Über-straße;ñ", "a\x85b", "漢字 かな", "É≠b"]
    for t in texts:
        assert np.frombuffer(quick.encode(t), "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids, t[:80]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab'sRÉñ .,!?\n\t́ -1é", max_size=40))
def test_pieces_equal_whole_random(text):
    from tokenizers import Tokenizer

    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        plain, quick = _held(name, Tokenizer)
        assert np.frombuffer(quick.encode(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


_tok = {}


def _held(name, kind):
    if name not in _tok:
        path = public_tokenizers.path(name)
        _tok[name] = kind.from_file(path), PieceEncoder(path)
    return _tok[name]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60000), st.integers(0, 2**64 - 1)), max_size=300))
def test_simple8b_round_trip(values):
    words, escaped = simple8b.encode_block(np.array(values, np.uint64))
    assert simple8b.decode_block(words, len(values), escaped).tolist() == values


def test_simple8b_density_and_damage():
    words, _ = simple8b.encode_block(np.full(600, 20000, np.uint64))
    assert len(words) == 150  # four of 15 bits in a word
    data = simple8b.pack_file([(5, np.arange(10, dtype="<u4").tobytes()), (7, b"")])
    names, starts, ids = simple8b.read_file(data)
    assert names == [5, 7] and starts.tolist() == [0, 10, 10] and ids.tolist() == list(range(10))
    for broken in (data[:-1], b"X" + data[1:], data[:10]):
        with pytest.raises(ValueError):
            simple8b.read_file(broken)


def test_ids_written_and_read(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + [(10_000 + i, t) for i, t in enumerate(EDGES)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    files = simple8b.write_ids(df, path, file_ids=5000)
    found = {r.doc_id: r for r in simple8b.read_ids(files).collect()}
    start = 0
    for i, t in sorted(rows, key=lambda r: r[0]):
        ids = np.array(plain.encode(t or "", add_special_tokens=False).ids + [1], "<u4").tobytes()
        assert (found[i].start, found[i].n_tokens, bytes(found[i].ids)) == (start, len(ids) // 4, ids)
        start += len(ids) // 4
    assert simple8b.read_ids(simple8b.write_ids(df.limit(0), path)).count() == 0


def test_documents_without_an_id(spark):
    rows = [(None, "one two three"), (None, None), (None, "one two three"), (BIG, "four five six"), (-3, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)
    ids = [i for i, _ in rows]
    order = lambda found: sorted(found, key=lambda i: (i is not None, i or 0))
    words, pieces = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
    read = simple8b.read_ids(simple8b.write_ids(docs, words)).orderBy("start").collect()
    assert [r.doc_id for r in read] == order(ids) and sum(r.n_tokens for r in read[:3]) == read[3].start
    assert order(r.doc_id for r in packing.pack(docs, pieces).collect()) == order(ids)
    groups = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert groups == {(None, None), (None, -3), (BIG, BIG), (-3, -3)}
    assert order(r.doc_id for r in mixing.mix(docs).collect()) == order(ids)
    assert order(r.doc_id for r in license.licenses(docs).collect()) == order(ids)
    labels = spark.createDataFrame([(None, 1), (BIG, None)], "doc_id bigint, quality int")
    assert order(r.doc_id for r in quality.judge(docs, labels).collect()) == order(ids)
    assert order(r.doc_id for r in langid.predict(docs, langid.fit(docs)).collect()) == order(ids)


# --- packing


def plain_first_fit(lengths, capacity):
    bins, out = [], [None] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        b = next((b for b, used in enumerate(bins) if used + lengths[i] <= capacity), len(bins))
        if b == len(bins):
            bins.append(0)
        out[i] = (b, bins[b])
        bins[b] += lengths[i]
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=80))
def test_tournament_is_first_fit(lengths):
    assert packing.first_fit_decreasing(lengths, 64) == plain_first_fit(lengths, 64)


def test_packing_holds_every_id_once(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + [(10_000 + i, t) for i, t in enumerate(EDGES)]
    pieces = packing.pack(spark.createDataFrame(rows, "doc_id bigint, text string"), path, group_size=64).collect()
    by_doc, by_seq = {}, {}
    for p in pieces:
        assert len(p.ids) == 4 * p.length and 1 <= p.length <= 1024
        by_doc.setdefault(p.doc_id, []).append((p.start, p.length, bytes(p.ids)))
        by_seq.setdefault(p.sequence_id, []).append((p.offset, p.length, bytes(p.ids)))
    for i, t in rows:
        want = np.array(plain.encode(t or "", add_special_tokens=False).ids + [0], "<u4").tobytes()
        assert packing.sequences(by_doc[i]) == want
    stored = 0
    for seq in by_seq.values():
        used = len(packing.sequences(seq)) // 4
        assert used <= 1024
        stored += packing.padded(used, 1024)
    total = sum(p.length for p in pieces)
    assert stored <= 1.05 * total
    assert zlib.crc32(bytes(pieces[0].ids)) == packing.digest(spark.createDataFrame([(bytes(pieces[0].ids),)], "ids binary")).first().ids_crc32


def test_packing_empty(spark):
    assert packing.pack(spark.createDataFrame([], SCHEMA), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


# --- languages


def test_languages_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs.where(~langid.held_out()))
    told = langid.predict(docs.select("doc_id", "text"), model).withColumn("out", langid.held_out())
    rows = told.join(docs.select("doc_id", "lang"), "doc_id").where("out and lang is not null").collect()
    right = sum(r.lang == r.lang_pred for r in rows)
    assert right >= 0.95 * len(rows) and all(0 <= r.score <= 1 for r in rows)
    assert sum(r.rejected for r in rows) <= 0.01 * len(rows)
    kept = langid.predict(docs, model, keep=True)
    assert kept.columns == docs.columns


def test_languages_edges(spark):
    docs = docs_of(spark, EDGES + ["123 !!", "la la la", "Straße und Haus"], lang=lambda i: [None, "x", "y"][i % 3])
    model = langid.fit(docs)
    found = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    for i, t in enumerate(EDGES + ["123 !!"]):
        assert (found[i].lang_pred == "und") == (not any(map(str.isalpha, t or "")))
    none = langid.fit(docs.where("false"))
    assert {r.lang_pred for r in langid.predict(docs, none).collect()} == {"und"}
    assert langid.predict(docs.limit(0), model).count() == 0


@pytest.mark.parametrize("per_language", [1, 37, 100_000])
def test_languages_training_rows_are_those_of_smallest_hash(spark, per_language):
    from pyspark.sql import functions as F

    docs = docs_of(spark, [None if i % 11 == 0 else f"text {i}" for i in range(4000)], lang=lambda i: None if i % 13 == 0 else "abcd"[min(3, i % 7)])
    found = sorted(tuple(r) for r in langid.training_rows(docs, per_language).collect())
    groups = {}
    for r in docs.where("lang is not null and text is not null").select("lang", F.xxhash64("doc_id").alias("h"), "doc_id", "text").collect():
        groups.setdefault(r.lang, []).append((r.h, r.doc_id, r.text))
    assert found == sorted((g, t) for g in groups for _, _, t in sorted(groups[g])[:per_language])


def test_languages_beyond_any_bound_are_learned(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    lang = lambda i: f"l{i % 130:03}"
    text = lambda i: " ".join((letters[i % 130 % 26] + letters[(i % 130 * 7 + 3) % 26] * 2) * (1 + i % 3) for _ in range(20 + i % 5))
    docs = docs_of(spark, [text(i) for i in range(1300)], lang=lang)
    model = langid.fit(docs)
    assert model.languages == [f"l{i:03}" for i in range(130)]
    right = sum(r.lang_pred == lang(r.doc_id) for r in langid.predict(docs, model).collect())
    assert right > 1250


def test_predictions_are_those_of_a_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs.where(~langid.held_out()))
    rows = docs.select("doc_id", "text").limit(60).collect() + [(10_000 + i, t) for i, t in enumerate(EDGES)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumnRenamed("x", "x")
    found = {r.doc_id: r for r in langid.predict(df, model).collect()}
    for i, t in rows:
        lang, score, rejected = plain.language(t, model)
        assert (found[i].lang_pred, found[i].rejected) == (lang, rejected) and found[i].score == pytest.approx(min(1, max(0, score)), abs=1e-5)


def test_nothing_is_held_out_without_an_id(spark):
    docs = spark.createDataFrame([(None,), (1,), (4,)], "doc_id bigint").withColumn("h", langid.held_out())
    assert {r.doc_id: r.h for r in docs.collect()} == {None: False, 1: zlib.crc32(b"1") % 3 == 1, 4: zlib.crc32(b"4") % 3 == 1}
