"""Importance resampling: the documents that look most like a target, drawn without replacement.

Features are runs of one to three words, hashed into buckets.  The first Arrow pass counts the buckets
of each partition with ``np.bincount`` into one vector, and ``treeReduce`` adds the vectors up; the gain
of a bucket is the log ratio of its smoothed shares in target and corpus.  The second pass gathers the
broadcast gains of a document's features and sums them with bincount's weights.  Gumbel noise that
depends only on seed and id turns a ranking by score into a draw by weight, the same at each run.

What goes through the driver is one vector of counts and one of gains, ``buckets`` long whatever the
corpus, and a row count for each file of the ranked table.  A null or empty text has no words; a null id
counts as the empty string in the noise and comes last among ties; repeated rows each take part.
"""

from __future__ import annotations

import hashlib
import math
from itertools import chain
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .shared import at_places, materialise, numbered, slices

#: Byte by byte: digits, letters in lower case and all of non-ASCII characters stay, the rest parts words.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: bytes | None) -> list[bytes]:
    return text.translate(_WORD_BYTES).split() if text else []


def hashed(documents: list[list[bytes]], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of every run of one to three words, repeats included.

    The checksum of a run continues that of the run without its last word.
    """
    sizes = np.array([len(d) for d in documents], np.int64)
    every, total = list(chain.from_iterable(documents)), int(sizes.sum())
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(total)  # words from here to the document's end
    of = np.repeat(np.arange(len(sizes)), sizes)
    later = [b" " + w for w in every]
    sums, docs, found = [crc32(w) for w in every], [], []
    for n in (1, 2, 3):
        if n > 1:
            sums = list(map(crc32, later[n - 1 :], sums))
        whole = left[: len(sums)] >= n
        docs.append(of[: len(sums)][whole])
        found.append((np.array(sums, np.int64)[whole]) % buckets)
    return np.concatenate(docs), np.concatenate(found)


def bucket_counts(docs: DataFrame, buckets: int = 10_000, text_col: str = "text") -> np.ndarray:
    """How many features of all texts fall in each bucket."""

    def count(batches):
        import pyarrow as pa

        out = np.zeros(buckets, np.int64)
        for batch in slices(batches, 256):
            out += np.bincount(hashed([words(t) for t in batch.column(0).to_pylist()], buckets)[1], minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["counts"])

    vectors = docs.select(F.col(text_col).cast("binary").alias("text")).mapInArrow(count, "counts binary")
    arrays = vectors.rdd.map(lambda row: np.frombuffer(row[0], np.int64))
    if not arrays.getNumPartitions():
        return np.zeros(buckets, np.int64)
    return arrays.treeReduce(np.add, depth=3)


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of each bucket's smoothed share in the target to that in the corpus, rounded down."""
    every, wanted, buckets = int(corpus.sum()), int(target.sum()), len(corpus)
    ratio = lambda s, t: float((t + 1) * (every + buckets)) / float((s + 1) * (wanted + buckets))
    return np.array([math.floor(1000 * math.log(ratio(s, t))) for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def noise(name: str, seed: int) -> int:
    """Thousandths of a Gumbel variate, rounded down, that only seed and name decide."""
    h = int(hashlib.sha256(f"{seed}:{name}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(docs: DataFrame, gain: np.ndarray, seed: int = 42, text_col: str = "text", id_col: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, n_words, n_features, weight, score and the columns of ``keep``) of every row."""
    import pyarrow as pa

    told = docs.sparkSession.sparkContext.broadcast(gain)
    slim = docs.select(F.col(text_col).cast("binary").alias("text"), F.col(id_col).cast("string").alias("name"), F.col(id_col).alias("id"), *(F.col(c).alias(f"keep{i}") for i, c in enumerate(keep)))

    def judge(batches):
        for batch in slices(batches, 256):
            held = [words(t) for t in batch.column(0).to_pylist()]
            of, bucket = hashed(held, len(told.value))
            weight = np.bincount(of, weights=told.value[bucket], minlength=len(held)).astype(np.int64)  # sums of whole numbers, exact
            score = weight + np.array([noise(n or "", seed) for n in batch.column(1).to_pylist()], np.int64)
            columns = [pa.array([len(d) for d in held], pa.int64()), *(pa.array(c, pa.int64()) for c in (np.bincount(of, minlength=len(held)), weight, score))]
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], *columns], names=[*batch.schema.names[2:], "n_words", "n_features", "weight", "score"])

    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in slim.schema.fields[2:]]
    out = slim.mapInArrow(judge, ", ".join([*kinds, "n_words bigint, n_features bigint, weight bigint, score bigint"]))
    return out.select(F.col("id").alias(id_col), "n_words", "n_features", "weight", "score", *(F.col(f"keep{i}").alias(c) for i, c in enumerate(keep)))


def rank(weighed: DataFrame, percent: int = 5, min_words: int = 20, id_col: str = "doc_id") -> DataFrame:
    """``weighed`` and rank: 1, 2, 3... by score, then smaller id, of the drawn; null for all others.

    Of the rows with ``min_words`` or more, ``percent`` in a hundred are drawn, rounded down.  The rows
    are dealt by ranges of the order and written sorted; a row's rank is its place in its file and the
    rows of the files before, so no task sees more than its range.
    """
    weighed, file, at = numbered(materialise(weighed, "importance-weighed"))
    fits = F.col("n_words") >= min_words
    order = [F.col("fits").desc(), F.col("score").desc(), F.asc_nulls_last(id_col), F.col(file), F.col(at)]
    dealt = weighed.withColumn("fits", fits).repartitionByRange(*order).sortWithinPartitions(*order)
    part = F.spark_partition_id().alias("part")
    ranked = materialise(dealt.select(*weighed.columns[:-2], "fits", part), "importance-ranked")
    ranked, file, at = numbered(ranked)
    held = sorted((r["part"], r[file], r["n"], r["q"]) for r in ranked.groupBy("part", file).agg(F.count("*").alias("n"), F.count_if("fits").alias("q")).collect())
    drawn = percent * sum(q for *_, q in held) // 100
    before, ahead = [], 0
    for _, name, n, _ in held:
        before.append((name, ahead))
        ahead += n
    offsets = F.broadcast(weighed.sparkSession.createDataFrame(before, "named long, ahead long"))
    place = F.col("ahead") + F.col(at) + 1
    joined = ranked.join(offsets, ranked[file] == offsets["named"], "left")
    return joined.select(*weighed.columns[:-2], F.when(place <= drawn, place).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, min_words: int = 20, buckets: int = 10_000, seed: int = 42, text_col: str = "text", id_col: str = "doc_id", target_col: str = "text") -> DataFrame:
    """(id, n_words, n_features, weight, score, rank) of every row of ``docs``; other columns aren't read, whatever their names."""
    gain = gains(bucket_counts(docs, buckets, text_col), bucket_counts(target, buckets, target_col))
    return rank(weigh(docs, gain, seed, text_col, id_col), percent, min_words, id_col)


def drawn(docs: DataFrame, target: DataFrame, percent: int = 5, min_words: int = 20, buckets: int = 10_000, seed: int = 42, text_col: str = "text", id_col: str = "doc_id", target_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are drawn, with all their columns as they are."""
    columns = docs.columns
    docs, file, at = numbered(docs, "importance-docs")
    gain = gains(bucket_counts(docs, buckets, text_col), bucket_counts(target, buckets, target_col))
    chosen = rank(weigh(docs, gain, seed, text_col, id_col, (file, at)), percent, min_words, id_col).where("rank IS NOT NULL")
    return at_places(docs, chosen.select(file, at), file, at).select(*columns)
