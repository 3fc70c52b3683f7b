"""Language identification by the nearest of several TF-IDF centroids per language.

Texts become L2-normalised TF-IDF vectors of letter n-grams (1 to 3 letters, lower case, a blank
between words) hashed to ``dims`` slots.  Spherical k-means gives each language a few centroids;
the prediction is the language of the centroid with the largest cosine, which is the score.
A text is rejected when that cosine falls below the language's threshold, or when it has no
letter.  Every language is learned, from a bounded sample of ``per_language`` of its rows: those
with the smallest hash of their id.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from .shared import let_go, materialise, slices

UNKNOWN = "und"
_letters = None


def letter_table():
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def ngram_counts(text: str, dims: int):
    """(slots, counts) of a text's n-grams, or None if it has no letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    mask = letter_table()[points]
    if not mask.any():
        return None
    points = np.where(mask, points, 32).astype(np.uint64)
    points = np.concatenate(([np.uint64(32)], points, [np.uint64(32)]))
    points = points[np.concatenate(([True], (points[1:] != 32) | (points[:-1] != 32)))]  # one blank between words
    one = points[points != 32]
    two = points[:-1] * np.uint64(0x9E3779B1) + points[1:]
    three = two[:-1] * np.uint64(0x9E3779B1) + points[2:]
    total = np.zeros(dims, np.int64)
    for salt, grams in enumerate((one, two, three), 1):
        mixed = (grams + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
        total += np.bincount(((mixed >> np.uint64(40)) % np.uint64(dims)).astype(np.int64), minlength=dims)
    slots = np.flatnonzero(total)
    return slots, total[slots]


@dataclass
class Model:
    languages: list[str]
    owner: np.ndarray  # language index of each centroid
    centroids: np.ndarray  # (centroids, dims), unit length
    idf: np.ndarray
    floor: np.ndarray  # smallest cosine accepted, per language

    def vector(self, text: str):
        found = ngram_counts(text, len(self.idf))
        if found is None:
            return None
        slots, counts = found
        weights = (1 + np.log(counts)) * self.idf[slots]
        return slots, weights / np.linalg.norm(weights)

    def predict(self, text: str | None):
        """(language, cosine, rejected)."""
        v = self.vector(text) if text else None
        if v is None or not self.languages:
            return UNKNOWN, 0.0, True
        cosines = self.centroids[:, v[0]] @ v[1]
        best = int(np.argmax(cosines))
        score = float(min(1.0, max(0.0, cosines[best])))
        lang = int(self.owner[best])
        return self.languages[lang], score, score < self.floor[lang]


def _clusters(x, k: int, rounds: int, rng):
    """Unit centroids of unit rows, by spherical k-means from spread-out seeds."""
    seeds = [int(rng.integers(len(x)))]
    near = x @ x[seeds[0]]
    while len(seeds) < min(k, len(x)):
        seeds.append(int(np.argmin(near)))
        near = np.maximum(near, x @ x[seeds[-1]])
    centroids = x[seeds].copy()
    for _ in range(rounds):
        side = np.argmax(x @ centroids.T, axis=1)
        for c in range(len(centroids)):
            if (side == c).any():
                total = x[side == c].sum(0)
                centroids[c] = total / max(np.linalg.norm(total), 1e-12)
    return centroids


def training_rows(docs: DataFrame, per_language: int = 800) -> DataFrame:
    """(lang, text): at most ``per_language`` rows of each language, by smallest hash of the id, then of the text.

    The hash below which a language's rows lie is found without the texts.  Hashes are counted in
    steps of an eighth of a power of two (at most 520 a language), and the step in which the
    ``per_language``-th row falls ends the search, so a language's task ranks little more than the
    rows it gives, whatever the input's size.  The table of languages and last steps has one row for
    each language; rows beyond a language's last step leave before any text is moved.
    """
    step = F.floor(8 * F.log2(F.col("h").cast("double") + F.lit(2.0**63) + 1)).cast("int")  # never falls as h grows
    known = docs.where("lang is not null and text is not null").select("doc_id", "lang", "text", F.xxhash64("doc_id").alias("h")).withColumn("step", step)
    counts = known.groupBy("lang", "step").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("lang").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    cuts = counts.withColumn("below", F.coalesce(F.sum("n").over(earlier), F.lit(0))).where(F.col("below") < per_language)
    cuts = materialise(cuts.groupBy("lang").agg(F.max("step").alias("last")), "language-steps")
    near = known.join(cuts, "lang").where("step <= last")
    # Map tasks cut each language to its first rows before the shuffle, repeated ids included.
    first = Window.partitionBy("lang").orderBy("h", "doc_id", F.xxhash64("text"))
    return near.withColumn("r", F.row_number().over(first)).where(F.col("r") <= per_language).select("lang", "text")


MODEL = "lang string, centroids binary, floor double"


def fit(docs: DataFrame, per_language: int = 800, centroids: int = 4, dims: int = 4096, rounds: int = 12, slack: float = 0.5, seed: int = 7) -> Model:
    """The model of ``docs`` (doc_id, text, lang); without a labelled letter it predicts ``und`` for all.

    Every language is learned, each in a task of its own from its ``per_language`` rows; document
    frequencies are summed by slot before.  The driver holds the model alone: ``centroids`` times
    ``dims`` numbers of 4 bytes for each language.
    """
    import pyarrow as pa

    sample = training_rows(docs, per_language)

    def counted(batches):
        let_go()
        for batch in slices(batches):
            langs, slots, counts = [], [], []
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                found = ngram_counts(text, dims)
                if found is not None:
                    langs.append(lang)
                    slots.append(found[0].astype("<u4").tolist())
                    counts.append(found[1].astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(slots, pa.list_(pa.int32())), pa.array(counts, pa.binary())], names=["lang", "slots", "counts"])

    rows = materialise(sample.mapInArrow(counted, "lang string, slots array<int>, counts binary"), "language-counts")
    present, total = np.zeros(dims), rows.count()
    for slot, n in rows.select(F.explode("slots").alias("slot")).groupBy("slot").count().collect():
        present[slot] = n
    idf = np.log((1 + total) / (1 + present)) + 1

    def learn(table):
        slots, counts = table["slots"].to_pylist(), table["counts"].to_pylist()
        order = sorted(range(len(slots)), key=lambda i: (slots[i], counts[i]))  # whatever order the rows came in
        x = np.zeros((len(slots), dims), np.float32)
        for at, i in enumerate(order):
            x[at, slots[i]] = (1 + np.log(np.frombuffer(counts[i], "<i8"))) * idf[slots[i]]
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        found = _clusters(x, centroids, rounds, np.random.default_rng(seed))
        least = slack * float(np.min((x @ found.T).max(axis=1)))
        return pa.table({"lang": table["lang"][:1].cast(pa.string()), "centroids": pa.array([found.astype("<f4").tobytes()], pa.binary()), "floor": pa.array([least])})

    made = sorted(tuple(r) for r in rows.groupBy("lang").applyInArrow(learn, MODEL).collect())
    stacks = [np.frombuffer(c, "<f4").reshape(-1, dims) for _, c, _ in made]
    owner = np.repeat(np.arange(len(made)), [len(x) for x in stacks])
    stack = np.concatenate(stacks) if stacks else np.zeros((0, dims), np.float32)
    return Model([lang for lang, _, _ in made], owner.astype(np.int64), stack, idf, np.array([f for _, _, f in made]))


def predict(docs: DataFrame, model: Model, keep: bool = False) -> DataFrame:
    """The columns of ``docs`` but text, with lang_pred, score (0 to 1) and rejected, from text alone.

    Columns that already bear those three names give way.  A null text and one without a letter give ``und``, 0 and true.  With ``keep`` only the rows
    that are not rejected come back, without the three columns.
    """
    import pyarrow as pa

    shared = docs.sparkSession.sparkContext.broadcast(model)
    extra = ["lang_pred", "score", "rejected"]
    slim = docs if keep else docs.drop(*extra)
    names = slim.columns
    at = names.index("text")

    def run(batches):
        let_go()
        for batch in slices(batches):
            found = [shared.value.predict(t) for t in batch.column(at).to_pylist()]
            if keep:
                mask = pa.array([not f[2] for f in found], pa.bool_())
                yield batch.filter(mask)
            else:
                more = [pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
                rest = [(n, batch.column(i)) for i, n in enumerate(names) if i != at]
                yield pa.RecordBatch.from_arrays([c for _, c in rest] + more, names=[n for n, _ in rest] + extra)

    if keep:
        return docs.mapInArrow(run, docs.schema)
    from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

    kept = [f for f in slim.schema.fields if f.name != "text"]
    schema = StructType(kept + [StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("rejected", BooleanType())])
    return slim.mapInArrow(run, schema)


def held_out(column="doc_id"):
    """True for the third of the ids that no model may learn from; a null id is not of it."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 3 == 1, F.lit(False))
