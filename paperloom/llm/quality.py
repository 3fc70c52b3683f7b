"""Quality rules whose cutoffs are chosen with risk control.

A rule rejects a document whose metric exceeds a cutoff.  Cutoffs come from labelled documents.
Per stratum there are five chains of ever stricter cutoffs, one of all rules and one without each
rule; they are fixed beforehand, so all labelled documents are a holdout.  A chain is walked while
the joint false rejection of good documents (quality 1) by its rules is shown, by the exact
binomial bound of Clopper and Pearson, to stay below ``epsilon``: a fixed sequence of tests, which
needs no correction inside.  Every test is made at ``delta`` divided by the number of strata that
have labels and by the number of chains (Bonferroni), so all strata hold together with probability
1 - delta, whichever of its proven points a stratum takes; it takes the one that rejects most of its
bad documents.  A stratum with too few labels (under about 300 at the defaults and four strata) gets
no rule: nothing is rejected unproven.  There is no bound on the number of strata.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, functions as F

from .shared import fresh_names, let_go, materialise, slices

SYMBOLS = b"#*$%&|<>"
UPPER, LETTERS = (bytes(i for i in range(256) if f(chr(i))) for f in (str.isupper, str.isalpha))
#: rule: its cutoffs from lenient to strict
GRID = {
    "symbol_ratio": (0.5, 0.3, 0.2, 0.1, 0.05, 0.02),
    "upper_ratio": (0.9, 0.75, 0.6, 0.5, 0.4, 0.3),
    "dup_line_ratio": (0.9, 0.75, 0.6, 0.5, 0.4, 0.3),
    "repeat_ratio": (0.45, 0.4, 0.35, 0.3, 0.25, 0.2),
}
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_lines", "n_upper", "n_letters")
METRICS = BASE + MORE
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50


def measure(text: str | None) -> tuple[int, ...]:
    """METRICS of a whole text; null counts as no text."""
    import numpy as np

    if not text:
        return (0,) * len(METRICS)
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    body = b"".join(words)
    chars = len(body) - len(body.translate(None, bytes(range(0x80, 0xC0)))) if not text.isascii() else 0
    lines = [x for x in raw.split(b"\n") if x.strip()]
    repeated = 0
    if n > 3:
        ids: dict[bytes, int] = {}
        numbers = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
        k = len(ids)
        pair = np.unique(numbers[:-1] * k + numbers[1:], return_inverse=True)[1]
        _, which, count = np.unique(pair[:-1] * k + numbers[2:], return_inverse=True, return_counts=True)
        again = count[which] > 1
        covered = np.zeros(n, bool)
        for step in range(3):
            covered[step : step + len(again)] |= again
        repeated = int(covered.sum())
    try:
        flat = text.encode("latin-1")
        upper, letters = (len(flat) - len(flat.translate(None, x)) for x in (UPPER, LETTERS))
    except UnicodeEncodeError:
        upper, letters = sum(map(str.isupper, text)), sum(map(str.isalpha, text))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    return n, len(body) - chars, symbols, len(lines) - len(set(lines)), repeated, len(lines), upper, letters


def metrics(docs: DataFrame, stratum: str = "lang") -> DataFrame:
    """(doc_id, stratum, METRICS...), one row per row of ``docs``; each text is read once, whole."""
    import pyarrow as pa

    slim = docs.select("doc_id", F.col(stratum).alias("stratum"), "text")

    def run(batches):
        let_go()
        for batch in slices(batches):
            found = list(zip(*map(measure, batch.column("text").to_pylist()))) or [()] * len(METRICS)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("stratum"), *(pa.array(c, pa.int64()) for c in found)], names=["doc_id", "stratum", *METRICS])

    head = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in slim.schema if f.name != "text")
    return slim.mapInArrow(run, head + "".join(f", {m} bigint" for m in METRICS))


def _ratio_columns(of: str = ""):
    share = lambda a, b: F.when(F.col(of + b) > 0, F.col(of + a) / F.col(of + b)).otherwise(0.0)
    return dict(zip(GRID, (share("n_symbols", "word_chars"), share("n_upper", "n_letters"), share("n_dup_lines", "n_lines"), share("n_repeat_words", "n_words"))))


def _base_column(of: str = ""):
    return (F.col(of + "n_words") < MIN_WORDS) | (100 * F.col(of + "n_repeat_words") > MAX_REPEAT_PERCENT * F.col(of + "n_words"))


def binomial_tail(k: int, n: int, p: float) -> float:
    """The probability of ``k`` or fewer among ``n`` at rate ``p``, by the regularised incomplete beta function.

    The continued fraction (modified Lentz) takes about sqrt(n) steps.
    """
    if k >= n or p <= 0:
        return 1.0
    if k < 0 or p >= 1:
        return 0.0
    a, b, x = n - k, k + 1, 1 - p
    mirrored = x > (a + 1) / (a + b + 2)
    if mirrored:
        a, b, x = b, a, p
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c = 1e-300, 1.0
    d = 1 / ((1 - (a + b) * x / (a + 1)) or tiny)
    value, m = d, 1
    while True:
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + top * d) or tiny)
            c = (1 + top / c) or tiny
            value *= c * d
        if abs(c * d - 1) < 1e-13:
            break
        m += 1
    share = front * value
    return 1 - share if mirrored else share


def upper_limit(k: int, n: int, alpha: float) -> float:
    """Clopper-Pearson: the rate p at which k or fewer of n happen with probability alpha."""
    if k >= n:
        return 1.0
    lo, hi = k / n, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if binomial_tail(k, n, mid) > alpha else (lo, mid)
    return hi


def chains() -> list[list[tuple[int, ...]]]:
    """Sequences of cutoff numbers per rule (0: none), each point at least as strict as the one before."""
    sizes, out = [len(g) for g in GRID.values()], []
    for left_out in (None, *range(len(sizes))):
        now, chain = [0] * len(sizes), []
        for level in range(1, max(sizes) + 1):
            for rule, size in enumerate(sizes):
                if rule != left_out and level <= size:
                    now[rule] = level
                    chain.append(tuple(now))
        out.append(chain)
    return out


def certify(good: dict[tuple[int, ...], int], bad: dict[tuple[int, ...], int], alpha: float, epsilon: float) -> tuple[int, ...]:
    """Cutoffs per rule (how many of its grid hold; 0: none), for good and bad documents counted by level.

    A document's level in a rule is the number of lenient-to-strict cutoffs that would not reject
    it; cutoff c (from 1) rejects it if level < c.  A limit stays below ``epsilon`` if and only if
    so few rejections are improbable (at most ``alpha``) at that rate.
    """
    n, best = sum(good.values()), (0, 0, (0,) * len(GRID))
    hit = lambda counts, point: sum(m for lv, m in counts.items() if any(x < c for x, c in zip(lv, point)))
    for chain in chains():
        for point in chain:
            if not n or binomial_tail(hit(good, point), n, epsilon) > alpha:
                break
            best = max(best, (hit(bad, point), sum(point), point))
    return best[2]


def _stratum_key(column):
    """A stratum's name, null and the empty text apart."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit("null"))


def cutoffs(measured: DataFrame, labels: DataFrame, epsilon: float = 0.02, delta: float = 0.05) -> DataFrame:
    """(key, one column per rule): the certified cutoffs of each stratum that has any, null where a rule has none.

    From ``labels`` (doc_id, quality) and the metrics of their documents.  Counts by (stratum,
    levels), at most 7 ** 4 for each quality of a stratum, meet in a task for each stratum.  The
    result has fewer rows than a two-hundredth of the labels.
    """
    told = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    levels = [sum(((r <= g).cast("int") for g in GRID[rule]), F.lit(0)).alias(rule) for rule, r in _ratio_columns().items()]
    passed = measured.where(~_base_column()).select("doc_id", _stratum_key(F.col("stratum")).alias("key"), *levels)
    counts = materialise(passed.join(told, "doc_id").groupBy("key", "quality", *GRID).count(), "quality-counts")
    strata = counts.where("quality = 1").select("key").distinct().count()
    alpha = delta / max(1, strata) / len(chains())

    def choose(table):
        import pyarrow as pa

        parts = {0: {}, 1: {}}
        for q, m, *lv in zip(*(table[c].to_pylist() for c in ("quality", "count", *GRID))):
            parts[q][tuple(lv)] = m
        found = certify(parts[1], parts[0], alpha, epsilon)
        row = {"key": table["key"][0].as_py()} | {rule: grid[c - 1] if c else None for (rule, grid), c in zip(GRID.items(), found)}
        return pa.Table.from_pylist([row] if any(found) else [], pa.schema([("key", pa.string()), *((r, pa.float64()) for r in GRID)]))

    return materialise(counts.groupBy("key").applyInArrow(choose, "key string" + "".join(f", {r} double" for r in GRID)), "quality-cutoffs")


def verdict(measured: DataFrame, chosen: DataFrame) -> DataFrame:
    """``measured`` plus base_failed and kept."""
    held = chosen.select("key", *(F.col(r).alias(f"cut_{r}") for r in GRID))
    joined = measured.withColumn("key", _stratum_key(F.col("stratum"))).join(held, "key", "left")
    bad = reduce(or_, (F.coalesce(ratio > F.col(f"cut_{rule}"), F.lit(False)) for rule, ratio in _ratio_columns().items()))
    return joined.select(*measured.columns, _base_column().alias("base_failed"), (~_base_column() & ~bad).alias("kept"))


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", epsilon: float = 0.02, delta: float = 0.05) -> DataFrame:
    """One row per row of ``docs``: doc_id, METRICS, base_failed and kept.

    No labels, or an empty table, leave the base rules alone in force.  A document labelled both
    ways counts as bad; null and the empty text are strata of their own; other columns aren't read.
    """
    measured = materialise(metrics(docs, stratum), "quality-metrics")
    return verdict(measured, cutoffs(measured, labels, epsilon, delta)).drop("stratum")


def keep_good(docs: DataFrame, labels: DataFrame, stratum: str = "lang", epsilon: float = 0.02, delta: float = 0.05) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns, whatever they are called.

    Each text is measured once: the rows are written with their metrics beside them and filtered
    when the cutoffs are known, so no text is shuffled.  Repeated ids are judged row by row.
    """
    import pyarrow as pa

    (name,) = fresh_names(docs, "_measured")
    at = docs.columns.index("text")

    def run(batches):
        let_go()
        for batch in slices(batches):
            found = list(zip(*map(measure, batch.column(at).to_pylist()))) or [()] * len(METRICS)
            made = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in found], METRICS)
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, name])

    from pyspark.sql.types import LongType, StructField, StructType

    schema = StructType([*docs.schema.fields, StructField(name, StructType([StructField(m, LongType()) for m in METRICS]))])
    rows = materialise(docs.mapInArrow(run, schema), "quality-rows")
    measured = rows.select("doc_id", F.col(stratum).alias("stratum"), *(F.col(f"{name}.{m}").alias(m) for m in METRICS))
    chosen = cutoffs(measured, labels, epsilon, delta)
    # The cutoffs have no more rows than a two-hundredth of the labels; Spark broadcasts them if they are few.
    key, *cuts = fresh_names(rows, "_key", *(f"_{rule}" for rule in GRID))
    held = chosen.select(F.col("key").alias(key), *(F.col(rule).alias(c) for rule, c in zip(GRID, cuts)))
    bad = reduce(or_, (F.coalesce(ratio > F.col(c), F.lit(False)) for c, ratio in zip(cuts, _ratio_columns(f"{name}.").values())))
    joined = rows.join(held, _stratum_key(rows[stratum]) == held[key], "left")
    return joined.where(~_base_column(f"{name}.") & ~bad).drop(name, key, *cuts)
