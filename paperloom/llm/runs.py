"""Periodic runs of words: every maximal stretch that repeats with a period, in each document.

A run is (start, length, period) in words: period is the smallest of its stretch, the stretch holds
at least ``min_exponent`` periods and ``min_length`` words, and neither neighbour extends it.

The words of many documents stand in one array.  Prefix doubling gives its suffix array and a name
for every factor of 2^k words; the names give the LCP array and, later, the longest common extension
of two places in either direction.  Suffix array and LCP give the longest-previous-factor (LPF)
array and from it the Lempel-Ziv blocks.  A run that touches a block's edge is found there by Main's
extensions; one strictly inside a block is a copy of an earlier run, taken over from a bucket of runs
by start.  Both bounds of the runs wanted narrow the periods tried at an edge, without losing any.

A null or empty text has no words and no runs.  Repeated rows are judged each for itself.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import chain

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

#: Words of the documents that are indexed together; a longer document stands alone.
BATCH_WORDS = 1 << 17


def factor_names(symbols: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(suffix array, names): ``names[k][i] == names[k][j]`` if and only if the 2^k symbols from i and j are equal.

    Documents must not share symbols.  A round sorts only the suffixes that still share a name, and the
    last place of each array of names stands for the end of all.
    """
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    name, names, width = np.full(n + 1, -1, np.int64), [], 1
    places, keys = np.arange(n), symbols[order]
    while len(places):
        head = np.concatenate(([True], keys[1:] != keys[:-1]))
        sizes = np.diff(np.append(np.flatnonzero(head), len(keys)))
        name[order[places]] = np.repeat(places[head], sizes)
        places = places[np.repeat(sizes > 1, sizes)]
        if not len(places):
            break
        names.append(name.astype(np.int32))
        at = order[places]
        keys = name[at] * (n + 2) + name[np.minimum(at + width, n)] + 1
        by = np.argsort(keys)
        order[places], keys = at[by], keys[by]
        width *= 2
    return order, names


def common_after(names: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many symbols from ``i`` and ``j`` on are equal; places differ, and each is at most the end."""
    out = np.zeros(len(i), np.int64)
    for k in reversed(range(len(names))):
        out += (names[k][i + out] == names[k][j + out]).astype(np.int64) << k
    return out


def common_before(names: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many symbols right before ``i`` and ``j`` are equal."""
    out = np.zeros(len(i), np.int64)
    for k in reversed(range(len(names))):
        a, b = i - out - (1 << k), j - out - (1 << k)
        same = (a >= 0) & (b >= 0) & (names[k][np.maximum(a, 0)] == names[k][np.maximum(b, 0)])
        out += same.astype(np.int64) << k
    return out


def previous_factors(order: np.ndarray, lcp: np.ndarray) -> tuple[list[int], list[int]]:
    """(LPF, source): the longest factor from each place that also starts earlier, and where it does.

    ``lcp[r]`` is that of the suffixes r - 1 and r.  A stack holds suffixes of growing place, each with
    its LCP to the one below; the next suffix of a smaller place settles those above it.
    """
    length, source = [0] * len(order), [-1] * len(order)
    near = lcp > 0
    near[:-1] |= lcp[1:] > 0
    stack, below = [], []
    for at, shared in zip(chain(order[near].tolist(), [-1]), chain(lcp[near].tolist(), [0])):
        while stack and stack[-1] > at:
            top, under = stack.pop(), below.pop()
            if under >= shared:
                if under:
                    length[top], source[top] = under, stack[-1]
            else:
                length[top], source[top] = shared, at
                shared = under
        stack.append(at)
        below.append(shared)
    return length, source


def edges(length: list[int], starts: list[int], ends: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, words of the block before, words of the block after) of all block edges, ends of documents included."""
    at, before, after = [], [], []
    for low, high in zip(starts, ends):
        last = 0
        while low < high:
            size = length[low] or 1
            at.append(low)
            before.append(last)
            after.append(size)
            low, last = low + size, size
        at.append(high)
        before.append(last)
        after.append(0)
    return np.array(at, np.int64), np.array(before, np.int64), np.array(after, np.int64)


def edge_runs(names, at, before, after, first, min_length: int, min_exponent: int) -> list[tuple[int, int, int]]:
    """(start, end, period) of the runs that touch an edge.  ``first`` is the start of each edge's document.

    A run that ends in the block after an edge and touches the edge begins less than a period before
    the block before it, else that block would have been longer: so length - period < before + after.
    """
    room = before + after
    low = np.maximum(1, min_length - room + 1)
    high = (room - 1) // (min_exponent - 1)
    found = []
    for side in (0, 1):  # the period's other end lies after the edge, or before it
        top = np.minimum(high, at - first if side else after)
        many = np.maximum(0, top - low + 1)
        which = np.repeat(np.arange(len(at)), many)
        period = low[which] + np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
        here = at[which] - (period if side else 0)
        left, right = common_before(names, here, here + period), common_after(names, here, here + period)
        total = left + period + right
        good = (total >= min_length) & (total >= min_exponent * period)
        found.append(np.stack([here - left, here + period + right, period], 1)[good])
    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    fresh = np.ones(len(rows), bool)  # of a stretch's periods the smallest divides the others
    fresh[1:] = (rows[1:, :2] != rows[:-1, :2]).any(1)
    return rows[fresh].tolist()


def all_runs(documents: list[list], min_length: int = 2, min_exponent: int = 2) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of every run of each document, by start, then period.

    ``documents`` are lists of hashable words; ``min_exponent`` is a whole number from 2.
    """
    if min_exponent < 2:
        raise ValueError("a run holds two periods or more")
    sizes = np.array([len(d) for d in documents], np.int64)
    ends = np.cumsum(sizes)
    starts, total = ends - sizes, int(sizes.sum())
    out: list[list[tuple[int, int, int]]] = [[] for _ in documents]
    if not total:
        return out
    seen: dict = {}
    words = np.fromiter((seen.setdefault(w, len(seen)) for w in chain.from_iterable(documents)), np.int64, total)
    order, names = factor_names(np.repeat(np.arange(len(sizes)), sizes) * len(seen) + words)
    lcp = np.zeros(total, np.int64)
    if names:
        alike = np.flatnonzero(names[0][order[1:]] == names[0][order[:-1]]) + 1
        lcp[alike] = common_after(names, order[alike - 1], order[alike])
    length, source = previous_factors(order, lcp)
    at, before, after = edges(length, starts.tolist(), ends.tolist())
    closing = np.flatnonzero(after == 0)  # the edge at the end of each document
    doc_of = np.repeat(np.arange(len(sizes)), np.diff(closing, prepend=-1))
    buckets: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for start, end, period in edge_runs(names, at, before, after, starts[doc_of], min_length, min_exponent):
        buckets[start].append((end, period))
    if buckets:
        for begin, size in zip(at.tolist(), after.tolist()):
            if size >= min_length + 2:
                _copy(buckets, begin, begin + size, begin - source[begin])
    doc = np.searchsorted(ends, np.array(sorted(buckets), np.int64), side="right").tolist()
    for start, d in zip(sorted(buckets), doc):
        low = int(starts[d])
        out[d] += sorted(((start - low, end - start, period) for end, period in buckets[start]), key=lambda r: r[2])
    return out


def _copy(buckets, begin: int, end: int, shift: int) -> None:
    """Take over the runs strictly inside a block from those ``shift`` words earlier, by growing start."""
    for start in range(begin + 1, end):
        held = buckets.get(start - shift)
        if held:
            inside = [(e + shift, p) for e, p in held if e + shift < end]
            if inside:
                buckets[start] += inside


def collapsed(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    gone = np.cumsum(change[:-1]) > 0
    return [w for w, g in zip(words, gone.tolist()) if not g]


def find_runs(docs: DataFrame, min_length: int = 2, min_exponent: int = 2, text_col: str = "text", id_col: str = "doc_id", rewrite=None) -> DataFrame:
    """(id, n_words, runs, collapsed): each row's runs and its text without what they repeat.

    Words are what stands between blanks (space and U+0009 to U+000D); ``collapsed`` is the words kept,
    joined by a space.  ``rewrite(id, words)`` may give other words, as bytes, in their place.  No other
    column is read, whatever its name.
    """
    import pyarrow as pa

    kind = docs.schema[id_col].dataType.simpleString()
    listed = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def judge(batches):
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            begin = 0
            while begin < len(ids):
                held, load, end = [], 0, begin
                while end < len(ids) and load < BATCH_WORDS:
                    text = texts[end].as_py()
                    words = text.split() if text else []
                    held.append(rewrite(ids[end], words) if rewrite else words)
                    load += len(words)
                    end += 1
                found = all_runs(held, min_length, min_exponent)
                kept = [b" ".join(collapsed(w, r)) for w, r in zip(held, found)]
                named = [[{"start": s, "length": n, "period": p} for s, n, p in r] for r in found]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(begin, end - begin), pa.array([len(w) for w in held], pa.int64()), pa.array(named, listed), pa.array(kept, pa.binary()).view(pa.string())],
                    names=["id", "n_words", "runs", "collapsed"],
                )
                begin = end

    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    told = slim.mapInArrow(judge, f"id {kind}, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")
    return told.withColumnRenamed("id", id_col)


def strongest(runs: Column) -> Column:
    """The run of greatest length / period, compared exactly; of equals the first.  Null where there is none."""
    none = F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>")
    more = lambda best, x: best.isNull() | (x["length"] * best["period"] > best["length"] * x["period"])
    return F.reduce(runs, none, lambda best, x: F.when(more(best, x), x).otherwise(best))


def listing(runs: Column) -> Column:
    """``start,length,period`` and a line feed for each run, as one string."""
    line = lambda r: F.concat(F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))), F.lit("\n"))
    return F.array_join(F.transform(runs, line), "")
