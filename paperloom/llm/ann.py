"""Approximate nearest neighbours by learned partitions.

On a bounded sample the exact neighbour graph is built and cut into balanced parts; a small
network is then trained to tell, from a vector alone, in which parts its neighbours lie.  All
vectors are stored in the part the network finds most probable, queries go to the most probable
parts and are reranked there by exact cosine.  How many parts is learned too: a tenth of the sample
is kept from training, and the fewest parts that cover ``recall`` of its neighbours are visited, or
more where those hold too few vectors.  There are about half as many parts as the root of the number
of vectors, and a part for every eight of the sample at most: beyond, parts grow, and are searched
in more blocks.  Tables of any size are searched this way.  Equal vectors are one candidate that
carries its smallest ids, which is exact because ties go to smaller ids.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from .shared import materialise


@dataclass
class Router:
    """Part probabilities of unit vectors: one hidden layer."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    def scores(self, x):
        return np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2


def neighbour_graph(x, k: int):
    """Indices of the ``k`` nearest of each unit row, itself left out."""
    out = np.empty((len(x), k), np.int64)
    for at in range(0, len(x), 1024):
        s = x[at : at + 1024] @ x.T
        s[np.arange(len(s)), np.arange(at, at + len(s))] = -2
        out[at : at + len(s)] = np.argpartition(-s, k - 1, axis=1)[:, :k] if k < len(x) else np.argsort(-s, axis=1)[:, :k]
    return out


def balanced_parts(x, graph, parts: int, rounds: int = 12, slack: float = 1.1, seed: int = 5):
    """A part for each row: balanced k-means to begin with, then moves that cut fewer graph edges.

    A part takes ``slack`` times its fair share at most.
    """
    rng = np.random.default_rng(seed)
    room = int(np.ceil(slack * len(x) / parts))
    centres = x[rng.choice(len(x), parts, replace=False)].copy()
    for _ in range(rounds):
        side = _fill(x @ centres.T, room)
        for p in range(parts):
            if (side == p).any():
                total = x[side == p].sum(0)
                centres[p] = total / max(np.linalg.norm(total), 1e-12)
    for _ in range(rounds):
        votes = np.zeros((len(x), parts), np.float32)
        rows = np.repeat(np.arange(len(x)), graph.shape[1])
        np.add.at(votes, (rows, side[graph.ravel()]), 1)
        np.add.at(votes, (graph.ravel(), side[rows]), 1)
        votes += 0.5 * (np.arange(parts)[None, :] == side[:, None]) + 1e-3 * (x @ centres.T)
        moved = _fill(votes, room)
        if (moved == side).all():
            break
        side = moved
    return side


def _fill(scores, room: int):
    """Every row's best part that still has room, the most decided rows first."""
    parts = scores.shape[1]
    order = np.argsort(-scores, axis=1)
    top = np.take_along_axis(scores, order[:, : min(2, parts)], axis=1)
    queue = np.argsort(-(top[:, 0] - top[:, -1]), kind="stable")
    left, side = [room] * parts, np.empty(len(scores), np.int64)
    for i in queue.tolist():
        for p in order[i].tolist():
            if left[p]:
                left[p] -= 1
                side[i] = p
                break
    return side


def train_router(x, graph, side, parts: int, hidden: int = 128, epochs: int = 30, seed: int = 3) -> Router:
    """Softmax network fitted to the shares of each row's neighbours (and itself) by part; Adam."""
    rng = np.random.default_rng(seed)
    aim = np.zeros((len(x), parts), np.float32)
    np.add.at(aim, (np.repeat(np.arange(len(x)), graph.shape[1]), side[graph.ravel()]), 1)
    aim[np.arange(len(x)), side] += graph.shape[1] / 2
    aim /= aim.sum(1, keepdims=True)
    shapes = [(x.shape[1], hidden), (hidden,), (hidden, parts), (parts,)]
    params = [rng.normal(0, (2 / s[0]) ** 0.5, s).astype(np.float32) if len(s) == 2 else np.zeros(s, np.float32) for s in shapes]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(len(x)), max(1, len(x) // 256)):
            xb = x[rows]
            h = np.maximum(xb @ params[0] + params[1], 0)
            z = h @ params[2] + params[3]
            p = np.exp(z - z.max(1, keepdims=True))
            d = (p / p.sum(1, keepdims=True) - aim[rows]) / len(rows)
            back = (d @ params[2].T) * (h > 0)
            step += 1
            for i, g in enumerate((xb.T @ back, back.sum(0), h.T @ d, d.sum(0))):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                params[i] = params[i] - 3e-3 * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return Router(*params)


def part_count(vectors: int, sample: int) -> int:
    """How many parts ``vectors`` are dealt to, ``sample`` of them being learned from."""
    return max(1, min(round(vectors**0.5 / 2), min(vectors, sample) // 8))


def probes_needed(router: Router, stored, asked, recall: float, k: int = 5) -> int:
    """The fewest parts to visit so that ``recall`` of the neighbours of ``asked`` among ``stored`` are met."""
    part = router.scores(stored).argmax(1)
    place = np.argsort(np.argsort(-router.scores(asked), axis=1, kind="stable"), axis=1)
    near = np.argsort(-(asked @ stored.T), axis=1)[:, :k]
    met = place[np.arange(len(asked))[:, None], part[near]]
    shares = np.cumsum(np.bincount(met.ravel(), minlength=len(router.b2))) / met.size
    return int(np.argmax(shares >= recall)) + 1


def fit(distinct: DataFrame, parts: int, sample: int = 8000, recall: float = 0.96, graph_k: int = 10) -> tuple[Router, int]:
    """(router, parts to visit), from at most ``sample`` distinct vectors: those of smallest hash."""
    rows = distinct.select("vector", F.xxhash64("vector").alias("h")).orderBy("h", "vector").limit(sample).select("vector").collect()
    x = np.array([r[0] for r in rows], np.float32)
    x /= np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True).astype(np.float32)
    asked, x = (x[: len(x) // 10], x[len(x) // 10 :]) if len(x) >= 20 else (x, x)
    parts = max(1, min(parts, len(x)))
    graph = neighbour_graph(x, min(graph_k, len(x) - 1)) if len(x) > 1 else np.zeros((1, 1), np.int64)
    router = train_router(x, graph, balanced_parts(x, graph, parts), parts)
    return router, probes_needed(router, x, asked, recall)


def exact_cosines(query, candidates):
    """Cosines in double precision, each from its own two vectors alone."""
    q, c = query.astype(np.float64), candidates.astype(np.float64)
    dots = (c * q).sum(axis=1)
    return dots / np.sqrt((q * q).sum() * (c * c).sum(axis=1))


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, vector): rows that can take part; null, zero and non-finite vectors cannot, nor null ids."""
    v = F.col(vector_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists(v, lambda x: x != 0)
    return vectors.where(F.col(id_col).isNotNull() & v.isNotNull()).where(~bad & some).select(F.col(id_col).alias("vec_id"), v.alias("vector"))


def search(vectors: DataFrame, every: int = 50, k: int = 5, recall: float = 0.96, sample: int = 8000, block: int = 8192, notes: dict | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of every row whose id ``every`` divides.

    Queries visit the most probable parts, as many as promise ``recall`` and hold more than ``k``
    candidates.  Vectors of unequal length never meet.  Candidates and queries of a part meet in
    blocks of about ``block`` of each, so a task's size is bounded whatever the table's.  A score is
    recomputed from the original vectors.  A query's own row is no candidate; another row of its id
    is.  Rows that repeat an id and its vector are one, and of unequal vectors of a query's id the
    smallest of each length asks.  ``notes`` takes (vectors, parts, parts visited) by length.
    """
    good = materialise(usable(vectors), "ann-vectors")
    keyed = good.select("vec_id", "vector", F.size("vector").alias("dims"), F.xxhash64("vector").alias("h")).distinct()
    low = Window.partitionBy("h", "vector").orderBy("vec_id")
    few = keyed.withColumn("n", F.row_number().over(low)).where(F.col("n") <= k + 1)
    distinct = materialise(few.groupBy("h", "vector", "dims").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")), "ann-distinct")
    by_dims = {r["dims"]: r["count"] for r in distinct.groupBy("dims").count().collect()}
    found, notes = None, {} if notes is None else notes
    for dims, count in sorted(by_dims.items()):
        one, notes[dims] = _search(distinct.where(F.col("dims") == dims), good.where(F.size("vector") == dims), count, every, k, recall, sample, block)
        found = one if found is None else found.unionByName(one)
    if found is None:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _search(distinct, good, count, every, k, recall, sample, block):
    parts = part_count(count, sample)
    router, visit = fit(distinct, parts, sample, recall)
    told = distinct.sparkSession.sparkContext.broadcast(router)

    def route(batches, held):
        """The best part of each vector, or with the parts' numbers of candidates those that a query visits."""
        import pyarrow as pa

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = np.asarray(batch.column("vector").flatten(), np.float64).reshape(n, -1)
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
            scores = told.value.scores(x.astype(np.float32))
            if held is None:
                chosen = scores.argmax(axis=1)[:, None].tolist()
            else:
                order = np.argsort(-scores, axis=1, kind="stable")
                enough = (np.cumsum(held[order], axis=1) <= k).sum(axis=1) + 1
                chosen = [o[: max(visit, e)] for o, e in zip(order.tolist(), enough.tolist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(chosen, pa.list_(pa.int32()))], names=[*batch.schema.names, "parts"])

    kind = distinct.schema["vector"].dataType.simpleString()
    placed = distinct.select("ids", "vector").mapInArrow(lambda b: route(b, None), f"ids array<bigint>, vector {kind}, parts array<int>")
    placed = materialise(placed.select("ids", "vector", F.col("parts")[0].alias("part")), "ann-placed")
    held = np.zeros(len(router.b2), np.int64)
    for part, ids in placed.groupBy("part").agg(F.sum(F.size("ids"))).collect():  # as many rows as parts
        held[part] = ids
    queries = good.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    asked = queries.mapInArrow(lambda b: route(b, held), f"vec_id bigint, vector {kind}, parts array<int>")
    asked = materialise(asked.select("vec_id", "vector", F.explode("parts").alias("part")), "ann-asked")

    # How many blocks each part's candidates and queries are dealt to: a row for each part.
    counted = lambda df, name: df.groupBy("part").agg(F.ceil(F.count("*") / block).cast("int").alias(name))
    blocks = F.broadcast(counted(placed, "of_c").join(counted(asked, "of_q"), "part"))
    own = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = placed.join(blocks, "part").select("ids", "vector", "part", own("vector", "of_c").alias("c"), each("of_q").alias("q"))
    right = asked.join(blocks, "part").select("vec_id", "vector", "part", each("of_c").alias("c"), own("vec_id", "of_q").alias("q"))

    def near(left, right):
        import pandas as pd

        out = []
        if len(left) and len(right):
            c = np.stack(left["vector"].to_numpy()).astype(np.float64)
            unit = (c / np.linalg.norm(c, axis=1, keepdims=True)).astype(np.float32)
            ids = left["ids"].tolist()
            asked_v, names = right["vector"].tolist(), right["vec_id"].tolist()
            for at in range(0, len(names), 512):
                q = np.stack(asked_v[at : at + 512]).astype(np.float64)
                rough = (q / np.linalg.norm(q, axis=1, keepdims=True)).astype(np.float32) @ unit.T
                # The query itself may stand before its k nearest; what single precision can't tell apart stays.
                short = min(len(c), k + 1)
                limit = -np.partition(-rough, short - 1, axis=1)[:, short - 1] - 1e-5
                for row, name in enumerate(names[at : at + 512]):
                    near_by = np.flatnonzero(rough[row] >= limit[row])
                    score = exact_cosines(q[row], c[near_by])
                    same = (c[near_by] == q[row]).all(axis=1)
                    rows = zip(score.tolist(), same.tolist(), near_by.tolist())
                    best = sorted((-s, int(i)) for s, equal, j in rows for i in ids[j] if not (equal and i == name))[:k]
                    out += [(name, i, -s) for s, i in best]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    grouped = left.groupBy("part", "c", "q").cogroup(right.groupBy("part", "c", "q"))
    return grouped.applyInPandas(near, "query_id bigint, vec_id bigint, score double"), (count, len(router.b2), visit)
