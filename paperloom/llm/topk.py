"""Exact top-k search by inner product: tiled matrix products, a selection in each tile, merged top lists.

Vectors become whole numbers, floor(scale * x), so that scores are exact and don't depend on the order
of additions.  Candidates are dealt by hash to shards and queries to blocks; every block meets every
shard in a task of its own, of bounded size.  A task multiplies its queries by its candidates in tiles
and keeps each query's ``k`` best of each tile.  The lists of a query are merged up a tree of shards,
``FAN`` at a time, so that no step holds more than FAN * k entries of a query.

Queries are a stated share of the rows, so work is (queries x rows), in blocks; what is shuffled
is each vector once for each block or shard of the other side.

Rows that repeat an id and its vector are one.  A query is no candidate of its own; a row of its id
with another vector is one, and of unequal vectors of a query's id the smallest of each length asks.
Vectors of unequal length never meet.  Null vectors, null ids, and vectors holding null or non-finite
components take no part.  A score beyond a long is cut to its range.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .shared import materialise

#: Candidates of a shard and queries of a block on average; queries of a tile; lists merged at a time.
SHARD, BLOCK, TILE, FAN = 8192, 8192, 256, 16
LONG = (-(1 << 63), (1 << 63) - 1)


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, vector) of the rows that take part."""
    v = F.col(vector_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(F.col(id_col).isNotNull() & v.isNotNull()).where(~bad).select(F.col(id_col).cast("long").alias("vec_id"), v.cast("array<double>").alias("vector"))


def products(queries, candidates):
    """Exact inner products of all rows of two matrices of whole numbers, as int64 where they fit, else as Python ints."""
    most = lambda m: float(np.abs(m).max()) if m.size else 0.0
    if most(queries) * most(candidates) * max(1, queries.shape[1]) < 2**53:
        return (queries @ candidates.T).astype(np.int64)
    exact = lambda m: np.array([[int(x) for x in row] for row in m], object).reshape(m.shape)
    return np.clip(exact(queries) @ exact(candidates).T, *LONG) if queries.shape[1] else np.zeros((len(queries), len(candidates)), np.int64)


def best_places(scores, k: int):
    """For each row the columns of its ``k`` greatest, greatest first, the smaller column first among equals."""
    width = scores.shape[1]
    k = min(k, width)
    if scores.dtype != object and abs(scores).max(initial=0) < 2**62 // width:
        key = scores * width - np.arange(width)  # no two are equal
        top = np.argpartition(-key, k - 1, axis=1)[:, :k]
        return np.take_along_axis(top, np.argsort(-np.take_along_axis(key, top, 1), axis=1), 1)
    return np.array([sorted(range(width), key=lambda c: (-row[c], c))[:k] for row in scores], np.int64).reshape(len(scores), k)


def search(vectors: DataFrame, every: int = 100, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding", shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows of greatest score for every row whose id ``every`` divides.

    Ties go to the smaller vec_id.  Other columns aren't read, whatever their names.
    """
    import pyarrow as pa

    spark = vectors.sparkSession
    good = materialise(usable(vectors, id_col, vector_col).withColumn("dims", F.size("vector")), "topk-vectors")
    asks = F.col("vec_id") % every == 0
    counted = good.agg(F.count("*").alias("n"), F.count_if(asks).alias("q")).first()
    # Never fewer shards than the cluster has places for tasks, so that all of them work.
    shards = max(-(-counted["n"] // shard), 2 * spark.sparkContext.defaultParallelism)
    blocks = max(1, -(-counted["q"] // block))
    asked = good.where(asks).groupBy("vec_id", "dims").agg(F.min("vector").alias("vector"))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda n, *cols: F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int")
    left = asked.select("dims", own(blocks, "vec_id").alias("block"), each(shards).alias("shard"), "vec_id", "vector")
    right = good.select("dims", each(blocks).alias("block"), own(shards, "vec_id", "vector").alias("shard"), "vec_id", "vector")
    out = pa.schema([("query_id", pa.int64()), ("node", pa.int32()), ("best", pa.list_(pa.struct([("score", pa.int64()), ("vec_id", pa.int64())])))])

    def tile(key, asked, held):
        dims, _, node = (x.as_py() for x in key)
        if not len(asked) or not len(held):
            return out.empty_table()
        order = np.argsort(held.column("vec_id").to_numpy(), kind="stable")
        ids = held.column("vec_id").to_numpy()[order]
        raw = np.asarray(held.column("vector").combine_chunks().flatten(), np.float64).reshape(len(held), dims)[order]
        once = np.ones(len(ids), bool)
        for a in np.flatnonzero(ids[1:] == ids[:-1]).tolist():  # rows that repeat an id: the first of each vector stays
            first = np.searchsorted(ids, ids[a])
            once[a + 1] = not (raw[first : a + 1][once[first : a + 1]] == raw[a + 1]).all(1).any()
        ids, raw = ids[once], raw[once]
        whole = np.floor(raw * scale)
        names = asked.column("vec_id").to_numpy()
        rows, lists = [], []
        for at in range(0, len(names), TILE):
            vectors = asked.column("vector").slice(at, TILE).combine_chunks()
            q = np.asarray(vectors.flatten(), np.float64).reshape(len(vectors), dims)
            scores = products(np.floor(q * scale), whole)
            for row, (name, places) in enumerate(zip(names[at : at + TILE].tolist(), best_places(scores, k + 1).tolist())):
                mine = [(int(scores[row, c]), int(ids[c])) for c in places if ids[c] != name or (raw[c] != q[row]).any()][:k]
                if mine:
                    rows.append(name)
                    lists.append([{"score": s, "vec_id": i} for s, i in mine])
        return pa.Table.from_arrays([pa.array(rows, pa.int64()), pa.array([node] * len(rows), pa.int32()), pa.array(lists, out.field("best").type)], schema=out)

    met = left.groupBy("dims", "block", "shard").cogroup(right.groupBy("dims", "block", "shard"))
    lists = met.applyInArrow(tile, "query_id bigint, node int, best array<struct<score: bigint, vec_id: bigint>>")
    # One shuffle by query; the tree's levels then need none.  Entries compare by score, ties by smaller id.
    lists = lists.repartition(F.col("query_id"))
    before = lambda a, b: F.when(a["score"] != b["score"], F.when(a["score"] > b["score"], -1).otherwise(1)).otherwise(F.when(a["vec_id"] < b["vec_id"], -1).when(a["vec_id"] > b["vec_id"], 1).otherwise(0))
    while shards > 1:
        merged = F.slice(F.array_sort(F.flatten(F.collect_list("best")), before), 1, k).alias("best")
        lists = lists.groupBy("query_id", F.floor(F.col("node") / FAN).cast("int").alias("node")).agg(merged)
        shards = -(-shards // FAN)
    ranked = lists.select("query_id", F.posexplode("best").alias("at", "hit"))
    return ranked.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))
