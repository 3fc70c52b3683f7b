"""SimHash near-duplicate detection by a binary trie self-join.

``fingerprints`` reads every text once.  ``linked_pairs`` finds links between *distinct*
fingerprints: a fingerprint is cut into eight bytes, and two that differ in at most two bits
agree on some six of them, so each is sent to the 28 tries named by six bytes.  At most 2**16
distinct fingerprints share a trie whatever the corpus holds, which bounds every task.  In a trie,
node pairs are walked together from the root, the differing bits add up, and a pair of nodes is
dropped once the error budget is exceeded.  A trie reports a spanning forest of its links, never
all pairs of a group.  ``connected`` closes the links over all tries by alternating large-star and
small-star rounds on tables; nothing is collected.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, functions as F

from .shared import at_places, materialise, numbered, slices

BITS, BYTES = 64, 8


def _fingerprint(raw: bytes | None, shingle: int) -> int:
    import numpy as np
    import xxhash

    words = (raw or b"").lower().split()
    if not words:
        return 0
    line, size, digest = b" ".join(words), min(shingle, len(words)), xxhash.xxh64_intdigest
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1]))
    total = len(words) - size + 1
    ones = np.zeros(BITS, np.int64)
    begin, stop = starts[:total].tolist(), (ends[size - 1 :] - 1).tolist()
    for at in range(0, total, 1 << 15):
        hashes = np.array([digest(line[s:e], 42) for s, e in zip(begin[at : at + (1 << 15)], stop[at : at + (1 << 15)])], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    value = 0
    for bit in np.flatnonzero(2 * ones > total).tolist():
        value |= 1 << bit
    return value - (1 << BITS) if value >> (BITS - 1) else value


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp): the 64-bit SimHash of a whole text, as a signed long.

    A-Z is lower-cased, words are split at ASCII white space, shingles count with repeats and are
    hashed by XXH64 with seed 42.  Fewer words than a shingle make one shingle; no word, and null,
    give 0.  Other columns are not read.
    """
    import pyarrow as pa

    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("raw"))

    def run(batches):
        for batch in slices(batches):
            values = [_fingerprint(r.as_py(), shingle) for r in batch.column("raw")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(values, pa.int64())], names=["id", "fp"])

    kind = slim.schema["id"].dataType.simpleString()
    return slim.mapInArrow(run, f"id {kind}, fp bigint").withColumnRenamed("id", id_col)


def trie_pairs(values, bounds, budget: int):
    """Index pairs of ``values`` (unsigned, sorted and distinct between two ``bounds``) within ``budget`` bits.

    A node is a run of the sorted values that shares a prefix.  All tries are walked level by
    level at once; the frontier holds pairs of nodes and the bits in which their prefixes differ.
    """
    import numpy as np

    lo = np.asarray(bounds[:-1], np.int64)
    hi = np.asarray(bounds[1:], np.int64)
    keep = hi - lo > 1
    a_lo, a_hi = lo[keep], hi[keep]
    b_lo, b_hi, diff = a_lo, a_hi, np.zeros(len(a_lo), np.int64)
    left, right = [], []
    for bit in range(BITS - 1, -1, -1):
        if not len(a_lo):
            break
        ones = np.concatenate(([0], np.cumsum((values >> np.uint64(bit)) & np.uint64(1)))).astype(np.int64)
        a_mid, b_mid = a_hi - (ones[a_hi] - ones[a_lo]), b_hi - (ones[b_hi] - ones[b_lo])
        same = a_lo == b_lo
        parts = [
            (a_lo, a_mid, b_lo, b_mid, diff, None),
            (a_mid, a_hi, b_mid, b_hi, diff, None),
            (a_lo, a_mid, b_mid, b_hi, diff + 1, None),
            (a_mid, a_hi, b_lo, b_mid, diff + 1, ~same),
        ]
        grown = []
        for al, ah, bl, bh, d, only in parts:
            ok = (ah > al) & (bh > bl) & (d <= budget) & ~((al == bl) & (ah - al == 1))
            if only is not None:
                ok &= only
            grown.append((al[ok], ah[ok], bl[ok], bh[ok], d[ok]))
        a_lo, a_hi, b_lo, b_hi, diff = (np.concatenate(x) for x in zip(*grown))
        single = (a_hi - a_lo == 1) & (b_hi - b_lo == 1)
        if single.any():  # two leaves: the rest of the walk is one count of bits
            i, j = a_lo[single], b_lo[single]
            near = np.bitwise_count(values[i] ^ values[j]) <= budget
            left.append(i[near])
            right.append(j[near])
            rest = ~single
            a_lo, a_hi, b_lo, b_hi, diff = a_lo[rest], a_hi[rest], b_lo[rest], b_hi[rest], diff[rest]
    if not left:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(left), np.concatenate(right)


def _roots(size: int, i, j):
    """Smallest index reachable from each, by hooking and pointer jumping."""
    import numpy as np

    parent = np.arange(size)
    while len(i):
        low = np.minimum(parent[i], parent[j])
        np.minimum.at(parent, parent[i], low)
        np.minimum.at(parent, parent[j], low)
        while True:
            above = parent[parent]
            if (above == parent).all():
                break
            parent = above
        apart = parent[i] != parent[j]
        i, j = i[apart], j[apart]
    return parent


def _trie_links(batches, budget: int):
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        lists = batch.column("fps")
        flat = np.asarray(lists.flatten()).astype(np.int64).view(np.uint64)
        sizes = np.asarray(lists.value_lengths())
        values = flat[np.lexsort((flat, np.repeat(np.arange(len(sizes)), sizes)))]
        i, j = trie_pairs(values, np.concatenate(([0], np.cumsum(sizes))), budget)
        root = _roots(len(values), i, j)
        moved = np.flatnonzero(root != np.arange(len(values)))
        signed = values.view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(signed[moved]), pa.array(signed[root[moved]])], names=["a", "b"])


def linked_pairs(distinct: DataFrame, budget: int = 2) -> DataFrame:
    """(a, b): links whose closure joins exactly the ``fp`` values linked within ``budget`` bits (2 at most)."""
    if not 0 <= budget <= 2:
        raise ValueError("six of eight bytes agree only while the budget is 0, 1 or 2")
    keys = []
    for c, free in enumerate(combinations(range(BYTES), 2)):
        mask = 0
        for byte in range(BYTES):
            if byte not in free:
                mask |= 0xFF << (8 * byte)
        mask -= (1 << BITS) if mask >> (BITS - 1) else 0
        keys.append(F.struct(F.lit(c).cast("byte").alias("c"), F.col("fp").bitwiseAND(F.lit(mask).cast("long")).alias("prefix")))
    spread = distinct.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.c", "k.prefix")
    tries = spread.groupBy("c", "prefix").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1).select("fps")
    return tries.mapInArrow(lambda batches: _trie_links(batches, budget), "a bigint, b bigint")


def connected(edges: DataFrame, label: str = "components", max_rounds: int = 60) -> DataFrame:
    """(node, root): every node of ``edges`` (a, b) with the smallest node it reaches.

    Alternates large-star and small-star rounds until the table of edges stays the same; each
    round's table is written to the shared folder.  Minima are pre-aggregated before the shuffle.
    A star with very many leaves meets its one centre in a join, as the larger side, which AQE
    splits over tasks.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = materialise(pairs, label)
    mark = _mark(now)
    for _ in range(max_rounds if mark[0] else 1):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        after = (
            small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v")))
            .distinct()
        )
        now = materialise(after, label)
        then, mark = mark, _mark(now)
        if then == mark:
            break
    else:
        raise RuntimeError("the components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _mark(edges: DataFrame):
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, budget: int = 2) -> DataFrame:
    """(id, fp, component_id): one row per row of ``docs``; near-duplicates share the smallest id they reach.

    Repeated rows stay repeated, equal texts share a fingerprint, null ids give way to any other id
    of their component, an empty table gives an empty table, other columns aren't read.  The last
    join meets a fingerprint with very many rows (such as that of empty texts) as its larger side,
    which AQE splits.
    """
    prints = materialise(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    least = materialise(prints.groupBy("fp").agg(F.min(id_col).alias("least_id")), "distinct-fingerprints")
    links = connected(linked_pairs(least.select("fp"), budget))
    placed = least.join(links, least.fp == links.node, "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    heads = placed.groupBy("root").agg(F.min("least_id").alias("component_id"))
    known = placed.join(heads, "root").select("fp", "component_id")
    return prints.join(known, "fp").select(id_col, "fp", "component_id")


def hex_fingerprint(column):
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, budget: int = 2) -> DataFrame:
    """One row of each component of ``docs``, that of the smallest id, with all its columns, whatever they are called.

    Rows that share the smallest id (or, with no id in the component, have none) are told apart by
    their place in the input, and the first stays.
    """
    rows, file, at = numbered(docs)
    slim = rows.select(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col(file).alias("file"), F.col(at).alias("at")).alias("row"), F.col(text_col).alias("text"))
    prints = materialise(fingerprints(slim, "row", "text", shingle), "fingerprints")
    links = connected(linked_pairs(prints.select("fp").distinct(), budget))
    return rows_of_heads(rows, prints, links, "fp", file, at)


def rows_of_heads(rows: DataFrame, prints: DataFrame, links: DataFrame, key: str, file: str, at: str) -> DataFrame:
    """Of ``rows`` those that come first in their component, by prints (row, key) and links (node, root) of keys.

    The smallest row of each key is found first, so a key with very many rows weighs no more than
    another; what comes back to the rows is a table of places, one of each component.
    """
    least = prints.groupBy(key).agg(F.min("row").alias("row"))
    placed = least.join(links, F.col(key) == F.col("node"), "left").select("row", F.coalesce("root", key).alias("root"))
    heads = placed.groupBy("root").agg(F.min("row").alias("row")).select(F.col("row.file").alias(file), F.col("row.at").alias(at))
    kept = materialise(heads, "kept-rows")
    return at_places(rows, kept, file, at).drop(file, at)
