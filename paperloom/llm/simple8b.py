"""Simple-8b: word-aligned coding of token ids, and a file of documents in it.

A 64-bit word holds a 4-bit selector on top and as many equal-width values below as fit; the first
value is lowest.  Selector 0 is an escape: the next word is one raw value, for ids of more than 60
bits.  Values are coded in blocks of ``BLOCK`` ids; a block starts at a word of its own and its
first word's index is stored, so blocks are decoded independently and, without an escape, by whole
arrays per selector.

File: magic, counts, doc ids, document lengths, flags of documents without an id (their ids read
0), block offsets, block escape flags, words; all little-endian.  Files are written in ascending doc_id order: the rows are range-partitioned, and a
file's name tells partition and place.
"""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from .shared import arrow_batches, fresh_path, materialise, put_file, text_rows
from .tokens import encoder_of

#: Fixed values: (values in a word, bits of each) by selector; 0 escapes, 15 is not used.
SELECTORS = {1: (60, 1), 2: (30, 2), 3: (20, 3), 4: (15, 4), 5: (12, 5), 6: (10, 6), 7: (8, 7), 8: (7, 8), 9: (6, 10), 10: (5, 12), 11: (4, 15), 12: (3, 20), 13: (2, 30), 14: (1, 60)}
ESCAPE = 0
BLOCK = 1 << 14
MAGIC = b"PLS8v002"
_HEAD = struct.Struct("<8sQQQQ")


def _selector_at(values):
    """For every position the selector that takes most values from there, zeros following the end."""
    n = len(values)
    bits = np.zeros(n + 64, np.uint8)
    top = int(values.max()) if n else 0
    width = np.zeros(n, np.uint8)
    for b in (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60):  # widths that selectors know
        if b == 1:
            width[:] = 1
            previous = 1
            continue
        width[values >= np.uint64(1 << previous)] = b
        previous = b
        if top < 1 << b:
            break
    if top >= 1 << 60:
        width[values >= np.uint64(1 << 60)] = 64
    bits[:n] = width
    doubled = {1: bits}
    for p in (2, 4, 8, 16, 32):
        half = doubled[p // 2]
        doubled[p] = np.maximum(half[: -(p // 2)], half[p // 2 :])
    chosen = np.full(n, ESCAPE, np.uint8)
    for selector in sorted(SELECTORS, reverse=True):
        count, b = SELECTORS[selector]
        p = 1 << (count.bit_length() - 1)
        window = np.maximum(doubled[p][:n], doubled[p][count - p : count - p + n])
        fits = window <= b
        if not fits.any():
            break  # more values at fewer bits fit nowhere either
        chosen[fits] = selector
    return chosen


_COUNT = np.array([1] + [SELECTORS[s][0] for s in range(1, 15)] + [0], np.int64)


def encode_block(values) -> tuple[np.ndarray, bool]:
    """(words, whether an escape occurs) of an array of unsigned 64-bit values."""
    values = np.ascontiguousarray(values, np.uint64)
    if not len(values):
        return np.empty(0, np.uint64), False
    chosen = _selector_at(values)
    ahead = (np.arange(len(values)) + _COUNT[chosen]).tolist()
    starts, at, end = [], 0, len(values)
    while at < end:
        starts.append(at)
        at = ahead[at]
    starts = np.array(starts)
    selectors = chosen[starts]
    sizes = 1 + (selectors == ESCAPE)
    places = np.cumsum(sizes) - sizes
    words = np.zeros(int(sizes.sum()), np.uint64)
    padded = np.concatenate((values, np.zeros(64, np.uint64)))
    for selector in np.unique(selectors).tolist():
        mine = selectors == selector
        first, place = starts[mine], places[mine]
        if selector == ESCAPE:
            words[place + 1] = values[first]
            continue
        count, bits = SELECTORS[selector]
        word = np.full(len(first), selector << 60, np.uint64)
        for k in range(count):
            word |= padded[first + k] << np.uint64(k * bits)
        words[place] = word
    return words, bool((selectors == ESCAPE).any())


def decode_block(words, n: int, escaped: bool):
    """The ``n`` values of a block."""
    words = np.asarray(words, np.uint64)
    selectors = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    if escaped:  # a raw word's top bits mean nothing, so the words are walked
        at, heads = 0, selectors.tolist()
        while at < len(heads):
            if heads[at] == ESCAPE:
                raw[at + 1] = True
                at += 1
            at += 1
    elif (selectors == ESCAPE).any():
        raise ValueError("an escape in a block without escapes")
    counts = np.where(raw, 1, np.where(selectors == ESCAPE, 0, _COUNT[selectors]))
    places = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()) if len(words) else 0, np.uint64)
    out[places[raw]] = words[raw]
    for selector in np.unique(selectors[~raw]).tolist():
        if selector == ESCAPE:
            continue
        if selector not in SELECTORS:
            raise ValueError(f"selector {selector} is not in use")
        count, bits = SELECTORS[selector]
        mine = (selectors == selector) & ~raw
        word, place, mask = words[mine], places[mine], np.uint64((1 << bits) - 1)
        for k in range(count):
            out[place + k] = (word >> np.uint64(k * bits)) & mask
    if len(out) < n or (len(out) > n and out[n:].any()):
        raise ValueError("the block's length is wrong")
    return out[:n]


def pack_file(docs: list[tuple[int | None, bytes]]) -> bytes:
    """A file of (doc_id, ids as little-endian uint32 bytes), in the order given."""
    lengths = np.array([len(d) // 4 for _, d in docs], "<u8")
    ids = np.frombuffer(b"".join(d for _, d in docs), "<u4").astype(np.uint64)
    blocks = [encode_block(ids[i : i + BLOCK]) for i in range(0, len(ids), BLOCK)]
    offsets = np.cumsum([0] + [len(w) for w, _ in blocks]).astype("<u8")
    return b"".join((
        _HEAD.pack(MAGIC, len(docs), len(ids), len(blocks), int(offsets[-1])),
        np.array([d or 0 for d, _ in docs], "<i8").tobytes(), lengths.tobytes(), np.array([d is None for d, _ in docs], np.uint8).tobytes(), offsets.tobytes(),
        np.array([e for _, e in blocks], np.uint8).tobytes(), *(w.astype("<u8").tobytes() for w, _ in blocks),
    ))


def read_file(data: bytes):
    """(doc ids or None, start of each document and the end, ids) of a file; ValueError if it is damaged."""
    if len(data) < _HEAD.size:
        raise ValueError("the file is too short")
    magic, n_docs, n_ids, n_blocks, n_words = _HEAD.unpack_from(data)
    if magic != MAGIC or len(data) != _HEAD.size + 17 * n_docs + 8 * (n_blocks + 1) + n_blocks + 8 * n_words:
        raise ValueError("not such a file, or cut short")
    at = _HEAD.size
    names = np.frombuffer(data, "<i8", n_docs, at)
    lengths = np.frombuffer(data, "<u8", n_docs, at + 8 * n_docs).astype(np.int64)
    nameless = np.frombuffer(data, np.uint8, n_docs, at + 16 * n_docs)
    at += 17 * n_docs
    offsets = np.frombuffer(data, "<u8", n_blocks + 1, at).astype(np.int64)
    flags = np.frombuffer(data, np.uint8, n_blocks, at + 8 * (n_blocks + 1))
    words = np.frombuffer(data, "<u8", n_words, at + 8 * (n_blocks + 1) + n_blocks)
    ids = np.empty(n_ids, np.uint64)
    for b in range(n_blocks):
        n = min(BLOCK, n_ids - b * BLOCK)
        ids[b * BLOCK : b * BLOCK + n] = decode_block(words[offsets[b] : offsets[b + 1]], n, bool(flags[b]))
    starts = np.concatenate(([0], np.cumsum(lengths)))
    if starts[-1] != n_ids:
        raise ValueError("the documents' lengths do not add up")
    return [None if gone else name for name, gone in zip(names.tolist(), nameless.tolist())], starts, ids


def write_ids(docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int = 1, file_ids: int = 2_000_000) -> DataFrame:
    """Encode whole texts, append ``end_id``, write files; returns their table (file, part, seq, n_docs, n_ids).

    Rows go to ranges of doc_id (rows that share one by the hash of their text) and are sorted
    there, so files in order of (part, seq) hold ascending ids.  Null and empty texts are one id.
    A file ends once it holds ``file_ids`` ids.  Documents without a doc_id come first.
    """
    spark = docs.sparkSession
    folder = folder or fresh_path(spark, "token-ids")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tie = F.xxhash64("text")
    rows = docs.select("doc_id", "text").repartitionByRange(parts, F.col("doc_id"), tie).sortWithinPartitions(F.col("doc_id"), tie)

    def run(batches):
        from pyspark import TaskContext

        encoder, end, part = encoder_of(tokenizer), np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId()

        def files():
            held, load, seq = [], 0, 0

            def flush():
                name = f"part-{part:06d}-{seq:06d}.s8b"
                put_file(folder, name, pack_file(held))
                return name, part, seq, len(held), load

            for (doc, _), ids in encoder.stream(text_rows(batches, "doc_id", "text"), 1):
                held.append((doc, ids + end))
                load += len(held[-1][1]) // 4
                if load >= file_ids:
                    yield flush()
                    held, load, seq = [], 0, seq + 1
            if held:
                yield flush()

        import pyarrow as pa

        yield from arrow_batches(files(), pa.schema([("file", pa.string()), ("part", pa.int32()), ("seq", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    listed = materialise(rows.mapInArrow(run, "file string, part int, seq int, n_docs bigint, n_ids bigint"), "token-files")
    return listed.withColumn("folder", F.lit(folder))


def read_ids(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document, read back from the files listed.

    ``start`` counts the ids of all documents before it; it is the file's start, from a running sum
    over the partitions that wrote files and within each, plus the document's place there.
    """
    spark = files.sparkSession
    head = files.select("folder").first()
    if head is None:
        return spark.createDataFrame([], "doc_id bigint, start bigint, n_tokens bigint, ids binary")
    before = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # A row for each partition that wrote files; a partition's own files add up within it.
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n_ids")).select("part", before(Window.orderBy("part")).alias("skip"))
    placed = files.select("file", "part", before(Window.partitionBy("part").orderBy("seq")).alias("within")).join(parts, "part").select("file", (F.col("skip") + F.col("within")).alias("base"))
    raw = spark.read.format("binaryFile").load(head["folder"]).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    joined = raw.join(F.broadcast(placed) if _few(files) else placed, "file")

    def run(batches):
        import pyarrow as pa

        def docs():
            for batch in batches:
                for base, content in zip(batch.column("base"), batch.column("content")):
                    names, starts, ids = read_file(content.as_buffer().to_pybytes())
                    small = ids.astype("<u4")
                    for k, name in enumerate(names):
                        a, b = int(starts[k]), int(starts[k + 1])
                        yield name, base.as_py() + a, b - a, small[a:b].tobytes()

        yield from arrow_batches(docs(), pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())]), weight=lambda r: len(r[3]))

    return joined.select("base", "content").mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids binary")


def _few(files: DataFrame, most: int = 100_000) -> bool:
    """Whether the table of files is known to be small; beyond, the join shuffles."""
    return files.count() <= most
