"""Packing token sequences: first-fit decreasing over a tournament tree of bin capacities.

Documents are encoded whole and cut at multiples of the sequence length.  Full pieces are
sequences as they are; the remainders are dealt at random into groups of about ``group_size`` and
packed within each group, largest first, into the first bin with room.  The tree's leaves are the
bins' free space and each inner node holds the larger of its two, so the first bin with room is
found by one descent.  Groups are independent tasks, of bounded size whatever the data's skew.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, functions as F

from .shared import BATCH_BYTES, arrow_batches, materialise, text_rows, trim
from .tokens import CACHE_SIZE, encoder_of


class Tournament:
    """Bins of equal capacity, opened in order; ``place`` finds the first with room."""

    def __init__(self, bins: int, capacity: int):
        self.width = 1
        while self.width < max(1, bins):
            self.width *= 2
        self.best = [capacity] * (2 * self.width)

    def place(self, size: int) -> int:
        best, node = self.best, 1
        if best[1] < size:
            raise ValueError("no bin has room")
        while node < self.width:
            node *= 2
            if best[node] < size:
                node += 1
        best[node] -= size
        bin_no, node = node - self.width, node // 2
        while node:
            top = max(best[2 * node], best[2 * node + 1])
            if best[node] == top:
                break
            best[node] = top
            node //= 2
        return bin_no


def first_fit_decreasing(lengths: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each item; ties keep their order."""
    tree, filled, out = Tournament(len(lengths), capacity), {}, [(0, 0)] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        b = tree.place(lengths[i])
        out[i] = (b, filled.get(b, 0))
        filled[b] = filled.get(b, 0) + lengths[i]
    return out


def padded(used: int, capacity: int) -> int:
    """A sequence's stored length: the capacity, or its own where that is a power of two."""
    return used if used & (used - 1) == 0 else capacity


PIECE = "doc_id {}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint, sequence_length bigint"


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 0, group_size: int = 4096, id_col: str = "doc_id", text_col: str = "text", cache_size: int = CACHE_SIZE) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian uint32), doc_tokens, sequence_id, offset, sequence_length.

    Every document ends in ``end_id``, so null and empty texts are pieces of one id.  Sequences are
    numbered: even numbers hold one full piece, odd ones are packed.  ``sequence_length`` is
    ``capacity``, or the ids held where that is a power of two.  Repeated rows are packed each.
    ``cache_size`` pieces are remembered by each worker; more of them take memory, fewer take time.
    """
    import pyarrow as pa

    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row"))

    def cut(batches):
        import numpy as np

        encoder, end = encoder_of(tokenizer, cache_size), np.array([end_id], "<u4").tobytes()

        def rows() -> Iterator[tuple]:
            serial = None
            for (doc, _, row), ids in encoder.stream(text_rows(batches, "doc_id", "text", "row"), 1):
                serial = row if serial is None else serial  # first row's number: no two tasks share one
                data = ids + end
                total = len(data) // 4
                for start in range(0, total, capacity):
                    piece = data[4 * start : 4 * (start + capacity)]
                    n = len(piece) // 4
                    full = n == capacity
                    yield doc, start, n, piece if full else _narrow(piece), total, 2 * serial if full else None, row
                    serial += full

        yield from arrow_batches(rows(), schema, weight=lambda r: len(r[3]), limit=BATCH_BYTES)
        trim()

    schema = pa.schema([
        ("doc_id", _arrow_type(docs, id_col)), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
        ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("row", pa.int64()),
    ])
    pieces = materialise(slim.mapInArrow(cut, f"doc_id {kind}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, row bigint"), "pieces")
    rest = pieces.where("sequence_id is null")
    groups = max(1, -(-rest.count() // group_size))
    dealt = rest.withColumn("g", F.pmod(F.xxhash64("row"), F.lit(groups)))

    def fit(key, table):
        # Arrow, not pandas: ids stay exact where a group holds nulls.
        table = table.sort_by([("row", "ascending"), ("start", "ascending")])
        bins, offsets = zip(*first_fit_decreasing(table["length"].to_pylist(), capacity))
        used: dict[int, int] = {}
        for b, n in zip(bins, table["length"].to_pylist()):
            used[b] = used.get(b, 0) + n
        first = key[0].as_py() << 32
        made = {
            "ids": pa.array([_widen(x.as_py()) for x in table["ids"]], pa.binary()),
            "sequence_id": pa.array([2 * (first + b) + 1 for b in bins], pa.int64()),
            "offset": pa.array(offsets, pa.int64()),
            "sequence_length": pa.array([padded(used[b], capacity) for b in bins], pa.int64()),
        }
        names = [x.split()[0] for x in PIECE.split(", ")]
        return pa.table([made[n] if n in made else table[n] for n in names], names=names)

    packed = dealt.drop("sequence_id").groupBy("g").applyInArrow(fit, PIECE.format(kind))
    whole = pieces.where("sequence_id is not null").drop("row").withColumn("offset", F.lit(0).cast("long")).withColumn("sequence_length", F.col("length"))
    return whole.unionByName(packed)


def _arrow_type(df: DataFrame, column: str):
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)


def _narrow(piece: bytes) -> bytes:
    """uint16 where every id fits, marked by a leading byte; remainders are what is shuffled."""
    import numpy as np

    ids = np.frombuffer(piece, "<u4")
    return b"\x02" + ids.astype("<u2").tobytes() if not len(ids) or ids.max() < 1 << 16 else b"\x04" + piece


def _widen(data: bytes) -> bytes:
    import numpy as np

    return np.frombuffer(data[1:], "<u2").astype("<u4").tobytes() if data[:1] == b"\x02" else bytes(data[1:])


def digest(pieces: DataFrame) -> DataFrame:
    """The pieces with the CRC-32 of their ids in place of the ids."""
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def sequences(pieces: Iterable[tuple[int, int, bytes]]) -> bytes:
    """A sequence's ids from its pieces (offset, length, ids), checked for gaps."""
    out, at = [], 0
    for offset, length, ids in sorted(pieces):
        if offset != at or len(ids) != 4 * length:
            raise ValueError("the pieces leave a gap")
        at += length
        out.append(ids)
    return b"".join(out)
