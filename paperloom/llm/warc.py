"""WARC archives in Zstandard: a dictionary frame first, then one frame per record.

An archive (.warc.zst) opens with a skippable frame (magic 0x184D2A5D) that holds the dictionary,
itself a Zstandard frame or raw; every record is a frame of its own compressed with it.  The
reader loads the dictionary, walks the frames, and validates each record: version line, required
fields, block length, closing line breaks, HTTP content length, block and payload digests.

Records with equal payloads are stored once: the smallest page_id is the response, the others are
revisits that refer to it and hold the HTTP header only.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from .shared import arrow_batches, fresh_path, materialise, numbered, put_file

DICT_MAGIC = 0x184D2A5D
SKIP_MAGICS = range(0x184D2A50, 0x184D2A60)
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REQUIRED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")


class WarcError(ValueError):
    """An archive or record that isn't valid."""


def digest32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes

    @property
    def page_id(self) -> int | None:
        return _page(self.headers["WARC-Record-ID"])


def _urn(page_id: int | None) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}>"


def _page(urn: str) -> int | None:
    if not urn.startswith("<urn:x-page:") or not urn.endswith(">"):
        raise WarcError(f"not a page's id: {urn}")
    return None if urn[12:-1] == "none" else int(urn[12:-1])


def _clean(url: str) -> str:
    """A URL that fits on a header line: control characters and blanks percent-encoded."""
    return "".join(c if 32 < ord(c) < 127 or ord(c) > 159 else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def build_record(page_id: int, url: str | None, payload: bytes | None, digest: str, size: int, refers_to: int | None) -> bytes:
    """A response, or with ``refers_to`` a revisit; ``payload`` is stored in responses only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"" if refers_to is None else b"")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_clean(url)}")
    lines += ["Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{digest32(block)}"]
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}"]
    head = "\r\n".join([*lines, f"Content-Length: {len(block)}"]) + "\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def parse_record(data: bytes) -> Record:
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not gap or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise WarcError("no version line or no end of the header")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or name in headers:
            raise WarcError(f"a bad or repeated header: {line[:60]}")
        headers[name] = value.strip()
    if missing := [x for x in REQUIRED if x not in headers]:
        raise WarcError(f"fields are missing: {missing}")
    size = int(headers["Content-Length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise WarcError("the block's length is wrong")
    block = rest[:size]
    if "WARC-Block-Digest" in headers and headers["WARC-Block-Digest"] != f"sha1:{digest32(block)}":
        raise WarcError("the block's digest is wrong")
    return Record(headers, block)


def page_row(record: Record) -> tuple[int, int, str, str, int | None, bytes | None]:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, payload) of a validated record."""
    h = record.headers
    http, gap, body = record.block.partition(b"\r\n\r\n")
    sizes = [x.split(b":")[1] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
    if not gap or len(sizes) != 1:
        raise WarcError("no HTTP header with one length")
    size, digest, kind = int(sizes[0]), h["WARC-Payload-Digest"].removeprefix("sha1:"), h["WARC-Type"]
    if kind == "response":
        if len(body) != size or digest32(body) != digest:
            raise WarcError("the payload's length or digest is wrong")
        return record.page_id, size, digest, kind, None, body
    if kind != "revisit" or body or h.get("WARC-Profile") != PROFILE:
        raise WarcError("neither a response nor a revisit without payload")
    return record.page_id, size, digest, kind, _page(h["WARC-Refers-To"]), None


def write_archive(records: list[bytes], dictionary_size: int = 1 << 14, sample_bytes: int = 1 << 20, level: int = 3) -> bytes:
    """An archive; its dictionary is trained on its first records, ``sample_bytes`` of them at most."""
    import zstandard as zstd

    sample, room = [], sample_bytes
    for r in records:
        if room <= 0:
            break
        sample.append(r[: min(room, 1 << 15)])
        room -= len(sample[-1])
    raw = b""
    if len(sample) >= 16 and sum(map(len, sample)) >= 8 * dictionary_size:
        try:
            raw = zstd.train_dictionary(dictionary_size, sample, k=200, d=8).as_bytes()
        except zstd.ZstdError:  # samples too alike to learn from
            raw = b""
    if not raw and sample:
        raw = b"".join(sample)[:dictionary_size]
    stored = zstd.ZstdCompressor(level=level).compress(raw)
    made = zstd.ZstdCompressor(level=level, dict_data=zstd.ZstdCompressionDict(raw) if raw else None, write_checksum=True, write_content_size=True)
    return b"".join((struct.pack("<II", DICT_MAGIC, len(stored)), stored, *map(made.compress, records)))


def frame_end(data: memoryview, at: int) -> int:
    """Where the frame that starts at ``at`` ends, from its header and the headers of its blocks."""
    import zstandard as zstd

    try:
        checked = zstd.get_frame_parameters(data[at : at + 18]).has_checksum
        at += zstd.frame_header_size(data[at : at + 18])
    except (zstd.ZstdError, ValueError) as e:
        raise WarcError(f"a damaged frame: {e}") from e
    last = False
    while not last:
        if at + 3 > len(data):
            raise WarcError("the last frame is cut short")
        head = int.from_bytes(data[at : at + 3], "little")
        last, kind, size = head & 1, head >> 1 & 3, head >> 3
        if kind == 3:
            raise WarcError("a damaged frame: a block of reserved kind")
        at += 3 + (1 if kind == 1 else size)  # a run stores one byte
    at += 4 * checked
    if at > len(data):
        raise WarcError("the last frame is cut short")
    return at


def read_archive(data: bytes) -> Iterator[Record]:
    """The records of an archive, one frame each; WarcError where it is cut short or damaged.

    Each frame's end is found first and each is decompressed once, so time grows with the archive.
    """
    import zstandard as zstd

    if len(data) < 8:
        raise WarcError("the archive is too short")
    magic, size = struct.unpack_from("<II", data)
    if magic != DICT_MAGIC or 8 + size > len(data):
        raise WarcError("no dictionary frame leads the archive")
    stored = data[8 : 8 + size]
    raw = zstd.ZstdDecompressor().decompress(stored) if stored[:4] == b"\x28\xb5\x2f\xfd" else stored
    reader = zstd.ZstdDecompressor(dict_data=zstd.ZstdCompressionDict(raw) if raw else None)
    whole, at = memoryview(data), 8 + size
    while at < len(whole):
        if len(whole) - at >= 8 and struct.unpack_from("<I", whole, at)[0] in SKIP_MAGICS:
            at += 8 + struct.unpack_from("<I", whole, at + 4)[0]
            if at > len(whole):
                raise WarcError("a skippable frame is cut short")
            continue
        end = frame_end(whole, at)
        frame = reader.decompressobj()
        try:
            out = frame.decompress(whole[at:end])
        except zstd.ZstdError as e:
            raise WarcError(f"a damaged frame: {e}") from e
        if not frame.eof:
            raise WarcError("the last frame is cut short")
        at = end
        yield parse_record(out)


def plan_records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, sha1, size, refers_to) of ``pages`` (page_id, url, html); refers_to is null for a response.

    Equal payloads are those of equal length, SHA-1 and SHA-256; payloads under ``min_bytes`` are
    all responses.  Null html is empty.  Rows that repeat the smallest page_id of their payload are
    responses too, as are rows without a page_id.  Other columns aren't read.

    Payloads are compared on a table of digests.  The first page of each payload is a pre-aggregated
    minimum, and only rows that differ from it come back to the pages, by their place in the input,
    so no task gets the payloads of a page that very many repeat.
    """
    rows, file, at = numbered(pages)
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    told = rows.select(F.col(file).alias("file"), F.col(at).alias("at"), "page_id", "url", payload.alias("payload"))
    size = F.octet_length("payload").cast("long")
    key = ["sha1", "sha256", "size"]
    slim = told.where(size >= min_bytes).select("file", "at", "page_id", F.unhex(F.sha1("payload")).alias("sha1"), F.unhex(F.sha2("payload", 256)).alias("sha256"), size.alias("size"))
    slim = materialise(slim, "warc-digests")
    firsts = slim.groupBy(*key).agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = materialise(slim.join(firsts, key).where("page_id > first").select("file", "at", F.col("first").alias("refers_to")), "warc-revisits")
    return told.join(again, ["file", "at"], "left").select("page_id", "url", "payload", F.unhex(F.sha1("payload")).alias("sha1"), size.alias("size"), "refers_to")


def write_warcs(pages: DataFrame, folder: str | None = None, min_bytes: int = 0, archive_bytes: int = 16 << 20) -> DataFrame:
    """Write archives of about ``archive_bytes`` (uncompressed) each; returns (file, n_records, folder)."""
    folder = folder or fresh_path(pages.sparkSession, "warc")
    planned = plan_records(pages, min_bytes)

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()

        def files():
            held, load, seq = [], 0, 0

            def flush():
                name = f"part-{part:06d}-{seq:06d}.warc.zst"
                put_file(folder, name, write_archive(held))
                return name, len(held)

            for batch in batches:
                for page, url, payload, sha1, size, refers in zip(*(batch.column(n) for n in ("page_id", "url", "payload", "sha1", "size", "refers_to"))):
                    data = None if refers.is_valid else payload.as_py()
                    held.append(build_record(page.as_py(), url.as_py(), data, base64.b32encode(sha1.as_py()).decode(), size.as_py(), refers.as_py()))
                    load += len(held[-1])
                    if load >= archive_bytes:
                        yield flush()
                        held, load, seq = [], 0, seq + 1
            if held:
                yield flush()

        yield from arrow_batches(files(), pa.schema([("file", pa.string()), ("n_records", pa.int64())]))

    slim = planned.withColumn("payload", F.when(F.col("refers_to").isNull(), F.col("payload")))
    return materialise(slim.mapInArrow(run, "file string, n_records bigint"), "warc-files").withColumn("folder", F.lit(folder))


PAGE = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def read_warcs(files: DataFrame, payloads: bool = False) -> DataFrame:
    """A row per record of the archives listed; ``payloads`` adds the payload column (null in revisits).

    Only files listed are read, so what a lost task left behind isn't.
    """
    import pyarrow as pa

    spark = files.sparkSession
    head = files.select("folder").first()
    wanted = PAGE + ", payload binary" * payloads
    if head is None:
        return spark.createDataFrame([], wanted)
    raw = spark.read.format("binaryFile").load(head["folder"]).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    raw = raw.join(files.select("file"), "file", "left_semi").select("content")
    fields = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
    schema = pa.schema(fields + [("payload", pa.binary())] * payloads)

    def run(batches):
        def rows():
            for batch in batches:
                for content in batch.column("content"):
                    for record in read_archive(content.as_buffer().to_pybytes()):
                        row = page_row(record)
                        yield row if payloads else row[:5]

        yield from arrow_batches(rows(), schema, weight=lambda r: len(r[5] or b"") if payloads else 0)

    return raw.mapInArrow(run, wanted)
