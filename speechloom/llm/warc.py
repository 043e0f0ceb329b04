"""WARC archives as seekable Zstandard bundles.

Records are grouped into independent Zstandard frames. A bundle begins with a warcinfo record in a frame of its
own and ends with two skippable frames: the record index, which maps each record's identifier to (frame, offset in
the frame's decompressed bytes), and the seek table of the public seekable format. So an archive is searchable by
itself, wherever it is copied. A bundle is one row of a table (bundle id, archive bytes, index) that Spark
writes to shared storage, so a write is atomic per task, survives lost executors and needs no local disk;
export_bundles() turns rows into .warc.zst files.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speechloom.llm.common import staged, texts, with_class

#: Decompressed bytes of a frame and compressed bytes of a bundle at which a new one begins.
FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 8 << 20
#: Fixed values of the public seekable format: magic numbers of a skippable frame and of the footer.
SKIPPABLE_MAGIC = 0x184D2A5E
FOOTER_MAGIC = 0x8F92EAB1
#: What the frame of the record index begins with.
INDEX_MAGIC = b"record index 1\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
BUNDLES = "bundle_id long, archive binary, record_ids array<string>, frames array<int>, offsets array<long>"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1 of a binary or string column, by DataFrame functions."""
    digest = F.sha1(payload)
    parts = [F.conv(F.substring(digest, 5 * i + 1, 5), 16, 10).cast("int") for i in range(8)]
    return F.concat(*[F.substring(F.lit(BASE32), F.shiftright(p, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for p in parts for s in (15, 10, 5, 0)])


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def write_bundles(pages: DataFrame, min_revisit_bytes: int = 0, level: int = 3, date: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Bundles of one WARC record per page; of equal payloads the smallest id is a response, others revisit it.

    Null payloads are empty. Payloads below min_revisit_bytes are always responses. A null id is never the
    smallest unless all are null; rows that repeat the smallest id are responses too. Null URLs are written
    as empty; line ends, and bytes of URLs that are no UTF-8, are percent-encoded. Record identifiers name page ids, so they are as unique as these. date is every record's
    WARC-Date, by default the time of this call. An empty table gives no bundles; other columns are not read.
    """
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    from_pages = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("payload"))
    hashed = from_pages.withColumn("digest", base32_sha1(F.col("payload")))
    first = hashed.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("size"))
    linked = with_class(hashed, first, ["digest"], "first_id").select("page_id", "url", "payload", "digest", "first_id")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=level).compress
        bundle = TaskContext.get().partitionId() << 40
        archive, sizes, frame, ids, frames, offsets = bytearray(), [], bytearray(), [], [], []

        def close_frame() -> None:
            if frame:
                archive.extend(data := pack(bytes(frame)))
                sizes.append((len(data), len(frame)))
                frame.clear()

        def open_bundle() -> None:
            frame.extend(warcinfo(bundle, date))
            close_frame()

        def close_bundle() -> pa.RecordBatch:
            nonlocal bundle
            close_frame()
            archive.extend(record_index(ids, frames, offsets))
            archive.extend(seek_table(sizes))
            out = pa.RecordBatch.from_pydict({"bundle_id": [bundle], "archive": [bytes(archive)], "record_ids": [list(ids)], "frames": [list(frames)], "offsets": [list(offsets)]}, schema=pa.schema([("bundle_id", pa.int64()), ("archive", pa.binary()), ("record_ids", pa.list_(pa.string())), ("frames", pa.list_(pa.int32())), ("offsets", pa.list_(pa.int64()))]))
            bundle += 1
            for x in (archive, sizes, ids, frames, offsets):
                x.clear()
            return out

        for batch in batches:
            page_ids, digests, firsts = (batch.column(i).to_pylist() for i in (0, 3, 4))
            for page, url, payload, digest, first_id in zip(page_ids, texts(batch.column(1)), texts(batch.column(2)), digests, firsts, strict=True):
                if not sizes:
                    open_bundle()
                revisit = len(payload) >= min_revisit_bytes and page != first_id
                record = warc_record(page, url, payload, digest, first_id if revisit else None, date)
                ids.append(record_id(page))
                frames.append(len(sizes))
                offsets.append(len(frame))
                frame.extend(record)
                if len(frame) >= FRAME_BYTES:
                    close_frame()
                if len(archive) >= BUNDLE_BYTES:
                    yield close_bundle()
        if ids:
            yield close_bundle()

    return linked.mapInArrow(write, BUNDLES)


def framed(fields: list[tuple[str, bytes]], body: bytes) -> bytes:
    """A record of these header fields and this block."""
    lines = [b"WARC/1.1", *[name.encode() + b": " + value for name, value in fields], b"Content-Length: %d" % len(body), b"", b""]
    return b"\r\n".join(lines) + body + b"\r\n\r\n"


def warcinfo(bundle: int, date: str) -> bytes:
    """The record that describes a bundle."""
    fields = [("WARC-Type", b"warcinfo"), ("WARC-Record-ID", b"<urn:bundle:%d>" % bundle), ("WARC-Date", date.encode()), ("Content-Type", b"application/warc-fields")]
    return framed(fields, b"software: speechloom\r\nformat: WARC File Format 1.1\r\n")


def warc_record(page: int | None, url: bytes, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One WARC/1.1 record of an HTTP response. A revisit names the response it repeats and holds the HTTP header alone."""
    fields = [
        ("WARC-Type", b"response" if refers_to is None else b"revisit"),
        ("WARC-Record-ID", record_id(page).encode()),
        ("WARC-Date", date.encode()),
        ("WARC-Target-URI", header_value(url)),
        ("WARC-Payload-Digest", b"sha1:" + digest.encode()),
        ("Content-Type", b"application/http; msgtype=response"),
    ]
    if refers_to is not None:
        fields += [("WARC-Profile", b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(refers_to).encode())]
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    return framed(fields, head + payload if refers_to is None else head)


def header_value(url: bytes) -> bytes:
    """A URL as a header line holds it: line ends and bytes that are no UTF-8 are percent-encoded."""
    plain = "".join(f"%{ord(c) - 0xDC00:02X}" if "\udc80" <= c <= "\udcff" else c for c in url.decode("utf-8", "surrogateescape"))
    return plain.replace("\r", "%0D").replace("\n", "%0A").encode()


def record_index(ids: list[str], frames: list[int], offsets: list[int]) -> bytes:
    """Skippable frame that maps each record's identifier to its frame and its offset there; readers of Zstandard pass over it."""
    import zstandard

    content = INDEX_MAGIC + zstandard.ZstdCompressor().compress("".join(f"{i} {f} {o}\n" for i, f, o in zip(ids, frames, offsets, strict=True)).encode())
    return struct.pack("<II", SKIPPABLE_MAGIC, len(content)) + content


def indexed_records(archive: bytes) -> list[tuple[str, int, int]]:
    """(identifier, frame, offset) of the records of an archive, from the frame behind those that its seek table names."""
    import zstandard

    start = sum(size for _, size in frame_spans(archive))
    magic, length = struct.unpack("<II", archive[start : start + 8])
    size = length + 8
    if magic != SKIPPABLE_MAGIC or archive[start + 8 : start + 8 + len(INDEX_MAGIC)] != INDEX_MAGIC:
        raise ValueError("the archive has no record index")
    lines = zstandard.ZstdDecompressor().decompress(archive[start + 8 + len(INDEX_MAGIC) : start + size]).decode().splitlines()
    return [(name, int(frame), int(offset)) for name, frame, offset in (line.rsplit(" ", 2) for line in lines)]


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    """Skippable frame: (compressed, decompressed) size per frame, then the footer."""
    entries = b"".join(struct.pack("<II", c, d) for c, d in sizes)
    content = entries + struct.pack("<IBI", len(sizes), 0, FOOTER_MAGIC)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(content)) + content


def frame_spans(archive: bytes) -> list[tuple[int, int]]:
    """(offset, compressed size) of each frame, from the footer's seek table."""
    n, _, magic = struct.unpack("<IBI", archive[-9:])
    if magic != FOOTER_MAGIC:
        raise ValueError("the archive has no seek table")
    entries = struct.unpack(f"<{2 * n}I", archive[-9 - 8 * n : -9])
    spans, at = [], 0
    for size in entries[::2]:
        spans.append((at, size))
        at += size
    return spans


def parse_records(data: bytes, at: int = 0) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record in decompressed bytes, from an offset on."""
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        fields = dict(line.split(": ", 1) for line in data[at:end].decode().split("\r\n")[1:])
        body = end + 4
        at = body + int(fields["Content-Length"])
        yield fields, data[body:at]
        at += 4


def read_record(archive: bytes, frame: int, offset: int) -> tuple[dict[str, str], bytes]:
    """One record by its index entry: only its frame is decompressed."""
    import zstandard

    start, size = frame_spans(archive)[frame]
    data = zstandard.ZstdDecompressor().decompress(archive[start : start + size])
    return next(parse_records(data, offset))


def described(fields: dict[str, str], block: bytes) -> tuple[int | None, int, str, str, int | None]:
    """A row of RECORDS from one record; a response's payload must have the length and the digest that it states."""

    def number(text: str | None) -> int | None:
        inner = text[len("<urn:page:") : -1] if text else "null"
        return None if inner == "null" else int(inner)

    head, _, payload = block.partition(b"\r\n\r\n")
    length = int(next(line[16:] for line in head.split(b"\r\n") if line.startswith(b"Content-Length: ")))
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (length, digest) != (len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()):
        raise ValueError(f"{fields['WARC-Record-ID']}: the payload differs from its length or digest")
    return number(fields["WARC-Record-ID"]), length, digest, fields["WARC-Type"], number(fields.get("WARC-Refers-To"))


def read_bundles(bundles: DataFrame) -> DataFrame:
    """RECORDS of all bundles: every record is opened by its (frame, offset) in the index, one frame at a time.

    ValueError if the record there has another identifier, or a payload that differs from its length or digest.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        for batch in batches:
            for archive, ids, frames, offsets in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                spans, wanted = frame_spans(archive), {}
                for entry in zip(frames, offsets, ids, strict=True):
                    wanted.setdefault(entry[0], []).append(entry[1:])
                for frame, entries in wanted.items():
                    start, size = spans[frame]
                    data, rows = unpack(archive[start : start + size]), []
                    for offset, name in entries:
                        fields, block = next(parse_records(data, offset))
                        if fields["WARC-Record-ID"] != name:
                            raise ValueError(f"{name} is not where the index says")
                        rows.append(described(fields, block))
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return bundles.select("archive", "record_ids", "frames", "offsets").mapInArrow(read, RECORDS)


def archive_round_trip(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """Write all pages to a bundle table in shared storage, then read every record back from it."""
    return read_bundles(staged(write_bundles(pages, min_revisit_bytes), "warc"))


def export_bundles(bundles: DataFrame, folder: str) -> list[str]:
    """Write bundles as .warc.zst files, one at a time, to a folder the driver can write to."""
    names = []
    for row in bundles.select("bundle_id", "archive").toLocalIterator():
        names.append(f"{folder}/{row.bundle_id:016x}.warc.zst")
        with open(names[-1], "wb") as out:
            out.write(row.archive)
    return names


ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body, sha1(coalesce(html, '')) AS hex FROM pages),
d AS (
  SELECT page_id, octet_length(body) AS payload_bytes,
    list_reduce([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((('0x' || substr(hex, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31))::BIGINT, 1) FOR i IN range(32)], lambda a, b: a || b) AS payload_digest
  FROM p
), f AS (SELECT payload_digest, min(page_id) AS first_id FROM d GROUP BY payload_digest)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS NOT DISTINCT FROM first_id THEN NULL ELSE first_id END AS refers_to
FROM d JOIN f USING (payload_digest)
"""
