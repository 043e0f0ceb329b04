"""Durations of WAV files from their chunks; of a file only the chunk headers and the format are read."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame

#: Fixed values of the format: a chunk's header, what is read of a format chunk, plain samples, and the extended format with its sub-format.
CHUNK, FORMAT, PCM, EXTENSIBLE = 8, 40, 1, 0xFFFE
PCM_SUBFORMAT = bytes.fromhex("0100000000001000800000aa00389b71")
#: File systems in which ranges of a file can be read without Spark.
RANGED = ("file", "hdfs", "s3", "s3a", "gs")

Read = Callable[[int, int], bytes]


def chunk_walk(read: Read, length: int) -> tuple[float | None, str | None]:
    """(seconds, error) of a file of `length` bytes; read(at, n) gives up to n bytes from a place.

    Chunks come in any order and number, those of odd size are followed by one byte, and the first data chunk
    after the format counts. Frames are whole ones of the chunk's size over the frame's bytes.
    """

    def number(raw: bytes, at: int, size: int) -> int:
        return int.from_bytes(raw[at : at + size], "little")

    head = read(0, 12)
    if len(head) < 12 or head[:4] != b"RIFF" or head[8:] != b"WAVE":
        return None, "no WAV header"
    at, frame, rate, known = 12, 0, 0, False
    while at + CHUNK <= length:
        name = read(at, CHUNK)
        if len(name) < CHUNK:
            break
        size = number(name, 4, 4)
        if name[:4] == b"fmt ":
            body = read(at + CHUNK, min(size, FORMAT))
            if len(body) < 16:
                return None, "no fmt chunk"
            kind = number(body, 0, 2)
            if kind != PCM and not (kind == EXTENSIBLE and body[24:40] == PCM_SUBFORMAT):
                return None, "unknown format"
            frame, rate, known = number(body, 2, 2) * ((number(body, 14, 2) + 7) // 8), number(body, 4, 4), True
        elif name[:4] == b"data":
            if not known:
                return None, "no fmt chunk"
            if not rate or not frame:
                return None, "invalid frame rate"
            if size > length - at - CHUNK:
                return None, "truncated"
            return size // frame / rate, None
        at += CHUNK + size + size % 2
    return None, "no data chunk" if known else "no fmt chunk"


def content_walk(content: bytes | None, length: int) -> tuple[float | None, str | None]:
    """chunk_walk() of bytes in memory, which may be the beginning of a longer file."""
    content = content or b""
    return chunk_walk(lambda at, n: content[at : at + n], length)


def file_walk(path: str, length: int) -> tuple[float | None, str | None]:
    """chunk_walk() of a file; one that cannot be opened or read has an error."""
    scheme, host, name = re.fullmatch(r"([a-z0-9]+):(?://([^/]*))?(/.*)", path).groups()
    try:
        if scheme == "file":
            store, place = fs.LocalFileSystem(), name
        else:
            store, _ = fs.FileSystem.from_uri(f"{'s3' if scheme == 's3a' else scheme}://{host or ''}/")
            place = name if scheme == "hdfs" else f"{host}{name}"
        with store.open_input_file(place) as file:

            def read(at: int, n: int) -> bytes:
                file.seek(at)
                return file.read(n)

            return chunk_walk(read, length)
    except OSError:
        return None, "unreadable"


def walked(files: DataFrame, walk: Callable[..., tuple[float | None, str | None]], given: str) -> DataFrame:
    """(rec, seconds, error) of rows (rec, length, and the column `given` that walk takes first)."""
    kind = files.schema["rec"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [walk(x, n or 0) for x, n in zip(batch.column(2).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s for s, _ in found], type=pa.float64()), pa.array([e for _, e in found], type=pa.string())], names=["rec", "seconds", "error"])

    return files.select("rec", "length", given).mapInArrow(run, f"rec {kind}, seconds double, error string")


def wav_fields(raw: DataFrame) -> DataFrame:
    """(rec, seconds, error) of rows (rec, length, content): the length of each file, and its content or the beginning that holds its chunk headers."""
    return walked(raw, content_walk, "content")


def wav_files(files: DataFrame, folder: str) -> DataFrame:
    """(rec, seconds, error) of rows (rec, path, length, content) of Spark's list of a folder.

    Where the folder's file system lets tasks read ranges, the content is never loaded, whatever its size. In other
    file systems Spark loads whole files, which ends at 2 GB.
    """
    scheme = re.match(r"([a-z0-9]+):/", folder)
    return walked(files, file_walk, "path") if scheme is None or scheme[1] in RANGED else wav_fields(files)
