"""Helpers that every operator of this subpackage shares: tables, shared scratch space, Arrow texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from speechloom.sources.scratch import scratch, staged  # noqa: F401  (operators take them from here)

#: Rows of one Arrow batch; with texts of a few kilobytes a batch stays at a few megabytes.
BATCH_ROWS = 512
#: Bytes of text that are worked on as one numpy block.
BLOCK_BYTES = 1 << 19
#: A group with 1 / HEAVY of all rows is heavy: there are at most HEAVY of these, which bounds what is broadcast.
HEAVY = 10_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one input table. Arrow batches are kept small, since single texts may be long, unless the session says how large."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":  # Spark's default
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """The name, lengthened until no column of df has it, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_class(rows: DataFrame, classes: DataFrame, keys: list[str], *wanted: str) -> DataFrame:
    """rows with the columns `wanted` of their class, by an equi-join on keys; classes have size, their number of rows.

    Rows of heavy classes are joined by a broadcast of these classes, at most HEAVY, so that copies of one text
    do not meet in one task.
    """
    total = classes.agg(F.sum("size").alias("__total"))
    marked = classes.crossJoin(F.broadcast(total)).withColumn("__heavy", F.col("size") * HEAVY >= F.col("__total"))  # one row of totals
    own = [F.col(c).alias(f"__{c}") for c in wanted]
    near = rows.join(F.broadcast(marked.where("__heavy").select(*keys, *own, F.lit(True).alias("__heavy"))), keys, "left")
    far = near.where("__heavy is null").select(*rows.columns).join(marked.where("not __heavy").select(*keys, *own), keys)
    out = [*rows.columns, *[f"__{c}" for c in wanted]]
    both = near.where("__heavy").select(*out).unionByName(far.select(*out))
    return both.withColumnsRenamed({f"__{c}": c for c in wanted})


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return [v or b"" for v in column.cast(pa.binary()).to_pylist()]


def blocks(values: list[bytes], limit: int = BLOCK_BYTES) -> Iterator[tuple[int, list[tuple[int, bytes]]]]:
    """Group texts into blocks of about `limit` bytes: (first row, [(row, part of its text), ...]).

    A text above the limit is cut behind white space where it has any, so words stay whole
    unless one word alone is longer than the limit.
    """
    held: list[tuple[int, bytes]] = []
    size = 0
    for row, value in enumerate(values):
        at = 0
        while True:
            part = value[at : at + limit]
            if at + limit < len(value):
                cut = max(part.rfind(b" "), part.rfind(b"\n")) + 1
                part = part[: cut or limit]
            if held and size + len(part) > limit:
                yield held[0][0], held
                held, size = [], 0
            held.append((row, part))
            size += len(part)
            at += len(part)
            if at >= len(value):
                break
    if held:
        yield held[0][0], held


#: Bytes that separate words: space and 0x09 to 0x0D.
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE_CODES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: dict[str, np.ndarray] = {}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, 2 * BLOCK_BYTES)
        for key, base in (("up", _BASE), ("down", _BASE_INVERSE)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[key] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixing step (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hash, start and end of each white-space separated word of a byte array."""
    if not len(data):
        none = np.zeros(0, dtype=np.int64)
        return none.astype(np.uint64), none, none
    inside = ~IS_SPACE[data]
    edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    up, down = _power_table(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE_CODES[data] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)), starts, ends
