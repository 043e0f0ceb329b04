"""Vector codes: integer codebooks per part of a vector, with entries found by pivots (LAESA).

A vector is cut into equal parts, and each part position has its own codebook. Pivots are chosen once, among a
position's first entries and far from each other; the distance of each part to its pivots is computed once and
kept beside the integers. A round computes the distances between pivots and entries, and |d(x, p) - d(p, e)| is
a lower bound of d(x, e): entries are tried in the order of their bounds, and those whose bound is above the
smallest distance so far are not evaluated at all. Everything is exact: kept distances are rounded down, bounds
take that into account, and evaluations are sums of squared integers.

A round is one map over the table; a task adds up its parts by entry, Spark adds up the tasks, and the driver
gets one number for each component of a codebook.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speechloom.llm.common import staged, with_class

#: A component x counts as floor(SCALE * x).
SCALE = 256
#: Integer components must be smaller: squared distances of 4,096 components then fit in 64 bits.
MOST = 1 << 24
#: Pivots of each part position.
PIVOTS = 4
#: Entries that are evaluated one after another, in the order of their bounds, before the rest is pruned.
ORDERED = 2


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances along the last axis."""
    away = a - b
    return np.einsum("...i,...i->...", away, away)


def roots(values: np.ndarray) -> np.ndarray:
    """Square roots of integers, rounded down; exact."""
    out = np.sqrt(values.astype(np.float64)).astype(np.int64)
    out -= out * out > values
    return out + ((out + 1) * (out + 1) <= values)


def choose_pivots(book: np.ndarray, count: int) -> np.ndarray:
    """Of each position's entries (positions, entries, width): the first, then always the one that is farthest from those chosen."""
    chosen = [np.zeros(len(book), dtype=np.int64)]
    every = np.arange(len(book))
    nearest = squares(book, book[:, :1])
    for _ in range(min(count, book.shape[1]) - 1):
        chosen.append(nearest.argmax(axis=1))
        nearest = np.minimum(nearest, squares(book, book[every, chosen[-1]][:, None]))
    return np.stack([book[every, c] for c in chosen], axis=1)


class Assigner:
    """The nearest entries of parts, under one state of the codebooks."""

    def __init__(self, book: np.ndarray, pivots: np.ndarray) -> None:
        self.book = book
        between = squares(pivots[:, :, None], book[:, None])
        self.low = roots(between)
        self.high = self.low + (self.low * self.low < between)

    def nearest(self, parts: np.ndarray, away: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(entry, squared distance) of parts (n, positions, width), the smallest index of equals, and how many distances were evaluated.

        away holds the rounded-down distances to the pivots (n, positions, pivots), so a true one is below away + 1.
        """
        n, positions, _ = parts.shape
        widest = max(int(away.max(initial=0)), int(self.high.max(initial=0)))
        kind = np.int16 if widest < 32_000 else np.int32
        away, low, high = away.astype(kind), self.low.astype(kind), self.high.astype(kind)
        bound = np.zeros((n, positions, self.book.shape[1]), dtype=kind)
        for k in range(away.shape[2]):
            gap = away[:, :, k, None] - high[None, :, k]
            np.maximum(bound, gap, out=bound)
            np.subtract(low[None, :, k] - 1, away[:, :, k, None], out=gap)
            np.maximum(bound, gap, out=bound)
        flat, at = bound.reshape(n * positions, -1), np.tile(np.arange(positions), n)
        own, row = parts.reshape(n * positions, -1), np.arange(n * positions)
        entry = flat.argmin(axis=1)
        best, held = squares(own, self.book[at, entry]), flat.copy() if flat.shape[1] > 1 else flat
        for _ in range(min(ORDERED, flat.shape[1]) - 1):
            held[row, entry] = np.iinfo(kind).max
            entry = held.argmin(axis=1)
            best = np.minimum(best, squares(own, self.book[at, entry]))
        # an integer bound is at most a distance if it is at most its rounded-down root; equal ones stay, as an entry of lower index may be as near
        open_ = flat <= np.minimum(roots(best), np.iinfo(kind).max).astype(kind)[:, None]
        r, e = np.nonzero(open_)  # at least the nearest of those tried
        d = squares(own[r], self.book[at[r], e])
        begins = np.searchsorted(r, row)
        least = np.minimum.reduceat(d, begins)
        equal = np.flatnonzero(d == least[r])
        first = equal[np.concatenate(([True], np.diff(r[equal]) > 0))]
        return e[first].reshape(n, positions), least.reshape(n, positions), len(d)


def integers(column: pa.Array, dims: int) -> np.ndarray:
    """floor(SCALE * x) of the vectors of a column."""
    values = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)
    if len(values) and np.abs(values).max() >= MOST:
        raise ValueError(f"components must lie between -{MOST // SCALE} and {MOST // SCALE}")
    return values.astype(np.int64).reshape(-1, dims)


def vector_codes(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Per kept row: vec_id, code, error, label_error and codebooks_sha256.

    Rows whose vector is null or empty, or holds null or non-finite components, are left out, and so are vectors
    of another length than that of the first kept row in the order of ids, since their parts compare with none.
    A codebook starts as the parts of the `entries` first kept rows, in the order of id, then of the vector
    where ids repeat; null ids come last. Fewer rows make smaller codebooks. Repeated rows are coded one by one; null labels are a
    label of their own. A length that is no multiple of `parts`, and components of 65,536 or more, raise
    ValueError. An empty table gives an empty result; other columns are not read.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has two hexadecimal digits, so there are 1 to 256 entries")
    x = F.col("vector")
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
    whole = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    rows = rows.where(x.isNotNull() & (F.size(x) > 0) & whole)
    order = [F.asc_nulls_last("vec_id"), F.asc("vector")]
    lengths = [len(r["vector"]) for r in rows.orderBy(*order).limit(1).collect()]  # one row
    dims = lengths[0] if lengths else parts
    if dims % parts:
        raise ValueError(f"vectors of {dims} components can't be cut into {parts} equal parts")
    rows = rows.where(F.size(x) == dims)
    first = rows.orderBy(*order).limit(entries).select("vector").collect() if lengths else []  # at most `entries` rows
    start = integers(pa.array([r["vector"] for r in first], type=pa.list_(pa.float64())), dims)
    book = np.ascontiguousarray(start.reshape(len(first), parts, dims // parts).transpose(1, 0, 2))
    pivots = choose_pivots(book, PIVOTS) if len(first) else book
    ids = {c: rows.schema[c].dataType.simpleString() for c in ("vec_id", "label")}

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = integers(batch.column(2), dims)
            away = roots(squares(own.reshape(len(own), parts, 1, -1), pivots[None]))
            kept = [pa.ListArray.from_arrays(pa.array(np.arange(0, a.size + 1, a.shape[1]), type=pa.int32()), pa.array(a.ravel().astype(np.int32))) for a in (own, away.reshape(len(own), -1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *kept], names=["vec_id", "label", "own", "away"])

    measured = staged(rows.mapInArrow(measure, f"vec_id {ids['vec_id']}, label {ids['label']}, own array<int>, away array<int>"), "codes-measured")

    def arrays(batch: pa.RecordBatch) -> list[np.ndarray]:
        return [batch.column(c).flatten().to_numpy().astype(np.int64).reshape(batch.num_rows, parts, -1) for c in ("own", "away")]

    for _ in range(rounds if len(first) else 0):
        book = next_book(measured, book, pivots, arrays)
    assigner = Assigner(book, pivots) if len(first) else None

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                code, error, _ = assigner.nearest(*arrays(batch))
                names = pa.array([c.tobytes().hex() for c in code.astype(np.uint8)], type=pa.string())
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), names, pa.array(error.sum(axis=1))], names=["vec_id", "label", "code", "error"])

    coded = staged(measured.mapInArrow(encode, f"vec_id {ids['vec_id']}, label {ids['label']}, code string, error long"), "codes-coded")
    key = [F.coalesce(F.col("label").cast("string"), F.lit("")).alias("name"), F.col("label").isNull().alias("none")]
    coded = coded.select("vec_id", "code", "error", *key)
    totals = coded.groupBy("name", "none").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("size"))
    digest = hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()
    return with_class(coded, totals, ["name", "none"], "label_error").select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def next_book(measured: DataFrame, book: np.ndarray, pivots: np.ndarray, arrays) -> np.ndarray:
    """The codebooks after one round: each entry the floored mean of its parts, or itself where it has none."""
    assigner, (positions, entries, width) = Assigner(book, pivots), book.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(book.size, dtype=np.int64), np.zeros(positions * entries, dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                own, away = arrays(batch)
                cell = assigner.nearest(own, away)[0] + np.arange(positions) * entries
                counts += np.bincount(cell.ravel(), minlength=len(counts))
                places = (cell[:, :, None] * width + np.arange(width)).ravel()
                sums += np.bincount(places, weights=own.ravel(), minlength=len(sums)).astype(np.int64)  # below 2**53: exact
        used = np.flatnonzero(np.repeat(counts, width))
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(sums[used]), pa.array(np.repeat(counts, width)[used])], names=["place", "total", "n"])

    found = measured.mapInArrow(add, "place long, total long, n long").groupBy("place").agg(F.sum(F.col("total").cast("decimal(28,0)")).alias("total"), F.sum("n").alias("n"))
    out = book.copy().ravel()
    for r in found.collect():  # a row for each component of the codebooks
        out[r["place"]] = int(r["total"]) // r["n"]
    return out.reshape(book.shape)


#: Fixed values of the statement: 16 parts, 64 entries, 2 rounds.
_NEAREST = """SELECT vec_id, p, arg_min(e, (d, e)) AS e, min(d) AS d FROM (SELECT v.vec_id, v.p, b.e, list_sum(list_transform(list_zip(v.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM part v JOIN {book} b ON b.p = v.p) GROUP BY vec_id, p"""
_NEXT = """SELECT b.p, b.e, coalesce(m.x, b.x) AS x FROM {book} b LEFT JOIN (SELECT p, e, list(t ORDER BY k) AS x FROM (SELECT p, e, k, CASE WHEN s >= 0 THEN s // n ELSE -((n - 1 - s) // n) END AS t FROM (SELECT a.p, a.e, k, sum(v.x[k])::BIGINT AS s, count(*) AS n FROM {near} a JOIN part v ON v.vec_id = a.vec_id AND v.p = a.p CROSS JOIN (SELECT unnest(range(1, 1 + (SELECT max(len(x)) FROM part))) AS k) GROUP BY a.p, a.e, k)) GROUP BY p, e) m ON m.p = b.p AND m.e = b.e"""
ORACLE = f"""WITH kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda v: floor(v::DOUBLE * 256)::BIGINT) AS y, len(embedding) // 16 AS w FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
part AS MATERIALIZED (SELECT vec_id, p, y[p * w + 1 : p * w + w] AS x FROM kept, (SELECT unnest(range(16)) AS p)),
book0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x FROM part WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 64)),
near0 AS MATERIALIZED ({_NEAREST.format(book="book0")}), book1 AS MATERIALIZED ({_NEXT.format(book="book0", near="near0")}),
near1 AS MATERIALIZED ({_NEAREST.format(book="book1")}), book2 AS MATERIALIZED ({_NEXT.format(book="book1", near="near1")}),
near2 AS MATERIALIZED ({_NEAREST.format(book="book2")}),
coded AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM near2 GROUP BY vec_id)
SELECT c.vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) FROM book2) AS codebooks_sha256 FROM coded c JOIN kept k ON k.vec_id = c.vec_id"""
