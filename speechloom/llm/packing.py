"""Vector bin packing of training examples.

Each example demands a vector (tokens, segments, loss-bearing tokens); a sequence offers a capacity in
each dimension. Bins are filled one after another: of the examples that still fit, the one whose scaled
demand has the largest dot product with the scaled remaining capacity goes in (the dot-product heuristic
for vector bin packing). Work is per task over blocks of examples: no shuffle, memory bounded by a block.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from speechloom.llm.common import texts
from speechloom.llm.wordbpe import encoder

#: Examples that are packed together; what is left open moves on to the next block.
BLOCK = 2048
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def dot_product_bins(demand: np.ndarray, capacity: np.ndarray, cut: bool = False) -> list[list[tuple[int, int, int]]]:
    """Bins of (example, first token, tokens), the last of which may be open.

    demand is (n, 3): tokens, segments, loss-bearing tokens. With `cut`, an example that does not fit may
    be cut so that its head fills the bin exactly; a cut piece of m tokens is one segment and bears m - 1
    losses, as its first token has no context. Ties go to the earliest example.
    """
    left = demand.astype(np.float64)
    if not cut and len(left) and (left > capacity).any():
        raise ValueError("an example exceeds the capacity of an empty sequence")
    begun = np.zeros(len(left), dtype=np.int64)
    alive = np.argsort(-left[:, 0], kind="stable")
    bins: list[list[tuple[int, int, int]]] = []
    room, held = capacity.astype(np.float64), []
    while len(alive):
        wants = left[alive]
        gain = (wants / capacity) @ (room / capacity)
        fits = (wants <= room).all(axis=1)
        if fits.any():
            at = int(np.where(fits, gain, -1.0).argmax())
            k = alive[at]
            held.append((int(k), int(begun[k]), int(left[k, 0])))
            room = room - left[k]
            alive = np.delete(alive, at)
            continue
        m = int(min(room[0], room[2] + 1))
        if cut and m > 0 and room[1] >= 1:
            k = alive[int(gain.argmax())]
            held.append((int(k), int(begun[k]), m))
            begun[k] += m
            left[k] = (left[k, 0] - m, 1, max(left[k, 0] - m - 1, 0))
        bins.append(held)
        room, held = capacity.astype(np.float64), []
    if held:
        bins.append(held)
    return bins


def powers_of_two(bin_: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """Cut an open bin into bins whose sizes are the powers of two of its total: none of them needs padding."""
    total, out, pieces = sum(m for _, _, m in bin_), [], list(reversed(bin_))
    while total:
        room = 1 << (total.bit_length() - 1)
        total -= room
        part = []
        while room:
            k, start, m = pieces.pop()
            part.append((k, start, min(m, room)))
            if m > room:
                pieces.append((k, start + room, m - room))
            room -= min(m, room)
        out.append(part)
    return out


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, max_segments: int = 256, max_loss: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode documents, append end_id and pack their ids into sequences; returns PACKED.

    A document's full sequences are cut off first; the rests are packed by dot_product_bins() under
    limits on tokens, segments and loss-bearing tokens (each id but the first of a piece bears a loss).
    Null and empty texts are the single id end_id. Null, repeated ids and repeated rows are packed like
    any other row; an empty table gives an empty result; other columns are not read. Sequence ids hold
    the task's number, so a recomputed task gives the same ids.
    """
    size = np.array([capacity, max_segments, max_loss])
    whole = min(capacity, max_loss + 1)
    end = int(end_id).to_bytes(4, "little")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        sequence = TaskContext.get().partitionId() << 40
        pending: list[tuple] = []

        def emit(bins: list[list[tuple[int, int, int]]], items: list[tuple]) -> pa.RecordBatch:
            nonlocal sequence
            rows = []
            for one in bins:
                offset = 0
                for k, start, m in one:
                    doc, base, ids, total = items[k]
                    rows.append((doc, base + start, m, zlib.crc32(ids[4 * start : 4 * (start + m)]), total, sequence, offset))
                    offset += m
                sequence += 1
            columns = zip(*rows, strict=True) if rows else [[]] * 7
            return pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in columns], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        def demands() -> np.ndarray:
            n = np.array([len(ids) // 4 for _, _, ids, _ in pending], dtype=np.int64).reshape(-1)
            return np.stack([n, np.ones_like(n), np.maximum(n - 1, 0)], axis=1)

        for batch in batches:
            full = []
            for doc, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                ids = encode(text) + end
                total = len(ids) // 4
                cut = total - total % whole
                full += [(doc, at, ids[4 * at : 4 * (at + whole)], total) for at in range(0, cut, whole)]
                if cut < total:
                    pending.append((doc, cut, ids[4 * cut :], total))
            if full:
                yield emit([[(k, 0, len(x[2]) // 4)] for k, x in enumerate(full)], full)
            if len(pending) >= BLOCK:
                bins = dot_product_bins(demands(), size, cut=True)
                done = bins.pop() if sum(m for _, _, m in bins[-1]) < whole else []
                yield emit(bins, pending)
                pending = [(pending[k][0], pending[k][1] + s, pending[k][2][4 * s : 4 * (s + m)], pending[k][3]) for k, s, m in done]
        if pending:
            bins = dot_product_bins(demands(), size, cut=True)
            last = bins.pop()
            yield emit(bins + powers_of_two(last), pending)

    return docs.select(id_col, text_col).mapInArrow(pack, PACKED)


def pack_examples(examples: DataFrame, capacity: int, max_segments: int, max_loss: int, id_col: str = "example_id", tokens_col: str = "n_tokens", loss_col: str = "n_loss") -> DataFrame:
    """Pack whole instruction examples by their sizes: id, sequence_id, n_tokens, n_loss.

    Null sizes count as 0. An example above a limit raises ValueError: it has to be cut first. Null and repeated ids and
    repeated rows are packed one by one; an empty table gives an empty result; other columns are not read. A task packs
    blocks of BLOCK examples and takes the emptiest bin of each block on to the next one, so it ends with one open bin.
    """
    size = np.array([capacity, max_segments, max_loss])
    key = examples.schema[id_col].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << 40
        ids, tokens, loss = None, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

        def emit(bins: list[list[tuple[int, int, int]]]) -> pa.RecordBatch:
            nonlocal sequence
            order = [k for one in bins for k, _, _ in one]
            of = np.repeat(np.arange(sequence, sequence + len(bins)), [len(one) for one in bins])
            sequence += len(bins)
            return pa.RecordBatch.from_arrays([ids.take(pa.array(order, type=pa.int64())), pa.array(of, type=pa.int64()), pa.array(tokens[order], type=pa.int64()), pa.array(loss[order], type=pa.int64())], names=["id", "sequence_id", "n_tokens", "n_loss"])

        def bins() -> list[list[tuple[int, int, int]]]:
            return dot_product_bins(np.stack([tokens, np.ones_like(tokens), loss], axis=1), size)

        for batch in batches:
            ids = batch.column(0) if ids is None else pa.concat_arrays([ids, batch.column(0)])
            more = [np.array([v or 0 for v in batch.column(i).to_pylist()], dtype=np.int64) for i in (1, 2)]
            tokens, loss = np.concatenate([tokens, more[0]]), np.concatenate([loss, more[1]])
            if len(tokens) >= BLOCK:
                found = bins()
                open_ = min(range(len(found)), key=lambda k: sum(tokens[j] for j, _, _ in found[k]))
                left = [k for k, _, _ in found.pop(open_)]
                yield emit(found)
                ids, tokens, loss = ids.take(pa.array(left, type=pa.int64())), tokens[left], loss[left]
        if len(tokens):
            yield emit(bins())

    return examples.select(id_col, tokens_col, loss_col).mapInArrow(pack, f"id {key}, sequence_id long, n_tokens long, n_loss long")
