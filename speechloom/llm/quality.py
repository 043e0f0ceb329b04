"""Supervised subword embeddings: a document is the mean of hashed word and character n-gram vectors.

The vectors and the softmax layer are learned by numpy stochastic gradient descent inside one task, on a
sample of labelled rows whose size is a parameter; scoring covers every whole text. Because a document
vector is a mean and the output layer is linear, the layer is folded into one number per hash bucket after
training (its size is a constant), and scoring a text is one gather and one sum.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speechloom.llm.common import IS_SPACE, LOWER, blocks, mix, texts, word_hashes

#: Hash buckets (a power of two), vector size, and bytes of the character n-grams.
BUCKETS = 1 << 18
DIM = 12
NGRAMS = (3, 4)
#: Bucket of the word pairs that are one word twice.
AGAIN = 1
#: Labelled documents that training may use; their whole texts count.
MAX_TRAIN = 6000
EPOCHS = 4
RATE = 0.4


def features(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and buckets of the words and character n-grams of bytes that begin and end with a space.

    n-grams lie inside a word or include the space at one or both of its ends. A word that repeats the one
    before it has the bucket AGAIN besides, whichever word it is.
    """
    data = LOWER[data]
    space = IS_SPACE[data]
    at, out = [], []
    words, starts, _ = word_hashes(data)
    again = 1 + np.flatnonzero(words[1:] == words[:-1])
    at += [starts, starts[again]]
    out += [words & np.uint64(BUCKETS - 1), np.full(len(again), AGAIN, dtype=np.uint64)]
    wide = data.astype(np.uint64)
    for n in NGRAMS:
        m = len(data) - n + 1
        if m <= 0:
            continue
        code = np.full(m, n, dtype=np.uint64)
        split = np.zeros(m, dtype=bool)
        for i in range(n):
            code = (code << np.uint64(8)) | wide[i : i + m]
            if 0 < i < n - 1:
                split |= space[i : i + m]
        keep = np.flatnonzero(~split)
        at.append(keep)
        out.append(mix(code[keep]) & np.uint64(BUCKETS - 1))
    return np.concatenate(at), np.concatenate(out).astype(np.int64)


def bag(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a whole text and the share of each."""
    found = [np.unique(features(np.frombuffer(b" " + part + b" ", dtype=np.uint8))[1], return_counts=True) for _, parts in blocks([text]) for _, part in parts]
    n = np.bincount(np.concatenate([x[0] for x in found]), weights=np.concatenate([x[1] for x in found]), minlength=1)
    ids = np.flatnonzero(n).astype(np.int32)
    return ids, (n[ids] / max(n.sum(), 1)).astype(np.float32)


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights per bucket and bias of the log odds of label 1; all 0 where one class is missing."""
    if not len(labels) or labels.min() == labels.max():
        prior = (labels.sum() + 0.5) / (len(labels) + 1)
        return np.zeros(BUCKETS, dtype=np.float32), float(np.log(prior / (1 - prior)))
    draw = np.random.default_rng(seed)
    vectors = ((draw.random((BUCKETS, DIM), dtype=np.float32) - 0.5) / DIM).astype(np.float32)
    layer, bias = np.zeros((DIM, 2), dtype=np.float32), np.zeros(2, dtype=np.float32)
    done, total = 0, EPOCHS * len(labels)
    for _ in range(EPOCHS):
        for k in draw.permutation(len(labels)):
            ids, share = bags[k]
            hidden = share @ vectors[ids] if len(ids) else np.zeros(DIM, dtype=np.float32)
            odds = hidden @ layer + bias
            p = np.exp(odds - odds.max())
            p /= p.sum()
            p[int(labels[k])] -= 1
            rate = np.float32(RATE * (1 - done / total))
            back = layer @ p
            layer -= rate * np.outer(hidden, p)
            bias -= rate * p
            if len(ids):  # scaled by the number of buckets, else a mean over thousands hardly moves its vectors
                vectors[ids] -= (rate * min(len(ids), 50)) * share[:, None] * back[None, :]
            done += 1
    weights = vectors @ (layer[:, 1] - layer[:, 0])
    return weights.astype(np.float32), float(bias[1] - bias[0])


def sample_labelled(docs: DataFrame, labels: DataFrame, usable: Column, max_train: int, label_col: str) -> DataFrame:
    """At most max_train labelled texts, chosen by a hash of their ids: (doc_id, text, label).

    Null labels and ids are left out; where an id has several labels, the largest counts. Where more rows than
    max_train are left because ids repeat, those first in the order of ids' and texts' hashes are taken; equal rows
    are as good as each other. Empty tables give no sample, other columns are not read.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull() & usable)
    few = known.groupBy("doc_id").agg(F.max(label_col).cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    # max_train rows of 12 bytes: the broadcast has a fixed bound
    found = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id")
    return found.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"), "text").limit(max_train)


def fit(sample: DataFrame) -> tuple[np.ndarray, float]:
    """Train on the bounded sample inside one task; only the folded weights come back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(doc, int(label > 0), bag(text)) for b in batches for doc, text, label in zip(b.column(0).to_pylist(), texts(b.column(1)), b.column(2).to_pylist(), strict=True)]
        rows.sort(key=lambda r: (*r[:2], len(r[2][0])))  # the order of arrival does not count
        weights, bias = train([r[2] for r in rows], np.array([r[1] for r in rows], dtype=np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()], type=pa.binary()), pa.array([bias])], names=["weights", "bias"])

    row = sample.select("doc_id", "text", "label").coalesce(1).mapInArrow(run, "weights binary, bias double").first()
    if row is None:  # no labelled row, no task
        return train([], np.zeros(0, dtype=np.int64))
    return np.frombuffer(row["weights"], dtype=np.float32), row["bias"]


def score_quality(docs: DataFrame, weights: np.ndarray, bias: float, keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """Probability of label 1 for every whole text, in the column `name` beside the columns named in keep.

    Null and empty texts have no n-grams but the one of two spaces that frames them; they get a score like
    any text. Repeated rows and null ids are scored one by one.
    """
    model = docs.sparkSession.sparkContext.broadcast((weights, bias))  # BUCKETS floats: a constant size
    keep = keep or ["doc_id"]
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    text_at = keep.index("text") if "text" in keep else len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, base = model.value
        for batch in batches:
            values = texts(batch.column(text_at))
            sums, counts = np.zeros(len(values)), np.zeros(len(values))
            for _, parts in blocks(values):
                data = np.frombuffer(b"".join(b" " + p + b" " for _, p in parts), dtype=np.uint8)
                ends = np.cumsum([len(p) + 2 for _, p in parts])
                at, found = features(data)
                owner = np.searchsorted(ends, at, side="right")
                # an n-gram over the seam of two texts has the two spaces of the seam inside, so it is no feature
                rows = np.array([row for row, _ in parts])
                sums += np.bincount(rows[owner], weights=table[found], minlength=len(values))
                counts += np.bincount(rows[owner], minlength=len(values))
            score = 1 / (1 + np.exp(-np.clip(sums / np.maximum(counts, 1) + base, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(score)], names=[*keep, name])

    return docs.select(*keep, *[] if "text" in keep else ["text"]).mapInArrow(run, f"{fields}, `{name}` double")
