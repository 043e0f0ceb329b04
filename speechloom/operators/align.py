"""Word alignment: edit distance, operations, and what follows from them."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from math import isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

#: Characters that stand for the words of a short pair.
_FIRST, _LAST = 0xE000, 0xF8FF
_SIGNS = "".join(map(chr, range(_FIRST, _LAST + 1)))
#: Words of a pair, of both sides, up to which the built-in distance serves.
SHORT_PAIR = 400
#: Cells of the table of costs that are held at once for one pair.
MOST_CELLS = 1 << 22


def word_distance(ref: Column, hyp: Column) -> Column:
    """Word-level edit distance; null arrays count as empty.

    In short pairs each distinct word becomes one private-use character, and the built-in distance serves; longer pairs
    go to a function of bit vectors. Short ones hand nulls to it.
    """
    ref, hyp = (F.coalesce(x, F.array().cast("array<string>")) for x in (ref, hyp))
    long = F.size(ref) + F.size(hyp) > SHORT_PAIR

    def distance(pair: Column) -> Column:
        def spelled(words: Column) -> Column:
            return F.array_join(F.transform(words, lambda w: F.substring(F.lit(_SIGNS), F.array_position(pair["known"], w).cast("int"), F.lit(1))), "")

        return F.levenshtein(spelled(pair["ref"]), spelled(pair["hyp"])).cast("long")

    # an array of one pair, so that the distinct words are found once and not for each word
    one = F.array(F.struct(ref.alias("ref"), hyp.alias("hyp"), F.array_distinct(F.concat(ref, hyp)).alias("known")))
    short = F.when(~long, F.get(F.transform(one, distance), F.lit(0)))
    return F.coalesce(short, long_distances(F.when(long, ref), F.when(long, hyp)))


def bit_distance(ref: list[str], hyp: list[str]) -> int:
    """Word-level edit distance by bit vectors: a column of the table of costs is two integers of a bit per word of ref.

    The bits say where the cost rises and where it falls by one from a word to the next, so a word of hyp takes a few
    operations on len(ref) / 64 machine words. What both sides begin and end with is left out.
    """
    n, m = len(ref), len(hyp)
    begin = next((k for k in range(min(n, m)) if ref[k] != hyp[k]), min(n, m))
    end = next((k for k in range(min(n, m) - begin) if ref[n - 1 - k] != hyp[m - 1 - k]), min(n, m) - begin)
    ref, hyp = ref[begin : n - end], hyp[begin : m - end]
    if not ref or not hyp:
        return len(ref) + len(hyp)
    places: dict[str, list[int]] = {}
    for k, w in enumerate(ref):
        places.setdefault(w, []).append(k)
    where = {w: bits_at(places[w], len(ref)) for w in places.keys() & set(hyp)}
    whole, last = (1 << len(ref)) - 1, 1 << (len(ref) - 1)
    rises, falls, cost = whole, 0, len(ref)
    for w in hyp:
        same = where.get(w, 0)
        flat = (((same & rises) + rises) ^ rises) | same | falls  # where the diagonal step is free, or a fall goes on
        up = falls | (whole & ~(flat | rises))
        down = rises & flat
        cost += bool(up & last) - bool(down & last)
        up, down = (up << 1) | 1, down << 1
        rises, falls = (down | (whole & ~(flat | up))) & whole, up & flat & whole
    return cost


def bits_at(places: list[int], size: int) -> int:
    out = np.zeros(size, dtype=np.uint8)
    out[places] = 1
    return int.from_bytes(np.packbits(out, bitorder="little").tobytes(), "little")


@F.pandas_udf(LongType())
def long_distances(ref: pd.Series, hyp: pd.Series) -> pd.Series:
    """bit_distance() of the pairs that are not null."""
    return pd.Series([None if r is None else bit_distance(list(r), list(h)) for r, h in zip(ref, hyp, strict=True)], dtype="Int64")


def alignment_path(ref: Sequence, hyp: Sequence) -> str:
    """Operations C, S, D, I from left to right; on ties equal words, then S, then D, then I, from the end.

    The table of costs is two bits a cell: whether the diagonal step to it is free, and whether the cost rises from the
    word of ref before. Of a large pair only the state before each band of columns is kept, and a band is worked out
    again on the way back: memory grows with the longer text times the root of the other. Equal words at the end are
    correct whatever is before them.
    """
    n, m = len(ref), len(hyp)
    end = next((k for k in range(min(n, m)) if ref[n - 1 - k] != hyp[m - 1 - k]), min(n, m))
    n, m = n - end, m - end
    where: dict = {}
    for k in range(n):
        where[ref[k]] = where.get(ref[k], 0) | 1 << k
    band = max(m, 1) if (n + 1) * (m + 1) <= MOST_CELLS else isqrt(m) + 1
    kept = {0: ((1 << n) - 1, 0)}  # before each band, where the costs of a column rise and fall
    for j in range(band, m, band):
        kept[j] = cost_columns(where, hyp[j - band : j], n, *kept[j - band])[2]
    i, j, first, out = n, m, m, []
    while i and j:
        if j <= first:  # go on in the band to the left
            first = (j - 1) // band * band
            free, rises, _ = cost_columns(where, hyp[first:j], n, *kept[first])
        if ref[i - 1] == hyp[j - 1]:
            out.append("C")
            i, j = i - 1, j - 1
        elif not free[j - 1 - first] >> (i - 1) & 1:
            out.append("S")
            i, j = i - 1, j - 1
        elif rises[j - 1 - first] >> (i - 1) & 1:
            out.append("D")
            i -= 1
        else:
            out.append("I")
            j -= 1
    return "D" * i + "I" * j + "".join(reversed(out)) + "C" * end


def cost_columns(where: dict, hyp: Sequence, n: int, rises: int, falls: int) -> tuple[list[int], list[int], tuple[int, int]]:
    """The bits of the columns of the words of hyp, and the state behind them; where: at which of n places of ref a word is.

    A bit of the first list says that the cost is that of the diagonal neighbour, one of the second that it is the cost of
    the word of ref before and one more. rises and falls are the state of the column before.
    """
    whole = (1 << n) - 1
    free, up = [], []
    for w in hyp:
        same = where.get(w, 0)
        flat = ((((same & rises) + rises) ^ rises) | same | falls) & whole
        right = ((falls | (whole & ~(flat | rises))) << 1) | 1
        left = (rises & flat) << 1
        rises, falls = (left | ~(flat | right)) & whole, right & flat
        free.append(flat)
        up.append(rises)
    return free, up, (rises, falls)


@F.arrow_udf(StringType())
def edit_operations(ref: pa.Array, hyp: pa.Array) -> pa.Array:
    """One operation string per pair of word arrays; null arrays count as empty.

    Words become numbers for the whole batch at once, so that only one pair's are Python objects at a time.
    """
    words = pa.concat_arrays([ref.flatten(), hyp.flatten()]).dictionary_encode(null_encoding="encode").indices.to_numpy()
    ends = [np.cumsum([0, *pc.fill_null(pc.list_value_length(x), 0).to_pylist()]).tolist() for x in (ref, hyp)]
    sides = words[: ends[0][-1]], words[ends[0][-1] :]
    cut = [lambda k, side=side, at=at: side[at[k] : at[k + 1]].tolist() for side, at in zip(sides, ends, strict=True)]
    return pa.array([alignment_path(cut[0](k), cut[1](k)) for k in range(len(ref))], type=pa.string())


def with_operations(pairs: DataFrame) -> DataFrame:
    """pairs (clip, ref, hyp, ...) with the column ops."""
    return pairs.withColumn("ops", edit_operations("ref", "hyp"))


def operation_counts(ops: Column) -> dict[str, Column]:
    """Numbers of substitutions, deletions, insertions and correct words of an operation string."""
    names = {"substitutions": "S", "deletions": "D", "insertions": "I", "correct": "C"}
    return {name: (F.length(ops) - F.length(F.replace(ops, F.lit(sign)))).cast("long") for name, sign in names.items()}


@F.arrow_udf(StructType([StructField(c, ArrayType(IntegerType())) for c in ("i", "j")]))
def words_used(ops: pa.Array) -> pa.Array:
    """How many words of ref (i) and of hyp (j) are used up by each operation of a string."""
    ops = pc.fill_null(ops, "")
    sizes = pc.binary_length(ops).to_numpy()
    ends = np.concatenate([[0], np.cumsum(sizes)])
    signs = np.frombuffer("".join(ops.to_pylist()).encode(), dtype=np.uint8)

    def counted(other: str) -> pa.Array:
        upto = np.concatenate([[0], np.cumsum(signs != ord(other))])  # over all strings of the batch
        own = upto[1:] - np.repeat(upto[ends[:-1]], sizes)
        return pa.ListArray.from_arrays(pa.array(ends, type=pa.int32()), pa.array(own, type=pa.int32()))

    return pa.StructArray.from_arrays([counted("I"), counted("D")], names=["i", "j"])


def steps(aligned: DataFrame, row: Callable[[Column, Column, Column, Column], Column]) -> DataFrame:
    """clip and the fields of row(pos, op, i, j), a struct, for each operation of the pairs.

    i and j are counted in one pass over the pair, and the struct is made inside of it, so a row that leaves the pair
    carries no arrays, and nothing is shuffled.
    """
    counted = aligned.withColumn("__used", words_used("ops"))
    signs = F.filter(F.split("ops", ""), lambda s: s != "")
    made = F.transform(signs, lambda op, pos: row(pos, op, F.get(F.col("__used.i"), pos), F.get(F.col("__used.j"), pos)))
    return counted.select("clip", F.inline(made))


def alignment_rows(aligned: DataFrame) -> DataFrame:
    """(clip, pos, operation, reference, hypothesis, langid) of pairs with ops; lang has one label per ref word.

    A word that is inserted takes the label of the next reference word, behind the last one of the last, and
    unknown where there is none.
    """

    def row(pos: Column, op: Column, i: Column, j: Column) -> Column:
        named = F.when(op == "C", "correct").when(op == "S", "substitution").when(op == "D", "deletion").otherwise("insertion")
        label = F.when(op != "I", F.get("lang", i - 1)).otherwise(F.coalesce(F.get("lang", i), F.get("lang", i - 1), F.lit("unknown")))
        reference, hypothesis = F.when(op == "I", "").otherwise(F.get("ref", i - 1)), F.when(op == "D", "").otherwise(F.get("hyp", j - 1))
        return F.struct(pos.cast("long").alias("pos"), named.alias("operation"), reference.alias("reference"), hypothesis.alias("hypothesis"), label.alias("langid"))

    return steps(aligned, row)


def positional_labels(words: Column, labels: Column) -> Column:
    """Labels of the words by position; all unknown where the counts differ."""
    return F.when(F.size(words) == F.size(labels), labels).otherwise(F.array_repeat(F.lit("unknown"), F.size(words)))


def counterparts(aligned: DataFrame) -> DataFrame:
    """(clip, pos, word, predicted): each reference word and the word it is aligned with, null where deleted."""

    def row(_: Column, op: Column, i: Column, j: Column) -> Column:
        return F.struct(i.cast("long").alias("pos"), F.get("ref", i - 1).alias("word"), F.when(op != "D", F.get("hyp", j - 1)).alias("predicted"), op.alias("__op"))

    return steps(aligned, row).where("__op <> 'I'").drop("__op")
