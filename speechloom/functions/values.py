"""Scalar, array and map functions of manifests, scores and training examples."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the label vocabulary and of the training targets.
CLASS_IDS = {"eng": 0, "spa": 1, "mixed": 2, "other": 3}
IGNORE = -100
LABELS = "array<struct<word: string, langid: string>>"


def safe_ratio(num: Column, den: Column, empty: str = "null") -> Column:
    """num / den; a zero denominator gives null, zero, nan, or (one) divides by 1 instead."""
    if empty == "one":
        return num / F.when(den == 0, F.lit(1)).otherwise(den)
    ratio = F.try_divide(num, den)
    return {"null": ratio, "zero": F.coalesce(ratio, F.lit(0.0)), "nan": F.coalesce(ratio, F.lit(float("nan")))}[empty]


def fixed(value: Column, digits: int) -> Column:
    """Text with this many decimals of the number's exact binary value, halves to even, as C prints it.

    A negative number that rounds to zero keeps its sign; what is not finite is nan, inf or -inf.
    """
    shape = f"%.{digits}f"

    @F.arrow_udf("string")
    def printed(values: pa.Array) -> pa.Array:
        return pa.array([None if x is None else shape % x for x in values.to_pylist()], type=pa.string())

    return printed(value.cast("double"))


def percent(value: Column) -> Column:
    return F.concat(fixed(value * 100, 1), F.lit("%"))


def clock(ms: Column) -> Column:
    """m:ss of rounded seconds, not below 0:00."""
    total = F.greatest(F.floor(ms / 1000 + 0.5).cast("long"), F.lit(0))
    return F.format_string("%d:%02d", F.floor(total / 60), total % 60)


def parse_offset_timestamp(text: Column) -> Column:
    """Timestamps whose offset is written as +0100 or as +01:00; anything else is null."""
    return F.coalesce(F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ssxxx")), F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ssxx")))


def offset_text(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ssxxx")


def quantise_pcm(samples: Column) -> Column:
    """Samples clamped to [-1, 1] as 16-bit integers (truncated)."""
    return F.transform(samples, lambda x: (F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x.cast("double"))) * 32767).cast("int"))


def dequantise_pcm(pcm: Column) -> Column:
    return F.transform(pcm, lambda x: x / F.lit(32768.0))


def softmax(logits: Column) -> Column:
    shifted = F.transform(logits, lambda x: F.exp(x.cast("double") - F.array_max(logits).cast("double")))
    total = F.aggregate(shifted, F.lit(0.0), lambda a, x: a + x)
    return F.transform(shifted, lambda x: x / total)


def cut_regions(samples: Column, regions: Column) -> Column:
    """Samples inside the regions (structs of start and end, end exclusive), one after another."""
    return F.flatten(F.transform(regions, lambda r: F.slice(samples, (r["start"] + 1).cast("int"), F.greatest(r["end"] - r["start"], F.lit(0)).cast("int"))))


def canonical_language(label: Column) -> Column:
    """The learnable class of a corpus label; null for undetermined and unknown ones."""
    name = F.lower(F.trim(label))
    return F.when(name.isin("eng", "spa"), name).when(name.isin("eng+spa", "spa+eng"), "mixed").when(name.isin("other", "unk"), "other")


def class_id(label: Column) -> Column:
    name = canonical_language(label)
    out = F.lit(None).cast("int")
    for key, value in CLASS_IDS.items():
        out = F.when(name == key, value).otherwise(out)
    return out


def viewer_language(label: Column) -> Column:
    name = F.lower(F.coalesce(label, F.lit("")))
    return F.when(name.isin("eng", "spa"), name).when(F.contains(name, F.lit("+")) | (name == "mixed"), "mixed").otherwise("other")


def parse_labels(cell: Column) -> Column:
    """Labels of a JSON cell: bad JSON is an empty list, a missing langid is unknown, items without a word go."""
    items = F.coalesce(F.from_json(cell, LABELS), F.array().cast(LABELS))
    named = F.filter(items, lambda x: x["word"].isNotNull() & (x["word"] != ""))
    return F.transform(named, lambda x: F.struct(x["word"].alias("word"), F.coalesce(x["langid"], F.lit("unknown")).alias("langid")))


def expand_labels(words: Column) -> Column:
    """One target per piece: words are structs of langid and pieces; undetermined labels give IGNORE."""
    return F.flatten(F.transform(words, lambda w: F.array_repeat(F.coalesce(class_id(w["langid"]), F.lit(IGNORE)), F.size(w["pieces"]))))


def teacher_forcing(tokens: Column, labels: Column, prefix: list[int], end: int) -> Column:
    """Struct of inputs, targets and label_targets of equal length for a decoder that sees prefix + tokens."""
    lead = F.array_repeat(F.lit(IGNORE), len(prefix) - 1)
    inputs = F.concat(F.array(*map(F.lit, prefix)), tokens)
    targets = F.concat(lead, tokens, F.array(F.lit(end)))
    label_targets = F.concat(lead, labels, F.array(F.lit(IGNORE)))
    same = (F.size(inputs) == F.size(targets)) & (F.size(inputs) == F.size(label_targets))
    checked = F.when(same, inputs).otherwise(F.raise_error(F.lit("inputs and targets differ in length")).cast("array<int>"))
    return F.struct(checked.alias("inputs"), targets.alias("targets"), label_targets.alias("label_targets"))


def pad_to(values: Column, length: Column, fill: int) -> Column:
    return F.concat(values, F.array_repeat(F.lit(fill), (length - F.size(values)).cast("int")))


def first_argmax(values: Column) -> Column:
    """0-based index of the largest value, the first one on ties."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")
