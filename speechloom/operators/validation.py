"""Manifest validation: one row per rule with the number of violations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speechloom.functions.text import label_word, split_words
from speechloom.functions.values import LABELS


def manifest_violations(manifest: DataFrame, listing: DataFrame, required: list[str]) -> DataFrame:
    """(rule, violations): missing columns, empty table, bad JSON, empty labels, missing audio, label mismatch.

    listing holds the audio_path of the files that exist. Rules on the rows share one pass.
    """
    spark = manifest.sparkSession
    missing = [c for c in required if c not in manifest.columns]
    labels = F.from_json("word_langids", LABELS)
    bad = F.try_parse_json(F.col("word_langids")).isNull()
    empty = ~bad & (F.size(F.coalesce(labels, F.array().cast(LABELS))) == 0)
    words = F.transform(labels, lambda x: label_word(x["word"]))
    spoken = F.filter(F.transform(split_words(F.col("transcript")), label_word), lambda w: w != "")
    known = listing.select("audio_path").distinct().withColumn("__there", F.lit(True))
    checked = manifest.join(known, "audio_path", "left")
    rules = {"bad_json": bad, "empty_labels": empty, "missing_audio": F.col("__there").isNull(), "label_mismatch": ~bad & ~empty & ~(words == spoken)}
    counts = checked.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(c).alias(name) for name, c in rules.items()])
    listed = [F.struct(F.lit("missing_column").alias("rule"), F.lit(len(missing)).cast("long").alias("violations")), F.struct(F.lit("empty_table").alias("rule"), (F.col("rows") == 0).cast("long").alias("violations"))]
    listed += [F.struct(F.lit(name).alias("rule"), F.col(name).alias("violations")) for name in rules]
    return counts.select(F.inline(F.array(*listed)))


def assert_valid(manifest: DataFrame, listing: DataFrame, required: list[str]) -> DataFrame:
    """The manifest, or ValueError naming the rules that it breaks."""
    broken = manifest_violations(manifest, listing, required).where("violations > 0").collect()  # six rows at most
    if broken:
        raise ValueError("; ".join(f"{r.rule}: {r.violations}" for r in broken))
    return manifest
