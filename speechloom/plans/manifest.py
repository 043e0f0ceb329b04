"""Compositions: from utterances and labelled tokens to manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def utterance_tokens(tokens: DataFrame) -> DataFrame:
    """(rec, utt, tokens): the labelled words of each utterance in order."""
    listed = F.array_sort(F.collect_list(F.struct("pos", "word", "langid")))
    return tokens.groupBy("rec", "utt").agg(F.transform(listed, lambda t: F.struct(t["word"].alias("word"), t["langid"].alias("langid"))).alias("tokens"))


def segment_manifest(segmented: DataFrame, tokens: DataFrame) -> DataFrame:
    """Rows of rec, seg, audio_path, start_ms, end_ms, transcript, word_langids, language_counts, utterance_ids, speakers.

    segmented holds utterances with seg; a segment ends where its last utterance ends, and its speakers stand in
    the order in which they first speak.
    """
    joined = segmented.join(utterance_tokens(tokens), ["rec", "utt"], "left")
    labels = "array<struct<word: string, langid: string>>"
    listed = F.array_sort(F.collect_list(F.struct("utt", "spk", F.coalesce("tokens", F.array().cast(labels)).alias("tokens"))))
    rolled = joined.groupBy("rec", "seg").agg(F.min_by("start_ms", "utt").alias("start_ms"), F.max_by("end_ms", "utt").alias("end_ms"), listed.alias("items"))
    named = rolled.withColumn("word_langids", F.flatten(F.transform("items", lambda i: i["tokens"])))
    counts = F.transform(F.array_sort(F.array_distinct("word_langids.langid")), lambda k: F.struct(k.alias("key"), F.size(F.filter("word_langids", lambda t: t["langid"] == k)).cast("long").alias("value")))
    return named.select(
        "rec", "seg", F.concat(F.lit("segments/"), segment_name(F.col("rec"), F.col("seg")), F.lit(".wav")).alias("audio_path"), "start_ms", "end_ms",
        F.array_join("word_langids.word", " ").alias("transcript"), "word_langids", F.map_from_entries(counts).alias("language_counts"),
        F.transform("items", lambda i: i["utt"]).alias("utterance_ids"), F.array_join(F.array_distinct("items.spk"), ",").alias("speakers"),
    )


def segment_name(rec, seg):
    return F.format_string("%s_%04d", rec, seg)


def train_manifest(vad: DataFrame) -> DataFrame:
    """audio_path, transcript, word_langids and language_counts, with empty defaults."""
    out = vad.select("audio_path", "transcript", "word_langids", "language_counts")
    return out.withColumn("word_langids", F.coalesce("word_langids", F.array().cast(vad.schema["word_langids"].dataType))).withColumn("language_counts", F.coalesce("language_counts", F.create_map().cast("map<string, long>")))
