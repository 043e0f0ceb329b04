"""Aggregations: error rates, losses, accuracy, durations, histograms, envelopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speechloom.functions.values import first_argmax, safe_ratio

ERRORS = ("substitutions", "deletions", "insertions")


def _count(operation: str) -> Column:
    return F.count_if(F.col("operation") == operation)


def _errors() -> Column:
    return F.col("substitutions") + F.col("deletions") + F.col("insertions")


def error_counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Substitutions, deletions, insertions, reference and hypothesis words of alignment rows by key."""
    return rows.groupBy(*keys).agg(
        _count("substitution").alias("substitutions"), _count("deletion").alias("deletions"), _count("insertion").alias("insertions"),
        F.count_if(F.col("operation") != "insertion").alias("reference_words"), F.count_if(F.col("operation") != "deletion").alias("hypothesis_words"),
    )


def clip_error_rates(rows: DataFrame, empty: str = "null") -> DataFrame:
    counts = error_counts(rows, ["clip"])
    return counts.withColumn("wer", safe_ratio(_errors(), F.col("reference_words"), empty))


def label_error_rates(rows: DataFrame) -> DataFrame:
    """By clip and raw label; a label's reference words are the reference words that bear it."""
    counts = error_counts(rows, ["clip", "langid"]).drop("hypothesis_words")
    return counts.withColumn("wer", safe_ratio(_errors(), F.col("reference_words")))


def corpus_error_rates(by_label: DataFrame) -> DataFrame:
    """Micro averages by label and over all (label total); an empty denominator counts as 1."""
    sums = by_label.groupingSets([["langid"], []], "langid").agg(*[F.sum(c).alias(c) for c in ("reference_words", *ERRORS)], F.grouping("langid").alias("__all"))
    named = sums.select(F.when(F.col("__all") == 1, "total").otherwise(F.col("langid")).alias("langid"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("reference_words", *ERRORS)])
    return named.withColumn("wer", safe_ratio(_errors(), F.col("reference_words"), "one"))


def language_share(by_label: DataFrame, language: str) -> DataFrame:
    """Share of a label in each clip's reference words, 0 where it has none."""
    own = F.sum(F.when(F.col("langid") == language, F.col("reference_words")).otherwise(0))
    return by_label.groupBy("clip").agg(safe_ratio(own, F.sum("reference_words"), "zero").alias("share"))


def dominant_language(labels: DataFrame, keys: list[str]) -> DataFrame:
    """en or es where only that language occurs, mixed for both, unknown for none."""
    eng, spa = (F.coalesce(F.bool_or(F.col("langid") == x), F.lit(False)) for x in ("eng", "spa"))
    named = F.when(eng & spa, "mixed").when(eng, "en").when(spa, "es").otherwise("unknown")
    return labels.groupBy(*keys).agg(named.alias("dominant"))


def batch_mean_losses(tokens: DataFrame, weight: float) -> DataFrame:
    """Corpus losses as means of batch means of the valid tokens, and their weighted sum."""
    per_batch = tokens.where("valid").groupBy("batch").agg(F.avg("token_loss").alias("token_loss"), F.avg("lid_loss").alias("lid_loss"))
    means = per_batch.agg(F.avg("token_loss").alias("token_loss"), F.avg("lid_loss").alias("language_id_loss"), F.count(F.lit(1)).alias("batches"))
    return means.withColumn("loss", F.col("token_loss") + weight * F.col("language_id_loss"))


def clip_losses(tokens: DataFrame, weight: float) -> DataFrame:
    """Per clip: masked means (divided by at least 1); the label loss is 0 where the weight is."""

    def masked(name: str) -> Column:
        return F.sum(F.when(F.col("valid"), F.col(name)).otherwise(0.0)) / F.greatest(F.count_if("valid"), F.lit(1))

    label = masked("lid_loss") if weight else F.lit(0.0)
    out = tokens.groupBy("clip").agg(masked("token_loss").alias("token_loss"), label.alias("language_id_loss"))
    return out.withColumn("loss", F.col("token_loss") + weight * F.col("language_id_loss"))


def label_accuracy(tokens: DataFrame) -> DataFrame:
    """Correct and counted tokens (null targets are ignored) and their ratio, NaN where none counts."""
    out = tokens.agg(F.count_if(F.col("predicted") == F.col("target")).alias("correct"), F.count("target").alias("tokens"))
    return out.withColumn("accuracy", safe_ratio(F.col("correct"), F.col("tokens"), "nan"))


def histogram(values: DataFrame, column: str, bins: int) -> DataFrame:
    """Equal-width bins over the range, empty ones too: bin, low, high, n, probability.

    A range that is nearly a point is padded by 5 % of it, at least 0.5, but not below 0; the largest value
    belongs to the last bin.
    """
    bounds = values.where(F.col(column).isNotNull()).agg(F.min(column).alias("lo"), F.max(column).alias("hi"), F.count(F.lit(1)).alias("total"))
    close = F.abs(F.col("hi") - F.col("lo")) <= 1e-9 * F.greatest(F.abs("hi"), F.abs("lo"))
    padding = F.greatest(F.col("lo") * 0.05, F.lit(0.5))
    lo = F.when(close, F.greatest(F.lit(0.0), F.col("lo") - padding)).otherwise(F.col("lo"))
    hi = F.when(close, F.col("hi") + padding).otherwise(F.col("hi"))
    bounds = bounds.select(lo.alias("lo"), hi.alias("hi"), "total").withColumn("width", (F.col("hi") - F.col("lo")) / bins)
    # bounds is one row
    placed = values.where(F.col(column).isNotNull()).crossJoin(F.broadcast(bounds)).select(F.least(F.floor((F.col(column) - F.col("lo")) / F.col("width")), F.lit(bins - 1)).cast("long").alias("bin"))
    counts = placed.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    every = values.sparkSession.range(bins).withColumnRenamed("id", "bin").crossJoin(F.broadcast(bounds))
    out = every.join(counts, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    return out.select("bin", (F.col("lo") + F.col("bin") * F.col("width")).alias("low"), (F.col("lo") + (F.col("bin") + 1) * F.col("width")).alias("high"), "n", safe_ratio(F.col("n"), F.col("total"), "zero").alias("probability"))


def envelope(samples: DataFrame, width: int) -> DataFrame:
    """(clip, bucket, low, high): extremes of `width` buckets of ceil(n / width) samples; samples: clip, idx, value."""
    sizes = samples.groupBy("clip").agg(F.ceil((F.max("idx") + 1) / width).cast("long").alias("step"))
    return samples.join(sizes, "clip").groupBy("clip", F.floor(F.col("idx") / F.col("step")).cast("long").alias("bucket")).agg(F.min("value").alias("low"), F.max("value").alias("high"))


def pooled_labels(tokens: DataFrame) -> DataFrame:
    """(clip, word_no, label, confidence, tokens): class probabilities averaged over each word's tokens."""
    parts = tokens.select("clip", "word_no", "tok_no", F.posexplode("probs").alias("dim", "p"))
    means = parts.groupBy("clip", "word_no", "dim").agg(F.avg("p").alias("p"), F.count(F.lit(1)).alias("n"))
    words = means.groupBy("clip", "word_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "p"))), lambda x: x["p"]).alias("probs"), F.max("n").alias("tokens"))
    return words.select("clip", "word_no", first_argmax(F.col("probs")).alias("label"), F.array_max("probs").alias("confidence"), "tokens")
