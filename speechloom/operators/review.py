"""What the review pages show: retention, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def retention(source: DataFrame, trimmed: DataFrame) -> DataFrame:
    """source rows with retained (share) and removed (seconds, not below 0); a clip that is filtered out loses all."""
    joined = source.join(trimmed, "audio_path")
    out = F.lower(F.coalesce("filtered_out", F.lit("false"))) == "true"
    retained = F.when(out, F.lit(0.0)).otherwise(F.try_divide("trimmed_s", "source_s"))
    removed = F.when(out, F.col("source_s")).otherwise(F.greatest(F.col("source_s") - F.col("trimmed_s"), F.lit(0.0)))
    return joined.select(*source.columns, retained.alias("retained"), removed.alias("removed"))


def review_summary(rows: DataFrame, metrics: list[str]) -> DataFrame:
    """Means of the finite values of each metric, and the error rate: errors over words, else the mean of wer.

    Empty cells are null and are left out, as NaN is.
    """

    def finite(name: str):
        return F.when(~F.isnan(name) & (F.abs(name) != float("inf")), F.col(name))

    ratio = F.try_divide(F.sum("word_errors"), F.sum("reference_words"))
    return rows.agg(F.count(F.lit(1)).alias("clips"), F.coalesce(ratio, F.avg(finite("wer"))).alias("wer"), *[F.avg(finite(m)).alias(m) for m in metrics])
