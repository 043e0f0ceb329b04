"""The stages of corpus_pipeline.py: each takes (spark, docs, sf_dir) and returns documents, the last one pieces.

All of them work row by row on the column text and the id doc_id: a row with a null id, and each of the rows that
repeat an id, is a document of its own. Null texts are empty and stay null where a text is returned. Further columns
of docs, whatever their names, are passed on as they are. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from speechloom.llm import decontaminate, neardup, packing, personal, quality
from speechloom.llm.common import fresh, staged, table
from speechloom.llm.queries import tokenizer_file

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Columns that stages read or write.
OWN = ("doc_id", "text", "n_chars")
#: Documents whose probability of label 1 is lower are rejected.
LEAST_QUALITY = 0.5


def any_names(stage: Stage) -> Stage:
    """The stage over docs whose further columns may have any names, also such as `a.b`: it sees plain ones."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        plain = [c if c in OWN else f"column_{k}" for k, c in enumerate(docs.columns)]
        return stage(spark, docs.toDF(*plain), sf_dir).toDF(*docs.columns)

    return run


@any_names
def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on a bounded sample of labelled ones, does not reject.

    Without labels, or with one kind only, every text gets the same score, and all stay or go.
    """
    sample = quality.sample_labelled(docs, table(spark, sf_dir, "labels"), F.lit(True), quality.MAX_TRAIN, "quality")
    name = fresh(docs, "score")
    scored = quality.score_quality(docs, *quality.fit(sample), keep=docs.columns, name=name)
    return scored.where(F.col(name) >= LEAST_QUALITY).select(*docs.columns)


@any_names
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id, a null id being the largest.

    Texts without words are near-duplicates of nothing and stay. Rows of one id with different texts are different
    documents; of equal rows one stays.
    """
    row = fresh(docs, "row")
    # the rows are numbered and written once, so that a row has one number wherever it is read
    numbered = staged(docs.withColumn(row, F.monotonically_increasing_id()), "stages-rows")
    found = neardup.near_duplicates(numbered, width=5, percent=80, id_col=row)
    groups = found.select(F.col("doc_id").alias(row), F.col("component_id").alias("__group")).join(numbered.select(row, F.col("doc_id").alias("__id")), row)
    first = groups.groupBy("__group").agg(F.min(F.struct(F.col("__id").isNull(), "__id", row)).alias("first"))
    return numbered.join(first.select(F.col(f"first.{row}").alias(row)), row, "left_semi").select(*docs.columns)


@any_names
def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is confirmed. Rows with equal id and text share their fate."""
    name = fresh(docs, "name")
    key = F.concat_ws("#", F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit(""))))
    named = docs.withColumn(name, key)
    leaks = decontaminate.find_leaks(named, table(spark, sf_dir, "benchmark"), id_col=name).select(F.col("doc_id").alias(name)).distinct()
    return named.join(leaks, name, "left_anti").select(*docs.columns)


@any_names
def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind in brackets; n_chars follows."""
    return personal.mask_personal_data(docs).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences of all documents that are left; an empty text is the end id alone."""
    return packing.pack_documents(docs, tokenizer_file(), capacity=2048, end_id=1)


STAGES = [("quality", keep_quality), ("neardup", drop_near_duplicates), ("decontaminate", drop_leaks), ("pii", mask_pii), ("packing", pack)]
