"""A corpus pipeline of the llm subpackage: STAGES are applied in order to the table documents.

Each stage takes (spark, docs, sf_dir), works on every row that the stage before it kept, and returns a
DataFrame that is written as Parquet and read again as the next stage's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from speechloom.llm import stages
from speechloom.llm.common import staged, table

STAGES = stages.STAGES

#: Training and tokenizing are not expressible in SQL; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents: the packed pieces of the cleaned corpus."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs, f"pipeline-{name}")
    return docs
