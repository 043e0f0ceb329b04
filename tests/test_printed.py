"""Numbers as text, against DuckDB's printf."""

import duckdb
from pyspark.sql import functions as F

from speechloom.functions import values as vx
from speechloom.plans import evaluation, registry  # noqa: F401

NUMBERS = [-2.7e-7, -1e-12, -0.0, 0.0, 0.0625, 0.1875, -0.0625, 2.0**-11, 3 * 2.0**-11, 0.35, 0.0000005, 1234567.1, 3.4e38, float("nan"), float("-inf")]


def test_small_negative_numbers_and_halves(spark, tmp_path):
    path = f"{tmp_path}/embeddings.parquet"
    spark.createDataFrame([(k, [x, x / 3], 0) for k, x in enumerate(NUMBERS)], "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{path}/*.parquet'")
    columns = "clip, idx, ten, six, shown"
    want = con.execute(f"SELECT {columns} FROM ({registry.ORACLES['fn_fixed_decimals']}) ORDER BY clip, idx").fetchall()
    got = registry.QUERIES["fn_fixed_decimals"](spark, str(tmp_path)).select(*columns.split(", ")).orderBy("clip", "idx").collect()
    assert [tuple(r) for r in got] == want
    assert want[0][3] == "-0.000000" and want[8][4] == "6.2%"


def test_nulls_stay(spark):
    row = spark.range(1).selectExpr("cast(null as double) AS x").select(vx.fixed(F.col("x"), 2).alias("a"), vx.percent(F.col("x")).alias("b")).first()
    assert tuple(row) == (None, None)
