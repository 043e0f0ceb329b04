"""Every registered query outside the llm subpackage against its DuckDB statement."""

import math

import duckdb
import pytest

from speechloom.plans import corpus, evaluation, files, registry  # noqa: F401

TABLES = ("events", "documents", "embeddings", "labels", "conversations")


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "~"
    if isinstance(value, bool):
        return str(value)
    return f"{value:.9g}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_equals_duckdb(spark, sf, duck, name):
    df = registry.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    ours = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    found = duck.execute(registry.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    theirs = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall())
    assert ours == theirs


def test_each_query_has_an_oracle():
    assert set(registry.QUERIES) == set(registry.ORACLES)
