"""Prefix scans by key in which a key may have any number of rows.

Rows are range-partitioned by key and order, so a long key lies in many partitions. Each partition is scanned by itself,
and what the partitions before hold for the same key is carried to it: one row for each partition that a key goes on
into, which is a table no larger than the number of partitions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from speechloom.sources.scratch import staged

#: How each kind of scan sums rows, goes on from what was before, and combines two values of which either may be null.
_KINDS = {
    "sum": (F.sum, lambda before, own: F.coalesce(before + own, before, own)),
    "min": (F.min, lambda before, own: F.least(before, own)),
    "last": (lambda c: F.last(c, ignorenulls=True), lambda before, own: F.coalesce(own, before)),
}


def ranged(df: DataFrame, keys: list[str], order: list[Column], name: str = "__p") -> DataFrame:
    """Rows with the number of the range of (keys, order) that they lie in, ascending; written once, so that the ranges stay."""
    return staged(df.repartitionByRange(*keys, *order).withColumn(name, F.spark_partition_id()), "ranged")


def prefix_scan(df: DataFrame, keys: list[str], order: list[Column], scans: dict[str, tuple[str, Column]]) -> DataFrame:
    """df with a column for each of scans (name -> kind, value): the value over all rows of the key up to this one, in order.

    Kinds: sum; min (of structs too); last, the last value that is not null. Null values are left out, null keys are
    one key. Rows that are equal in keys and order are taken in any order. Without keys, the table is one key. The order is ascending, but for scans of sums and
    minima, where it may be any.
    """
    spread = ranged(df, keys, order)
    upto = Window.partitionBy("__p", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = spread.withColumns({name: _KINDS[kind][0](value).over(upto) for name, (kind, value) in scans.items()})
    # keys that go on into another partition: fewer than there are partitions
    pieces = spread.groupBy(*keys).agg(F.min("__p").alias("__first"), F.max("__p").alias("__last")).where("__first < __last")
    same = reduce(lambda a, b: a & b, [F.col(f"s.{k}").eqNullSafe(F.col(f"k.{k}")) for k in keys], F.lit(True))
    long = spread.alias("s").join(F.broadcast(pieces.alias("k")), same).select("s.*") if keys else spread
    place = F.struct(*order)
    sums = {name: F.max_by(value, F.when(value.isNotNull(), place)) if kind == "last" else _KINDS[kind][0](value) for name, (kind, value) in scans.items()}
    totals = long.groupBy("__p", *keys).agg(*[c.alias(f"__{name}") for name, c in sums.items()])
    before = Window.partitionBy(*keys).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1) if keys else Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select("__p", *keys, *[_KINDS[kind][0](F.col(f"__{name}")).over(before).alias(f"__{name}") for name, (kind, _) in scans.items()])
    match = reduce(lambda a, b: a & b, [F.col(f"l.{k}").eqNullSafe(F.col(f"c.{k}")) for k in keys], F.col("l.__p") == F.col("c.__p"))
    both = local.alias("l").join(F.broadcast(carried.alias("c")), match, "left")
    return both.select(*[F.col(f"l.{c}") for c in df.columns], *[_KINDS[kind][1](F.col(f"c.__{name}"), F.col(f"l.{name}")).alias(name) for name, (kind, _) in scans.items()])
