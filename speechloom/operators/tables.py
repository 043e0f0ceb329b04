"""Joins, splits, set operations and orderings of manifests and run tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from speechloom.operators.scan import prefix_scan


def complete_recordings(audio: DataFrame, chats: DataFrame, words: DataFrame) -> DataFrame:
    """Recordings (rec) that have a transcript and a word table."""
    return audio.select("rec").join(chats.select("rec"), "rec").join(words.select("rec"), "rec").distinct()


def incomplete_recordings(audio: DataFrame, chats: DataFrame, words: DataFrame) -> DataFrame:
    return audio.select("rec").distinct().join(complete_recordings(audio, chats, words), "rec", "left_anti")


def last_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def point_in_interval(points: DataFrame, intervals: DataFrame, bucket_ms: int) -> DataFrame:
    """Pairs with start_ms <= t <= end_ms in the same rec, by an equi-join on buckets of time.

    Buckets of level k are bucket_ms * 2 ** k long. An interval lies in the level whose buckets are as long as itself, so
    in two or three buckets, whatever its length; a point is looked up in one bucket of each level that has intervals.
    Intervals that end before they start, and nulls, meet nothing.
    """
    length = F.col("end_ms") - F.col("start_ms")
    leveled = intervals.where(length >= 0).withColumn("__k", F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(length, F.lit(1)) / bucket_ms))).cast("int"))

    def bucket(at: str) -> Column:
        return F.floor(F.col(at) / (F.lit(float(bucket_ms)) * F.pow(F.lit(2.0), F.col("__k")))).cast("long")

    covered = leveled.withColumn("__b", F.explode(F.sequence(bucket("start_ms"), bucket("end_ms"))))
    levels = leveled.select("__k").distinct()  # one row for each power of two, 64 at most
    placed = points.crossJoin(F.broadcast(levels)).withColumn("__b", bucket("t"))
    return placed.join(covered, ["rec", "__k", "__b"]).where((F.col("t") >= F.col("start_ms")) & (F.col("t") <= F.col("end_ms"))).drop("__b", "__k")


def held_out_keys(clips: DataFrame, seed: int, train_fraction: float) -> DataFrame:
    """Recordings held out: in an order shuffled by seed, whole ones while the rows taken so far are below the target.

    The running sum is over recordings, one row each, and the order is a hash of their names.
    """
    counts = clips.groupBy("rec").agg(F.count(F.lit(1)).alias("n")).withColumn("__o", F.md5(F.concat(F.lit(f"{seed}:"), F.col("rec"))))
    counts = running_total(counts, [F.col("__o"), F.col("rec")], F.col("n"), "__upto")
    # one row of totals
    target = counts.agg(F.greatest(F.lit(1.0), F.rint(F.sum("n") * F.lit(1 - train_fraction))).alias("target"))
    return counts.crossJoin(F.broadcast(target)).where(F.col("__upto") - F.col("n") < F.col("target")).select("rec")


def split_by_recording(clips: DataFrame, seed: int, train_fraction: float = 0.9) -> tuple[DataFrame, DataFrame]:
    """(train, test) by whole recordings."""
    keys = held_out_keys(clips, seed, train_fraction)
    return clips.join(keys, "rec", "left_anti"), clips.join(keys, "rec", "left_semi")


def split_single_recording(clips: DataFrame, seed: int, train_fraction: float = 0.9) -> tuple[DataFrame, DataFrame]:
    """(train, test) of single clips, for a table with one recording; clips need the column clip."""
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col("clip").cast("string")))
    placed = ranked(clips, [order, F.col("clip")], "__place")
    # one row of totals
    target = placed.agg(F.greatest(F.lit(1.0), F.rint(F.count(F.lit(1)) * F.lit(1 - train_fraction))).alias("__target"))
    marked = placed.crossJoin(F.broadcast(target)).withColumn("__test", F.col("__place") <= F.col("__target")).drop("__place", "__target")
    return marked.where(~F.col("__test")).drop("__test"), marked.where("__test").drop("__test")


def seeded_sample(df: DataFrame, seed: int, key: Column, n: int) -> DataFrame:
    """n rows in the order of a hash of seed and key."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), key).limit(n)


def upsert(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of new replace those of the same key."""
    return existing.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def ranked(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Rows in order, with their 1-based place, so that the order is part of the result."""
    return running_total(df, order, F.lit(1), name)


def running_total(df: DataFrame, order: list[Column], value: Column, name: str) -> DataFrame:
    """Rows with the sum of value up to each of them, over the whole table in order."""
    return prefix_scan(df, [], order, {name: ("sum", value.cast("long"))})


def exact_median(df: DataFrame, column: str) -> DataFrame:
    """One row, median: the middle value of a column, or the mean of the two; null without values. NaN counts as the largest.

    Equal values are counted first; the middle is found by the running count of the distinct ones, which lie in range
    partitions, so no task holds the column.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    placed = running_total(counts, [F.col("__v")], F.col("__n"), "__upto")
    total = counts.agg(F.sum("__n").alias("__total"))  # one row
    begin, rank = F.col("__upto") - F.col("__n"), [F.floor((F.col("__total") + k) / 2) for k in (1, 2)]
    middle = [F.max(F.when((begin < r) & (F.col("__upto") >= r), F.col("__v"))) for r in rank]
    return placed.crossJoin(F.broadcast(total)).agg((0.5 * middle[0] + 0.5 * middle[1]).alias("median"))


def search(rows: DataFrame, term: str, columns: list[str], status: str = "all") -> DataFrame:
    """Rows whose columns contain the term in any case, and whose filtered_out is the status (all: any)."""
    out = rows.where(F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(term.strip().lower())))
    return out if status == "all" else out.where(F.lower(F.coalesce("filtered_out", F.lit("false"))) == status)


def kept(rows: DataFrame) -> DataFrame:
    """Rows that are not filtered out; a missing flag or column keeps."""
    return rows.where(F.lower(F.coalesce("filtered_out", F.lit("false"))) != "true") if "filtered_out" in rows.columns else rows
