"""Streams replayed in several batches against the batch queries."""

import random

from pyspark.sql import functions as F

from speechloom.operators import sequence
from speechloom.streaming import regions

FIRST = 1_700_000_000_000


def replay(spark, batches, schema, folder, build):
    """All rows that the stream gives when the batches arrive one after another."""
    name = f"out_{folder.name.replace('-', '_')}"
    source = folder / "in"
    source.mkdir(parents=True)
    stream = build(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source)))
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(folder / "c")).start()
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        q.processAllAvailable()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


def shuffled_batches(rows, rng, late):
    """Rows by time, some of them some places late, in batches; the last one moves the watermark far on."""
    order = sorted(range(len(rows)), key=lambda k: k + (rng.randint(0, late) if rng.random() < 0.5 else 0))
    return [[rows[k] for k in order[at : at + 25]] for at in range(0, len(rows), 25)]


def test_running_best_stream(spark, tmp_path):
    rng = random.Random(1)
    rows = [(run, k, rng.choice([float("nan"), 9.0 - k / 50, rng.uniform(0, 9)]), FIRST + 1000 * k) for k in range(100) for run in "ab"]
    batches = [*shuffled_batches(rows, rng, 12), [("z", 1, 0.5, FIRST + 10_000_000)], [("z", 2, 0.5, FIRST + 20_000_000)]]
    schema = "run string, step long, loss double, ms long"
    got = replay(spark, batches, schema, tmp_path / "best", lambda s: regions.running_best_stream(s.withColumn("at", F.timestamp_millis("ms")), "60 seconds"))
    want = sequence.running_best(spark.createDataFrame(rows, schema).select("run", "step", "loss"))
    want = want.withColumn("loss", F.nanvl("loss", F.lit(None)))
    plain = lambda df: sorted(str(tuple(r[c] for c in ("run", "step", "loss", "improved", "best_loss", "best_step"))) for r in df.where("run <> 'z'").collect())
    assert plain(got) == plain(want) and len(plain(got)) == 200


def test_merged_regions_stream(spark, tmp_path):
    rng = random.Random(2)
    rows, at = [], FIRST
    for k in range(150):
        at += rng.choice([10, 400, 1500])
        rows.append((f"r{k % 3}", at, at + rng.choice([5, 300, 2500]), k, at))  # a region may end after the one that follows it
    schema = "rec string, start long, end long, event_id long, ms long"
    batches = [*shuffled_batches(rows, rng, 8), [("z", FIRST + 10**7, FIRST + 10**7, 900, FIRST + 10**7)], [("z", FIRST + 2 * 10**7, FIRST + 2 * 10**7, 901, FIRST + 2 * 10**7)]]
    got = replay(spark, batches, schema, tmp_path / "merged", lambda s: regions.merged_regions_stream(s.withColumn("at", F.timestamp_millis("ms")), 1000, "30 seconds"))
    want = sequence.merge_gaps(spark.createDataFrame(rows, schema), 1000, ["start", "event_id"])
    plain = lambda df: sorted((r["rec"], r["start"], r["end"], r["n"]) for r in df.where("rec <> 'z'").collect())
    assert plain(got) == plain(want) and len(plain(want)) > 10


def test_upsert_writes_only_touched_buckets(spark, tmp_path):
    schema, path, source = "run_name string, evaluation_step long, loss double", str(tmp_path / "table"), tmp_path / "in"
    source.mkdir()
    q = regions.upsert_results(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source)), path, str(tmp_path / "c"), buckets=16)
    batches = [[(f"run{k}", 1, 0.5) for k in range(60)], [("run7", 2, 0.4), ("run7", 3, 0.3), ("new", 1, 0.9)], [("run8", 1, 0.1)]]
    want = {}
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        q.processAllAvailable()
        want |= {r[0]: r for r in rows}
        assert sorted(map(tuple, regions.read_results(spark, path, n).collect())) == sorted(want.values())
    q.stop()
    # the second batch has two keys, the third has one
    assert len(list((tmp_path / "table/version=1").glob("bucket=*"))) <= 2 and len(list((tmp_path / "table/version=2").glob("bucket=*"))) == 1
    # older versions stay whole
    assert regions.read_results(spark, path, 0).count() == 60
