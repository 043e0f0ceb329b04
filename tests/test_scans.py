"""Scans, segmentation, medians and interval joins over keys that many tasks share, against plain loops."""

import random
import statistics
import struct
import wave

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from speechloom.operators import sequence, tables
from speechloom.operators.scan import prefix_scan
from speechloom.sources import files, wav


@pytest.fixture
def many_partitions(spark):
    """Small tables keep their partitions."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("keys", [1, 2, 40])
def test_scans_equal_windows(spark, many_partitions, keys):
    rng = random.Random(keys)
    rows = [(rng.choice([None, *"abcdefghij"][: min(keys, 11)]) if keys < 40 else f"k{rng.randrange(keys)}", k, rng.choice([None, *range(-50, 50)])) for k in range(500)]
    df = spark.createDataFrame(rows, "key string, place long, v long")
    got = prefix_scan(df, ["key"], [F.col("place")], {"total": ("sum", F.col("v")), "least": ("min", F.struct("v", "place")), "newest": ("last", F.col("v"))})
    w = Window.partitionBy("key").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    want = df.withColumns({"total": F.sum("v").over(w), "least": F.min(F.struct("v", "place")).over(w), "newest": F.last("v", ignorenulls=True).over(w)})
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    # the rows of one key lie in several partitions
    assert keys > 2 or df.repartitionByRange("key", "place").withColumn("p", F.spark_partition_id()).groupBy("key").agg(F.countDistinct("p").alias("n")).agg(F.max("n")).first()[0] > 1
    upwards = prefix_scan(df, [], [F.desc("place")], {"n": ("sum", F.lit(1).cast("long"))}).collect()
    assert all(r["n"] == 500 - r["place"] for r in upwards)


def test_running_best_of_one_run(spark, many_partitions):
    rng = random.Random(2)
    losses = [rng.choice([float("nan"), 5.0, 4.0, 3.5, 3.0 - k / 300, 2.9]) for k in range(300)]
    got = {r["step"]: r for r in sequence.running_best(spark.createDataFrame([("a", k, x) for k, x in enumerate(losses)], "run string, step long, loss double")).collect()}
    best, at = None, None
    for k, x in enumerate(losses):
        better = x == x and (best is None or x < best)
        best, at = (x, k) if better else (best, at)
        assert (got[k]["improved"], got[k]["best_loss"], got[k]["best_step"]) == (better, best, at)
    last = sequence.evaluation_steps(spark.createDataFrame([("a", k, 0) for k in range(1, 12)] + [("b", 10, 0)], "run string, step long, x int"), 5).collect()
    assert sorted((r["run"], r["step"]) for r in last) == [("a", 5), ("a", 10), ("a", 11), ("b", 10)]


def loop(rows, budget):
    out, current, begin, seg = [], None, 0, 0
    for rec, utt, start, end in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1])):
        if (rec,) != current:
            current, begin, seg = (rec,), start, 1
        elif end - begin > budget:
            begin, seg = start, seg + 1
        out.append((rec, utt, seg))
    return sorted(out, key=str)


@pytest.mark.parametrize(("kind", "budget"), [("ordered", 300), ("ordered", 50), ("ordered", 10**9), ("wild", 400), ("wild", 60), ("equal", 0)])
def test_one_long_recording(spark, many_partitions, kind, budget):
    rng = random.Random(budget)
    rows, at = [], 0
    for k in range(700):
        at = at + rng.randint(0, 60) if kind == "ordered" else rng.randint(0, 5000) if kind == "wild" else 7
        rows.append(("long", k, at, at + rng.randint(0, 120) - (40 if kind == "wild" else 0)))
    rows += [(f"s{k % 9}", k, k * 50, k * 50 + rng.randint(1, 200)) for k in range(60)] + [(None, 1, 0, 5), (None, 2, 9, 1000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "rec string, utt long, start_ms long, end_ms long")
    got = sequence.segment_by_budget(df, budget).collect()
    assert sorted(((r["rec"], r["utt"], r["seg"]) for r in got), key=str) == loop(rows, budget)


def test_median(spark, many_partitions):
    rng = random.Random(1)
    for values in ([3.0], [1.0, 2.0], [5.0] * 7, [rng.choice([1.0, 2.5, 9.0]) for _ in range(50)], [rng.random() for _ in range(101)], [None, 4.0, None, 1.0]):
        got = tables.exact_median(spark.createDataFrame([(v,) for v in values], "x double"), "x").collect()
        assert [r["median"] for r in got] == [statistics.median(v for v in values if v is not None)]
    assert tables.exact_median(spark.createDataFrame([(None,)], "x double"), "x").first()["median"] is None


def test_points_in_intervals_of_any_length(spark):
    rng = random.Random(3)
    year = 365 * 86_400_000
    spans = [(k, s, s + rng.choice([0, 1, 5_000, 10_000, 10_001, 80_000, 3_600_000, year, -5])) for k, s in enumerate(rng.randint(-50_000, 5_000_000) for _ in range(80))] + [(99, -(2**40), 2**40), (98, 7, None), (97, 10_000, 20_000)]
    points = [rng.randint(-60_000, 5_100_000) for _ in range(150)] + [10_000, 20_000, 9_999, year // 2]
    got = tables.point_in_interval(spark.createDataFrame([("r", t) for t in points], "rec string, t long"), spark.createDataFrame([("r", k, a, b) for k, a, b in spans], "rec string, k int, start_ms long, end_ms long"), 10_000)
    want = sorted((t, k) for t in points for k, a, b in spans if b is not None and a <= t <= b)
    assert sorted((r["t"], r["k"]) for r in got.collect()) == want


def chunk(name, body, size=None):
    return name + struct.pack("<I", len(body) if size is None else size) + body + b"\0" * (len(body) % 2)


def test_wav_chunks_like_the_standard_reader(spark, tmp_path):
    rng = random.Random(5)
    plain = lambda rate, channels=1, bits=16: struct.pack("<HHIIHH", 1, channels, rate, rate * channels * bits // 8, channels * bits // 8, bits)
    extended = lambda rate: struct.pack("<HHIIHH", 0xFFFE, 2, rate, rate * 4, 4, 16) + struct.pack("<HHI", 22, 16, 3) + wav.PCM_SUBFORMAT
    extra = lambda: b"".join(chunk(rng.choice([b"LIST", b"fact", b"id3 "]), rng.randbytes(rng.randint(0, 90))) for _ in range(rng.randint(0, 4)))
    for k in range(40):
        fmt = [plain(8000), plain(44100, 2), plain(16000, 1, 8), plain(48000, 3, 24), plain(16000) + b"\0\0", extended(22050)][k % 6]
        body = b"WAVE" + extra() + chunk(b"fmt ", fmt) + extra() + chunk(b"data", bytes(rng.randint(0, 5000))) + extra()
        (tmp_path / f"a {k}%20.wav").write_bytes(b"RIFF" + struct.pack("<I", len(body)) + body)
    found = {r["rec"]: (r["seconds"], r["error"]) for r in files.wav_durations(spark, str(tmp_path)).collect()}
    assert len(found) == 40
    for path in tmp_path.glob("*.wav"):
        with wave.open(str(path)) as audio:
            assert found[path.stem] == (audio.getnframes() / audio.getframerate(), None)
        raw = path.read_bytes()
        assert wav.content_walk(raw, len(raw)) == found[path.stem]


def test_wav_errors_and_large_files(spark, tmp_path):
    fmt = struct.pack("<HHIIHH", 1, 1, 8000, 16000, 2, 16)
    broken = {"order": chunk(b"data", b"12") + chunk(b"fmt ", fmt), "none": chunk(b"fmt ", fmt), "float": chunk(b"fmt ", struct.pack("<H", 3) + fmt[2:]) + chunk(b"data", b"12"), "cut": chunk(b"fmt ", fmt) + chunk(b"data", b"12", 99), "half": chunk(b"fmt ", fmt[:9], 16), "wide": chunk(b"fmt ", fmt[:14] + b"\0\0") + chunk(b"data", b"")}
    for name, body in broken.items():
        (tmp_path / f"{name}.wav").write_bytes(b"RIFF\0\0\0\0WAVE" + body)
    (tmp_path / "other.wav").write_bytes(b"RIFX\0\0\0\0WAVE")
    (tmp_path / "empty.wav").write_bytes(b"")  # Spark does not list files without bytes
    size = 3 << 30  # of a file above 2 GB only headers are read; the file is sparse
    with (tmp_path / "large.wav").open("wb") as file:
        file.write(b"RIFF\0\0\0\0WAVE" + chunk(b"fmt ", fmt) + b"LIST" + struct.pack("<I", size - 1000))
        file.seek(size - 1000, 1)
        file.write(b"data" + struct.pack("<I", 16000) + bytes(16000))
    found = {r["rec"]: (r["seconds"], r["error"]) for r in files.wav_durations(spark, str(tmp_path)).collect()}
    assert found == {"order": (None, "no fmt chunk"), "none": (None, "no data chunk"), "float": (None, "unknown format"), "cut": (None, "truncated"), "half": (None, "no fmt chunk"), "wide": (None, "invalid frame rate"), "other": (None, "no WAV header"), "large": (1.0, None)}


def test_training_words_of_any_parentheses(spark):
    import re
    import time

    from speechloom.functions import text as tx

    def loop(t):
        while re.search(r"\([^()]*\)", t):
            t = re.sub(r"\([^()]*\)", "", t)
        return [w for w in "".join(c for c in t.replace("<", "").replace(">", "").replace("_", " ") if c not in "().,").split() if w.lower() not in ("www", "xxx")]

    rng = random.Random(8)
    given = ["".join(rng.choice("()ab (") for _ in range(rng.randint(0, 40))) for _ in range(400)] + ["", ")(", "((a)b", "a)b(c", "www (xxx) Www"]
    got = spark.createDataFrame(list(enumerate(given)), "k long, t string").select("k", tx.training_words(F.col("t")).alias("w")).collect()
    assert {r["k"]: r["w"] for r in got} == {k: loop(t) for k, t in enumerate(given)}
    # ten thousand side by side are one round
    began = time.time()
    wide = spark.createDataFrame([("x (y) " * 10_000 + "(" * 10_000,)], "t string").select(F.size(tx.training_words(F.col("t"))).alias("n")).first()["n"]
    assert wide == 10_000 and time.time() - began < 20


def test_descriptor_without_a_row_of_all_names(spark, many_partitions, tmp_path):
    import json

    names = [f'r"{k}\\ é,' if k % 7 == 0 else f"rec {k:03}" for k in range(90)]
    rows = spark.createDataFrame([(n,) for n in [*names, names[0]]], "rec string")
    files.write_descriptor(rows, str(tmp_path / "d"), 'Ti"tle', {"audio_dir": "a/"})
    parts = sorted((tmp_path / "d").glob("part-*"))
    whole = "".join(p.read_text() for p in parts)
    assert len(parts) > 1 and json.loads(whole) == {"title": 'Ti"tle', "paths": {"audio_dir": "a/"}, "recordings": sorted(names)}
    found = files.descriptor_lines(spark, str(tmp_path / "d")).orderBy("position").collect()
    assert [(r["title"], r["position"], r["rec"], r["paths"]) for r in found] == [('Ti"tle', k, n, '{"audio_dir":"a/"}') for k, n in enumerate(sorted(names), 1)]
    (tmp_path / "one.json").write_text(whole)
    assert [r["rec"] for r in files.descriptor(spark, str(tmp_path / "one.json")).orderBy("position").collect()] == sorted(names)
    files.write_descriptor(rows.limit(0), str(tmp_path / "e"), "none", {})
    assert files.descriptor_lines(spark, str(tmp_path / "e")).collect() == []
