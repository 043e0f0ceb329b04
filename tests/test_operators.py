"""Properties and edge cases of the operators."""

import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from speechloom.functions import text as tx
from speechloom.functions import values as vx
from speechloom.operators import align, metrics, sequence, tables
from speechloom.operators.validation import assert_valid, manifest_violations
from speechloom.sources import files
from speechloom.streaming import regions


def words_of(rng, n):
    return [rng.choice(["a", "b", "c", "dd", "é"]) for _ in range(n)]


def test_alignment_counts_add_up(spark):
    rng = random.Random(3)
    pairs = [(str(k), words_of(rng, rng.randint(0, 9)), words_of(rng, rng.randint(0, 9))) for k in range(60)]
    df = spark.createDataFrame(pairs, "clip string, ref array<string>, hyp array<string>")
    n = align.operation_counts(F.col("ops"))
    rows = align.with_operations(df).select("ref", "hyp", *[n[k].alias(k) for k in n], align.word_distance(F.col("ref"), F.col("hyp")).alias("d")).collect()
    for r in rows:
        assert r.substitutions + r.deletions + r.insertions == r.d
        assert r.correct + r.substitutions + r.deletions == len(r.ref)
        assert r.correct + r.substitutions + r.insertions == len(r.hyp)


def test_alignment_ties():
    assert align.alignment_path(["a"], ["b", "a"]) == "IC"
    assert align.alignment_path(["a", "b"], []) == "DD"
    assert align.alignment_path([], []) == ""
    assert align.alignment_path(["x", "y"], ["z"]) == "DS"


def test_inserted_words_take_the_next_label(spark):
    df = spark.createDataFrame([("c", ["a"], ["x", "a", "y"], ["eng"]), ("d", [], ["q"], [])], "clip string, ref array<string>, hyp array<string>, lang array<string>")
    rows = {(r.clip, r.pos): (r.operation, r.langid) for r in align.alignment_rows(align.with_operations(df)).collect()}
    assert rows == {("c", 0): ("insertion", "eng"), ("c", 1): ("correct", "eng"), ("c", 2): ("insertion", "eng"), ("d", 0): ("insertion", "unknown")}


def test_segments_fit_the_budget(spark):
    rng = random.Random(5)
    rows = []
    for rec in ("a", "b", None):
        at = 0
        for utt in range(40):
            length = rng.choice([100, 900, 2500])
            rows.append((rec, utt, at, at + length))
            at += length + rng.randint(0, 300)
    df = spark.createDataFrame(rows, "rec string, utt long, start_ms long, end_ms long")
    out = sequence.segment_by_budget(df, 2000).collect()
    assert len(out) == len(rows)
    for rec in ("a", "b", None):
        mine = sorted((r for r in out if r.rec == rec), key=lambda r: r.utt)
        assert [r.seg for r in mine] == sorted(r.seg for r in mine)
        for s in {r.seg for r in mine}:
            group = [r for r in mine if r.seg == s]
            assert len(group) == 1 or group[-1].end_ms - group[0].start_ms <= 2000
            after = [r for r in mine if r.seg == s + 1]
            if after:
                assert after[0].end_ms - group[0].start_ms > 2000
    assert sequence.segment_by_budget(df.limit(0), 2000).count() == 0


def test_merging_uses_the_last_end_and_an_inclusive_gap(spark):
    df = spark.createDataFrame([("r", 0, 100, 1), ("r", 10, 20, 2), ("r", 30, 40, 3), ("r", 51, 60, 4)], "rec string, start long, end long, event_id long")
    merged = sequence.merge_gaps(df, 10, ["start", "event_id"]).orderBy("start").collect()
    assert [(r.start, r["end"], r.n) for r in merged] == [(0, 40, 3), (51, 60, 1)]


def test_split_is_disjoint_and_overshoots_to_whole_recordings(spark):
    rows = [(f"r{k % 7}", k) for k in range(50)]
    df = spark.createDataFrame(rows, "rec string, clip long")
    train, test = tables.split_by_recording(df, 1)
    a, b = ({tuple(r) for r in x.collect()} for x in (train, test))
    assert a | b == set(rows) and not a & b and len(b) >= 5
    assert not {r for r, _ in a} & {r for r, _ in b}
    one_train, one_test = tables.split_single_recording(df.withColumn("rec", F.lit("r")), 1)
    assert (one_train.count(), one_test.count()) == (45, 5)


def test_histogram_of_equal_values_is_padded(spark):
    df = spark.createDataFrame([(3.0,)] * 4 + [(None,)], "seconds double")
    rows = metrics.histogram(df, "seconds", 4).orderBy("bin").collect()
    assert sum(r.n for r in rows) == 4 and rows[0].low == 2.5 and rows[-1].high == 3.5


def test_text_rules(spark):
    df = spark.createDataFrame([("a(b(c)d)e <x_y> www ¿Qué? it's Straße $5",)], "s string")
    row = df.select(tx.training_words(F.col("s")).alias("t"), tx.evaluation_words(F.col("s")).alias("e"), tx.wer_words(F.col("s")).alias("w")).first()
    assert row.t == ["ae", "x", "y", "Qué", "its", "Straße", "$5"]
    assert row.e == ["ade", "x", "y", "www", "qué", "its", "strasse", "$5"]
    assert row.w == ["abcde", "x_y", "www", "qué", "its", "strasse", "5"]


def test_values(spark):
    df = spark.createDataFrame([(3, 0, 61_500, "eng&spa"), (None, 2, -5, None)], "n int, d int, ms long, l string")
    rows = df.select(vx.safe_ratio(F.col("n"), F.col("d")).alias("a"), vx.safe_ratio(F.col("n"), F.col("d"), "zero").alias("z"), vx.clock(F.col("ms")).alias("c"), vx.canonical_language(F.col("l")).alias("l"), vx.viewer_language(F.col("l")).alias("v")).collect()
    assert [tuple(r) for r in rows] == [(None, 0.0, "1:02", None, "other"), (None, 0.0, "0:00", None, "other")]
    samples = spark.createDataFrame([([0.5, -2.0, 0.25],)], "x array<double>").select(vx.dequantise_pcm(vx.quantise_pcm(F.col("x"))).alias("y")).first().y
    assert np.allclose([float(v) for v in samples], [0.5, -1.0, 0.25], atol=1e-4)


def test_ranked_numbers_all_rows(spark):
    df = spark.range(500).select((F.col("id") * 7 % 13).alias("v"), "id")
    rows = tables.ranked(df, [F.desc("v"), F.asc("id")]).collect()
    want = sorted(((r.v, r.id) for r in rows), key=lambda x: (-x[0], x[1]))
    assert [(r.v, r.id) for r in sorted(rows, key=lambda r: r["rank"])] == want
    assert sorted(r["rank"] for r in rows) == list(range(1, 501))


def test_manifest_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("p.wav", 'a, "b"\nc', [("é", "eng")])], "audio_path string, transcript string, word_langids array<struct<word: string, langid: string>>")
    files.write_manifest(df, f"{tmp_path}/m", ["transcript", "audio_path", "word_langids"])
    back = files.read_manifest(spark, f"{tmp_path}/m")
    assert back.columns == ["transcript", "audio_path", "word_langids"]
    row = back.select("transcript", vx.parse_labels(F.col("word_langids")).alias("w")).first()
    assert row.transcript == 'a, "b"\nc' and row.w[0].word == "é"


def test_chat_files(spark, tmp_path):
    (tmp_path / "rec1.cha").write_bytes("@Participants:\tMAR, JON\r\n@Languages:\teng, spa\r\n*MAR:\thello@s:eng&spa [- spa] \x1510_20\x15 \x1530_40\x15\r\n%eng:\tfirst\r\n%eng:\tsecond\r\n*JON:\tuntimed \xff.\r\n".encode("latin-1"))
    lines = files.chat_lines(spark, str(tmp_path))
    rows = files.chat_tiers(lines).orderBy("line_no").collect()
    assert [r.kind for r in rows] == ["header", "header", "speech", "translation", "translation", "speech", "other"]
    assert (rows[2].speaker, rows[2].start_ms, rows[2].end_ms, rows[2].shown) == ("MAR", 10, 20, "hello")
    assert rows[5].start_ms is None and "�" in rows[5].shown
    assert files.chat_headers(lines).first().headers["Languages"] == "eng, spa"
    spoken = sequence.number_rows(files.chat_tiers(lines).where("kind = 'speech'").select("rec", "line_no"), ["rec"], ["line_no"], "utt")
    tiers = files.chat_tiers(lines).where("kind <> 'header'").select("rec", "line_no", F.when(F.col("kind") == "translation", F.col("shown")).alias("translation")).join(spoken, ["rec", "line_no"], "left")
    assert {r.utt: r.translation for r in sequence.fill_translations(tiers).collect()} == {1: "second", 2: ""}


def test_word_tables(spark, tmp_path):
    (tmp_path / "rec1_cgwords.tsv").write_text('utterance_id\tsurface\tlangid\textra\n1\t"a\tb"\teng\tx\n\tlost\tspa\tx\n2\tc\teng&spa\tx\n')
    rows = files.word_tables(spark, str(tmp_path)).orderBy("utterance_id").collect()
    assert [tuple(r) for r in rows] == [("rec1", 1, "a\tb", "eng"), ("rec1", 2, "c", "eng&spa")]


def test_wav_headers(spark, tmp_path):
    def wav(name, rate, data, cut=0):
        head = b"RIFF" + struct.pack("<I", 36 + data) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate * 2, 2, 16) + b"data" + struct.pack("<I", data)
        (tmp_path / name).write_bytes((head + bytes(data))[: len(head) + data - cut])

    wav("a.wav", 16000, 32000)
    wav("b.wav", 8000, 8000)
    wav("c.wav", 0, 100)
    wav("d.wav", 8000, 8000, cut=10)
    (tmp_path / "e.wav").write_bytes(b"RIFF")
    rows = {r.rec: (r.seconds, r.error) for r in files.wav_durations(spark, str(tmp_path)).collect()}
    assert rows["a"] == (1.0, None) and rows["b"] == (0.5, None)
    assert [rows[k][1] for k in "cde"] == ["invalid frame rate", "truncated", "no WAV header"]
    assert {r.rec for r in files.recordings(spark, str(tmp_path)).collect()} == set("abcde")


def test_descriptor_and_run_results(spark, tmp_path):
    (tmp_path / "d.json").write_text('{"title": "T",\n "recordings": ["x", "y"], "paths": {"audio_dir": "a/"}}')
    assert [(r.position, r.rec) for r in files.descriptor(spark, f"{tmp_path}/d.json").collect()] == [(1, "x"), (2, "y")]
    (tmp_path / "runs.csv").write_text("run_name,evaluated_at,evaluation_step,wer,lid_accuracy\na,2025-01-01T10:00:00+0100,,0.5,nan\nb,2025-01-01T10:00:00+01:00,7,0.25,0.9\n")
    rows = {r.run_name: r for r in files.run_results(spark, f"{tmp_path}/runs.csv").collect()}
    assert rows["a"].evaluated_at == rows["b"].evaluated_at is not None
    assert rows["a"].evaluation_step is None and np.isnan(rows["a"].lid_accuracy) and rows["b"].evaluation_step == 7


def test_published_results_are_consistent():
    """Fixed values of published run rows: errors over words is the rate, and losses add up."""
    for errors, words, rate in ((1411, 2782, 0.5071890726), (959, 2782, 0.3447160316), (1510, 2782, 0.5427749820)):
        assert abs(errors / words - rate) < 1e-9
    assert abs(1.2432559402 + 0.3 * 0.0849129026 - 1.2687298110) < 1e-9


def test_validation(spark):
    rows = [("a", "one two", '[{"word": "one", "langid": "eng"}, {"word": "two", "langid": "eng"}]'), ("b", "x", "[{"), ("c", "x", "[]"), ("d", "x y", '[{"word": "x", "langid": "eng"}]')]
    df = spark.createDataFrame(rows, "audio_path string, transcript string, word_langids string")
    found = {r.rule: r.violations for r in manifest_violations(df, df.where("audio_path <> 'a'"), ["audio_path", "language_counts"]).collect()}
    assert found == {"missing_column": 1, "empty_table": 0, "bad_json": 1, "empty_labels": 1, "missing_audio": 1, "label_mismatch": 1}
    with pytest.raises(ValueError, match="bad_json"):
        assert_valid(df, df, ["audio_path"])


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    new = spark.createDataFrame([("b", 3), ("c", 4)], "k string, v int")
    once = tables.upsert(old, new, "k")
    assert sorted(map(tuple, tables.upsert(once, new, "k").collect())) == sorted(map(tuple, once.collect())) == [("a", 1), ("b", 3), ("c", 4)]


def test_streams(spark, sf, tmp_path):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    (tmp_path / "in").mkdir()
    spark.read.parquet(f"{sf}/events.parquet").coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/in")
    events = spark.readStream.schema(schema).parquet(f"{tmp_path}/in").withColumn("ts", F.col("ts").cast("timestamp"))
    q = regions.session_regions(events, "4 hours", "1 hour").writeStream.format("memory").queryName("regions").outputMode("append").option("checkpointLocation", f"{tmp_path}/c1").start()
    q.processAllAvailable()
    q.stop()
    batch = spark.read.parquet(f"{sf}/events.parquet").count()
    assert 0 < spark.table("regions").agg(F.sum("n")).first()[0] <= batch
    spark.createDataFrame([("a", 1, 0.5), ("b", 1, 0.4), ("a", 2, 0.3)], "run_name string, evaluation_step long, loss double").coalesce(1).write.parquet(f"{tmp_path}/runs")
    results = spark.readStream.schema("run_name string, evaluation_step long, loss double").parquet(f"{tmp_path}/runs")
    q = regions.upsert_results(results, f"{tmp_path}/table", f"{tmp_path}/c2")
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/table/version=0").select("run_name", "evaluation_step").collect())) == [("a", 2), ("b", 1)]
