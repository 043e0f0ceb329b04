"""Files of many recordings: their number does not grow with the recordings."""

from pathlib import Path

from speechloom.plans import files as plans
from speechloom.plans import registry
from speechloom.sources import files


def conversations(spark, path, n):
    rows = [(k, t, "user", f'one "two"\tthree\r\nfour {k}') for k in range(n) for t in range(3)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{path}/conversations.parquet")


def written(base, label):
    return [p for p in Path(base).glob(f"{label}-*/**/part-*") if p.suffix != ".crc"]


def shared(spark, monkeypatch, path):
    monkeypatch.setattr(plans, "scratch", lambda _, label: f"{path}/out/{label}-x")


def test_transcripts_share_files(spark, tmp_path, monkeypatch):
    conversations(spark, tmp_path, 200)
    shared(spark, monkeypatch, tmp_path)
    rows = registry.QUERIES["src_chat_lines"](spark, str(tmp_path)).collect()
    assert len(rows) == 200 and {r["n"] for r in rows} == {7}
    assert 0 < len(written(f"{tmp_path}/out", "chat")) <= 8


def test_word_tables_share_files(spark, tmp_path, monkeypatch):
    conversations(spark, tmp_path, 200)
    shared(spark, monkeypatch, tmp_path)
    rows = registry.QUERIES["src_word_tsv"](spark, str(tmp_path)).collect()
    assert len(rows) == 200 * 3 * 5 and len({r["rec"] for r in rows}) == 200
    assert 0 < len(written(f"{tmp_path}/out", "tsv")) <= 16


def test_bundle_keeps_lines(spark, tmp_path):
    texts = [("a b/ü", "@Begin\n*MAR:\tone\r\n\n@Ending\n%eng:\t@End "), ("c", ""), ("d", "last\n")]
    files.write_chat_bundles(spark.createDataFrame(texts, "rec string, text string").coalesce(1), f"{tmp_path}/b")
    got = sorted(map(tuple, files.chat_bundle_lines(spark, f"{tmp_path}/b").collect()))
    assert got == sorted((rec, k, line) for rec, text in texts for k, line in enumerate(text.replace("\r", "").split("\n"), 1))


def test_recordings_share_files(spark, tmp_path, monkeypatch):
    rows = [(k, k % 300, None if k % 7 == 0 else k / 8) for k in range(900)]
    spark.createDataFrame(rows, "event_id long, user_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    shared(spark, monkeypatch, tmp_path)
    found = registry.QUERIES["src_recordings"](spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in found) == [(u, f"user_{u}") for u in range(300)]
    assert 0 < len(written(f"{tmp_path}/out", "recordings")) <= 8


def test_bundled_recordings_have_their_length(spark, tmp_path):
    lines = spark.createDataFrame([("x/b.wav", "12"), ("x/a.tar.gz", "ü"), ("x/b.wav", "345")], "path string, content string")
    files.write_recording_bundles(lines, f"{tmp_path}/b")
    assert [tuple(r) for r in files.bundled_recordings(spark, f"{tmp_path}/b").collect()] == [("x/a.tar.gz", "a.tar", 2), ("x/b.wav", "b", 5)]
