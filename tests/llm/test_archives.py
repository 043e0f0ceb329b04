"""Exported archives by themselves: their own record index, and URLs of any bytes."""

import pytest
import zstandard
from pyspark.sql import functions as F

from speechloom.llm import warc


def test_an_exported_file_finds_its_records(spark, sf, tmp_path):
    bundles = warc.write_bundles(spark.read.parquet(f"{sf}/pages.parquet"))
    pages = {r["page_id"]: r["html"] or "" for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    seen = set()
    for name in warc.export_bundles(bundles, str(tmp_path)):
        with open(name, "rb") as file:
            archive = file.read()
        for record, frame, offset in warc.indexed_records(archive):
            fields, block = warc.read_record(archive, frame, offset)
            assert fields["WARC-Record-ID"] == record
            page = int(record.removeprefix("<urn:page:").removesuffix(">"))
            seen.add(page)
            assert fields["WARC-Type"] == "revisit" or block.partition(b"\r\n\r\n")[2].decode() == pages[page]
        # a plain reader passes over both skippable frames
        with zstandard.ZstdDecompressor().stream_reader(archive, read_across_frames=True) as reader:
            whole = reader.read()
        assert len(list(warc.parse_records(whole))) == len(warc.indexed_records(archive)) + 1
    assert seen == set(pages)
    with pytest.raises(ValueError, match="no record index"):
        warc.indexed_records(b"\x28\xb5\x2f\xfd" + bytes(12) + warc.seek_table([(16, 0)]))


def test_urls_of_any_bytes(spark):
    rows = spark.createDataFrame([(1, "x"), (2, "y")], "page_id long, html string")
    raw = F.when(F.col("page_id") == 1, F.unhex(F.lit("687474703A2F2F61FF2FC3A9E2820D0A")).cast("string")).otherwise("http://b/")
    bundles = warc.write_bundles(rows.withColumn("url", raw)).collect()
    urls = [warc.read_record(b.archive, f, o)[0]["WARC-Target-URI"] for b in bundles for _, f, o in warc.indexed_records(b.archive)]
    assert sorted(urls) == ["http://a%FF/é%E2%82%0D%0A", "http://b/"]
    assert sorted(r["page_id"] for r in warc.read_bundles(spark.createDataFrame(bundles)).collect()) == [1, 2]
