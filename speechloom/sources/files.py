"""Readers and writers of corpus files: transcripts, word tables, manifests, descriptors, WAV headers."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from speechloom.functions.text import SPEECH_LINE, speech_parts, stem, transcript_display
from speechloom.functions.values import parse_offset_timestamp
from speechloom.operators.tables import ranked
from speechloom.sources.wav import wav_files

#: What ends a transcript in a bundle: the format's last line.
CHAT_END = "\n@End\n"
WORD_SCHEMA = "utterance_id string, surface string, langid string"
#: Fixed values of the run table: its number columns, the first four of which are integers.
RESULT_FIELDS = ("evaluation_step", "clips", "reference_words", "word_errors", "wer", "loss", "token_loss", "language_id_loss", "lid_accuracy")


def _files(spark: SparkSession, folder: str, pattern: str, key: str | None = None) -> DataFrame:
    """Files of a folder, or with a key those of its subfolders key=name."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", key is not None).load(folder)


def _named(path: Column, key: str | None) -> Column:
    """A file's name without its ending, or with a key the name that its subfolder key=name gives."""
    return stem(path) if key is None else F.url_decode(F.regexp_extract(path, f"{key}=([^/]*)/", 1))


def recordings(spark: SparkSession, folder: str, pattern: str = "*.wav", key: str | None = None) -> DataFrame:
    """(path, rec, length) of the files of a folder in order of path; their content is not read.

    With a key, files lie in subfolders key=name, as Spark writes them, and rec is that name.
    """
    return _files(spark, folder, pattern, key).select("path", _named(F.col("path"), key).alias("rec"), "length").orderBy("path")


def write_recording_bundles(lines: DataFrame, folder: str) -> None:
    """Recordings (path, content) in a Parquet table; a row is a piece of one, such as a line, so that no row holds a long one."""
    lines.select("path", F.octet_length("content").cast("long").alias("length"), "content").write.parquet(folder)


def bundled_recordings(spark: SparkSession, folder: str) -> DataFrame:
    """(path, rec, length) of a table that write_recording_bundles() has written, as recordings() gives them of single files."""
    found = spark.read.parquet(folder).groupBy("path").agg(F.sum("length").alias("length"))
    return found.select("path", stem(F.col("path")).alias("rec"), "length").orderBy("path")


def chat_lines(spark: SparkSession, folder: str, pattern: str = "*.cha", key: str | None = None) -> DataFrame:
    """(rec, line_no, line) of transcripts, in file order; bytes that are no UTF-8 are replaced.

    A transcript is one file of a recording, so it is a single row until its lines are exploded. key: as in
    recordings().
    """
    text = F.make_valid_utf8(F.col("content").cast("string"))
    lines = _files(spark, folder, pattern, key).select(_named(F.col("path"), key).alias("rec"), F.posexplode(F.split(F.replace(text, F.lit("\r"), F.lit("")), "\n")).alias("p", "line"))
    return lines.select("rec", (F.col("p") + 1).cast("long").alias("line_no"), "line")


def write_chat_bundles(transcripts: DataFrame, folder: str) -> None:
    """Transcripts (rec, text) in text files of many: a record is a name on a line of its own and the text, and ends with a line @End.

    There are as many files as partitions, however many recordings. Names hold no line break and texts no line @End.
    """
    transcripts.select(F.concat("rec", F.lit("\n"), "text").alias("value")).write.option("lineSep", CHAT_END).text(folder)


def chat_bundle_lines(spark: SparkSession, folder: str) -> DataFrame:
    """(rec, line_no, line) of bundles that write_chat_bundles() has written, as chat_lines() gives them of single files."""
    text = F.replace(F.make_valid_utf8("value"), F.lit("\r"), F.lit(""))
    rows = spark.read.option("lineSep", CHAT_END).text(folder).select(F.posexplode(F.split(text, "\n")).alias("p", "line"), F.substring_index("value", "\n", 1).alias("rec"))
    return rows.where("p > 0").select("rec", F.col("p").cast("long").alias("line_no"), "line")


def chat_tiers(lines: DataFrame) -> DataFrame:
    """Lines with kind (header, speech, translation or other), speaker, shown text, start_ms and end_ms."""
    line = F.col("line")
    kind = F.when(line.startswith("@"), "header").when(line.rlike(SPEECH_LINE), "speech").when(line.startswith("%eng:"), "translation").otherwise("other")
    parts = speech_parts(line)
    shown = F.when(F.col("kind") == "speech", transcript_display(parts["text"])).when(F.col("kind") == "translation", transcript_display(F.substring(line, F.lit(6), F.length(line))))
    return lines.withColumn("kind", kind).select("rec", "line_no", "kind", *[F.when(F.col("kind") == "speech", parts[c]).alias(c) for c in ("speaker", "start_ms", "end_ms")], shown.alias("shown"), "line")


def chat_headers(lines: DataFrame) -> DataFrame:
    """(rec, headers): a map of each transcript's @key: value lines; of a repeated key the last counts."""
    key, value = F.regexp_extract("line", r"^@([^:]+):\s*(.*)$", 1), F.regexp_extract("line", r"^@([^:]+):\s*(.*)$", 2)
    pairs = lines.select("rec", "line_no", key.alias("key"), value.alias("value")).where("key <> ''")
    newest = pairs.groupBy("rec", "key").agg(F.max_by("value", "line_no").alias("value"))
    return newest.groupBy("rec").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("headers"))


def word_tables(spark: SparkSession, folder: str, suffix: str = "_cgwords", key: str | None = None) -> DataFrame:
    """(rec, utterance_id, surface, langid) of quoted tab-separated files with a header; rows without an id go.

    Columns are taken by name from each file's header. key: as in recordings(), for files of any name.
    """
    raw = spark.read.csv(f"{folder}/*{suffix}.tsv" if key is None else folder, sep="\t", header=True, quote='"', escape='"', multiLine=True)
    names = ["utterance_id", "surface", "langid"]
    rec = F.regexp_replace(stem(F.col("_metadata.file_name")), f"{suffix}$", "") if key is None else _named(F.col("_metadata.file_path"), key)
    named = raw.select(rec.alias("rec"), *names)
    return named.where("utterance_id <> ''").withColumn("utterance_id", F.col("utterance_id").cast("long"))


def write_word_bundles(words: DataFrame, folder: str) -> None:
    """Word tables of many recordings in quoted tab-separated files with a header, the recording's name in the column rec.

    A file holds a million words at most, as one task reads it: its cells may hold line breaks.
    """
    words.write.option("maxRecordsPerFile", 1_000_000).option("header", True).option("sep", "\t").option("quote", '"').option("escape", '"').option("quoteAll", True).csv(folder)


def word_bundles(spark: SparkSession, folder: str) -> DataFrame:
    """(rec, utterance_id, surface, langid) of files that write_word_bundles() has written; rows without an id go."""
    raw = spark.read.csv(folder, sep="\t", header=True, quote='"', escape='"', multiLine=True)
    return raw.select("rec", "utterance_id", "surface", "langid").where("utterance_id <> ''").withColumn("utterance_id", F.col("utterance_id").cast("long"))


def read_manifest(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A CSV manifest with quoted newlines; every column is text unless a schema is given."""
    reader = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"')
    return (reader.schema(schema) if schema else reader.option("inferSchema", False)).csv(path)


def write_manifest(df: DataFrame, path: str, columns: list[str]) -> None:
    """CSV with these columns in this order; nested ones become JSON cells."""
    cells: list[Column] = [F.to_json(c).alias(c) if df.schema[c].dataType.typeName() in ("array", "map", "struct") else F.col(c) for c in columns]
    df.select(*cells).write.option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "").csv(path)


def descriptor(spark: SparkSession, path: str) -> DataFrame:
    """(title, position, rec, paths) of a data set's JSON descriptor in one file: one row per recording.

    The document is one row until its list is exploded, so it ends at 2 GB; descriptor_lines() has no such end.
    """
    doc = spark.read.json(path, multiLine=True)
    return doc.select("title", F.posexplode("recordings").alias("p", "rec"), F.to_json("paths").alias("paths")).select("title", (F.col("p") + 1).cast("long").alias("position"), "rec", "paths")


def write_descriptor(recordings: DataFrame, folder: str, title: str, paths: dict[str, str]) -> None:
    """A data set's descriptor as text files which, one after another in the order of their names, are one JSON document.

    recordings: rec. A line is a recording, in order of name, so that no row holds the list.
    """
    placed = ranked(recordings.select("rec").distinct(), [F.col("rec")], "place")
    total = placed.agg(F.count(F.lit(1)).alias("total"))  # one row
    quoted = F.to_json(F.array("rec"))
    name = F.concat(F.substring(quoted, F.lit(2), F.length(quoted) - 2), F.when(F.col("place") < F.col("total"), ",").otherwise(""))
    lines = placed.crossJoin(F.broadcast(total)).select("place", name.alias("line"))
    head = json.dumps({"title": title, "paths": paths, "recordings": []}, ensure_ascii=False).removesuffix("]}")
    ends = total.select(F.inline(F.array(F.struct(F.lit(0).cast("long").alias("place"), F.lit(head).alias("line")), F.struct((F.col("total") + 1).alias("place"), F.lit("]}").alias("line")))))
    whole = lines.unionByName(ends).repartitionByRange("place").sortWithinPartitions("place")
    whole.select(F.col("line").alias("value")).write.text(folder)


def descriptor_lines(spark: SparkSession, folder: str) -> DataFrame:
    """(title, position, rec, paths) of a descriptor that write_descriptor() has written, line by line."""
    block = F.col("_metadata.file_block_start")
    lines = spark.read.text(folder).select("value", F.struct(F.col("_metadata.file_name"), block, F.monotonically_increasing_id()).alias("at"))
    head = lines.where(F.startswith("value", F.lit("{"))).select(F.from_json(F.concat("value", F.lit("]}")), "title string, paths map<string, string>").alias("h"))  # one row
    names = lines.where(F.startswith("value", F.lit('"'))).select("at", F.from_json(F.concat(F.lit("["), F.regexp_replace("value", ",$", ""), F.lit("]")), "array<string>")[0].alias("rec"))
    placed = ranked(names, [F.col("at")], "position")
    return placed.crossJoin(F.broadcast(head)).select("h.title", "position", "rec", F.to_json("h.paths").alias("paths"))


def wav_durations(spark: SparkSession, folder: str, pattern: str = "*.wav", key: str | None = None) -> DataFrame:
    """(rec, seconds, error) of the WAV files of a folder; files that cannot be read have an error.

    Files without bytes are not in the list, as Spark leaves them out. key: as in recordings().
    """
    found = _files(spark, folder, pattern, key)
    return wav_files(found.select(_named(F.col("path"), key).alias("rec"), "path", "length", "content"), folder)


def run_results(spark: SparkSession, path: str) -> DataFrame:
    """The run table: numbers where cells are numbers, null where they are empty, NaN where they say nan."""
    raw = read_manifest(spark, path)
    return raw.select("run_name", parse_offset_timestamp(F.col("evaluated_at")).alias("evaluated_at"), *[F.col(c).try_cast("long" if c in RESULT_FIELDS[:4] else "double").alias(c) for c in RESULT_FIELDS if c in raw.columns])
