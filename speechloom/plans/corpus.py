"""Queries from recordings to manifests."""

from __future__ import annotations

from pyspark.sql import functions as F

from speechloom.fixtures import REGION_GAP
from speechloom.functions import text as tx
from speechloom.functions import values as vx
from speechloom.operators import metrics, sequence, tables
from speechloom.plans import manifest
from speechloom.plans.registry import query


@query("proj_recording_key", r"SELECT audio_path, regexp_extract(audio_path, '([^/]*)$', 1) AS base, replace(regexp_extract(audio_path, '([^/]*)$', 1), '.wav', '') AS stem, rec AS recording FROM seg")
def proj_recording_key(v):
    path = F.col("audio_path")
    return v.seg.select("audio_path", tx.base_name(path).alias("base"), tx.stem(path).alias("stem"), tx.recording_key(path).alias("recording"))


@query("filter_kept", "SELECT rec, seg, filtered_out FROM vad WHERE lower(coalesce(filtered_out, 'false')) <> 'true'")
def filter_kept(v):
    return tables.kept(v.vad).select("rec", "seg", "filtered_out")


@query("proj_train_manifest", "SELECT audio_path, transcript, n_words, (SELECT count(DISTINCT x) FROM (SELECT unnest(string_split(langs, ' ')) AS x) WHERE x <> '') AS n_labels FROM vad WHERE lower(coalesce(filtered_out, 'false')) <> 'true'")
def proj_train_manifest(v):
    out = manifest.train_manifest(tables.kept(v.vad))
    return out.select("audio_path", "transcript", F.size("word_langids").cast("long").alias("n_words"), F.size("language_counts").cast("long").alias("n_labels"))


@query("filter_tokens_with_id", "SELECT rec, utt, pos, word FROM tok WHERE pos % 7 <> 3")
def filter_tokens_with_id(v):
    raw = v.tok.withColumn("utterance_id", F.when(F.col("pos") % 7 == 3, "").otherwise(F.col("utt").cast("string")))
    return raw.where("utterance_id <> ''").select("rec", F.col("utterance_id").cast("long").alias("utt"), "pos", "word")


@query("filter_timed_utterances", "SELECT rec, line_no, start_ms, end_ms FROM line WHERE timed AND nw > 0")
def filter_timed_utterances(v):
    return v.line.where("timed and nw > 0").select("rec", "line_no", "start_ms", "end_ms")


@query("proj_durations", "SELECT audio_path, (end_ms - start_ms) / 1000.0::DOUBLE AS seconds, printf('%.3f', start_ms / 1000.0::DOUBLE) || '–' || printf('%.3f', end_ms / 1000.0::DOUBLE) AS range_text FROM seg")
def proj_durations(v):
    span = F.concat(vx.fixed(F.col("start_ms") / 1000, 3), F.lit("–"), vx.fixed(F.col("end_ms") / 1000, 3))
    return v.seg.select("audio_path", ((F.col("end_ms") - F.col("start_ms")) / 1000.0).cast("double").alias("seconds"), span.alias("range_text"))


@query("proj_provenance", "SELECT audio_path, 'whisper' AS model_backend, 'medium' AS model_name, 'cpu' AS device FROM seg")
def proj_provenance(v):
    return v.seg.select("audio_path", F.lit("whisper").alias("model_backend"), F.lit("medium").alias("model_name"), F.lit("cpu").alias("device"))


@query("token_flags", "SELECT rec, utt, pos, word, regexp_matches(langid, '[&+]') AS mixed FROM tok WHERE word <> '' AND langid <> ''")
def token_flags(v):
    labels = manifest.utterance_tokens(v.tok)
    named = labels.select("rec", "utt", F.posexplode(F.filter("tokens", lambda t: (t["word"] != "") & (t["langid"] != ""))).alias("p", "t"))
    return named.select("rec", "utt", (F.col("p") + 1).cast("long").alias("pos"), F.col("t.word").alias("word"), F.col("t.langid").rlike("[&+]").alias("mixed"))


@query("stage_counts", "SELECT coalesce(lower(filtered_out), 'false') AS status, count(*) AS n FROM vad GROUP BY ALL")
def stage_counts(v):
    return v.vad.groupBy(F.lower(F.coalesce("filtered_out", F.lit("false"))).alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("join_recording_files", "SELECT rec, rec IN (SELECT rec FROM chats) AND rec IN (SELECT rec FROM tsvs) AS complete FROM audio")
def join_recording_files(v):
    whole = tables.complete_recordings(v.audio, v.chats, v.tsvs).withColumn("complete", F.lit(True))
    return whole.unionByName(tables.incomplete_recordings(v.audio, v.chats, v.tsvs).withColumn("complete", F.lit(False)))


@query("join_utterance_tokens", "SELECT u.rec, u.utt, u.start_ms, u.end_ms, len(words)::BIGINT AS n_tokens FROM utt u WHERE len(words) > 0")
def join_utterance_tokens(v):
    joined = v.utt.select("rec", "utt", "start_ms", "end_ms").join(manifest.utterance_tokens(v.tok), ["rec", "utt"])
    return joined.select("rec", "utt", "start_ms", "end_ms", F.size("tokens").cast("long").alias("n_tokens"))


@query("join_stage_compare", "SELECT a.rec, a.seg, a.start_ms, a.end_ms, b.filtered_out AS vad_flag FROM seg a JOIN vad b ON a.audio_path = b.audio_path")
def join_stage_compare(v):
    # the right side repeats each clip with another flag; the last row of a clip wins
    right = v.vad.select("audio_path", "filtered_out", F.lit(2).alias("row")).unionByName(v.seg.select("audio_path", F.lit("stale").alias("filtered_out"), F.lit(1).alias("row")))
    newest = tables.last_per_key(right.withColumn("name", tx.base_name(F.col("audio_path"))), ["name"], ["row"]).select("name", F.col("filtered_out").alias("vad_flag"))
    return v.seg.withColumn("name", tx.base_name(F.col("audio_path"))).join(newest, "name").select("rec", "seg", "start_ms", "end_ms", "vad_flag")


@query("join_point_in_interval", "SELECT t.rec, t.t, u.utt FROM (SELECT rec, start_ms + 500 AS t FROM utt UNION ALL SELECT rec, end_ms FROM utt) t JOIN utt u ON u.rec = t.rec AND t.t BETWEEN u.start_ms AND u.end_ms")
def join_point_in_interval(v):
    ticks = v.utt.select("rec", (F.col("start_ms") + 500).alias("t")).unionByName(v.utt.select("rec", F.col("end_ms").alias("t")))
    return tables.point_in_interval(ticks, v.utt.select("rec", "utt", "start_ms", "end_ms"), 10_000).select("rec", "t", "utt")


@query("agg_utterance_tokens", "SELECT rec, utt, string_agg(word || '/' || langid, ' ' ORDER BY pos) AS tokens FROM tok GROUP BY rec, utt")
def agg_utterance_tokens(v):
    return manifest.utterance_tokens(v.tok).select("rec", "utt", F.array_join(F.transform("tokens", lambda t: F.concat(t["word"], F.lit("/"), t["langid"])), " ").alias("tokens"))


@query("agg_segments", "SELECT rec, seg, audio_path, start_ms, end_ms, transcript, langs, n_words, utts, speakers FROM seg")
def agg_segments(v):
    return v.seg.select("rec", "seg", "audio_path", "start_ms", "end_ms", "transcript", F.array_join("word_langids.langid", " ").alias("langs"), F.size("word_langids").cast("long").alias("n_words"), F.array_join(F.col("utterance_ids").cast("array<string>"), ",").alias("utts"), "speakers")


@query("agg_language_counts", "SELECT rec, seg, langid, count(*) AS n FROM segtok GROUP BY ALL")
def agg_language_counts(v):
    return v.seg.select("rec", "seg", F.explode("language_counts").alias("langid", "n"))


@query("agg_clips_per_recording", "SELECT rec AS recording, count(*) AS n FROM seg GROUP BY rec")
def agg_clips_per_recording(v):
    return v.seg.groupBy(tx.recording_key(F.col("audio_path")).alias("recording")).agg(F.count(F.lit(1)).alias("n"))


@query("win_utterance_id", "SELECT rec, utterance_id, start_ms FROM (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY line_no) AS utterance_id FROM line) WHERE timed AND nw > 0")
def win_utterance_id(v):
    return sequence.number_rows(v.line, ["rec"], ["line_no"], "utterance_id").where("timed and nw > 0").select("rec", "utterance_id", "start_ms")


@query("win_segment_number", "SELECT rec, start_ms, row_number() OVER (PARTITION BY rec ORDER BY start_ms, seg) AS number, rec || '_' || printf('%04d', row_number() OVER (PARTITION BY rec ORDER BY start_ms, seg)) AS segment_id FROM seg")
def win_segment_number(v):
    out = sequence.number_rows(v.seg.select("rec", "seg", "start_ms"), ["rec"], ["start_ms", "seg"], "number")
    return out.select("rec", "start_ms", "number", manifest.segment_name(F.col("rec"), F.col("number")).alias("segment_id"))


@query("seq_segment_budget", "SELECT rec, utt, start_ms, end_ms, seg FROM useg")
def seq_segment_budget(v):
    return v.useg.select("rec", "utt", "start_ms", "end_ms", "seg")


@query("win_merge_gaps", 'SELECT rec, island, start, "end", n FROM island')
def win_merge_gaps(v):
    return sequence.merge_gaps(v.reg, REGION_GAP, ["start", "event_id"])


@query("win_first_n", "SELECT rec, seg FROM seg WHERE seg <= 2")
def win_first_n(v):
    return sequence.first_n(v.seg.select("rec", "seg"), ["rec"], ["seg"], 2)


@query("agg_trimmed_length", 'SELECT a.rec, coalesce(sum(i."end" - i.start), 0)::BIGINT AS length, count(i.rec) = 0 AS filtered_out FROM (SELECT DISTINCT user_id AS rec FROM events) a LEFT JOIN (SELECT * FROM island WHERE rec % 3 <> 0) i ON i.rec = a.rec GROUP BY a.rec')
def agg_trimmed_length(v):
    merged = sequence.merge_gaps(v.reg, REGION_GAP, ["start", "event_id"]).where("rec % 3 <> 0")
    sums = merged.groupBy("rec").agg(F.sum(F.col("end") - F.col("start")).alias("length"))
    return v.reg.select("rec").distinct().join(sums, "rec", "left").select("rec", F.coalesce("length", F.lit(0)).cast("long").alias("length"), F.col("length").isNull().alias("filtered_out"))


@query("top_recordings", "SELECT rec FROM audio ORDER BY rec LIMIT 10")
def top_recordings(v):
    return v.audio.select("rec").orderBy("rec").limit(10)


@query("union_kept_filtered", "SELECT rec, seg, CASE WHEN lower(coalesce(filtered_out, 'false')) = 'true' THEN 1 ELSE 0 END AS part FROM vad")
def union_kept_filtered(v):
    kept = tables.kept(v.vad).select("rec", "seg", F.lit(0).alias("part"))
    return kept.unionByName(v.vad.where("lower(filtered_out) = 'true'").select("rec", "seg", F.lit(1).alias("part")))


@query("fn_training_words", r"""SELECT rec, utt, pos, array_to_string(list_filter(regexp_split_to_array(regexp_replace(translate(
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(surface, '\([^()]*\)', '', 'g'), '\([^()]*\)', '', 'g'), '\([^()]*\)', '', 'g'), '\([^()]*\)', '', 'g'),
  '_<>', ' '), '\p{P}', '', 'g'), '\s+'), lambda w: w <> '' AND lower(w) NOT IN ('www', 'xxx')), ' ') AS words FROM surf""")
def fn_training_words(v):
    return v.surf.select("rec", "utt", "pos", F.array_join(tx.training_words(F.col("surface")), " ").alias("words"))


@query("fn_eval_words", r"SELECT rec, utt, pos, array_to_string(list_filter(regexp_split_to_array(replace(lower(regexp_replace(translate(regexp_replace(surface, '\([^)]*\)', '', 'g'), '_<>', ' '), '\p{P}', '', 'g')), 'ß', 'ss'), '\s+'), lambda w: w <> ''), ' ') AS words FROM surf")
def fn_eval_words(v):
    return v.surf.select("rec", "utt", "pos", F.array_join(tx.evaluation_words(F.col("surface")), " ").alias("words"))


@query("fn_wer_words", r"SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(regexp_replace(replace(lower(replace(text, ' ', ' ')), 'ß', 'ss'), '[^\p{L}\p{N}_\s]', '', 'g'), '\s+'), lambda w: w <> ''), ' ') AS words FROM documents")
def fn_wer_words(v):
    return v.table("documents").select("doc_id", F.array_join(tx.wer_words(F.col("text")), " ").alias("words"))


@query("fn_label_word", r"SELECT rec, utt, pos, replace(lower(regexp_replace(trim(surface), '\p{P}', '', 'g')), 'ß', 'ss') AS word FROM surf")
def fn_label_word(v):
    return v.surf.select("rec", "utt", "pos", tx.label_word(F.col("surface")).alias("word"))


@query("fn_viewer_word", r"SELECT rec, utt, pos, regexp_replace(lower(surface), '[^\p{L}\p{N}]', '', 'g') AS word FROM surf")
def fn_viewer_word(v):
    return v.surf.select("rec", "utt", "pos", tx.viewer_word(F.col("surface")).alias("word"))


@query("fn_labels_safe", r"SELECT user_id, event_id, regexp_replace(event_type || user_id, '([A-Za-z]+)_?(\d+)$', '\1 \2') AS display, regexp_replace(event_type || '/' || user_id || ' x', '[^A-Za-z0-9._-]+', '-', 'g') AS safe FROM events")
def fn_labels_safe(v):
    name = F.concat("event_type", F.col("user_id").cast("string"))
    raw = F.concat("event_type", F.lit("/"), F.col("user_id").cast("string"), F.lit(" x"))
    return v.table("events").select("user_id", "event_id", tx.recording_name(name).alias("display"), tx.file_safe(raw).alias("safe"))


@query("fn_resolve_path", "SELECT rec, seg, CASE WHEN seg % 2 = 0 THEN '/abs/' || audio_path ELSE 'base/' || audio_path END AS path FROM seg")
def fn_resolve_path(v):
    given = F.when(F.col("seg") % 2 == 0, F.concat(F.lit("/abs/"), F.col("audio_path"))).otherwise(F.col("audio_path"))
    return v.seg.select("rec", "seg", tx.resolve_path(given, F.lit("base/")).alias("path"))


@query("fn_clock", "SELECT rec, utt, printf('%d:%02d', s // 60, s % 60) AS clock FROM (SELECT rec, utt, greatest(floor((start_ms - 2000) / 1000.0::DOUBLE + 0.5), 0)::BIGINT AS s FROM utt)")
def fn_clock(v):
    return v.utt.select("rec", "utt", vx.clock(F.col("start_ms") - 2000).alias("clock"))


@query("fn_quantise_pcm", "SELECT clip, idx, trunc(greatest(-1.0, least(1.0, value * 3)) * 32767)::INT AS pcm, trunc(greatest(-1.0, least(1.0, value * 3)) * 32767)::INT / 32768.0::DOUBLE AS back FROM smx")
def fn_quantise_pcm(v):
    pcm = v.smp.select("clip", vx.quantise_pcm(F.transform("samples", lambda x: x * 3)).alias("pcm"))
    both = pcm.select("clip", F.posexplode(F.arrays_zip("pcm", vx.dequantise_pcm(F.col("pcm")).alias("back"))).alias("p", "z"))
    return both.select("clip", F.col("p").cast("long").alias("idx"), F.col("z.pcm").alias("pcm"), F.col("z.back").cast("double").alias("back"))


@query("fn_cut_regions", "SELECT clip, len(x)::BIGINT AS n, list_sum(x) AS total FROM (SELECT clip, list_concat(samples[3:8], samples[21:30]) AS x FROM smp)")
def fn_cut_regions(v):
    regions = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in ((2, 8), (12, 12), (20, 30))])
    cut = v.smp.select("clip", vx.cut_regions(F.col("samples"), regions).alias("x"))
    return cut.select("clip", F.size("x").cast("long").alias("n"), F.aggregate("x", F.lit(0.0), lambda a, b: a + b).alias("total"))


@query("fn_canonical_lang", "SELECT rec, utt, pos, CASE WHEN langid IN ('eng', 'spa', 'other') THEN langid WHEN langid = 'eng+spa' THEN 'mixed' END AS canonical FROM tok")
def fn_canonical_lang(v):
    return v.tok.select("rec", "utt", "pos", vx.canonical_language(F.concat(F.lit(" "), F.upper("langid"))).alias("canonical"))


@query("fn_viewer_lang", "SELECT rec, utt, pos, CASE WHEN langid IN ('eng', 'spa') THEN langid WHEN langid = 'eng+spa' THEN 'mixed' ELSE 'other' END AS shown FROM tok")
def fn_viewer_lang(v):
    return v.tok.select("rec", "utt", "pos", vx.viewer_language(F.upper("langid")).alias("shown"))


@query("fn_parse_labels", "SELECT rec, utt, CASE WHEN utt % 4 = 3 THEN '' ELSE string_agg(CASE WHEN pos % 5 = 0 THEN '' ELSE word || '/' || CASE WHEN pos % 3 = 0 THEN 'unknown' ELSE langid END || ' ' END, '' ORDER BY pos) END AS labels FROM tok GROUP BY rec, utt")
def fn_parse_labels(v):
    items = F.transform("tokens", lambda t, i: F.struct(F.when((i + 1) % 5 != 0, t["word"]).alias("word"), F.when((i + 1) % 3 != 0, t["langid"]).alias("langid")))
    cells = manifest.utterance_tokens(v.tok).select("rec", "utt", F.when(F.col("utt") % 4 == 3, "[{bad").otherwise(F.to_json(items)).alias("cell"))
    return cells.select("rec", "utt", F.array_join(F.transform(vx.parse_labels(F.col("cell")), lambda t: F.concat(t["word"], F.lit("/"), t["langid"], F.lit(" "))), "").alias("labels"))


@query("json_roundtrip", "SELECT rec, seg, coalesce(string_agg(langid || '=' || n, ',' ORDER BY langid), '') AS counts FROM (SELECT u.rec, u.seg, t.langid, count(t.langid) AS n FROM (SELECT DISTINCT rec, seg FROM useg) u LEFT JOIN segtok t ON t.rec = u.rec AND t.seg = u.seg GROUP BY ALL) GROUP BY rec, seg")
def json_roundtrip(v):
    cells = v.seg.select("rec", "seg", F.to_json("language_counts").alias("cell"))
    parsed = F.array_sort(F.map_entries(F.from_json("cell", "map<string, long>")))
    return cells.select("rec", "seg", F.array_join(F.transform(parsed, lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("counts"))


@query("validate_manifest", """SELECT 'missing_column' AS rule, 1::BIGINT AS violations UNION ALL SELECT 'empty_table', 0 UNION ALL SELECT 'bad_json', count(*) FROM (SELECT rec, seg, seg % 5 AS k, n_words FROM seg) WHERE k = 0
UNION ALL SELECT 'empty_labels', count(*) FROM (SELECT rec, seg, seg % 5 AS k, n_words FROM seg) WHERE k = 1 OR (n_words = 0 AND k <> 0) UNION ALL SELECT 'missing_audio', count(*) FROM (SELECT rec, seg, seg % 5 AS k, n_words FROM seg) WHERE seg % 9 = 4
UNION ALL SELECT 'label_mismatch', count(*) FROM (SELECT rec, seg, seg % 5 AS k, n_words FROM seg) WHERE k = 2 AND n_words > 0""")
def validate_manifest(v):
    from speechloom.operators.validation import manifest_violations

    k = F.col("seg") % 5
    cell = F.when(k == 0, "[{").when(k == 1, "[]").otherwise(F.to_json("word_langids"))
    text = F.when(k == 2, F.concat("transcript", F.lit(" extra"))).otherwise(F.col("transcript"))
    given = v.seg.select("audio_path", "seg", text.alias("transcript"), cell.alias("word_langids"))
    listing = v.seg.where("seg % 9 <> 4").select("audio_path")
    return manifest_violations(given, listing, ["audio_path", "transcript", "word_langids", "language_counts"])


@query("agg_duration_stats", "SELECT avg(seconds) AS mean, median(seconds) AS median, min(seconds) AS low, max(seconds) AS high, count(*) AS n FROM dur")
def agg_duration_stats(v):
    rest = v.dur.agg(F.avg("seconds").cast("double").alias("mean"), F.min("seconds").cast("double").alias("low"), F.max("seconds").cast("double").alias("high"), F.count(F.lit(1)).alias("n"))
    return rest.crossJoin(tables.exact_median(v.dur, "seconds"))  # one row each


@query("agg_histogram", """SELECT range AS bin, lo + range * w AS low, lo + (range + 1) * w AS high, coalesce(n, 0) AS n, coalesce(n, 0) / total::DOUBLE AS probability FROM range(20) CROSS JOIN
 (SELECT min(seconds) AS lo, (max(seconds) - min(seconds)) / 20 AS w, count(*) AS total FROM dur) LEFT JOIN
 (SELECT least(floor((seconds - (SELECT min(seconds) FROM dur)) / (SELECT (max(seconds) - min(seconds)) / 20 FROM dur)), 19)::BIGINT AS bin, count(*) AS n FROM dur GROUP BY 1) c ON c.bin = range""")
def agg_histogram(v):
    return metrics.histogram(v.dur.select(F.col("seconds").cast("double").alias("seconds")), "seconds", 20)


@query("agg_envelope", "SELECT clip, idx // s AS bucket, min(value) AS low, max(value) AS high FROM smx JOIN (SELECT clip AS c, ceil(count(*) / 10.0)::BIGINT AS s FROM smx GROUP BY clip) ON c = clip GROUP BY clip, idx // s")
def agg_envelope(v):
    return metrics.envelope(v.smx, 10)


@query("agg_retention", "SELECT rec, seg, CASE WHEN lower(coalesce(filtered_out, 'false')) = 'true' THEN 0.0 ELSE 0.75 END::DOUBLE AS retained, CASE WHEN lower(coalesce(filtered_out, 'false')) = 'true' THEN s ELSE greatest(s - 0.75 * s, 0) END AS removed FROM (SELECT *, (end_ms - start_ms) / 1000.0::DOUBLE AS s FROM vad) WHERE s > 0")
def agg_retention(v):
    from speechloom.operators.review import retention

    source = v.seg.select("rec", "seg", "audio_path", ((F.col("end_ms") - F.col("start_ms")) / 1000.0).cast("double").alias("source_s")).where("source_s > 0")
    trimmed = v.vad.select("audio_path", "filtered_out", ((F.col("end_ms") - F.col("start_ms")) / 1000.0 * 0.75).cast("double").alias("trimmed_s"))
    return retention(source, trimmed).select("rec", "seg", "retained", "removed")
