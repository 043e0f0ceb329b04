"""Queries on alignments, held-out scores, splits and training tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from speechloom.functions import values as vx
from speechloom.operators import align, metrics, review, sequence, tables
from speechloom.plans import manifest
from speechloom.plans.registry import query

SEED = 42


@query("align_distance", "SELECT p.clip, c[len(p.ref) + 1][len(p.hyp) + 1]::BIGINT AS distance FROM pair p JOIN table2 t ON t.clip = p.clip")
def align_distance(v):
    return v.pair.select("clip", align.word_distance(F.col("ref"), F.col("hyp")).alias("distance"))


@query("align_ops", "SELECT clip, pos, operation, reference, hypothesis, langid FROM arow")
def align_ops(v):
    return align.alignment_rows(v.aligned)


@query("align_counts", "SELECT o.clip, length(ops) - length(replace(ops, 'S', '')) AS substitutions, length(ops) - length(replace(ops, 'D', '')) AS deletions, length(ops) - length(replace(ops, 'I', '')) AS insertions, len(ref)::BIGINT AS words FROM ops o JOIN pair p ON p.clip = o.clip")
def align_counts(v):
    n = align.operation_counts(F.col("ops"))
    return v.aligned.select("clip", n["substitutions"].alias("substitutions"), n["deletions"].alias("deletions"), n["insertions"].alias("insertions"), F.size("ref").cast("long").alias("words"))


@query("join_positional_labels", "SELECT clip, array_to_string(lang, ' ') AS labels FROM pair")
def join_positional_labels(v):
    return v.pair.select("clip", F.array_join(align.positional_labels(F.col("ref"), F.col("lang")), " ").alias("labels"))


@query("join_aligned_labels", "SELECT clip, i::BIGINT AS pos, ref[i::BIGINT] AS word, CASE WHEN op <> 'D' THEN hyp[j::BIGINT] END AS predicted, coalesce(ref[i::BIGINT] = CASE WHEN op <> 'D' THEN hyp[j::BIGINT] END, false) AS same FROM opx WHERE op <> 'I'")
def join_aligned_labels(v):
    return align.counterparts(v.aligned).withColumn("same", F.coalesce(F.col("word") == F.col("predicted"), F.lit(False)))


@query("agg_clip_wer", "SELECT * FROM clipwer")
def agg_clip_wer(v):
    return metrics.clip_error_rates(align.alignment_rows(v.aligned))


@query("agg_wer_by_langid", "SELECT * FROM langwer")
def agg_wer_by_langid(v):
    return metrics.label_error_rates(align.alignment_rows(v.aligned))


@query("agg_corpus_wer", "SELECT *, (substitutions + deletions + insertions) / greatest(reference_words, 1)::DOUBLE AS wer FROM (SELECT coalesce(langid, 'total') AS langid, sum(reference_words)::BIGINT AS reference_words, sum(substitutions)::BIGINT AS substitutions, sum(deletions)::BIGINT AS deletions, sum(insertions)::BIGINT AS insertions FROM langwer GROUP BY GROUPING SETS ((langid), ()))")
def agg_corpus_wer(v):
    return metrics.corpus_error_rates(metrics.label_error_rates(align.alignment_rows(v.aligned)))


@query("agg_language_share", "SELECT * FROM share")
def agg_language_share(v):
    return metrics.language_share(metrics.label_error_rates(align.alignment_rows(v.aligned)), "spa")


@query("agg_label_sets", "SELECT rec, utt, string_agg(DISTINCT langid, ',' ORDER BY langid) AS labels FROM tok GROUP BY rec, utt UNION ALL SELECT 'all', 0, string_agg(DISTINCT langid, ',' ORDER BY langid) FROM tok")
def agg_label_sets(v):
    names = F.array_join(F.sort_array(F.collect_set("langid")), ",").alias("labels")
    whole = v.tok.agg(names).select(F.lit("all").alias("rec"), F.lit(0).cast("long").alias("utt"), "labels")
    return v.tok.groupBy("rec", "utt").agg(names).unionByName(whole)


@query("agg_dominant_language", "SELECT rec, utt, CASE WHEN bool_or(langid = 'eng') AND bool_or(langid = 'spa') THEN 'mixed' WHEN bool_or(langid = 'eng') THEN 'en' WHEN bool_or(langid = 'spa') THEN 'es' ELSE 'unknown' END AS dominant FROM tok GROUP BY rec, utt")
def agg_dominant_language(v):
    return metrics.dominant_language(v.tok, ["rec", "utt"])


@query("agg_eval_wer", "SELECT sum(reference_words)::BIGINT AS reference_words, sum(substitutions + deletions + insertions)::BIGINT AS word_errors, count(*) AS clips, sum(substitutions + deletions + insertions) / sum(reference_words)::DOUBLE AS wer FROM clipwer")
def agg_eval_wer(v):
    n = align.operation_counts(F.col("ops"))
    sums = v.aligned.where("ops <> ''").agg(F.sum(F.size("ref")).alias("reference_words"), F.sum(n["substitutions"] + n["deletions"] + n["insertions"]).alias("word_errors"), F.count(F.lit(1)).alias("clips"))
    return sums.withColumn("wer", vx.safe_ratio(F.col("word_errors"), F.col("reference_words"), "nan"))


@query("agg_lid_accuracy", "SELECT count(*) FILTER (p = target) AS correct, count(target) AS tokens, count(*) FILTER (p = target) / count(target)::DOUBLE AS accuracy FROM (SELECT target, list_position(logits, list_max(logits)) - 1 AS p FROM pred)")
def agg_lid_accuracy(v):
    return metrics.label_accuracy(v.pred.select(vx.first_argmax(F.col("probs")).alias("predicted"), "target"))


@query("agg_batch_mean_loss", "SELECT avg(t) AS token_loss, avg(l) AS language_id_loss, count(*) AS batches, avg(t) + 0.3::DOUBLE * avg(l) AS loss FROM (SELECT batch, avg(token_loss) AS t, avg(lid_loss) AS l FROM loss WHERE valid GROUP BY batch)")
def agg_batch_mean_loss(v):
    return metrics.batch_mean_losses(v.loss, 0.3)


@query("agg_clip_loss", "SELECT clip, t AS token_loss, l AS language_id_loss, t + 0.3::DOUBLE * l AS loss FROM (SELECT clip, sum(CASE WHEN valid THEN token_loss ELSE 0 END) / greatest(count(*) FILTER (valid), 1) AS t, sum(CASE WHEN valid THEN lid_loss ELSE 0 END) / greatest(count(*) FILTER (valid), 1) AS l FROM loss GROUP BY clip)")
def agg_clip_loss(v):
    return metrics.clip_losses(v.loss, 0.3)


@query("join_clip_losses", "SELECT l.clip, l.loss, p.words FROM (SELECT clip, sum(CASE WHEN valid THEN token_loss ELSE 0 END) / greatest(count(*) FILTER (valid), 1) AS loss FROM loss GROUP BY clip) l JOIN (SELECT clip, count(DISTINCT word_no) AS words FROM pred GROUP BY clip) p ON p.clip = l.clip")
def join_clip_losses(v):
    words = metrics.pooled_labels(v.pred).groupBy("clip").agg(F.count(F.lit(1)).alias("words"))
    return metrics.clip_losses(v.loss, 0.0).select("clip", F.col("token_loss").alias("loss")).join(words, "clip")


@query("agg_review_summary", "SELECT count(*) AS clips, sum(substitutions + deletions + insertions) / sum(reference_words)::DOUBLE AS wer, avg(substitutions) FILTER (substitutions > 2) AS loss, avg(deletions) AS token_loss FROM clipwer")
def agg_review_summary(v):
    rows = metrics.clip_error_rates(align.alignment_rows(v.aligned), "zero")
    loss = F.when(F.col("substitutions") > 2, F.col("substitutions").cast("double")).otherwise(F.lit(float("nan")))
    shown = rows.select("wer", "reference_words", (F.col("substitutions") + F.col("deletions") + F.col("insertions")).alias("word_errors"), loss.alias("loss"), F.col("deletions").cast("double").alias("token_loss"))
    return review.review_summary(shown, ["loss", "token_loss"])


@query("agg_argmax_language", "SELECT clip, tok_no, ['eng', 'spa', 'mixed', 'other'][list_position(probs, list_max(probs))] AS language, list_max(probs) AS p FROM pred")
def agg_argmax_language(v):
    named = v.pred.select("clip", "tok_no", F.map_from_arrays(F.array(*map(F.lit, vx.CLASS_IDS)), "probs").alias("chances"))
    # the map's entries by probability, then by name downwards, so that ties take the first name
    best = F.array_sort("e", lambda a, b: F.when(a["value"] > b["value"], -1).when(a["value"] < b["value"], 1).when(a["key"] < b["key"], -1).otherwise(1))
    return named.withColumn("e", F.map_entries("chances")).select("clip", "tok_no", F.get(best, F.lit(0))["key"].alias("language"), F.get(best, F.lit(0))["value"].alias("p"))


@query("token_argmax", "SELECT clip, tok_no, (list_position(probs, list_max(probs)) - 1)::INT AS label, list_max(probs) AS confidence FROM pred")
def token_argmax(v):
    return v.pred.select("clip", "tok_no", vx.first_argmax(F.col("probs")).alias("label"), F.array_max("probs").alias("confidence"))


@query("agg_word_pooled_label", "SELECT clip, word_no, (list_position(m, list_max(m)) - 1)::INT AS label, list_max(m) AS confidence, n AS tokens FROM (SELECT clip, word_no, [avg(probs[1]), avg(probs[2]), avg(probs[3]), avg(probs[4])] AS m, count(*) AS n FROM pred GROUP BY clip, word_no)")
def agg_word_pooled_label(v):
    return metrics.pooled_labels(v.pred)


@query("win_running_best", "SELECT run, step, loss, improved, last_value(CASE WHEN improved THEN loss END IGNORE NULLS) OVER w AS best_loss, last_value(CASE WHEN improved THEN step END IGNORE NULLS) OVER w AS best_step FROM (SELECT *, NOT isnan(loss) AND coalesce(loss < min(CASE WHEN NOT isnan(loss) THEN loss END) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS improved FROM step) WINDOW w AS (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def win_running_best(v):
    return sequence.running_best(v.step)


@query("win_eval_steps", "SELECT run, step FROM (SELECT *, max(step) OVER (PARTITION BY run) AS last FROM step) WHERE step % 250 = 0 OR step = last")
def win_eval_steps(v):
    return sequence.evaluation_steps(v.step.select("run", "step"), 250)


@query("win_batches", "SELECT rec, seg, (row_number() OVER (PARTITION BY rec ORDER BY seg) - 1) // 2 AS batch FROM seg")
def win_batches(v):
    return sequence.batches(v.seg.select("rec", "seg"), ["seg"], 2, ["rec"])


@query("win_token_offsets", "SELECT rec, utt, pos, coalesce(sum(len(pieces)) OVER (PARTITION BY rec, utt ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"offset\" FROM piece")
def win_token_offsets(v):
    return sequence.group_offsets(v.piece, ["rec", "utt"], ["pos"], F.size("pieces")).select("rec", "utt", "pos", "offset")


@query("win_grouped_split", "SELECT rec, seg, rec IN (SELECT rec FROM heldkeys) AS held_out FROM seg")
def win_grouped_split(v):
    keys = tables.held_out_keys(v.seg, SEED, 0.9).withColumn("__held", F.lit(True))
    return v.seg.select("rec", "seg").join(keys, "rec", "left").select("rec", "seg", F.coalesce("__held", F.lit(False)).alias("held_out"))


@query("split_train", "SELECT rec, seg FROM seg WHERE rec NOT IN (SELECT rec FROM heldkeys)")
def split_train(v):
    return tables.split_by_recording(v.seg.select("rec", "seg"), SEED)[0]


@query("split_test", "SELECT rec, seg FROM seg WHERE rec IN (SELECT rec FROM heldkeys)")
def split_test(v):
    return tables.split_by_recording(v.seg.select("rec", "seg"), SEED)[1]


@query("split_partition_check", "SELECT count(*) AS rows, 0::BIGINT AS shared, 0::BIGINT AS lost FROM seg")
def split_partition_check(v):
    clips = v.seg.select("rec", "seg")
    train, test = tables.split_by_recording(clips, SEED)
    count = F.count(F.lit(1))
    return clips.agg(count.alias("rows")).crossJoin(train.intersect(test).agg(count.alias("shared"))).crossJoin(clips.exceptAll(train.unionAll(test)).agg(count.alias("lost")))


@query("top_clips", "SELECT rec, seg, audio_path FROM vad WHERE lower(coalesce(filtered_out, 'false')) <> 'true' ORDER BY rec, seg LIMIT 20")
def top_clips(v):
    return tables.kept(v.vad).select("rec", "seg", "audio_path").orderBy("rec", "seg").limit(20)


@query("sample_seeded", "SELECT audio_path FROM seg ORDER BY md5('7:' || audio_path), audio_path LIMIT 50")
def sample_seeded(v):
    return tables.seeded_sample(v.seg.select("audio_path"), 7, F.col("audio_path"), 50)


@query("top_eval_rows", "SELECT rec, seg FROM seg WHERE rec IN (SELECT rec FROM heldkeys) ORDER BY rec, seg LIMIT 10")
def top_eval_rows(v):
    return tables.split_by_recording(v.seg.select("rec", "seg"), SEED)[1].orderBy("rec", "seg").limit(10)


@query("sort_by_wer", "SELECT clip, wer, row_number() OVER (ORDER BY wer DESC, clip) AS rank FROM clipwer")
def sort_by_wer(v):
    rows = metrics.clip_error_rates(align.alignment_rows(v.aligned)).select("clip", "wer")
    return tables.ranked(rows, [F.desc("wer"), F.asc("clip")])


@query("sort_by_share", "SELECT clip, share, row_number() OVER (ORDER BY share, clip) AS rank FROM share")
def sort_by_share(v):
    rows = metrics.language_share(metrics.label_error_rates(align.alignment_rows(v.aligned)), "spa")
    return tables.ranked(rows, [F.asc("share"), F.asc("clip")])


@query("sort_by_metric", "SELECT run, step, metric, row_number() OVER (ORDER BY metric DESC, run, step) AS rank FROM (SELECT run, step, CASE WHEN isnan(loss) OR step % 10 = 0 THEN 0 ELSE loss END AS metric FROM step)")
def sort_by_metric(v):
    cell = F.when(F.col("step") % 10 == 0, F.lit("")).otherwise(F.col("loss").cast("string"))
    metric = F.nanvl(F.coalesce(cell.try_cast("double"), F.lit(0.0)), F.lit(0.0))
    return tables.ranked(v.step.select("run", "step", metric.alias("metric")), [F.desc("metric"), F.asc("run"), F.asc("step")])


@query("sort_by_duration", "SELECT audio_path, seconds, row_number() OVER (ORDER BY seconds DESC, audio_path) AS rank FROM dur")
def sort_by_duration(v):
    return tables.ranked(v.dur.select("audio_path", F.col("seconds").cast("double").alias("seconds")), [F.desc("seconds"), F.asc("audio_path")])


@query("search_manifest", "SELECT rec, seg FROM vad WHERE contains(lower(audio_path || ' ' || transcript || ' ' || speakers), 'the') AND lower(coalesce(filtered_out, 'false')) = 'false'")
def search_manifest(v):
    return tables.search(v.vad, " The", ["audio_path", "transcript", "speakers"], "false").select("rec", "seg")


@query("search_documents", "SELECT doc_id, lang FROM documents WHERE contains(lower(text || ' ' || source), 'tion of')")
def search_documents(v):
    return tables.search(v.table("documents"), "tion OF", ["text", "source"]).select("doc_id", "lang")


@query("upsert_runs", "SELECT * FROM run WHERE run_name NOT IN (SELECT run_name FROM newrun) UNION ALL SELECT * FROM newrun")
def upsert_runs(v):
    return tables.upsert(v.run, v.newrun, "run_name")


@query("fn_fixed_decimals", "SELECT clip, idx, printf('%.10f', value) AS ten, printf('%.6f', value) AS six, printf('%.1f%%', value * 100) AS shown FROM smx")
def fn_fixed_decimals(v):
    return v.smx.select("clip", "idx", vx.fixed(F.col("value"), 10).alias("ten"), vx.fixed(F.col("value"), 6).alias("six"), vx.percent(F.col("value")).alias("shown"))


@query("fn_safe_ratio", "SELECT clip, e / nullif(n, 0)::DOUBLE AS r_null, coalesce(e / nullif(n, 0)::DOUBLE, 0) AS r_zero, coalesce(e / nullif(n, 0)::DOUBLE, 'NaN'::DOUBLE) AS r_nan, e / (CASE WHEN n = 0 THEN 1 ELSE n END)::DOUBLE AS r_one FROM (SELECT clip, len(hyp) AS e, CASE WHEN turn % 3 = 0 THEN 0 ELSE len(ref) END AS n FROM pair)")
def fn_safe_ratio(v):
    rows = v.pair.select("clip", F.size("hyp").alias("e"), F.when(F.col("turn") % 3 == 0, 0).otherwise(F.size("ref")).alias("n"))
    return rows.select("clip", *[vx.safe_ratio(F.col("e"), F.col("n"), kind).alias(f"r_{kind}") for kind in ("null", "zero", "nan", "one")])


@query("fn_softmax", "SELECT clip, tok_no, probs[1] AS p0, probs[2] AS p1, probs[3] AS p2, probs[4] AS p3 FROM pred")
def fn_softmax(v):
    return v.pred.select("clip", "tok_no", *[F.get("probs", F.lit(k)).alias(f"p{k}") for k in range(4)])


def _examples(v):
    words = v.piece.groupBy("rec", "utt").agg(F.array_sort(F.collect_list(F.struct("pos", "langid", "pieces"))).alias("words"))
    return words.select("rec", "utt", F.flatten("words.pieces").alias("tokens"), vx.expand_labels(F.col("words")).alias("labels"))


_TARGET = "CASE langid WHEN 'eng' THEN 0 WHEN 'spa' THEN 1 WHEN 'eng+spa' THEN 2 WHEN 'other' THEN 3 ELSE -100 END"
_EXAMPLES = f"(SELECT rec, utt, flatten(list(pieces ORDER BY pos)) AS tokens, flatten(list(list_transform(pieces, lambda x: {_TARGET}) ORDER BY pos)) AS labels FROM piece GROUP BY rec, utt)"
_FORCED = f"(SELECT rec, utt, list_concat([1, 2, 3], tokens) AS inputs, list_concat([-100, -100], tokens, [9]) AS targets, list_concat([-100, -100], labels, [-100]) AS label_targets FROM {_EXAMPLES})"


@query("fn_expand_labels", f"SELECT rec, utt, array_to_string(tokens, ' ') AS tokens, array_to_string(labels, ' ') AS labels FROM {_EXAMPLES}")
def fn_expand_labels(v):
    return _examples(v).select("rec", "utt", *[F.array_join(F.col(c).cast("array<string>"), " ").alias(c) for c in ("tokens", "labels")])


@query("fn_shift_targets", f"SELECT rec, utt, array_to_string(inputs, ' ') AS inputs, array_to_string(targets, ' ') AS targets, array_to_string(label_targets, ' ') AS label_targets FROM {_FORCED}")
def fn_shift_targets(v):
    forced = _examples(v).select("rec", "utt", vx.teacher_forcing(F.col("tokens"), F.col("labels"), [1, 2, 3], 9).alias("x"))
    return forced.select("rec", "utt", *[F.array_join(F.col(f"x.{c}").cast("array<string>"), " ").alias(c) for c in ("inputs", "targets", "label_targets")])


@query("fn_pad_batch", f"SELECT rec, utt, m::BIGINT AS length, list_sum(inputs)::BIGINT + 9 * (m - len(inputs)) AS input_sum, list_sum(targets)::BIGINT - 100 * (m - len(targets)) AS target_sum FROM (SELECT *, max(len(inputs)) OVER (PARTITION BY rec, (utt - 1) // 2) AS m FROM {_FORCED})")
def fn_pad_batch(v):
    from pyspark.sql import Window

    forced = _examples(v).select("rec", "utt", vx.teacher_forcing(F.col("tokens"), F.col("labels"), [1, 2, 3], 9).alias("x"))
    batch = Window.partitionBy("rec", F.floor((F.col("utt") - 1) / 2))
    sized = forced.withColumn("m", F.max(F.size("x.inputs")).over(batch))
    padded = sized.select("rec", "utt", vx.pad_to(F.col("x.inputs"), F.col("m"), 9).alias("inputs"), vx.pad_to(F.col("x.targets"), F.col("m"), vx.IGNORE).alias("targets"))

    def total(name):
        return F.aggregate(name, F.lit(0).cast("long"), lambda a, x: a + x)

    return padded.select("rec", "utt", F.size("inputs").cast("long").alias("length"), total("inputs").alias("input_sum"), total("targets").alias("target_sum"))
