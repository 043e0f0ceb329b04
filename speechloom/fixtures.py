"""Corpus-shaped views over the driver tables: in Spark, and as DuckDB SQL of the same names for the oracle."""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from speechloom.functions import text as tx
from speechloom.operators import sequence
from speechloom.operators.scan import prefix_scan

BUDGET_MS = 20_000
#: Gap that merges regions of user activity: four hours in ms.
REGION_GAP = 14_400_000


def langid(word: Column, pos: Column) -> Column:
    k = (F.length(word) + pos) % 10
    return F.when(k <= 4, "eng").when(k <= 6, "spa").when(k == 7, "eng&spa").when(k == 8, "eng+spa").otherwise("other")


class Views:
    """The views over one folder of tables; each is built when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def utt(self) -> DataFrame:
        """Utterances: rec, utt, spk, nw, start_ms, end_ms, words, text."""
        base = self.table("conversations").select(
            F.concat(F.lit("conv_"), F.col("conv_id")).alias("rec"), (F.col("turn") + 1).alias("utt"), F.upper(F.substring("role", 1, 3)).alias("spk"),
            tx.split_words(tx.drop_punctuation(F.col("text"))).alias("words"), "text",
        )
        w = Window.partitionBy("rec").orderBy("utt").rowsBetween(Window.unboundedPreceding, -1)
        timed = base.withColumn("nw", F.size("words").cast("long")).withColumn("start_ms", F.coalesce(F.sum(F.col("nw") * 100 + 250).over(w), F.lit(0)).cast("long"))
        return timed.select("rec", "utt", "spk", "nw", "start_ms", (F.col("start_ms") + F.col("nw") * 100).alias("end_ms"), "words", "text")

    @cached_property
    def line(self) -> DataFrame:
        return self.utt.select("rec", F.col("utt").alias("line_no"), "spk", "nw", "start_ms", "end_ms", ((F.col("utt") + F.length("rec")) % 5 != 0).alias("timed"))

    @cached_property
    def tok(self) -> DataFrame:
        words = self.utt.select("rec", "utt", F.posexplode("words").alias("p", "word"))
        return words.select("rec", "utt", (F.col("p") + 1).cast("long").alias("pos"), "word", langid(F.col("word"), F.col("p") + 1).alias("langid"))

    @cached_property
    def surf(self) -> DataFrame:
        shapes = {0: ("(", ")"), 1: ("a(b(c)", ")e"), 2: ("<", ">"), 5: ("¿", "?"), 6: ("", "'s")}
        word, k = F.col("word"), F.col("pos") % 8
        out = F.when(k == 3, F.concat(word, F.lit("_"), word)).when(k == 4, F.lit("www"))
        for at, (left, right) in shapes.items():
            out = out.when(k == at, F.concat(F.lit(left), word, F.lit(right)))
        return self.tok.select("rec", "utt", "pos", out.otherwise(word).alias("surface"), "langid")

    @cached_property
    def useg(self) -> DataFrame:
        return sequence.segment_by_budget(self.utt.select("rec", "utt", "spk", "start_ms", "end_ms"), BUDGET_MS)

    @cached_property
    def seg(self) -> DataFrame:
        """The segment manifest: one row per segment with nested labels."""
        from speechloom.plans.manifest import segment_manifest

        return segment_manifest(self.useg, self.tok)

    @cached_property
    def vad(self) -> DataFrame:
        k = F.col("seg") % 7
        return self.seg.withColumn("filtered_out", F.when(k == 0, "True").when(k == 1, "FALSE").when(k != 2, "False"))

    @cached_property
    def reg(self) -> DataFrame:
        """Regions: rec, start, end, event_id."""
        start = F.unix_millis(F.col("ts").cast("timestamp"))
        return self.table("events").select(F.col("user_id").alias("rec"), start.alias("start"), (start + F.floor(F.col("value") * 60000 + 0.5).cast("long")).alias("end"), "event_id")

    @cached_property
    def smp(self) -> DataFrame:
        return self.table("embeddings").select(F.col("vec_id").alias("clip"), F.transform("embedding", lambda x: x.cast("double")).alias("samples"))

    @cached_property
    def smx(self) -> DataFrame:
        return self.smp.select("clip", F.posexplode("samples").alias("p", "value")).select("clip", F.col("p").cast("long").alias("idx"), "value")

    @cached_property
    def pair(self) -> DataFrame:
        """Reference and hypothesis words of whole turns: clip, turn, ref, hyp, lang (one short in some clips).

        Turns are dealt to as many tasks as a shuffle has, since the table may lie in few row groups.
        """
        tasks = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        base = self.table("conversations").repartition(tasks, "conv_id", "turn").select(F.concat_ws("_", "conv_id", "turn").alias("clip"), "turn", tx.wer_words(F.col("text")).alias("ref"))

        def heard(w: Column, i: Column) -> Column:
            return F.when(i % 7 == 6, F.lit(None)).when(i % 5 == 4, F.lit("zz")).when(i % 11 == 10, F.concat(w, F.lit("qq"))).otherwise(w)

        labels = F.transform("ref", lambda w, i: langid(w, i + 1))
        short = F.when((F.col("turn") % 6 == 5) & (F.size("ref") > 0), F.slice(labels, F.lit(1), F.size("ref") - 1)).otherwise(labels)
        return base.select("clip", "turn", "ref", F.filter(F.transform("ref", heard), lambda w: w.isNotNull()).alias("hyp"), short.alias("lang"))

    @cached_property
    def aligned(self) -> DataFrame:
        """Pairs with positional labels and their operations."""
        from speechloom.operators import align

        labelled = self.pair.withColumn("lang", align.positional_labels(F.col("ref"), F.col("lang")))
        return align.with_operations(labelled)

    @cached_property
    def pred(self) -> DataFrame:
        """Token predictions: clip, word_no, tok_no, logits, probs, target."""
        from speechloom.functions.values import softmax

        k = F.col("vec_id") % 12
        logits = F.transform(F.slice("embedding", 1, 4), lambda x: x.cast("double"))
        base = self.table("embeddings").select(F.floor(F.col("vec_id") / 12).cast("long").alias("clip"), F.floor(k / 3).cast("long").alias("word_no"), k.alias("tok_no"), logits.alias("logits"), F.nullif(F.col("label") % 5, F.lit(4)).cast("int").alias("target"))
        return base.withColumn("probs", softmax(F.col("logits")))

    @cached_property
    def loss(self) -> DataFrame:
        return self.smx.select("clip", F.floor(F.col("clip") / 4).cast("long").alias("batch"), "idx", F.abs("value").alias("token_loss"), (F.col("idx") % 5 != 0).alias("valid"), (F.col("value") * F.col("value")).alias("lid_loss"))

    @cached_property
    def step(self) -> DataFrame:
        """Metric rows: run, step, loss (NaN at step 1)."""
        rows = self.table("events").select(F.col("event_type").alias("run"), "event_id", "value")
        numbered = prefix_scan(rows, ["run"], [F.col("event_id")], {"step": ("sum", F.lit(1).cast("long"))})
        return numbered.select("run", "step", F.when(F.col("step") == 1, F.lit(float("nan"))).otherwise(F.col("value")).alias("loss"))

    @cached_property
    def run(self) -> DataFrame:
        """One result row per run: run_name, evaluation_step, clips, loss."""
        return self.step.groupBy(F.col("run").alias("run_name")).agg(F.max("step").alias("evaluation_step"), F.count_if(~F.isnan("loss")).alias("clips"), F.min(F.when(~F.isnan("loss"), F.col("loss"))).alias("loss"))

    @cached_property
    def newrun(self) -> DataFrame:
        """Other numbers for the runs with an even length of name, and one new run."""
        changed = self.run.where(F.length("run_name") % 2 == 0).select("run_name", (F.col("evaluation_step") + 1).alias("evaluation_step"), "clips", (F.col("loss") / 2).alias("loss"))
        fresh = self.run.agg(F.lit("fresh").alias("run_name"), F.max("evaluation_step").alias("evaluation_step"), F.sum("clips").alias("clips"), F.max("loss").alias("loss"))
        return changed.unionByName(fresh)

    @cached_property
    def piece(self) -> DataFrame:
        """Words with pieces of three letters: rec, utt, pos, word, langid, pieces."""
        starts = F.sequence(F.lit(1), F.length("word"), F.lit(3))
        ids = F.transform(starts, lambda _, i: (i + 100 * F.length("word")).cast("int"))
        return self.tok.withColumn("pieces", ids)

    @cached_property
    def audio(self) -> DataFrame:
        return self.table("conversations").select(F.concat(F.lit("conv_"), F.col("conv_id")).alias("rec"), "conv_id").distinct()

    @cached_property
    def chats(self) -> DataFrame:
        return self.audio.where("conv_id % 9 <> 4")

    @cached_property
    def tsvs(self) -> DataFrame:
        return self.audio.where("conv_id % 10 <> 3")

    @cached_property
    def dur(self) -> DataFrame:
        return self.seg.select("audio_path", ((F.col("end_ms") - F.col("start_ms")) / 1000.0).alias("seconds"))


#: The same views in DuckDB.
LANGID = "CASE WHEN (length({w}) + {p}) % 10 <= 4 THEN 'eng' WHEN (length({w}) + {p}) % 10 <= 6 THEN 'spa' WHEN (length({w}) + {p}) % 10 = 7 THEN 'eng&spa' WHEN (length({w}) + {p}) % 10 = 8 THEN 'eng+spa' ELSE 'other' END"
SQL = {
    "utt0": r"SELECT 'conv_' || conv_id AS rec, turn + 1 AS utt, upper(left(role, 3)) AS spk, text, list_filter(regexp_split_to_array(regexp_replace(replace(text, ' ', ' '), '\p{P}', '', 'g'), '\s+'), lambda w: w <> '') AS words FROM conversations",
    "utt1": "SELECT *, len(words)::BIGINT AS nw, coalesce(sum(len(words) * 100 + 250) OVER (PARTITION BY rec ORDER BY utt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_ms FROM utt0",
    "utt": "SELECT rec, utt, spk, nw, start_ms, start_ms + nw * 100 AS end_ms, words, text FROM utt1",
    "line": "SELECT rec, utt AS line_no, spk, nw, start_ms, end_ms, (utt + length(rec)) % 5 <> 0 AS timed FROM utt",
    "tok0": "SELECT rec, utt, unnest(range(1, nw + 1)) AS pos, unnest(words) AS word FROM utt",
    "tok": f"SELECT *, {LANGID.format(w='word', p='pos')} AS langid FROM tok0",
    "surf": "SELECT rec, utt, pos, langid, CASE pos % 8 WHEN 0 THEN '(' || word || ')' WHEN 1 THEN 'a(b(c)' || word || ')e' WHEN 2 THEN '<' || word || '>' WHEN 3 THEN word || '_' || word WHEN 4 THEN 'www' WHEN 5 THEN '¿' || word || '?' WHEN 6 THEN word || '''s' ELSE word END AS surface FROM tok",
    "urow": "SELECT *, row_number() OVER (PARTITION BY rec ORDER BY utt) AS rn FROM utt",
    "useg": f"SELECT rec, utt, spk, start_ms, end_ms, start_ms AS seg_start, 1::BIGINT AS seg, rn FROM urow WHERE rn = 1 UNION ALL SELECT u.rec, u.utt, u.spk, u.start_ms, u.end_ms, CASE WHEN u.end_ms - s.seg_start > {BUDGET_MS} THEN u.start_ms ELSE s.seg_start END, CASE WHEN u.end_ms - s.seg_start > {BUDGET_MS} THEN s.seg + 1 ELSE s.seg END, u.rn FROM useg s JOIN urow u ON u.rec = s.rec AND u.rn = s.rn + 1",
    "segtok": "SELECT s.rec, s.seg, t.utt, t.pos, t.word, t.langid FROM useg s JOIN tok t ON t.rec = s.rec AND t.utt = s.utt",
    "segspk": "SELECT rec, seg, string_agg(spk, ',' ORDER BY f) AS speakers FROM (SELECT rec, seg, spk, min(utt) AS f FROM useg GROUP BY ALL) GROUP BY ALL",
    "segtext": "SELECT rec, seg, string_agg(word, ' ' ORDER BY utt, pos) AS transcript, string_agg(langid, ' ' ORDER BY utt, pos) AS langs, count(*) AS n_words FROM segtok GROUP BY ALL",
    "seg": "SELECT u.rec, u.seg, 'segments/' || u.rec || '_' || printf('%04d', u.seg) || '.wav' AS audio_path, min(u.start_ms) AS start_ms, arg_max(u.end_ms, u.utt) AS end_ms, coalesce(any_value(t.transcript), '') AS transcript, coalesce(any_value(t.langs), '') AS langs, coalesce(any_value(t.n_words), 0) AS n_words, string_agg(u.utt::VARCHAR, ',' ORDER BY u.utt) AS utts, any_value(p.speakers) AS speakers FROM useg u LEFT JOIN segtext t ON t.rec = u.rec AND t.seg = u.seg JOIN segspk p ON p.rec = u.rec AND p.seg = u.seg GROUP BY u.rec, u.seg",
    "vad": "SELECT *, CASE WHEN seg % 7 = 0 THEN 'True' WHEN seg % 7 = 1 THEN 'FALSE' WHEN seg % 7 = 2 THEN NULL ELSE 'False' END AS filtered_out FROM seg",
    "reg": "SELECT user_id AS rec, epoch_us(ts) // 1000 AS start, epoch_us(ts) // 1000 + floor(value * 60000 + 0.5)::BIGINT AS \"end\", event_id FROM events",
    "smp": "SELECT vec_id AS clip, list_transform(embedding, lambda x: x::DOUBLE) AS samples FROM embeddings",
    "smx": "SELECT clip, unnest(range(0, len(samples))) AS idx, unnest(samples) AS value FROM smp",
    "pair0": r"SELECT conv_id || '_' || turn AS clip, turn, list_filter(regexp_split_to_array(regexp_replace(replace(lower(replace(text, ' ', ' ')), 'ß', 'ss'), '[^\p{L}\p{N}_\s]', '', 'g'), '\s+'), lambda w: w <> '') AS ref FROM conversations",
    "pair": f"SELECT clip, turn, ref, list_filter(list_transform(ref, lambda w, i: CASE WHEN (i - 1) % 7 = 6 THEN NULL WHEN (i - 1) % 5 = 4 THEN 'zz' WHEN (i - 1) % 11 = 10 THEN w || 'qq' ELSE w END), lambda w: w IS NOT NULL) AS hyp, CASE WHEN turn % 6 = 5 THEN list_transform(ref, lambda w: 'unknown') ELSE list_transform(ref, lambda w, i: {LANGID.format(w='w', p='i')}) END AS lang FROM pair0",
    "dp": "SELECT clip, ref, hyp, 0 AS i, range(0, len(hyp) + 1) AS cost FROM pair UNION ALL SELECT clip, ref, hyp, i + 1, list_transform(t, lambda x, j: list_min(list_transform(t[1:j], lambda y, k: y - k)) + j) FROM (SELECT clip, ref, hyp, i, list_concat([i + 1], list_transform(hyp, lambda w, j: least(cost[j] + CASE WHEN w = ref[i + 1] THEN 0 ELSE 1 END, cost[j + 1] + 1))) AS t FROM dp WHERE i < len(ref))",
    "table2": "SELECT clip, any_value(ref) AS ref, any_value(hyp) AS hyp, list(cost ORDER BY i) AS c FROM dp GROUP BY clip",
    "back": "SELECT clip, ref, hyp, c, len(ref) AS i, len(hyp) AS j, 0 AS k, '' AS op FROM table2 UNION ALL SELECT clip, ref, hyp, c, CASE WHEN o IN ('C', 'S', 'D') THEN i - 1 ELSE i END, CASE WHEN o IN ('C', 'S', 'I') THEN j - 1 ELSE j END, k + 1, o FROM (SELECT *, CASE WHEN i > 0 AND j > 0 AND ref[i] = hyp[j] AND c[i + 1][j + 1] = c[i][j] THEN 'C' WHEN i > 0 AND j > 0 AND c[i + 1][j + 1] = c[i][j] + 1 THEN 'S' WHEN i > 0 AND c[i + 1][j + 1] = c[i][j + 1] + 1 THEN 'D' ELSE 'I' END AS o FROM back WHERE i > 0 OR j > 0)",
    "ops": "SELECT clip, string_agg(op, '' ORDER BY k DESC) AS ops FROM back GROUP BY clip",
    "opx0": "SELECT o.clip, ops, p.ref, p.hyp, p.lang, unnest(range(0, length(ops))) AS pos, unnest(string_split(ops, '')) AS op FROM ops o JOIN pair p ON p.clip = o.clip WHERE ops <> ''",
    "opx": "SELECT *, sum((op <> 'I')::INT) OVER w AS i, sum((op <> 'D')::INT) OVER w AS j FROM opx0 WINDOW w AS (PARTITION BY clip ORDER BY pos)",
    "arow": "SELECT clip, pos, CASE op WHEN 'C' THEN 'correct' WHEN 'S' THEN 'substitution' WHEN 'D' THEN 'deletion' ELSE 'insertion' END AS operation, CASE WHEN op = 'I' THEN '' ELSE ref[i::BIGINT] END AS reference, CASE WHEN op = 'D' THEN '' ELSE hyp[j::BIGINT] END AS hypothesis, CASE WHEN op <> 'I' THEN lang[i::BIGINT] ELSE coalesce(lang[i::BIGINT + 1], CASE WHEN i > 0 THEN lang[i::BIGINT] END, 'unknown') END AS langid FROM opx",
    "clipwer": "SELECT *, (substitutions + deletions + insertions) / nullif(reference_words, 0)::DOUBLE AS wer FROM (SELECT clip, count(*) FILTER (operation = 'substitution') AS substitutions, count(*) FILTER (operation = 'deletion') AS deletions, count(*) FILTER (operation = 'insertion') AS insertions, count(*) FILTER (operation <> 'insertion') AS reference_words, count(*) FILTER (operation <> 'deletion') AS hypothesis_words FROM arow GROUP BY clip)",
    "langwer": "SELECT *, (substitutions + deletions + insertions) / nullif(reference_words, 0)::DOUBLE AS wer FROM (SELECT clip, langid, count(*) FILTER (operation = 'substitution') AS substitutions, count(*) FILTER (operation = 'deletion') AS deletions, count(*) FILTER (operation = 'insertion') AS insertions, count(*) FILTER (operation <> 'insertion') AS reference_words FROM arow GROUP BY clip, langid)",
    "share": "SELECT clip, coalesce(sum(CASE WHEN langid = 'spa' THEN reference_words ELSE 0 END) / nullif(sum(reference_words), 0)::DOUBLE, 0) AS share FROM langwer GROUP BY clip",
    "pred0": "SELECT vec_id // 12 AS clip, (vec_id % 12) // 3 AS word_no, vec_id % 12 AS tok_no, list_transform(embedding[1:4], lambda x: x::DOUBLE) AS logits, CASE WHEN label % 5 = 4 THEN NULL ELSE label % 5 END AS target FROM embeddings",
    "pred1": "SELECT *, list_transform(logits, lambda x: exp(x - list_max(logits))) AS e FROM pred0",
    "pred": "SELECT clip, word_no, tok_no, logits, target, list_transform(e, lambda x: x / list_sum(e)) AS probs FROM pred1",
    "loss": "SELECT clip, clip // 4 AS batch, idx, abs(value) AS token_loss, idx % 5 <> 0 AS valid, value * value AS lid_loss FROM smx",
    "step0": "SELECT event_type AS run, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS step, value FROM events",
    "step": "SELECT run, step, CASE WHEN step = 1 THEN 'NaN'::DOUBLE ELSE value END AS loss FROM step0",
    "run": "SELECT run AS run_name, max(step) AS evaluation_step, count(*) FILTER (NOT isnan(loss)) AS clips, min(loss) FILTER (NOT isnan(loss)) AS loss FROM step GROUP BY run",
    "newrun": "SELECT run_name, evaluation_step + 1 AS evaluation_step, clips, loss / 2 AS loss FROM run WHERE length(run_name) % 2 = 0 UNION ALL SELECT 'fresh', max(evaluation_step), sum(clips)::BIGINT, max(loss) FROM run",
    "piece": "SELECT *, list_transform(range(0, (length(word) + 2) // 3), lambda i: i + 100 * length(word)) AS pieces FROM tok",
    "audio": "SELECT DISTINCT 'conv_' || conv_id AS rec, conv_id FROM conversations",
    "chats": "SELECT * FROM audio WHERE conv_id % 9 <> 4",
    "tsvs": "SELECT * FROM audio WHERE conv_id % 10 <> 3",
    "dur": "SELECT audio_path, (end_ms - start_ms) / 1000.0::DOUBLE AS seconds FROM seg",
    "heldkeys": "SELECT rec FROM (SELECT rec, n, coalesce(sum(n) OVER (ORDER BY md5('42:' || rec), rec ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS taken FROM (SELECT rec, count(*) AS n FROM seg GROUP BY rec)) WHERE taken < (SELECT greatest(1.0, round_even(count(*) * (1 - 0.9::DOUBLE), 0)::DOUBLE) FROM seg)",
    "island0": f"SELECT *, CASE WHEN start - lag(\"end\") OVER w > {REGION_GAP} OR lag(\"end\") OVER w IS NULL THEN 1 ELSE 0 END AS cut FROM reg WINDOW w AS (PARTITION BY rec ORDER BY start, event_id)",
    "island1": "SELECT *, sum(cut) OVER (PARTITION BY rec ORDER BY start, event_id)::BIGINT AS island FROM island0",
    "island": "SELECT rec, island, arg_min(start, (start, event_id)) AS start, arg_max(\"end\", (start, event_id)) AS \"end\", count(*) AS n FROM island1 GROUP BY rec, island",
}


def with_views(sql: str) -> str:
    """The statement with the views that it names, and those that they name, in front."""
    needed: list[str] = []

    def need(text: str, own: str = "") -> None:
        for name in SQL:
            if name != own and name not in needed and re.search(rf"\b(FROM|JOIN)\s+{name}\b", text):
                need(SQL[name], name)
                if name not in needed:
                    needed.append(name)

    need(sql)
    return ("WITH RECURSIVE " + ", ".join(f"{n} AS MATERIALIZED ({SQL[n]})" if n not in ("useg", "dp", "back") else f"{n} AS ({SQL[n]})" for n in needed) + " " if needed else "") + sql
