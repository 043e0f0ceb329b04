"""The registered queries of this subpackage: one opN_<name> per operator, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from speechloom.llm import codes, decontaminate, editcount, metricjoin, neardup, packing, perplexity, personal, phrases, quality, roles, urlrules, warc
from speechloom.llm.common import table


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_file(), capacity=2048, end_id=1)


def op2_role_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roles.repair_chats(table(spark, sf_dir, "conversations"))


def op3_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.find_personal_data(table(spark, sf_dir, "documents"))


def op4_perplexity_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity.perplexity_rules(table(spark, sf_dir, "documents"))


def op5_minmax_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = urlrules.listed(spark, ["verdict", "rule"], urlrules.HOST_PATH_RULES)
    patterns = urlrules.listed(spark, ["pattern"], [(p,) for p in urlrules.PATTERN_RULES])
    return urlrules.filter_urls(table(spark, sf_dir, "pages"), rules, patterns)


def op7_subword_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fold = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(4))
    sample = quality.sample_labelled(docs, table(spark, sf_dir, "labels"), fold != 2, quality.MAX_TRAIN, "quality")
    scored = quality.score_quality(docs, *quality.fit(sample))
    return scored.select("doc_id", (fold == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op8_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three edits in every document: words put in at a quarter, a joined suffix at half, a cut at three quarters."""
    import public_tokenizers

    ranks, pattern = tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    state = editcount.build_state(table(spark, sf_dir, "documents"), ranks, pattern)
    n = F.length("text")
    edits = [(n / 4, 7, " newly revised "), (n / 2, 0, "n't"), (n * 3 / 4, 12, "")]
    one = [F.struct(F.floor(at).cast("long").alias("pos"), F.lit(cut).cast("long").alias("deleted"), F.lit(put).alias("inserted")) for at, cut, put in edits]
    done = editcount.apply_edits(state.withColumn("edits", F.array(*one)), ranks, pattern)
    return done.select(F.col("id").alias("doc_id"), "tokens_before", F.col("n_tokens").alias("tokens_after"), "n_edits", "encoded_pieces", F.md5("text").alias("text_md5"))


def op9_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_seekable_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages"))


def op11_voronoi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metricjoin.jaccard_components(table(spark, sf_dir, "documents"), width=4, percent=85)


def op12_pivot_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.vector_codes(table(spark, sf_dir, "embeddings"), parts=16, entries=64, rounds=2)


def op13_graph_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"), least=30, percent=80, top=2000)


QUERIES = {f.__name__: f for f in (op1_vector_packing, op2_role_repair, op3_contextual_pii, op4_perplexity_bands, op5_minmax_neardup, op6_url_rules, op7_subword_classifier, op8_edit_counts, op9_benchmark_leaks, op10_seekable_warc, op11_voronoi_join, op12_pivot_codes, op13_graph_phrases)}
ORACLES = {"op6_url_rules": urlrules.ORACLE, "op10_seekable_warc": warc.ORACLE, "op12_pivot_codes": codes.ORACLE, "op13_graph_phrases": phrases.ORACLE}
