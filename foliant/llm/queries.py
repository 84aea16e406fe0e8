"""The queries over the synthetic tables, thin projections of the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import chat_format, conversation_repair, decontam, html_extract, jaccard_join, leaderboard, line_dedup, mixing, ngram_lm, pii, quality_rules, url_filter, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    done = chat_format.format_conversations(turns)
    return done.select("conv_id", chat_format.digests(F.col("formatted"), F.col("loss_mask")).alias("d")).select("conv_id", "d.*")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.archive_pages(table(spark, sf_dir, "pages"))
    return read.select(
        warc.page_number(F.col("record_id")).alias("page_id"),
        F.col("payload_length").alias("payload_bytes"),
        "payload_digest",
        F.col("type").alias("record_type"),
        warc.page_number(F.col("refers_to")).alias("refers_to"),
    )


def op4_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").filter("quality = 1 AND toxic = 0")
    found = ngram_lm.classify(table(spark, sf_dir, "documents"), trusted)
    return found.select("doc_id", "lang", "words", F.round("bits_per_word", 4).alias("bits_per_word"), F.round("perplexity", 2).alias("perplexity"), "threshold", "kept")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.measure(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.spans(table(spark, sf_dir, "documents"))
    counts = [pii.counted(F.col("spans"), kind).alias(f"n_{kind}") for kind in ("email", "ip", "card", "phone")]
    told = [pii.counted(F.col("all_spans"), kind) for kind in ("secret", "term")]
    private = (F.size("spans") + told[0]).cast("bigint").alias("n_private")
    return found.select("doc_id", *counts, told[0].alias("n_secret"), told[1].alias("n_term"), private, F.sha2(pii.joined(F.col("spans")), 256).alias("base_sha256"), pii.joined(F.col("all_spans")).alias("spans"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.report(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = jaccard_join.join(table(spark, sf_dir, "documents"))
    return done.select("doc_id", F.col("n").alias("n_shingles"), "component_id", "n_links")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "first_slot")


def op11_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "sale_lines")
    cut = leaderboard.cut(lines, table(spark, sf_dir, "vendors"), table(spark, sf_dir, "items"))
    return leaderboard.feed(cut, leaderboard.shards_for(lines.count()))


def op12_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return conversation_repair.report(conversation_repair.damaged(conversations), conversations)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_format": op1_chat_format,
    "op2_url_filter": op2_url_filter,
    "op3_warc": op3_warc,
    "op4_ngram_lm": op4_ngram_lm,
    "op5_quality_rules": op5_quality_rules,
    "op6_pii": op6_pii,
    "op7_line_dedup": op7_line_dedup,
    "op8_decontam": op8_decontam,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_mixing": op10_mixing,
    "op11_leaderboard": op11_leaderboard,
    "op12_html_extract": op12_html_extract,
    "op13_conversation_repair": op13_conversation_repair,
}
