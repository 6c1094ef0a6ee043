"""Queries of the training-data operators (opN_<name>) and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (chat, decontamination, hamming_search, html_extract, mixing, near_duplicates, packing, periodic_runs, quality, sharding, suffix_dedup,
               token_alignment, toxicity)
from .common import text_or_empty, words
from .oracles import ORACLES  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = text_or_empty()
    # what the result needs of a text is taken first, so that no text is moved
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"))
    return sharding.shard(docs).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_extract.extract(pages.select("page_id", "url", "html"), html_extract.fit(pages))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_lines", "n_stop_words")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(fold != 0))
    return toxicity.score(docs.select("doc_id", (fold == 0).alias("held_out"), "text"), model).select(
        "doc_id", "held_out", "score", "predicted")


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], rows.schema)
    return chat.read_back(chat.format_turns(chat.canonical_turns(rows.unionByName(extra))))


def op7_hamming_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return hamming_search.search(vectors, vectors.where(F.col("vec_id") % 50 == 0))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "group_id")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", F.round("target", 4).alias("target"), "taken")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def with_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, text): where crc32(doc_id) is divisible by 10, the text's words repeat from word a on with period p."""
    code = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    split = words(text_or_empty())
    n, g = F.size("__mf_w").cast("long"), F.floor(F.col("__mf_h") / 10)
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))
    place = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.when(i < a, i).otherwise(a + (i - a) % p))
    repeated = F.array_join(F.transform(place, lambda i: F.get("__mf_w", i.cast("int"))), " ")
    chosen = docs.select("doc_id", "text", code.alias("__mf_h")) \
        .withColumn("__mf_w", F.when(F.col("__mf_h") % 10 == 0, split))
    return chosen.select("doc_id", F.when(F.size("__mf_w") > 0, repeated).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find_runs(with_repeats(table(spark, sf_dir, "documents")))
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    # the greatest length; of equal ones the smallest start, then period
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    return found.withColumn("__mf_top", longest).select(
        "doc_id", "n_words", F.size("runs").cast("long").alias("n_runs"), (-F.col("__mf_top.s")).alias("start"),
        F.col("__mf_top.length").alias("length"), (-F.col("__mf_top.p")).alias("period"),
        F.floor(1000 * F.col("__mf_top.length") / -F.col("__mf_top.p")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(line, lambda x: F.concat(x, F.lit("\n"))), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.link_statistics(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.find_leaks(docs, table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda total, h: total + h["end"] - h["start"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


QUERIES = {f.__name__: f for f in (
    op1_best_fit_packing, op2_sharding, op3_html_extraction, op4_quality_rules, op5_toxicity, op6_chat_format, op7_hamming_search,
    op8_ngram_jaccard, op9_mixing, op10_suffix_dedup, op11_periodic_runs, op12_token_alignment,
    op13_decontamination)}
