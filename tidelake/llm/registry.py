"""Queries of the corpus operators, opN_<name>, and their oracle SQL."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontamination, extraction, jaccard, packing, quality, repair, runs, sharding, substrings, url_filters, warc
from .common import written
from .oracles import ORACLES

URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
SHARDS = 24
#: Vocabularies of the quality rules: pieces with byte fallback, byte-level pairs.
FERTILITY = ("piece_bpe_32k.model", "byte_bpe_multi_50k.tiktoken")


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary("byte_bpe_50k.tiktoken")
    coded = bpe.encode(table(spark, sf_dir, "documents"), path, packed=True)
    hashed = coded.withColumns({"ids_sha256": F.sha2("token_ids", 256), "offsets_sha256": F.sha2("token_offsets", 256)})
    return bpe.decode(hashed, path, keep=("doc_id", "n_tokens", "ids_sha256", "offsets_sha256")).select(
        "doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"), "offsets_sha256")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"), *(vocabulary(name) for name in FERTILITY))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                         "chars_per_token", "chars_per_wide_token", "byte_share", "token_entropy")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.archive_folder(spark)
    index = warc.archive(table(spark, sf_dir, "pages"), folder)
    return warc.read_bundles(index, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    labelled = url_filters.label_pages(pages, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), URL_RULES)
    paths, templates = url_filters.learn_templates(labelled)
    return url_filters.judge_urls(pages, paths, templates, URL_RULES)


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    winners = written(extraction.winning_paths(extraction.host_votes(pages)), "winners")
    return extraction.extract(pages, winners).withColumn("n_chars", F.length("text").cast("long"))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup_substrings(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = r"\### Assistant: </turn> ok"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(own).alias("text"))
    made = chat.format_conversations(rows.unionByName(extra))
    back = made.select("conv_id", "valid", chat.read_turns(F.col("formatted")).alias("turns"), chat.loss_text(F.col("segments")).alias("trained"), "formatted")
    flat = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(flat, 256).alias("turns_sha256"),
        F.length("trained").cast("long").alias("loss_chars"), F.sha2("trained", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "valid")


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similarity_components(table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    made = sharding.shard_by_bytes(docs.withColumn("text_crc32", F.crc32(F.coalesce("text", F.lit("")))), SHARDS)
    return made.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.token_pieces(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    hashed = pieces.withColumn("ids_crc32", F.crc32("token_ids")).drop("token_ids")
    return packing.pack(hashed).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    results, _ = repair.repair(repair.damage(rows))
    every = rows.select("conv_id").distinct()
    found = every.join(results, F.col("conv_id").eqNullSafe(F.col("conv")), "left")
    count = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return found.select("conv_id", *(count(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"),
                        F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = runs.plant_repeats(table(spark, sf_dir, "documents"))
    found = runs.find_runs(docs)
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    best = F.reduce("runs", F.element_at("runs", 1), lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best))
    flat = found.withColumn("best", F.when(F.size("runs") > 0, best))
    return flat.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
                       F.expr("1000 * best.length div best.period").alias("exponent_milli"),
                       F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_bpe, op2_quality_rules, op3_warc, op4_url_filters, op5_html_extraction, op6_benchmark_decontamination, op7_substring_dedup, op8_chat_formatting, op9_ngram_jaccard_join, op10_sharding,
                             op11_best_fit_packing, op12_conversation_repair, op13_periodic_runs)}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
