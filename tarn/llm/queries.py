"""One query for each operator, on its whole table, with the SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm import contamination, html, idfiles, manifest, mixing, neardup, packing, passages, preferences, quality, repair, shards, tokens, urls
from tarn.shared import shared_path, written


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = tokens.encode_texts(_table(spark, sf_dir, "documents"), tokenizer_path(), ["doc_id"], end_id=1)
    pieces = packing.cut(encoded, ["doc_id"]).withColumn("ids_crc32", F.crc32("ids"))
    return packing.pack(pieces, ["doc_id", "piece", "start", "length", "ids_crc32"])


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.quality_rules(_table(spark, sf_dir, "documents"), keep=["doc_id"])
    return judged.select("doc_id", *(f"quality.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")), F.array_join("quality.beyond", ",").alias("beyond"))


def op3_stratified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select("doc_id", "source", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    placed = shards.stratified_shards(narrow, n_shards=8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


def op4_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"), ["doc_id"]).select("doc_id", "class_id")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination.find_benchmark(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), contamination.is_contaminated().alias("contaminated"),
    )


def op6_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = passages.remove_repeats(_table(spark, sf_dir, "documents"), ["doc_id"])
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op7_ranked_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = tokens.encode_texts(_table(spark, sf_dir, "documents"), tokenizer_path(), ["doc_id"], end_id=2, id_bytes=2)
    path = shared_path(spark, "idfiles")
    idfiles.write_ids(written(encoded, "encoded"), path, id_bytes=2)
    return idfiles.read_ids(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op8_line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_pages(_table(spark, sf_dir, "pages"), ["page_id", "url"]).withColumn("n_chars", F.length("text").cast("long"))


def op9_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = preferences.turns_of(_table(spark, sf_dir, "conversations"))
    pairs = preferences.preference_pairs(*preferences.swapped_replies(turns))
    ranges = (F.array_join(F.transform(f"{s}_trained", lambda r: F.concat_ws("-", r["start"].cast("string"), r["stop"].cast("string"))), ",").alias(f"{s}_trained") for s in ("chosen", "rejected"))
    return pairs.select(F.col("pair").alias("conv_id"), "prompt_turns", "prompt", "chosen", "rejected", *ranges)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urls.judge_urls(_table(spark, sf_dir, "pages"))
    return judged.select("page_id", *(f"url_verdict.{c}" for c in ("host", "path", "rule", "verdict", "strict_hits", "soft_hits")))


def op11_hash_threshold_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(_table(spark, sf_dir, "documents"), ["doc_id"])
    return mixed.select("doc_id", *(f"mix.{c}" for c in ("size", "source_size", "target", "taken")))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixed = repair.repaired(repair.damaged(repair.conversations_of(_table(spark, sf_dir, "conversations"))))
    return fixed.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.sha2(F.encode(repair.rendered("repaired"), "UTF-8"), 256).alias("repaired_sha256"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    odd = F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), "UTF-8")) % 2 == 1
    text = F.when(odd, F.col("text")).otherwise(F.replace("text", F.lit("\n"), F.lit("")))
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    return manifest.merkle_manifest(docs, columns, ["doc_id"], against=manifest.leaf([*(F.col(c) for c in columns[:-1]), text]))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_best_fit_packing, op2_quality_rules, op3_stratified_shards, op4_order_minhash, op5_decontamination, op6_repeated_passages, op7_ranked_id_files, op8_line_blocks, op9_preferences, op10_url_filter, op11_hash_threshold_mix, op12_conversation_repair, op13_merkle_manifest)}


def oracle_sql() -> dict[str, str]:
    from tarn.llm import oracles

    return oracles.ORACLES
