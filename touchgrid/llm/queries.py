"""The registered queries of this subpackage: thin callers of its operators."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, decontaminate, html_text, lines, media, oracles, phrases, pieces, prefix_trie, resample, secrets, simhash, spelling, token_store
from .shared import small_batches


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return small_batches(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.remove_lines(_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text_hash")


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    files = token_store.write_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return token_store.read_tokens(files)


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = media.read_media(media.store_media(docs))
    return rows.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", F.col("length").alias("media_bytes"), F.col("digest").alias("media_sha256"), "feature", "width", "height")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode_decode(docs, public_tokenizers.path("word_bpe_49k.json"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op7_quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    found = resample.resample(docs.select("doc_id", "text"), labels, k=resample.POSITIVE)
    return found.select("doc_id", "kept", "toxic", "n_grams", F.round("log_ratio", 6).alias("log_ratio"), F.round("worst", 6).alias("worst_log_ratio"), F.round("log_weight", 6).alias("log_weight"), F.round("key", 6).alias("key"))


def op8_repeated_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    return decontaminate.contamination_report(docs.select("doc_id", "text"), items.select("item_id", "text"))


def op11_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrays = prefix_trie.turn_arrays(_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"), family=20)
    shared = (F.crc32(F.col("conv_id").cast("string")) % 4).cast("int")
    return prefix_trie.prefix_trie(prefix_trie.with_shared_heads(arrays, shared, longest=3))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = spelling.document_words(_table(spark, sf_dir, "documents").select("doc_id", "text"), spoil=97, least_length=5)
    return spelling.group_variants(spelling.vocabulary(counts, least_length=5, least_count=3))


def queries() -> dict:
    return {f.__name__: f for f in (op1_line_dedup, op2_token_store, op3_media_columns, op4_bpe, op5_secret_scan, op6_html_text, op7_quality_resampling, op8_repeated_phrases, op9_simhash, op10_decontaminate, op11_sentence_pieces, op12_prefix_trie, op13_spelling_variants)}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
