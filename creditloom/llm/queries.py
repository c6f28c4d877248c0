"""The registered queries of this package, and the SQL that checks those which SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.llm.attention_lm import score_with_training
from creditloom.llm.conversation_trie import conversation_trie, trie_sql
from creditloom.llm.decontamination import contaminations
from creditloom.llm.hard_negatives import hard_negatives, mining_sql, whole_numbers
from creditloom.llm.licences import licence_scan, scan_sql
from creditloom.llm.minhash_join import groups_sql, minhash_groups
from creditloom.llm.packing import packed
from creditloom.llm.parity_join import parity_join
from creditloom.llm.sharding import shards
from creditloom.llm.suffix_dedup import suffix_dedup
from creditloom.llm.token_counts import token_counts
from creditloom.llm.toxicity import fit_toxicity, toxicity_scores
from creditloom.llm.winnowing import edited_fingerprints, fingerprint_text, hashes_of, likeness

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(_table(spark, sf_dir, "documents"), length=50).select(
        "doc_id", "n_bytes", "n_removed", F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


def op3_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: a source is a project with a directory for each language."""
    documents = _table(spark, sf_dir, "documents")
    known = lambda name: F.coalesce(F.col(name).cast("string"), F.lit("unknown"))
    path = F.concat_ws("/", known("source"), known("lang"), F.concat(known("doc_id"), F.lit(".txt")))
    scanned = licence_scan(documents.select(path.alias("path"), "text"))
    number = F.expr("try_cast(regexp_extract(path, '([^/]*)[.]txt$', 1) as bigint)")
    return scanned.select(number.alias("doc_id"), "path", "licence", "origin", "similarity", "from_path")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminations(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), percent=10)


def _remainder(column: str):
    """crc32 of an id's text modulo 5; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % 5


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    model = fit_toxicity(documents, _table(spark, sf_dir, "labels").filter(_remainder("doc_id") != 0))
    return toxicity_scores(documents, model).select(
        "doc_id", (_remainder("doc_id") == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op6_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity_join(_table(spark, sf_dir, "documents"), width=3, percent=90)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packed(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards(_table(spark, sf_dir, "documents"), 40).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op9_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    compared = edited_fingerprints(_table(spark, sf_dir, "documents"))
    own = hashes_of(F.col("kept"))
    return compared.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        fingerprint_text(F.col("kept")).alias("fingerprint"),
        fingerprint_text(F.col("edited_kept")).alias("edited_fingerprint"),
        likeness(own, hashes_of(F.col("edited_kept"))).alias("near_edited"),
        likeness(own, hashes_of(F.col("next_kept"))).alias("near_next"),
    )


def op10_attention_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    scored = score_with_training(documents, _remainder("doc_id") != 1, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return scored.withColumn("held_out", _remainder("doc_id") == 1)


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_groups(_table(spark, sf_dir, "documents"), width=5, percent=85)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    planted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(whole_numbers(vectors.withColumn("label", planted)), F.col("vec_id") % 50 == 0)


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(_table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Query] = {
    "op1_token_counts": op1_token_counts,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_licence_scan": op3_licence_scan,
    "op4_decontamination": op4_decontamination,
    "op5_toxicity": op5_toxicity,
    "op6_parity_join": op6_parity_join,
    "op7_packing": op7_packing,
    "op8_sharding": op8_sharding,
    "op9_winnowing": op9_winnowing,
    "op10_attention_lm": op10_attention_lm,
    "op11_minhash": op11_minhash,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_conversation_trie": op13_conversation_trie,
}

ORACLE_SQL: dict[str, str] = {
    "op3_licence_scan": scan_sql(
        "SELECT doc_id, coalesce(source, 'unknown') || '/' || coalesce(lang, 'unknown') || '/' || "
        "coalesce(doc_id::VARCHAR, 'unknown') || '.txt' AS path, coalesce(text, '') AS text FROM documents"
    ),
    "op11_minhash": groups_sql(),
    "op12_hard_negatives": mining_sql(
        "SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, "
        "list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings "
        "WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL "
        "AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
    ),
    "op13_conversation_trie": trie_sql(),
}
