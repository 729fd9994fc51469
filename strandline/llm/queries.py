"""One query per operator over its whole table, with production parameters, and DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import classifier, exact_dedup, langid, license_scan, manifest, mixing, oracles, packing, quality, secret_scan, sharding, simhash, token_files, trie
from .common import documents

SHARDS = 24


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(documents(spark, sf_dir, "doc_id", "text")))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_rows(documents(spark, sf_dir, "doc_id", "text", "source"))


def op3_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir, "doc_id", "text"), [1.0] * SHARDS)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(documents(spark, sf_dir, "doc_id", "text"))
    names = F.array_join(F.transform("licenses", lambda x: x["template"]), ",")
    return found.select("doc_id", F.size("licenses").cast("long").alias("n_licenses"), names.alias("licenses"), F.coalesce(F.array_max(F.transform("licenses", lambda x: x["containment"])), F.lit(0.0)).alias("containment"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = token_files.round_trip(documents(spark, sf_dir, "doc_id", "text"))
    return read.select("doc_id", "start", F.expr("octet_length(ids) div 4").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op6_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(documents(spark, sf_dir, "doc_id", "text")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op7_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(documents(spark, sf_dir, "doc_id", "text"))


def op8_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    return quality.judge(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict_languages(documents(spark, sf_dir, "doc_id", "text", "lang"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir, "doc_id", "text"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.rebuilt_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"))


def op12_rule_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.classify(documents(spark, sf_dir, "doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.verified(documents(spark, sf_dir, *manifest.FIELDS))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_secret_scan, op2_source_mixing, op3_rendezvous_sharding, op4_license_scan, op5_token_files, op6_harmonic_packing, op7_simhash_groups, op8_line_quality, op9_language_id, op10_exact_dedup, op11_conversation_trie, op12_rule_quality, op13_merkle_manifest)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    """The others have no SQL: hashes that DuckDB lacks, tokenizers, fitted models, random rounding. Their tests have brute force."""
    return {"op10_exact_dedup": oracles.EXACT_DEDUP, "op11_conversation_trie": oracles.CONVERSATION_TRIE, "op13_merkle_manifest": oracles.MERKLE_MANIFEST}
