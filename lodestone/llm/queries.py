"""The corpus operators as registered queries: production parameters, whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import clustering, compaction, langid, licenses, mixing, oracles, packing, quality, repeats, sharding, simhash, topk, vector_dedup, warc
from lodestone.llm.common import shared_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_hash_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents"), shards=16)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), with_ids=False).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(_table(spark, sf_dir, "documents"), shingle=3, threshold=2)
    return found.select("doc_id", simhash.hex_bits("fingerprint_bits").alias("fingerprint"), "component_id")


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(_table(spark, sf_dir, "documents"))


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.link_vectors(_table(spark, sf_dir, "embeddings"), threshold=0.98)


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), every=50, k=5, scale=256.0)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_summary(_table(spark, sf_dir, "documents"))


def op8_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "warc")
    warc.write_warc(_table(spark, sf_dir, "pages"), path)
    return warc.read_warc(spark, path, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_languages(_table(spark, sf_dir, "documents"))


def op11_prefix_free_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.remove_repeats(_table(spark, sf_dir, "documents"), window=400)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op12_compaction_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compaction.compaction_plan(_table(spark, sf_dir, "documents"))


def op13_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.ball_kmeans(_table(spark, sf_dir, "embeddings"), dim=64, k=16, rounds=3, scale=64.0, seed="1")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_hash_tree_sharding, op2_best_fit_packing, op3_embedding_near_dedup, op4_simhash_near_dedup, op5_exact_top_k,
        op6_license_scan, op7_source_mixing, op8_warc_round_trip, op9_quality_classifier, op10_language_id,
        op11_prefix_free_repeats, op12_compaction_plan, op13_ball_kmeans,
    )
}

ORACLES: dict[str, str] = {
    "op1_hash_tree_sharding": oracles.sharding(16),
    "op3_embedding_near_dedup": oracles.vector_links(0.98),
    "op5_exact_top_k": oracles.top_k(50, 5, 256.0),
    "op6_license_scan": oracles.license_scan(),
    "op7_source_mixing": oracles.mixing(),
    "op8_warc_round_trip": oracles.warc(),
    "op12_compaction_plan": oracles.compaction(compaction.Rules()),
    "op13_ball_kmeans": oracles.ball_kmeans(64, 16, 3, 64.0, "1"),
}
