"""The registered query of each operator, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import anchors, best_positions, byte_pairs, compression, decontaminate, fertility, kmeans_tree, licenses, merkle, minhash_join, packing, placement, rotation

BYTE_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
SHARDS = [f"shard-{i:03d}" for i in range(200)]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_fertility_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.quality(_table(spark, sf_dir, "documents"), BYTE_VOCABULARY, PIECE_MODEL)


def op2_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotation.rotated(_table(spark, sf_dir, "conversations"))


def op3_grouping_packer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_table(spark, sf_dir, "documents"), BYTE_VOCABULARY)


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_join.similarity_classes(_table(spark, sf_dir, "documents"))


def op5_permutation_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placement.placed(_table(spark, sf_dir, "documents").select("doc_id", "text"), SHARDS).select("doc_id", "part", "slot", "shard")


def op6_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(_table(spark, sf_dir, "documents"))


def op8_substring_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anchors.digests(_table(spark, sf_dir, "documents"))


def op9_kmeans_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans_tree.search(_table(spark, sf_dir, "embeddings"))


def op10_bpe_pair_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_pairs.digests(_table(spark, sf_dir, "documents"), BYTE_VOCABULARY)


def op11_best_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_positions.ranked(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(_table(spark, sf_dir, "documents"))


def op13_window_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digests(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_fertility_rules, op2_perspective_rotation, op3_grouping_packer, op4_ngram_jaccard_join, op5_permutation_table, op6_compression_toxicity, op7_license_scan, op8_substring_anchors, op9_kmeans_tree, op10_bpe_pair_index, op11_best_positions, op12_merkle_manifest, op13_window_decontamination)}
ORACLES: dict[str, str] = {"op2_perspective_rotation": rotation.SQL, "op11_best_positions": best_positions.SQL, "op12_merkle_manifest": merkle.SQL, "op13_window_decontamination": decontaminate.SQL}
