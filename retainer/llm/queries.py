"""Registered queries of the training-data operators: name -> (query, DuckDB SQL or None)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from retainer.llm.bpe_sql import bpe_round_trip
from retainer.llm.crf_langid import language_id
from retainer.llm.cross_polytope import nearest
from retainer.llm import fixity, hnsw, iblt, trie
from retainer.llm.hilbert import shard
from retainer.llm.minhash_odd import near_duplicates
from retainer.llm.packing import pack
from retainer.llm.ppm import score
from retainer.llm.repair import damaged_repair
from retainer.llm.suffix_dedup import remove_repeats


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(_documents(spark, sf_dir))


def op2_crf_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(_documents(spark, sf_dir), folds=4, held_out=2)


def op3_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixity.seeded_audit(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_documents(spark, sf_dir), length=50)


def op5_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(_documents(spark, sf_dir), shards=16)


def op6_ppm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(_documents(spark, sf_dir), folds=7, held_out=2)


def op7_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, vectors.filter("vec_id % 50 = 0"), k=5)


def op9_hnsw_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), least=0.95)


def op8_bounded_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_documents(spark, sf_dir))


def op10_odd_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_documents(spark, sf_dir), words=2, percent=80)


def _conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet")


def op11_weighted_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return damaged_repair(_conversations(spark, sf_dir))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(_conversations(spark, sf_dir))


def op13_lookup_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iblt.fingerprint_versions(_documents(spark, sf_dir))


REGISTRY = {
    "op1_byte_bpe": (op1_byte_bpe, None),
    "op2_crf_language": (op2_crf_language, None),
    "op3_merkle_fixity": (op3_merkle_fixity, fixity.ORACLE_SQL),
    "op4_suffix_dedup": (op4_suffix_dedup, None),
    "op5_hilbert_shards": (op5_hilbert_shards, None),
    "op6_ppm_score": (op6_ppm_score, None),
    "op7_cross_polytope": (op7_cross_polytope, None),
    "op8_bounded_packing": (op8_bounded_packing, None),
    "op9_hnsw_components": (op9_hnsw_components, None),
    "op10_odd_sketch": (op10_odd_sketch, None),
    "op11_weighted_repair": (op11_weighted_repair, None),
    "op12_prefix_trie": (op12_prefix_trie, trie.ORACLE_SQL),
    "op13_lookup_sketch": (op13_lookup_sketch, iblt.ORACLE_SQL),
}
