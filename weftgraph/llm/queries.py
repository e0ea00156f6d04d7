"""The queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import asof_join, bpe_segtree, centroid_blocks, covering_simhash, gam_quality, lm_trie, mixing, pca_neardup, quality_rules, secret_scan, toxic_segments, warc_chunks, zstd_langid


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.score(_table(spark, sf_dir, "documents"))


def op2_lm_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_trie.score(_table(spark, sf_dir, "documents"))


def op3_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_chunks.stored(_table(spark, sf_dir, "pages"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op5_gam_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gam_quality.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_pca_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pca_neardup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op7_zstd_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zstd_langid.identify(_table(spark, sf_dir, "documents"))


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_segtree.round_trip(_table(spark, sf_dir, "documents"), tokenizer_path())


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covering_simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op10_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxic_segments.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(_table(spark, sf_dir, "documents"))


def op12_asof_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asof_join.clicks_to_sales(_table(spark, sf_dir, "clicks"), _table(spark, sf_dir, "sales"))


def op13_centroid_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_blocks.cluster(_table(spark, sf_dir, "embeddings"))


def queries() -> dict:
    made = (op1_quality_rules, op2_lm_trie, op3_warc_chunks, op4_mixing, op5_gam_quality, op6_pca_tiles, op7_zstd_language, op8_bpe, op9_simhash, op10_toxic_segments, op11_secret_scan, op12_asof_shards, op13_centroid_blocks)
    return {f.__name__: f for f in made}


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": quality_rules.oracle(), "op3_warc_chunks": warc_chunks.ORACLE, "op4_mixing": mixing.ORACLE, "op6_pca_tiles": pca_neardup.ORACLE, "op11_secret_scan": secret_scan.oracle(), "op12_asof_shards": asof_join.ORACLE, "op13_centroid_blocks": centroid_blocks.oracle()}
