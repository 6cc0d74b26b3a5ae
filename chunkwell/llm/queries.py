"""The registered query of each corpus operator, and DuckDB SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chunkwell.llm import chat, fingerprint, language_id, license_scan, mixing, near_dedup, quality, sentencepiece_codec, substring_dedup, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    out = substring_dedup.dedup(docs)
    return out.select("doc_id", "text", "n_chars", out["__sub_removed"].alias("removed"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(_table(spark, sf_dir, "documents"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(_table(spark, sf_dir, "documents"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(_table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op8_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.base_and_verdict(_table(spark, sf_dir, "documents"))


def op9_chat_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.link(_table(spark, sf_dir, "conversations"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode(_table(spark, sf_dir, "documents"), sentencepiece_codec.load_model(spark))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_license_scan": op3_license_scan,
    "op4_url_filter": op4_url_filter,
    "op5_fingerprints": op5_fingerprints,
    "op6_near_dedup": op6_near_dedup,
    "op7_mixing": op7_mixing,
    "op8_quality_cascade": op8_quality_cascade,
    "op9_chat_linking": op9_chat_linking,
    "op10_sentencepiece": op10_sentencepiece,
}
ORACLE_SQL = {"op8_quality_cascade": quality.ORACLE_SQL}
