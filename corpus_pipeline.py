"""A corpus pipeline over ``documents``: each stage works on what its predecessor kept.

1. language ID (operator 1): documents without a recognised language go.
2. near-duplicates (operator 6): one document of each class stays.
3. substring dedup (operator 2): passages that an earlier document has are cut out.
4. mixing (operator 7): each document is repeated, kept once or left out, so that the sources
   meet their target weights.
5. SentencePiece (operator 10): every remaining document becomes token ids.

Every stage is written as Parquet and read again, so a lost executor costs tasks and never a
stage.  The operators' modules say what each does with nulls, ties, repeats and empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chunkwell.llm import language_id, mixing, near_dedup, sentencepiece_codec, substring_dedup
from chunkwell.llm.common import store


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn from the labelled rows of ``docs`` that are not held out; keep recognised rows."""
    return language_id.keep_identified(docs, language_id.train(docs.where(~language_id.held_out())))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the first document of each class of near-duplicates."""
    return near_dedup.keep_first(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut repeated passages out of the texts; all rows stay."""
    return substring_dedup.dedup(docs).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents by the mix."""
    return mixing.apply_mix(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids, parity, round_trip`` of every remaining document."""
    return sentencepiece_codec.encode(docs, sentencepiece_codec.load_model(spark))


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeated_passages),
    ("mixing", mix_sources),
    ("sentencepiece", encode_tokens),
]

#: Trained scores, order min-hash, gear chunks and hashed ranks are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs, _ = store(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
