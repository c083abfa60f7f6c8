"""A corpus pipeline over documents: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fluxbar.llm import langid, line_dedup, mixing, near_copies, packing
from fluxbar.llm.common import materialize
from fluxbar.llm.queries import tokenizer_path


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents without an identified language go."""
    return langid.keep_identified(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: later copies of repeated line runs go."""
    return line_dedup.without_repeated_lines(docs)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near-dedup: of documents linked by a similarity of 0.8 in shingles of five words one stays."""
    return near_copies.keep_representatives(docs, shingle=5, similarity=0.8)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: each document as often as its source's target weight asks for."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing: token pieces and their places in the training sequences."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [("language_id", identify), ("line_dedup", dedup_lines), ("simhash_dedup", dedup_near), ("mix_sources", mix), ("pack", pack)]

#: Near-copy groups and token ids can't be expressed in SQL; tests/llm compares the rows with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
