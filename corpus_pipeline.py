"""Corpus pipeline: five stages over ``documents``, each written and reread before the next.

Every stage takes (spark, docs, sf_dir) and returns a frame. All but the last return the columns of
documents; the last writes the token blocks and returns what reading them back gives.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from signalops.functions.lineage import cut
from signalops.llm import mixing, quality_rules, simhash, tiling, tokens


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the base rules or the line-frequency rule reject, and frequent lines from the others."""
    return quality_rules.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, the one with the smallest doc_id, of each group of near copies."""
    return simhash.keep_first(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    return tiling.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sample documents to the flattened marginals of source, language and topic."""
    return mixing.sample(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write token ids as range-coded blocks, read them back, and return one row per document."""
    return tokens.round_trip(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontaminate),
          ("mixing", mix), ("token_output", tokenize)]

# The near-duplicate components, the tiling and the coder are not SQL; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
