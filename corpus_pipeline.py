"""The corpus pipeline: quality, exact and near deduplication, mixing, packing.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir), works on all that its predecessor kept and
returns a DataFrame, all but the last with the columns of documents. ``run`` applies them to the documents table, each
stage written as Parquet to the shared checkpoint folder and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from yieldnorm.llm import exact_dedup, minhash, mixing, packing, quality
from yieldnorm.llm.common import read_table, small_batches
from yieldnorm.plans.sizing import materialize
from yieldnorm.session import local_checkpoints


def _prepare(spark: SparkSession) -> None:
    local_checkpoints(spark)
    small_batches(spark)  # the same workers serve all stages


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    _prepare(spark)
    return quality.accepted(docs, read_table(spark, sf_dir, "labels"))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts (the largest doc_id)."""
    _prepare(spark)
    return exact_dedup.drop_duplicates(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates (the least doc_id)."""
    _prepare(spark)
    return minhash.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    _prepare(spark)
    return mixing.mix_documents(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids, each in its place in a window."""
    _prepare(spark)
    # the same workers serve the other stages: tables are small and go with the task
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), max_runs=RUNS, keep=False)


RUNS = 100_000

STAGES = [("quality", quality_filter), ("exact_dedup", exact_duplicates), ("near_dedup", near_duplicates),
          ("mixing", mix_sources), ("packing", pack_windows)]

#: The classifier, the signatures and the packing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    _prepare(spark)
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
