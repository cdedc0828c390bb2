"""The corpus pipeline: five stages from documents to packed sequences.

All stages read whole texts of any length, keep rows with a null id, keep columns of any other name as they are, and give
an empty table for an empty one; their own rules for nulls, ties and repeated rows are in their docstrings.

This is an application, not a library: where its session isn't told a size of Arrow batches, it chooses one for
executors of 3 GB. Operators leave the session as it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from buildlens.llm.common import Staged, staging
from buildlens.llm.exact_dedup import drop_exact_copies
from buildlens.llm.language_id import drop_unidentified
from buildlens.llm.minhash_dedup import drop_near_duplicates
from buildlens.llm.mixing import mixed_documents
from buildlens.llm.packing import pack_documents

#: Learning, Viterbi, MinHash and tokenising can't be written as SQL; tests hold the stages against brute force.
ORACLE_SQL = None
SIMILARITY, SEQUENCE = 80, 2048
#: Languages to keep (None: all that were learned), and the least share of words that speak for the language.
LANGUAGES, MIN_SCORE = None, 0.3


def _configure(spark: SparkSession) -> None:
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1024")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no language of LANGUAGES, or for which less than MIN_SCORE of their words speak, go: other scripts,
    too mixed texts, texts without a letter, null texts. Repeated rows are judged each."""
    _configure(spark)
    return drop_unidentified(docs, kept=LANGUAGES, min_score=MIN_SCORE)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, that with the smallest id stays (null ids come last); null text counts as empty. Of rows that repeat
    an id and its text one stays."""
    return drop_exact_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates, the document with the smallest id stays. Rows with a null id, and texts
    without words, are linked with nothing and stay; rows that repeat an id stay or go together."""
    return drop_near_duplicates(docs, percent=SIMILARITY)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target takes them, in training order. A null source is one of its own; null
    and empty texts are not taken; rows that repeat an id share one decision."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences, at least one for each row. A task packs the rows of its file splits, so sequences
    follow the training order within a file, and files are told apart by sequence_id alone."""
    import public_tokenizers

    _configure(spark)
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), max_tokens=SEQUENCE, remembered=100_000)


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each reading what the one before has written to the shared folder."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for i, (name, stage) in enumerate(STAGES):
        if i == len(STAGES) - 1:
            return stage(spark, docs, sf_dir)
        with staging() as tables:  # what a stage stages goes once its result is written
            staged = tables.keep(Staged(stage(spark, docs, sf_dir), name))
        if before:
            before.drop()
        docs, before = staged.df, staged
    return docs
