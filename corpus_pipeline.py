"""From raw documents to packed training sequences, in five stages.

Every stage takes the documents that its predecessor kept, as reread from Parquet, and its
decisions take effect: rejected documents and near duplicates are gone, repeated and leaked
passages are cut out of the texts. The last stage returns the packed pieces with their token ids.
"""

from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from argentum.llm import decontaminate, ngram_join, packing, quality, substrings
from argentum.session import pin, remove_staged, stage, staging_noted, unstage


def _with_words(docs: DataFrame) -> DataFrame:
    """Documents that have a word left, with their length brought up to date."""
    left = docs.where(F.col("text").rlike(quality.NOT_SPACE))
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else left


#: Tables that operators of the stage before have staged; its result is written by the time the next begins.
_LEFT: list[str] = []


def _stage(function):
    """Pin the session, and remove what the stage before needed."""

    @wraps(function)
    def begin(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        remove_staged(pin(spark), _LEFT)
        _LEFT.clear()
        with staging_noted() as written:
            out = function(spark, docs, sf_dir)
        if function is not packed_pieces:
            _LEFT.extend(written)
        return out

    return begin


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules."""
    return quality.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of documents that link at five words and a similarity of 0.8."""
    return ngram_join.keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without windows of words that an earlier document has."""
    return _with_words(substrings.remove_repeats(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without benchmark passages."""
    return _with_words(decontaminate.remove_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def packed_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids in sequences of a fixed window."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", _stage(quality_rules)),
    ("near_duplicates", _stage(near_duplicates)),
    ("substring_dedup", _stage(substring_dedup)),
    ("decontamination", _stage(decontamination)),
    ("packing", _stage(packed_pieces)),
]

#: The join's classes, substring windows and packing can't be put in SQL of bounded size; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
        if before is not None:  # its successor is written
            unstage(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
