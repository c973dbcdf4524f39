"""The corpus pipeline: five stages, each one of the operators in llm/, over documents.

All stages but the last return the columns of documents, whatever these are called, and work on every row: rows with a
null doc_id are documents like others, null and empty texts stay until the last stage gives them a segmentation without
pieces, rows that repeat an id and a text are one document that goes or stays as a whole (in the second stage, a group's
rows of least id all stay), and an empty table gives an empty result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from llm import decontaminate, line_dedup, ngram_join, pieces, toxicity
from llm._scratch import Scratch


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic (score 0.5 or more) go; texts without words stay, unless toxic labels prevail."""
    return toxicity.reject(spark, docs, _table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that with the least id: five-word shingles, similarity 0.8 or more. Documents without
    words are in no group and stay, as do those of a group in which no row has an id."""
    return ngram_join.keep_one(spark, docs, n=5, percent=80)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of units are cut from the texts; short lines stay, as clean documents have them in common."""
    return line_dedup.dedup(spark, docs, line_words=line_dedup.UNIT_WORDS)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; a row without an id goes if any such row holds one."""
    return decontaminate.clean(spark, docs, _table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of each text, one where it has no more; the sample follows from doc_id and text."""
    return pieces.encode(spark, docs, k=2)


STAGES = [("toxicity", toxic), ("ngram_jaccard", near_copies), ("substring_dedup", repeats), ("decontamination", benchmarks), ("pieces", encoded)]

#: Training, latent space and sampling are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again as the next one's input."""
    scratch = Scratch(spark, "pipeline")
    docs = _table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        last, docs = docs, scratch.cut(stage(spark, docs, sf_dir))
        scratch.sweep(last)
    return docs
