"""Corpus cleaning from raw documents to token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and reread as the next one's
docs: quality rules, line dedup, near-dedup, benchmark decontamination, BPE. All but the last return the columns of
documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chaffsieve.llm import boosted_rules, bpe, decontam, line_dedup, near_dup
from chaffsieve.llm._common import table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the count rules or the boosted trees go. Null, empty and blank texts fail; every row of a repeated
    doc_id is judged by its own text; rows with null doc_id are judged like others."""
    return boosted_rules.filtered(docs, table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three-line windows are cut out; documents with nothing left go. Null texts and rows with null
    doc_id stay as they are; equal rows are one document and lose the same lines."""
    return line_dedup.deduplicated(docs)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: five words a shingle, a similarity of 0.8. Null and empty texts and
    rows with null doc_id stay; the rows of a doc_id stay or go together, and go if the text of one of them does."""
    groups = near_dup.near_duplicates(docs, size=5, threshold=(80, 100))
    return docs.join(groups.filter("not kept").select("doc_id"), "doc_id", "left_anti").select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark windows are cut out; documents that consist mostly of them go. Null and empty texts stay; every row is judged
    by its own text."""
    out = decontam.decontaminated(docs, table(spark, sf_dir, "benchmark"))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, the ids of each document as little-endian unsigned 32-bit integers, and the text decoded from them. A
    row for every row; null and empty texts have no ids."""
    return bpe.round_trip(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_near),
    ("decontamination", decontaminate),
    ("bpe", encode),
]
#: The boosted trees and the merges of BPE are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to the table documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, name)
    return docs
