"""A corpus pipeline over `documents`: quality rules, near-duplicates, repeated passages, benchmark leaks, tokens.

Each stage takes (spark, docs, sf_dir), docs being what the stage before it kept, and all but the last
return the columns of documents. Columns beyond those are kept, whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from docloom.llm.bpe_codec import encode_documents
from docloom.llm.common import checkpoint, read_table
from docloom.llm.decontaminate import without_leaks
from docloom.llm.near_copies import keep_one
from docloom.llm.quality_rules import fit_rules, keep_documents
from docloom.llm.suffix_dedup import without_repeats


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the rules reject: null, empty and short texts among them. Repeated rows go or stay alike."""
    return keep_documents(docs, fit_rules(docs, read_table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies, the least id; a null id comes last. Texts without words are one group."""
    return keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts what an earlier document has; a text of which nothing remains goes. Null and empty texts, rows without an id and rows under one id are left alone."""
    return without_repeats(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold an item, with all rows that repeat them. Null and empty texts stay."""
    return without_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and digests per row; a null text counts as empty."""
    return encode_documents(docs, public_tokenizers.path("byte_bpe_50k.json")).drop("decoded")


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", near_duplicates),
    ("suffix_array_dedup", repeated_passages),
    ("benchmark_decontamination", benchmark_leaks),
    ("bpe_encoding", tokens),
]

#: Trees, fingerprints and merges aren't SQL: the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = checkpoint(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
