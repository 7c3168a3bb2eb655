"""A training corpus from documents: toxicity filter, exact and near deduplication, source mixing, piece encoding.

Every stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept; its result is written as Parquet
and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import materialise, read
from tidemark.llm.exact_dedup import deduplicated
from tidemark.llm.jaccard_join import without_near_copies
from tidemark.llm.mixing import mix
from tidemark.llm.queries import PIECES, tokenizer_path
from tidemark.llm.sentencepieces import encode
from tidemark.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return without_toxic(docs, read(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest doc_id stays."""
    return deduplicated(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group connected by a similarity of 0.8 on five-word shingles, the document with the smallest doc_id stays."""
    return without_near_copies(docs, shingle=5, percent=80)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All sources get the same share; documents repeat by their Poisson draws, in a globally shuffled order."""
    return mix(docs, copy_column=None, order_column=None)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document with the ids of its pieces."""
    return encode(docs, tokenizer_path(PIECES), keep=("text", "ids"))


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("pieces", pieces)]

#: SQL can't express the classifier, the piece search and the connected components at this size
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
