"""One query for each operator of this subpackage, with production parameters, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import read

BPE_JSON = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"


def tokenizer_path(name: str) -> str:
    """Where the box keeps a public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.language_id import language_id

    return language_id(read(spark, sf_dir, "documents"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.sentencepieces import encode

    return encode(read(spark, sf_dir, "documents"), tokenizer_path(PIECES))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.token_files import token_files

    return token_files(read(spark, sf_dir, "documents"), tokenizer_path(BPE_JSON))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.mixing import mix

    return mix(read(spark, sf_dir, "documents"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.fingerprints import fingerprints

    return fingerprints(read(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.exact_dedup import exact_dedup

    return exact_dedup(read(spark, sf_dir, "documents"))


def op7_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.lm_scores import lm_scores

    return lm_scores(read(spark, sf_dir, "documents"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.jaccard_join import jaccard_components

    return jaccard_components(read(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.token_counts import token_counts

    return token_counts(read(spark, sf_dir, "documents"), tokenizer_path(PIECES))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.toxicity import toxicity

    return toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language_id, op2_sentencepiece, op3_token_files, op4_mix_sources, op5_fingerprints, op6_exact_dedup, op7_lm_scores, op8_jaccard_join, op9_token_counts, op10_toxicity)}


def oracle_sql() -> dict[str, str]:
    from tidemark.llm import exact_dedup, mixing

    return {"op4_mix_sources": mixing.ORACLE_SQL, "op6_exact_dedup": exact_dedup.ORACLE_SQL}
