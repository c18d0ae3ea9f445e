"""A training-data pipeline over `documents`: stages of (name, function), each working on all its predecessor kept.

Every function takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanloom.llm.common import materialize


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go: those whose text is null, empty or without a letter. lang becomes the predicted
    one; ties between languages go to the name that comes first. Repeated rows and other columns stay."""
    from spanloom.llm.language import filter_languages

    return filter_languages(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: that of the least doc_id. Texts that are null, empty or
    without a word, and rows with a null doc_id, are groups of their own; of rows with one doc_id one stays."""
    from spanloom.llm.near_duplicates import keep_one

    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go. Null and empty texts, and rows with a null doc_id, stay; an
    empty benchmark removes nothing."""
    from spanloom.llm.decontaminate import decontaminate

    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data get surrogates; n_chars becomes the new text's length, null for a null text. Every row stays."""
    from pyspark.sql import functions as F

    from spanloom.llm.pii import pseudonymise

    return pseudonymise(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept texts as packed pieces: doc_id, piece, start, length, ids_crc32, sequence_id, offset. A null or empty
    text is one piece of the end id; repeated rows are packed each by itself."""
    import public_tokenizers

    from spanloom.llm.packing import pack_documents

    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language ID", language),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("PII surrogates", personal_data),
    ("best-fit packing", packing),
]

#: SQL can't express the learned stages; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, f"stage{k}")
    return docs
