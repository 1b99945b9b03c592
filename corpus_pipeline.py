"""The corpus pipeline: five operators in a row over the documents table.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the columns
of documents; the last adds mix_rate and mix_copies. An empty table goes through every stage as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cambium.llm import decontaminate, language, mixing, pii, simhash
from cambium.llm.common import durable, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the compression classifier doesn't reject."""
    return language.keep_identified(docs, language.fit(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the smallest doc_id, of each group that links of Jaccard similarity 0.8 or more over five-word shingles connect."""
    return simhash.drop_near_duplicates(docs, shingle=5)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark within the edit budget."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by surrogates."""
    return pii.pseudonymise(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the rates and copies that give the domains their target weights; those without a copy go."""
    return mixing.mixed_documents(docs, table(spark, sf_dir, "labels"))


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontamination", decontamination), ("pii", personal_data), ("mixing", mix)]

#: SQL can't express the stages; tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir))
    return docs
