"""A training corpus from the documents table: quality, near duplicates, personal data, mixing, packing.

Each stage takes what the one before it kept, as a table written and read again, and calls one operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folio.llm import mixing, ngram_join, packing, pii, quality
from folio.llm.common import persist, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches 0.3."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"), threshold=0.3)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles link at 0.8."""
    return ngram_join.keep_one(docs, n=5, num=80, den=100)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Entities generalised to their kind, terms that reveal them removed."""
    return pii.sanitise(docs)


def mixing_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as their fitted rates say."""
    return mixing.mix(docs, table(spark, sf_dir, "labels"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their sequence and offset."""
    return packing.packed_pieces(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", near_duplicates),
    ("PII", personal_data),
    ("mixing sources to target weights", mixing_weights),
    ("best-fit packing", best_fit_packing),
]

#: The trained models and the tokenizer can't be put in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs, _ = persist(stage(spark, docs, sf_dir), "stage-" + name.split()[0].lower())
    return docs
