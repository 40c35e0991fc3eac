"""A corpus pipeline of four stages; each one's rows are written as Parquet and reread as the next one's documents.

Every stage takes what its operator takes: null or empty texts are scored by the bias, fail the rules, are classes of their own and have length 0; a null doc_id passes the first three
stages like any other; repeated rows share their fate until the join, which leaves one of them; very long texts stay whole; further columns of documents pass through up to the packing; an
empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from posterboard.llm import ngram_join, packing, quality_classifier, quality_rules
from posterboard.llm.common import crc_mod, n_words, table, written


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier gives a fair chance of good quality; it learns from the labels of these documents."""
    learn = table(spark, sf_dir, "labels").where(crc_mod(F.col("doc_id"), 5) != 0)
    scored = quality_classifier.score(docs, quality_classifier.train(docs, learn))
    return scored.where(F.col("score") >= quality_classifier.THRESHOLD).select(*docs.columns)


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, without the lines that are frequent in their source; n_chars is that of the text that is left."""
    return quality_rules.keep_good(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def ngram_join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five words and 0.8."""
    return ngram_join.one_of_each(docs, threshold=80, n=5)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, "doc_id", n_words(F.col("text")))


STAGES = [
    ("quality_classifier", quality_classifier_stage),
    ("quality_rules", quality_rules_stage),
    ("ngram_join", ngram_join_stage),
    ("packing", packing_stage),
]

#: The classifier and the packing's dynamic programming are beyond SQL; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
