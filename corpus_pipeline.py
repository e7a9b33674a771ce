"""From raw documents to a mixed training corpus: each stage works on all that the one before it kept.

Every stage takes ``(spark, docs, sf_dir)`` and returns the columns of ``documents``; the last returns the pieces of the
mix, a row per piece in shard order. Each result is written as Parquet and read back, so a lost executor costs one stage's
tasks at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cityloom.llm import decontaminate, langid, mixing, neardup, substring
from cityloom.llm.storage import table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; texts without a letter or unlike every language go."""
    model = langid.fit(docs)
    found = langid.identify(docs, model)
    return found.where(~F.col("rejected")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, the one with the smallest id."""
    return neardup.keep_first(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that also start earlier; ``n_chars`` follows the text."""
    return substring.remove_repeats(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by benchmark items."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents that the source mix takes, by shard."""
    return mixing.shards(mixing.draw(mixing.measure(docs)))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmarks", benchmarks),
    ("mixture", mixture),
]

#: several stages have no SQL form; they are tested against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        docs = table(stage(spark, docs, sf_dir), name)
    return docs
