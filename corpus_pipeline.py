"""Corpus pipeline over ``documents``: quality rules, language ID, line dedup, near duplicates, packing.

Each stage reads all documents its predecessor kept; all but the last return the
columns of ``documents``. Null columns, empty tables, repeated rows and extra columns are
handled as the operators' docstrings say.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragspark.llm import jaccard, langid, linedup, packing, rules, tokens
from ragspark.session import shared_folder, tune


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base checks and the decision list learned from ``labels``."""
    tune(spark)
    return rules.keep_good(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; the model learns from the rows that are not held out."""
    tune(spark)
    return langid.keep_known(docs, langid.fit(docs.where(~langid.held_out())))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of long runs of lines; those that were nothing else go."""
    tune(spark)
    out = linedup.dedup(docs, drop_emptied=True)
    # The column counts the characters of the text, which has changed where lines went.
    if "n_chars" in docs.columns:
        changed = F.size(out.columns[-1]) > 0
        out = out.withColumn("n_chars", F.when(changed, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    tune(spark)
    return jaccard.keep_first(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens."""
    tune(spark)
    return packing.pack(docs, tokens.default_path())


STAGES = [
    ("quality_rules", quality), ("language_id", language), ("line_dedup", lines), ("jaccard_join", near_duplicates), ("packing", pack),
]
#: Learned stages and packing have no SQL form; tests compare some of the operators, but neither the stages nor run(), with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each result is written as Parquet and read again by the next stage."""
    tune(spark)
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        path = f"{shared_folder(spark).rstrip('/')}/ragspark/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
