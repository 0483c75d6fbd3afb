"""Corpus jobs: regulation sections and policies, each with both chunk arms."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragspark import fixed
from ragspark.functions.text import policy_references, strip, word_count
from ragspark.operators import chunking, sections
from ragspark.session import materialise


@dataclass
class Corpus:
    sections: DataFrame
    documents: DataFrame
    chunks: DataFrame


def build_regulation(provisions: DataFrame, **limits) -> Corpus:
    """Sections, whole-section documents and structure chunks of provision records."""
    table = materialise(sections.section_table(provisions))
    blocks = sections.provision_units(provisions)
    documents = sections.section_documents(blocks, table)
    units = blocks.join(table.select("section", "heading"), "section").select(
        F.col("section").alias("parent"), "ord", "label", "text", F.col("heading").alias("header")
    )
    packed = chunking.pack_units(units, **limits).withColumnRenamed("parent", "section")
    meta = table.drop("heading", "provision_count")
    chunks = packed.join(meta, "section").select(
        chunking.chunk_name(F.col("section"), F.col("chunk_index")).alias("chunk_id"), F.col("text").alias("content"),
        *meta.columns, F.size("labels").alias("provision_count"), "chunk_index", "labels", F.lit("structure").alias("arm"),
    )
    return Corpus(table, documents, chunks)


def fixed_arm(documents: DataFrame, table: DataFrame, **window) -> DataFrame:
    """Fixed windows over section documents, with the metadata of their section.

    ``source_id`` names the file a window comes from; de-duplicating on it gives
    one chunk per file.
    """
    windows = chunking.fixed_windows_of_parts(documents, "section", **window)
    meta = table.drop("heading")
    return windows.join(meta, "section").select(
        "chunk_id", F.concat(F.col("section"), F.lit(".md")).alias("source_id"), F.col("text").alias("content"),
        *meta.columns, "chunk_index", F.lit("fixed").alias("arm"),
    )


def build_policies(policies: DataFrame, model_id: str, generated_at: str, **limits) -> DataFrame:
    """Structure chunks of ``policies(slug, content)`` with the policy's metadata."""
    content = F.col("content")
    described = policies.select(
        F.col("slug"), "content", chunking.policy_title(content).alias("title"), chunking.policy_units(content).alias("units"),
        F.size(policy_references(content)).alias("fca_modules_count"), word_count(content).alias("word_count"),
    )
    meta = described.select(
        "slug", strip(F.regexp_replace("title", r"^[# ]+", "")).alias("document_title"), "fca_modules_count", "word_count",
        F.lit(True).alias("synthetic"), F.lit(model_id).alias("model_id"), F.lit(generated_at).alias("generation_timestamp"),
        *[F.lit(v).alias(k) for k, v in fixed.POLICY_METADATA.items()],
    )
    # Metadata and chunks come from the same row, so they are exploded together.
    packed = described.withColumn("_c", chunking.packed(F.col("units"), F.col("title"), **limits))
    rows = packed.select("slug", F.posexplode_outer("_c").alias("chunk_index", "c")).where(F.col("c").isNotNull()).select(
        chunking.chunk_name(F.col("slug"), F.col("chunk_index")).alias("chunk_id"), "slug", "chunk_index",
        F.col("c.text").alias("content"), F.col("c.labels").alias("labels"),
        F.element_at("c.labels", 1).alias("section_heading"), F.lit("structure").alias("arm"),
    )
    return rows.join(meta, "slug")


