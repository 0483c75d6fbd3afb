"""Landed documents: the document tree, raw provisions, sections and the chunk store."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragspark import fixed, schemas
from ragspark.functions.text import links
from ragspark.operators.ranking import number_rows


def read_tree(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.HANDBOOK_TREE).option("multiLine", True).json(path)


def section_pairs(tree: DataFrame, modules: Sequence[str] = fixed.TARGET_MODULES) -> DataFrame:
    """(module, chapter, section) of the kept modules, one row per section."""
    return (
        tree.select(F.explode("parts").alias("m"))
        .where(F.col("m.entityId").isin(list(modules)))
        .select(F.col("m.entityId").alias("module"), F.explode("m.parts").alias("c"))
        .select("module", F.col("c.entityId").alias("chapter"), F.explode("c.parts").alias("s"))
        .select("module", "chapter", F.col("s.entityId").alias("section"))
    )


def chapter_modules(tree: DataFrame, modules: Sequence[str] = fixed.TARGET_MODULES) -> DataFrame:
    """Chapter to module; a chapter without sections still counts."""
    return (
        tree.select(F.explode("parts").alias("m"))
        .where(F.col("m.entityId").isin(list(modules)))
        .select(F.explode("m.parts.entityId").alias("chapter"), F.col("m.entityId").alias("module"))
        .distinct()
    )


def normalise_provisions(raw: DataFrame, chapters: DataFrame) -> DataFrame:
    """Provision records from landed responses; an unknown chapter is its own module."""
    def text(name):
        return F.coalesce(name, F.lit(""))

    joined = raw.join(chapters, "chapter", "left")
    return joined.select(
        text("provisionName").alias("provision_id"), text("entityId").alias("entity_id"),
        F.coalesce("module", "chapter").alias("module"), "chapter", "section",
        text("sectionName").alias("section_name"), text("provisionType").alias("provision_type"),
        text("contentText").alias("text"), text("contentType").alias("html"),
        links(text("contentType")).alias("cross_references"), text("timeline").alias("last_modified"),
        F.col("ord").cast("long").alias("ord"),
    )


def read_provisions(spark: SparkSession, path: str) -> DataFrame:
    """Provision records from JSON lines with an explicit schema."""
    return spark.read.schema(schemas.PROVISIONS).json(path)


def load_provisions(spark: SparkSession, path: str) -> DataFrame:
    """Provision records from JSON lines in the order of the files, as the scraper wrote them: ``ord`` from 0.

    The lines carry no position. It comes from the reader: the file's path, the start of the split in the file and the
    row's place in the split. So files may be many, large and read in any order.
    """
    plain = read_provisions(spark, path).drop("ord")
    placed = plain.select(
        "*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_split"),
        F.monotonically_increasing_id().alias("_row"),
    )
    numbered = number_rows(placed, [], [F.col("_file"), F.col("_split"), F.col("_row")], "_n")
    return numbered.withColumn("ord", F.col("_n") - 1).drop("_file", "_split", "_row", "_n")


def write_store(table: DataFrame, path: str, partition: str | None = "arm") -> None:
    """Overwrite a section or chunk table, partitioned by arm."""
    writer = table.write.mode("overwrite")
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def section_index(metadata: DataFrame, documents: DataFrame) -> DataFrame:
    """Metadata of sections whose document exists."""
    return metadata.join(documents.select("section").distinct(), "section", "left_semi").select(
        F.col("section").alias("section_id"), "module", "chapter",
        F.coalesce("section_name", F.lit("")).alias("section_name"),
        F.coalesce(F.col("provision_count").cast("long"), F.lit(0).cast("long")).alias("provision_count"),
    )


def one_index(*corpora: DataFrame) -> DataFrame:
    """Union of corpora whose metadata differ."""
    every = corpora[0]
    for corpus in corpora[1:]:
        every = every.unionByName(corpus, allowMissingColumns=True)
    return every


def spot_check(table: DataFrame, key: str, n: int = 10, seed: str = "0") -> DataFrame:
    """``n`` rows for manual checking: a random order that repeats for the same seed."""
    return table.orderBy(F.sha2(F.concat(F.lit(seed), F.lit(":"), F.col(key).cast("string")), 256), key).limit(n)
