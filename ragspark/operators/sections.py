"""Sections and their documents from provision records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragspark import fixed
from ragspark.functions.text import clean_text, provision_block, section_heading
from ragspark.operators.ranking import row_numbers
from ragspark.session import materialise, spread


def section_table(provisions: DataFrame) -> DataFrame:
    """One row per section: heading and lean metadata of its first provision, and its size."""
    first = F.min_by(F.struct("module", "chapter", "section_name", "provision_id"), "ord").alias("_f")
    grouped = provisions.groupBy("section").agg(first, F.count("*").alias("provision_count"))
    heading = section_heading(F.col("_f.module"), F.col("_f.section_name"), F.col("_f.provision_id"), F.col("section"))
    return grouped.select(
        "section", "_f.module", "_f.chapter", F.coalesce("_f.section_name", F.lit("")).alias("section_name"),
        "provision_count", heading.alias("heading"), F.lit(False).alias("synthetic"),
        *[F.lit(v).alias(k) for k, v in fixed.REGULATION_METADATA.items()],
    )


def provision_units(provisions: DataFrame) -> DataFrame:
    """Non-empty provision blocks as units ``section, ord, label, text``.

    Cleaned once and written down: documents and chunks both read the result,
    and a filter on a computed text would compute it again.
    """
    clean = spread(provisions).withColumn("_clean", clean_text(F.coalesce("text", F.lit(""))))
    block = provision_block(F.col("provision_id"), F.col("provision_type"), F.col("_clean"))
    units = materialise(clean.select("section", "ord", F.col("provision_id").alias("label"), block.alias("text")))
    return units.where(F.col("text") != "")


def section_documents(units: DataFrame, sections: DataFrame, units_per_part: int = 512) -> DataFrame:
    """Whole-section documents ``section, part, text, n_units`` from provision units.

    A document longer than ``units_per_part`` provisions comes in consecutive
    parts whose texts, joined in order, are the document; others are one part.
    A section without any text is its heading alone.
    """
    placed = row_numbers(
        units, ["section"], F.floor(F.col("ord") / 4096), [F.col("ord")], "pos"
    ).withColumn("part", F.floor((F.col("pos") - 1) / units_per_part))
    parts = placed.groupBy("section", "part").agg(
        F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("_u")
    ).select("section", "part", F.array_join(F.transform(
        "_u", lambda u: F.concat(F.lit("\n"), u["text"], F.lit("\n"))), "").alias("body"), F.size("_u").alias("n_units"))
    heads = sections.select("section", "heading")
    joined = heads.join(parts, "section", "left")
    part = F.coalesce("part", F.lit(0))
    return joined.select(
        "section", part.cast("long").alias("part"),
        F.concat(F.when(part == 0, F.concat("heading", F.lit("\n"))).otherwise(""), F.coalesce("body", F.lit(""))).alias("text"),
        F.coalesce("n_units", F.lit(0)).alias("n_units"),
    )


def module_counts(sections: DataFrame) -> DataFrame:
    """Sections and provisions per module with a TOTAL row."""
    return sections.rollup("module").agg(
        F.count("*").alias("n_sections"), F.sum("provision_count").alias("n_provisions"), F.grouping("module").alias("_all")
    ).select(F.when(F.col("_all") == 1, "TOTAL").otherwise(F.upper("module")).alias("module"), "n_sections", "n_provisions")
