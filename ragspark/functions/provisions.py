"""Provision references as column expressions (no UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ragspark import fixed
from ragspark.functions.text import WHITE_SPACE


# Stands between module and identifier while white space inside the identifier is dropped.
_GAP = "\0"


def _compact(ref: Column) -> Column:
    """``MODULE\\0identifier`` without white space and trailing sub-paragraphs."""
    bare = F.regexp_replace(F.upper(ref), fixed.SUBPARAGRAPH_TAIL, "")
    marked = F.regexp_replace(bare, r"(?U)^\s*([A-Z]+)\s*(?=\d)", f"$1{_GAP}")
    return F.translate(marked, WHITE_SPACE, "")


def _without_status(compact: Column) -> Column:
    """Drop the one status letter that may end an identifier."""
    has_status = F.right(compact, F.lit(1)).isin("R", "G", "E")
    return F.when(has_status, F.left(compact, F.length(compact) - 1)).otherwise(compact)


def provision_key(ref: Column) -> Column:
    """Comparison key ``MODULE id`` without sub-paragraphs and status letter, else null."""
    compact = _compact(ref)
    return F.when(compact.contains(_GAP), F.replace(_without_status(compact), F.lit(_GAP), F.lit(" ")))


def parse_provision(ref: Column) -> Column:
    """Struct (module, core, status); null when the reference cannot be parsed."""
    compact = _compact(ref)
    last = F.right(compact, F.lit(1))
    return F.when(
        compact.contains(_GAP),
        F.struct(
            F.split_part(compact, F.lit(_GAP), F.lit(1)).alias("module"),
            F.split_part(_without_status(compact), F.lit(_GAP), F.lit(2)).alias("core"),
            F.when(last.isin("R", "G", "E"), last).alias("status"),
        ),
    )


def provision_keys(refs: Column) -> Column:
    """Distinct keys of an array of references, unparseable ones dropped."""
    return F.array_compact(F.array_distinct(F.transform(refs, provision_key)))


def defined_provisions(content: Column) -> Column:
    """Distinct keys of provisions whose rule text is present, not merely mentioned."""
    found = F.regexp_extract_all(content, F.lit(fixed.PROVISION_DEFINITION), F.lit(0))
    # The type label is the last parenthesis, so the key rule drops it like a sub-paragraph.
    return provision_keys(found)


def chunk_section(section: Column, chunk_id: Column) -> Column:
    """Section of a chunk: its metadata, else the stem of its file name."""
    from_name = F.regexp_extract(chunk_id, fixed.CHUNK_FILE_SECTION, 1)
    return F.coalesce(F.nullif(section, F.lit("")), F.nullif(from_name, F.lit("")))
