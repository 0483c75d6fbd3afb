"""Text expressions: cleaning, references in prose, links, slugs, spans."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragspark import fixed


# Every character that counts as white space at the ends of a text.
WHITE_SPACE = "".join(map(chr, [*range(9, 14), *range(28, 33), 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]))


def strip(text: Column) -> Column:
    """Trim Unicode white space on both sides."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def strip_chars(text: Column, char: str) -> Column:
    return F.regexp_replace(text, f"^[{char}]+|[{char}]+$", "")


@F.pandas_udf(T.StringType())
def _decode_entities(text: pd.Series) -> pd.Series:
    return text.map(html.unescape, na_action="ignore")


def clean_text(text: Column) -> Column:
    """Decode HTML entities, fold no-break spaces, collapse blanks and tabs, trim.

    Only rows that hold an ``&`` carry their text to Python.
    """
    decoded = F.coalesce(_decode_entities(F.when(text.contains("&"), text)), text)
    # Single blanks, by far the most, are left untouched.
    return strip(F.regexp_replace(F.replace(decoded, F.lit("\u00a0"), F.lit(" ")), r"[ \t]{2,}|\t", " "))


def links(page: Column, prefix: str = fixed.HANDBOOK_LINK_PREFIX) -> Column:
    """Distinct link targets under ``prefix`` in first-seen order, prefix and slashes removed."""
    found = F.regexp_extract_all(page, F.lit(f'href="({prefix}[^"]+)"'), F.lit(1))
    bare = F.transform(found, lambda r: strip_chars(F.replace(r, F.lit(prefix), F.lit("")), "/"))
    return F.array_distinct(F.filter(bare, lambda r: r != ""))


def policy_references(text: Column) -> Column:
    """Sorted distinct ``MODULE [number]`` references of a policy text."""
    pattern = F.lit(
        r"(?U)\b(" + "|".join(fixed.POLICY_REFERENCE_MODULES) + r")(?:\s+(\d[\w.]*(?:[RGDE])?))?\b"
    )
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    return F.array_sort(F.array_distinct(F.transform(found, lambda m: F.regexp_replace(m, r"(?U)\s+", " "))))


def context_references(policy: Column) -> Column:
    """Sorted references of the regulatory-context block at chapter or section level."""
    modules = "|".join(fixed.CONTEXT_TABLE_MODULES)
    block = F.regexp_extract(policy, fixed.CONTEXT_BLOCK, 1)
    numbered = F.lit(rf"(?U)\b({modules})\s+(\d+[A-Za-z]?(?:\.\d+)?)")
    bare = F.lit(rf"(?U)\*\*\b({modules})\b\*\*")
    pairs = F.zip_with(
        F.regexp_extract_all(block, numbered, F.lit(1)),
        F.regexp_extract_all(block, numbered, F.lit(2)),
        lambda m, n: F.concat(m, F.lit(" "), n),
    )
    return F.array_sort(F.array_union(pairs, F.regexp_extract_all(block, bare, F.lit(1))))


def slug(name: Column) -> Column:
    return strip_chars(F.regexp_replace(F.lower(name), r"[^a-z0-9]+", "-"), "-")


def policy_source_ref(file_name: Column) -> Column:
    """Ground-truth id of a policy file."""
    return F.concat(F.lit("synthetic_"), F.regexp_replace(file_name, r"\.md$", ""))


def word_count(text: Column) -> Column:
    """Number of white-space separated words."""
    return F.regexp_count(text, F.lit(r"(?U)\S+"))


def token_count(text: Column) -> Column:
    """Default token counter: words and single punctuation marks.

    It is additive over texts joined by white space, which is what the packer needs.
    """
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"))


def truncate(text: Column, limit: int, mark: str = fixed.TRUNCATION_MARK) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(mark))).otherwise(text)


def spans(text: Column, part: Column) -> Column:
    """All (start, end) spans of ``part`` in ``text``, overlapping ones included, 0-based.

    Splitting at a look-ahead cuts the text at every occurrence, so the lengths
    of the pieces are the distances between the starts.
    """
    quoted = F.concat(F.lit("(?=\\Q"), F.replace(part, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E)"))
    none = F.array().cast("array<int>")
    walked = F.aggregate(
        F.split(text, quoted, -1), F.struct(F.lit(0).alias("at"), none.alias("starts")),
        lambda acc, piece: F.struct(
            (acc["at"] + F.length(piece)).alias("at"), F.array_append(acc["starts"], acc["at"]).alias("starts")
        ),
        lambda acc: acc["starts"],
    )
    # The first piece starts at 0, which is an occurrence only if the text begins with the part.
    starts = F.when(
        (F.length(part) > 0) & text.contains(part),
        F.filter(walked, lambda at: (at > 0) | text.startswith(part)),
    )
    found = F.transform(starts, lambda at: F.struct(at.alias("start"), (at + F.length(part)).alias("end")))
    return F.coalesce(found, F.array().cast("array<struct<start:int,end:int>>"))


def token_type(token: Column) -> Column:
    """Entity type of a vault token."""
    kind = F.regexp_extract(token, fixed.TOKEN_TYPE_PATTERN, 1)
    return F.coalesce(F.nullif(kind, F.lit("")), F.lit("UNKNOWN"))


def section_heading(module: Column, section_name: Column, provision_id: Column, section: Column) -> Column:
    """Heading of a section from its first provision."""
    stem = F.when(
        provision_id.contains("."), F.regexp_extract(provision_id, r"^(.*)\.[^.]*$", 1)
    ).otherwise(section)
    name = F.coalesce(F.nullif(section_name, F.lit("")), stem)
    return F.concat(F.lit("# "), F.upper(module), F.lit(" — "), name)


def provision_block(provision_id: Column, provision_type: Column, clean: Column) -> Column:
    """Markdown block of one provision from its cleaned text; empty without text."""
    kind = F.when(
        F.coalesce(provision_type, F.lit("")) != "", F.concat(F.lit(" ("), provision_type, F.lit(")"))
    ).otherwise("")
    block = F.concat(F.lit("## "), F.coalesce(provision_id, F.lit("")), kind, F.lit("\n\n"), clean)
    return F.when(F.coalesce(clean, F.lit("")) != "", block).otherwise("")
