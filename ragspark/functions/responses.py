"""Model responses: text extraction, tolerant JSON, label normalisation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ragspark import fixed
from ragspark.functions.text import strip

# Shape of one content block of a response message.
CONTENT_BLOCKS = "array<struct<type:string,text:string,reasoningContent:struct<reasoningText:struct<text:string>>,other:string>>"


def response_text(blocks: Column) -> Column:
    """Answer text of a message: its text blocks, else reasoning text, else an array-like value."""
    def joined(field):
        kept = F.filter(F.transform(blocks, field), lambda t: t.isNotNull() & (t != ""))
        return F.nullif(F.array_join(kept, "\n"), F.lit(""))
    array_like = F.filter(
        F.transform(blocks, lambda b: b["other"]), lambda t: strip(t).startswith("[")
    )
    return F.coalesce(
        joined(lambda b: b["text"]),
        joined(lambda b: b["reasoningContent"]["reasoningText"]["text"]),
        F.get(array_like, F.lit(0)),
        F.lit(""),
    )


def unfence(raw: Column) -> Column:
    """Drop a leading code fence line and a closing one."""
    text = strip(raw)
    body = F.regexp_replace(text, r"^```[^\n]*\n?", "")
    body = F.regexp_replace(body, r"(?:^|\n)[ \t\r]*```[ \t\r]*$", "")
    return F.when(text.startswith("```"), strip(body)).otherwise(text)


def _between(text: Column, first: str, last: str) -> Column:
    start = F.locate(first, text)
    end = F.length(text) - F.locate(last, F.reverse(text)) + 1
    cut = F.substr(text, start, end - start + 1)
    return F.when((start > 0) & (F.locate(last, text) > 0) & (end > start), cut)


def json_items(raw: Column) -> Column:
    """Objects of a JSON array in a model response, as ``array<variant>``.

    Fences and a preamble are tolerated, non-objects are dropped, and anything
    that cannot be read gives an empty array.
    """
    text = unfence(raw)
    value = F.coalesce(F.try_parse_json(text), F.try_parse_json(_between(text, "[", "]")))
    items = F.try_variant_get(value, "$", "array<variant>")
    objects = F.filter(items, lambda v: F.try_variant_get(v, "$", "map<string,variant>").isNotNull())
    return F.coalesce(objects, F.array().cast("array<variant>"))


def json_document(raw: Column) -> Column:
    """One JSON value anywhere in a response (first fence, whole text, object, array) as variant."""
    fenced = F.regexp_extract(raw, r"(?s)```(?:json)?\s*\n?(.*?)\n?```", 1)
    text = F.when(raw.rlike(r"(?s)```.*?```"), strip(fenced)).otherwise(raw)
    return F.coalesce(
        F.try_parse_json(text),
        F.try_parse_json(_between(text, "{", "}")),
        F.try_parse_json(_between(text, "[", "]")),
    )


def field(item: Column, name: str, default: str = "") -> Column:
    return F.coalesce(F.try_variant_get(item, f"$.{name}", "string"), F.lit(default))


def _label(value: Column, allowed: list[str], default: str) -> Column:
    label = strip(F.replace(F.upper(value), F.lit(" "), F.lit("_")))
    return F.when(label.isin(allowed), label).otherwise(default)


def status_label(value: Column) -> Column:
    return _label(value, list(fixed.COVERAGE_WEIGHTS), "MISSING")


def grounding_label(value: Column) -> Column:
    return _label(value, fixed.GROUNDING_LABELS, "UNGROUNDED")


def source_field_label(value: Column) -> Column:
    name = strip(value)
    return F.when(name.isin(fixed.SOURCE_FIELDS), name).otherwise("unknown")


def supporting_chunk(item: Column) -> Column:
    """Chunk id of a claim: a list gives its first entry, an empty list or null gives null."""
    value = F.try_variant_get(item, "$.supporting_chunk_id", "variant")
    is_list = F.schema_of_variant(value).startswith("ARRAY")
    first = F.try_variant_get(item, "$.supporting_chunk_id[0]", "string")
    return F.when(is_list, first).otherwise(F.try_variant_get(value, "$", "string"))


def verdicts(raw: Column) -> Column:
    """Rubric verdicts of a response: ``array<struct<element,status,evidence,reasoning>>``."""
    return verdicts_of(json_items(raw))


def verdicts_of(items: Column) -> Column:
    return F.transform(
        items,
        lambda v: F.struct(
            field(v, "element").alias("element"),
            status_label(field(v, "status", "MISSING")).alias("status"),
            field(v, "evidence").alias("evidence"),
            field(v, "reasoning").alias("reasoning"),
        ),
    )


def claims(raw: Column) -> Column:
    """Graded claims of a response."""
    return F.transform(
        json_items(raw),
        lambda v: F.struct(
            field(v, "claim").alias("claim"),
            source_field_label(field(v, "source_field")).alias("source_field"),
            grounding_label(field(v, "grounding", "UNGROUNDED")).alias("grounding"),
            supporting_chunk(v).alias("supporting_chunk_id"),
            field(v, "reasoning").alias("reasoning"),
        ),
    )
