"""Prompt messages as column expressions. System prompts are supplied by the caller."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _or_empty(text: Column) -> Column:
    return F.coalesce(F.nullif(text, F.lit("")), F.lit("(empty)"))


def rubric_block() -> Column:
    """Definition block of one rubric element, from the rubric's columns."""
    def line(label, name):
        return F.concat(F.lit(f"{label}: "), F.coalesce(F.col(name), F.lit("")))
    return F.concat_ws(
        "\n",
        F.concat(F.lit("### "), F.col("element"), F.lit(" (audience: "), F.coalesce("audience", F.lit("customer")), F.lit(")")),
        line("Definition", "definition"), line("PRESENT if", "present_if"), line("PARTIAL if", "partial_if"),
        line("MISSING if", "missing_if"),
        F.when(F.coalesce("not_satisfied_by", F.lit("")) != "", line("Not satisfied by", "not_satisfied_by")),
    )


def drafting_message(context: Column, question: Column) -> Column:
    return F.concat(
        F.lit("Retrieved provisions:\n\n"), context, F.lit("\n\n---\n\nMessage:\n"), question,
        F.lit("\n\nAnswer from these provisions only and list each one you rely on in cited_provisions."),
    )


# The two fields of a draft, as claims name them in source_field.
DRAFT_FIELDS = {"handler_answer": "HANDLER ANSWER", "customer_draft": "CUSTOMER DRAFT"}


def drafted_response(handler: Column, customer: Column, tagged: bool = False) -> Column:
    """Both parts of a draft; ``tagged`` parts carry the name a claim has to give as its source_field."""
    heads = [f"--- {title} (source_field: {field}) ---\n" if tagged else f"--- {title} ---\n" for field, title in DRAFT_FIELDS.items()]
    return F.concat(
        F.lit("DRAFTED RESPONSE\n" + heads[0]), _or_empty(handler), F.lit("\n\n" + heads[1]), _or_empty(customer),
    )


def rubric_message(scenario: Column, stage: Column, drafted: Column, elements: Column) -> Column:
    return F.concat(
        F.lit("COMPLAINT:\n"), scenario, F.lit("\n\nRESPONSE STAGE: "), stage, F.lit("\n\n"), drafted,
        F.lit("\n\nREQUIRED ELEMENTS:\n\n"), elements,
        F.lit("\n\n---\n\nScore each element. Return a JSON array with keys element, status, evidence, reasoning."),
    )


def grounding_message(handler: Column, customer: Column, context: Column) -> Column:
    return F.concat(
        drafted_response(handler, customer, tagged=True), F.lit("\n\nRETRIEVED PROVISIONS:\n\n"), context,
        F.lit("\n\n---\n\nReturn a JSON array of claims with keys claim, source_field, grounding, supporting_chunk_id, reasoning."),
    )


def question_message(context: Column, question: Column) -> Column:
    return F.concat(
        F.lit("Retrieved context:\n\n"), context, F.lit("\n\n---\n\nQuestion: "), question,
        F.lit("\n\nAnswer from this context only. Return a JSON object with keys answer, citations (chunk ids), confidence, insufficient_context."),
    )


def claims_message(question: Column, answer: Column, context: Column) -> Column:
    return F.concat(
        F.lit("QUESTION:\n"), question, F.lit("\n\nANSWER:\n"), answer, F.lit("\n\nRETRIEVED CONTEXT:\n\n"), context,
        F.lit("\n\n---\n\nReturn a JSON array of claims with keys claim, grounding, supporting_chunk_id, reasoning."),
    )
