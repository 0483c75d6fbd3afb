"""Audit records: building, filtering, summarising."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragspark.functions.numbers import keyed_hash
from ragspark.operators.redaction import merge_detections
from ragspark import schemas


def audit_records(turns: DataFrame, key: bytes) -> DataFrame:
    """One record per turn. The question is hashed, never stored.

    A turn may carry its ``input_hash`` instead of the question. Expects the masked output and reason, the detections of the input and of the
    three output fields, ids, flags, latencies and a ``usage`` struct.
    """
    def number(name):
        return F.coalesce(F.col("usage")[name].cast("long"), F.lit(0).cast("long")).alias(name)

    draft = F.coalesce("masked_customer_draft", F.lit(""))
    output = F.concat(
        F.coalesce("masked_handler_answer", F.lit("")),
        F.when(draft != "", F.concat(F.lit("\n\n[Customer draft]\n"), draft)).otherwise(""),
    )
    merged = merge_detections(F.col("answer_detections"), F.col("draft_detections"), F.col("reason_detections"))
    hashed = F.col("input_hash") if "input_hash" in turns.columns else keyed_hash(F.col("raw_question"), key)
    record = turns.select(
        "timestamp", "session_id", hashed.alias("input_hash"),
        "input_detections", merged.alias("output_detections"), output.alias("output"),
        F.coalesce("model_id", F.lit("")).alias("model_id"), "cited_provisions", "retrieved_chunk_ids",
        "human_review_required", F.coalesce("masked_review_reason", F.lit("")).alias("human_review_reason"),
        "insufficient_context", "latency_ms", "retrieval_latency_ms", "generation_latency_ms",
        number("input_tokens"), number("output_tokens"), number("total_tokens"),
    )
    return record.select([F.col(f.name).cast(f.dataType) for f in schemas.AUDIT.fields])


def filter_audit(
    records: DataFrame, *, session: str | None = None, since: str | None = None,
    until: str | None = None, review_only: bool = False,
) -> DataFrame:
    """Inclusive string compares on the ISO time stamp; every filter reaches the scan."""
    if session:
        records = records.where(F.col("session_id") == session)
    if since:
        records = records.where(F.col("timestamp") >= since)
    if until:
        records = records.where(F.col("timestamp") <= until)
    if review_only:
        records = records.where(F.col("human_review_required"))
    return records


def most_recent(records: DataFrame, order: str, limit: int | None) -> DataFrame:
    """The last ``limit`` records in trail order; no limit keeps all."""
    if not limit:
        return records
    return records.orderBy(F.col(order).desc()).limit(limit).orderBy(order)


def summary_line() -> Column:
    """One-line summary of an audit record."""
    listed = F.array_join(
        F.transform("input_detections", lambda d: F.concat(d["entity_type"], F.lit(":"), d["count"].cast("string"))), ", "
    )
    return F.concat(
        F.col("timestamp"), F.lit("  "), F.substring("session_id", 1, 8), F.lit("  "),
        F.rpad(F.when(F.col("human_review_required"), "REVIEW").otherwise("ok"), 6, " "), F.lit("  tokens="),
        F.rpad(F.col("total_tokens").cast("string"), F.greatest(F.lit(5), F.length(F.col("total_tokens").cast("string"))), F.lit(" ")),
        F.lit(" "), F.bround("latency_ms", 0).cast("long").cast("string"), F.lit("ms  input_pii=["),
        F.coalesce(F.nullif(listed, F.lit("")), F.lit("none")), F.lit("]  hash="),
        F.substring("input_hash", 1, 12), F.lit("..."),
    )
