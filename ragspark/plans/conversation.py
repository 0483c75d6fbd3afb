"""A redacted conversation with its audit trail, as one batch over turns."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragspark.functions.pii import DETECTORS, Detector
from ragspark.operators.audit import audit_records
from ragspark.operators.redaction import redact

# Order in which a turn's texts meet the session's vault.
FIELDS = ["raw_question", "handler_answer", "customer_draft", "human_review_reason"]
TURN = ["session_id", "turn"]


@dataclass
class Conversation:
    turns: DataFrame
    vault: DataFrame
    audit: DataFrame


def redact_conversation(turns: DataFrame, key: bytes, detectors: Sequence[Detector] = DETECTORS) -> Conversation:
    """Mask the question and the three output fields of each turn with one vault per session.

    ``turns`` holds the raw fields and the audit columns (time stamp, model, ids,
    flags, latencies, usage). The raw text leaves this job only as a keyed hash.
    """
    done = redact(field_rows(turns), detectors)
    masked = turns.join(masked_turns(done.texts), TURN)
    return Conversation(masked.drop(*FIELDS), done.vault, audit_records(masked, key))


def field_rows(turns: DataFrame, *extra) -> DataFrame:
    """The four texts of each turn as rows ``session_id, turn, pass_no, text``, in vault order."""
    cells = F.array(*[
        F.struct(F.lit(i).alias("pass_no"), F.coalesce(F.col(c), F.lit("")).alias("text")) for i, c in enumerate(FIELDS)
    ])
    return turns.select(*TURN, *extra, F.explode(cells).alias("_c")).select(*TURN, "_c.*", *[c for c in ("note",) if extra])


def masked_turns(texts: DataFrame, *extra) -> DataFrame:
    """One row per turn from its four redacted texts."""
    wide = texts.groupBy(*TURN).agg(*extra, *[
        F.max_by(F.struct("clean_text", "detections"), F.when(F.col("pass_no") == i, 1)).alias(f"_{i}") for i in range(len(FIELDS))
    ])
    names = ["masked_question", "masked_handler_answer", "masked_customer_draft", "masked_review_reason"]
    found = ["input_detections", "answer_detections", "draft_detections", "reason_detections"]
    kept = [c for c in wide.columns if not c.startswith("_")]
    return wide.select(
        *kept, *[F.col(f"_{i}.clean_text").alias(n) for i, n in enumerate(names)],
        *[F.col(f"_{i}.detections").alias(n) for i, n in enumerate(found)],
    )


def history(masked: DataFrame, asking: DataFrame) -> DataFrame:
    """Earlier masked messages for the turns being asked: ``session_id, turn, past_turn, role, text``.

    ``asking(session_id, turn)`` is the work in hand, normally one open turn per
    session, so each past message appears once.
    """
    draft = F.coalesce("masked_customer_draft", F.lit(""))
    answer = F.concat("masked_handler_answer", F.when(draft != "", F.concat(F.lit("\n\n[Customer draft]\n"), draft)).otherwise(""))
    messages = masked.select(
        "session_id", F.col("turn").alias("past_turn"),
        F.explode(F.array(
            F.struct(F.lit("user").alias("role"), F.col("masked_question").alias("text")),
            F.struct(F.lit("assistant").alias("role"), answer.alias("text")),
        )).alias("m"),
    ).select("session_id", "past_turn", "m.*")
    return asking.join(messages, "session_id").where(F.col("past_turn") < F.col("turn")).select(
        "session_id", "turn", "past_turn", "role", "text"
    )
