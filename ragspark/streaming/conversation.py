"""The redacted conversation as a stream: session vault, audit trail and vault table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ragspark.functions.numbers import keyed_hash
from ragspark.functions.pii import DETECTORS, Detector
from ragspark.operators.audit import audit_records
from ragspark.plans.conversation import FIELDS, TURN, field_rows, masked_turns
from ragspark.streaming.sessions import redact_stream


def conversation_sink(
    turns: DataFrame, key: bytes, path: str, checkpoint: str, *, detectors: Sequence[Detector] = DETECTORS,
    vault: DataFrame | None = None, **trigger,
) -> StreamingQuery:
    """Redact each turn's question and output and record it.

    ``turns`` has the columns of the batch job. Writes ``audit`` (JSON lines),
    ``turns`` (masked texts) and ``vault`` (tokens issued, with type and number) under ``path``, one
    folder per micro batch, which a replay overwrites. ``vault`` is an earlier vault to go on from. The raw question leaves
    the first stage only as its hash; the audit columns travel as a note.
    """
    meta = [c for c in turns.columns if c not in {*TURN, *FIELDS}]
    shape = turns.select(*meta, F.lit("").alias("input_hash")).schema
    note = F.to_json(F.struct(*meta, keyed_hash(F.coalesce("raw_question", F.lit("")), key).alias("input_hash")))
    redacted = redact_stream(field_rows(turns, note.alias("note")), detectors, vault=vault)

    def record(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            folder = f"batch={batch_id:09d}"
            masked = masked_turns(batch, F.max("note").alias("note")).withColumn("_n", F.from_json("note", shape)).select("*", "_n.*")
            audit_records(masked, key).write.mode("overwrite").json(f"{path}/audit/{folder}")
            masked.select(*TURN, "masked_question", "masked_handler_answer", "masked_customer_draft", "masked_review_reason").write.mode(
                "overwrite").parquet(f"{path}/turns/{folder}")
            issued = batch.select("session_id", F.explode("issued").alias("i")).select("session_id", "i.*")
            issued.write.mode("overwrite").parquet(f"{path}/vault/{folder}")
        finally:
            batch.unpersist()

    return (
        redacted.writeStream.foreachBatch(record).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )
