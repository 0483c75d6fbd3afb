"""Streaming sinks: the audit trail and incremental evaluation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ragspark.sources.records import remaining_work, write_run


def audit_sink(records: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append audit records as JSON files; the checkpoint makes each record appear once."""
    return (
        records.writeStream.format("json").outputMode("append").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    )


def evaluate_stream(
    planned: DataFrame, evaluate: Callable[[DataFrame], DataFrame], read_done: Callable[[], DataFrame],
    path: str, checkpoint: str, keys: list[str], **trigger,
) -> StreamingQuery:
    """Evaluate arriving work once: each batch skips recorded keys and writes its own run.

    A batch that is replayed after a failure overwrites its own run, so nothing
    is recorded twice.
    """
    def step(batch: DataFrame, batch_id: int) -> None:
        done = read_done()
        if "run_ts" in done.columns:
            done = done.where(done["run_ts"].cast("string") != f"batch-{batch_id:09d}")
        write_run(evaluate(remaining_work(batch.dropDuplicates(keys), done, keys)), path, f"batch-{batch_id:09d}", mode="overwrite")

    return (
        planned.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )
