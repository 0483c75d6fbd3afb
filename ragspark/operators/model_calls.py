"""Calls to an injected model: a table of prompts in, a table of responses out."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ragspark.session import materialise

# (model, system, prompt) -> {"text": str, "input_tokens": int, "output_tokens": int, "total_tokens": int}
ModelFn = Callable[[str, str, str], dict]

ANSWER = "raw string, input_tokens bigint, output_tokens bigint, total_tokens bigint, latency_ms double, error string"
LEDGER = f"hash string, {ANSWER}"


def _answer(model: ModelFn, row) -> dict:
    start = time.perf_counter()
    try:
        got, error = model(row.model, row.system, row.prompt), None
    except Exception as failure:  # the record keeps the reason
        got, error = {}, str(failure)
    return {
        "raw": got.get("text", ""), **{f"{k}_tokens": int(got.get(f"{k}_tokens", 0)) for k in ("input", "output", "total")},
        "latency_ms": (time.perf_counter() - start) * 1000, "error": error,
    }


def call_model(prompts: DataFrame, keys: list[str], model: ModelFn, ledger: str | None = None, overlap: int = 4) -> DataFrame:
    """Answer ``prompts(keys, model, system, prompt)``.

    A failed call gives an empty response with its error, never an exception. At most ``overlap`` calls of a task
    run at once, so ``model`` has to bear threads. Responses are written down at once, so readers never call again.

    ``ledger`` names a folder on shared storage that keeps answers by a hash of model, system and prompt. Each answer
    is there as soon as its call ends, so a job that was killed, or a task that lost its executor, asks
    only what has no answer yet. Equal prompts are asked once and share their answer with its tokens. Failures are not
    kept: the next job asks again. Speculative execution may ask twice and keeps one answer.
    """
    kept = prompts.select(*keys, "model", "system", "prompt")
    if ledger is not None:
        return _through_ledger(kept, keys, model, ledger, overlap)
    base = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields if f.name not in ("system", "prompt"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(overlap) as pool:
            for batch in batches:
                if len(batch):
                    got = pd.DataFrame(list(pool.map(lambda r: _answer(model, r), batch.itertuples(index=False))), index=batch.index)
                    yield pd.concat([batch.drop(columns=["system", "prompt"]), got], axis=1)

    return materialise(kept.mapInPandas(run, f"{base}, {ANSWER}"))


# --- ledger ----------------------------------------------------------------------------


def prompt_hash(*parts: Column) -> Column:
    """Hash of the parts with their lengths, so that no two lists of parts give one text; null is apart from empty."""
    marked = [F.coalesce(F.concat(F.octet_length(p).cast("string"), F.lit(":"), p), F.lit("-")) for p in parts]
    return F.sha2(F.concat(*marked), 256)


def _folder(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path.removeprefix("file:")


def _file(root: str, name: str) -> str:
    # Folders by the first digits of the hash keep any one of them small.
    return f"{root.rstrip('/')}/calls/{name[:2]}/{name}.json"


def _read(spark: SparkSession, path: str, form: str) -> DataFrame:
    try:
        return spark.read.schema(LEDGER).option("recursiveFileLookup", True).format(form).load(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER)


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    """Answers by prompt hash, one row each: those folded into the table and those whose job has not ended."""
    root = ledger.rstrip("/")
    return _read(spark, f"{root}/answers", "parquet").unionByName(_read(spark, f"{root}/calls", "json")).dropDuplicates(["hash"])


def fold_ledger(spark: SparkSession, ledger: str) -> None:
    """Move single answers into the ledger's table. Interrupted, it leaves some in both, which readers see once."""
    root = ledger.rstrip("/")
    single = _read(spark, f"{root}/calls", "json")
    # The files were listed once, so what is deleted is what is written.
    _move(single, ledger)


def _move(answers: DataFrame, ledger: str) -> None:
    """Append answers to the ledger's table, then delete their files."""
    if answers.isEmpty():
        return
    root = ledger.rstrip("/")
    answers.write.mode("append").parquet(f"{root}/answers")

    def drop(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = _folder(root)
        for batch in batches:
            for name in batch["hash"]:
                try:
                    system.delete_file(_file(base, name))
                except FileNotFoundError:  # an earlier attempt of this task
                    pass
            yield batch

    answers.select("hash").mapInPandas(drop, "hash string").write.format("noop").mode("overwrite").save()


def _through_ledger(kept: DataFrame, keys: list[str], model: ModelFn, ledger: str, overlap: int) -> DataFrame:
    spark = kept.sparkSession
    named = materialise(kept.withColumn("hash", prompt_hash(F.col("model"), F.col("system"), F.col("prompt"))))
    known = materialise(read_ledger(spark, ledger).join(named.select("hash"), "hash", "left_semi"))
    # Equal hashes are equal prompts, so any of them will do; the aggregation is by the hash alone.
    wanted = named.join(known.select("hash"), "hash", "left_anti").groupBy("hash").agg(
        *[F.first(c).alias(c) for c in ("model", "system", "prompt")]
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = _folder(ledger)
        made = set()

        def ask(row) -> dict:
            at = _file(base, row.hash)
            # An earlier attempt of this task may have got the answer.
            if system.get_file_info(at).type == fs.FileType.File:
                with system.open_input_stream(at) as stream:
                    return json.loads(stream.read())
            got = {"hash": row.hash, **_answer(model, row)}
            if got["error"] is None:
                folder, name = at.rsplit("/", 1)
                if folder not in made:
                    system.create_dir(folder, recursive=True)
                    made.add(folder)
                # Readers pass over names with a dot until the file is whole.
                part = f"{folder}/.{name}.{uuid.uuid4().hex}"
                with system.open_output_stream(part) as stream:
                    stream.write(json.dumps(got).encode())
                system.move(part, at)
            return got

        with ThreadPoolExecutor(overlap) as pool:
            for batch in batches:
                if len(batch):
                    yield pd.DataFrame(list(pool.map(ask, batch.itertuples(index=False))), columns=[c.split()[0] for c in LEDGER.split(", ")])

    asked = materialise(wanted.mapInPandas(run, LEDGER))
    out = materialise(named.drop("system", "prompt").join(known.unionByName(asked), "hash").drop("hash").select(
        *keys, "model", *[c.split()[0] for c in ANSWER.split(", ")]
    ))
    # This job's answers are in a table already; only files that a killed job left have to be listed and read.
    _move(asked.where("error IS NULL"), ledger)
    fold_ledger(spark, ledger)
    return out


def usage_calls(responses: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Responses as rows of the cost table."""
    return responses.select(*keys, F.lit(label).alias("label"), "model", "input_tokens", "output_tokens")
