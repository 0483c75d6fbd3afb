"""Run records and model calls on ``lineitem``, ``orders`` and ``documents``."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ragspark.operators.model_calls import call_model, read_ledger
from ragspark.plans import evaluation
from ragspark.queries.references import SETS_SQL, _line_sets
from ragspark.queries.registry import query
from ragspark.session import shared_folder
from ragspark.sources import records


def _folder(t, name: str) -> str:
    return f"{shared_folder(t.spark).rstrip('/')}/ragspark/{name}-{uuid.uuid4().hex}"


@query("offline_rescoring", f"""
WITH {SETS_SQL},
n AS (SELECT run_id, count_if(c)::BIGINT AS nc, count_if(e)::BIGINT AS ne, count_if(c AND e)::BIGINT AS nm FROM items GROUP BY run_id),
g AS (SELECT l_orderkey AS run_id, count(*) AS claims, count_if(l_linenumber % 3 = 1) AS good,
             count_if(l_linenumber % 3 = 2) AS bad FROM lineitem GROUP BY l_orderkey)
SELECT cast(o_orderkey AS VARCHAR) AS scenario_id, o_orderpriority AS config_label, o_totalprice AS latency_ms,
       round(coalesce(nm / nullif(nc, 0), 0.0), 6) AS citation_precision, round(coalesce(nm / nullif(ne, 0), 0.0), 6) AS citation_recall,
       round(0.0 - coalesce(nm / nullif(ne, 0), 0.0), 6) AS drafting_gap,
       round(coalesce(good / claims, 0.0), 6) AS grounded_pct, round(coalesce(bad / claims, 0.0), 6) AS ungrounded_pct
FROM orders LEFT JOIN n ON n.run_id = o_orderkey LEFT JOIN g ON g.run_id = o_orderkey""")
def offline_rescoring(t):
    """Orders as runs: their records are written once, read back by column and scored."""
    run = [F.col("o_orderkey").cast("string").alias("scenario_id"), F.col("o_orderpriority").alias("config_label")]
    orders = t.orders.select("o_orderkey", *run, F.col("o_totalprice").alias("latency_ms"))
    _, cited, expected = _line_sets(t)
    wanted = expected.groupBy("run_id").agg(F.collect_list("provision").alias("expected_provisions"))
    none = F.array().cast("array<string>")
    scenarios = orders.join(wanted, F.col("o_orderkey") == F.col("run_id"), "left").select(
        "scenario_id", F.coalesce("expected_provisions", none).alias("expected_provisions"),
        none.alias("expected_provision_sections"), none.alias("required_response_elements"),
    )
    def of_run(table, key):
        return table.join(orders.select("o_orderkey", "scenario_id", "config_label"), F.col(key) == F.col("o_orderkey"))
    kind = F.col("l_linenumber") % 3
    grounding = F.when(kind == 1, "GROUNDED").when(kind == 2, "UNGROUNDED").otherwise("PARTIALLY_GROUNDED")
    claims = of_run(t.lineitem.select("l_orderkey", grounding.alias("grounding")), "l_orderkey").select(
        *evaluation.RUN, F.lit("customer_draft").alias("source_field"), "grounding"
    )
    def empty(ddl):
        return t.spark.createDataFrame([], f"scenario_id string, config_label string, {ddl}")
    verdicts = empty(evaluation.DETAIL["primary"])
    inputs = evaluation.DraftingInputs(
        scenarios=scenarios, rubric=t.spark.createDataFrame([], "key string"), runs=orders.select(*evaluation.RUN, "latency_ms"),
        retrieved=empty(evaluation.DETAIL["retrieved"]), cited=of_run(cited, "run_id").select(*evaluation.RUN, "provision"),
        primary=verdicts, secondary=verdicts, claims=claims, calls=empty(evaluation.DETAIL["calls"]),
    )
    path = _folder(t, "detail")
    records.write_run(evaluation.detail_records(inputs), path, "20260101_000000")
    stored = evaluation.from_detail(records.read_latest(t.spark, path), scenarios, inputs.rubric)
    scores = evaluation.score_drafting(stored)
    numbers = ("citation_precision", "citation_recall", "drafting_gap", "grounded_pct", "ungrounded_pct")
    return scores.select(*evaluation.RUN, "latency_ms", *[F.round(c, 6).alias(c) for c in numbers])


def canned(model: str, system: str, prompt: str) -> dict:
    """A model that tells the length of its prompt, and is down for prompts of a length divisible by eleven in its first trial."""
    if system == "first" and len(prompt) % 11 == 0:
        raise RuntimeError("down")
    return {"text": str(len(prompt)), "input_tokens": len(prompt), "output_tokens": 1, "total_tokens": len(prompt) + 1}


@query("model_call_ledger", """
SELECT source, count(*) AS n, sum(length(coalesce(text, '')))::BIGINT AS chars, count_if(length(coalesce(text, '')) % 11 = 0)::BIGINT AS n_down
FROM documents GROUP BY source
UNION ALL SELECT '(ledger)', count(*), sum(length(x))::BIGINT, 0 FROM (SELECT DISTINCT coalesce(text, '') AS x FROM documents)""")
def model_call_ledger(t):
    """Every text as a prompt, by source; the second job is answered by the ledger of the first, which has each distinct text once."""
    ledger = _folder(t, "ledger")
    prompts = t.spread("documents").select("doc_id", "source", F.lit("m").alias("model"), F.lit("s").alias("system"), F.coalesce("text", F.lit("")).alias("prompt"))
    plain = call_model(prompts.withColumn("system", F.lit("first")), ["doc_id"], canned)
    down = plain.where("error IS NOT NULL").select("doc_id").withColumn("down", F.lit(1))
    call_model(prompts, ["doc_id"], canned, ledger)
    again = call_model(prompts, ["doc_id", "source"], canned, ledger)
    by_source = again.join(down, "doc_id", "left").groupBy("source").agg(
        F.count("*").alias("n"), F.sum(F.col("raw").cast("long")).alias("chars"), F.count_if(F.col("down") == 1).alias("n_down")
    )
    kept = read_ledger(t.spark, ledger).agg(F.count("*").alias("n"), F.sum(F.col("raw").cast("long")).alias("chars"))
    return by_source.unionByName(kept.select(F.lit("(ledger)").alias("source"), "n", "chars", F.lit(0).cast("long").alias("n_down")))
