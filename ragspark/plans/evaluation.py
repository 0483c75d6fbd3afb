"""Evaluation jobs: scores of drafted complaint responses and of question answering."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragspark import fixed, schemas
from ragspark.functions import prompts, responses
from ragspark.functions.numbers import model_id
from ragspark.operators import metrics, retrieval
from ragspark.operators.model_calls import ModelFn, call_model, usage_calls
from ragspark.session import materialise

RUN = ["scenario_id", "config_label"]
DRAFT = (
    "handler_answer string, customer_draft string, human_review_required boolean, human_review_reason string, "
    "insufficient_context boolean, "
    "cited_provisions array<struct<provision:string,provision_type:string,relevance:string,chunk_id:string>>"
)


@dataclass
class DraftingInputs:
    """Stored results of runs, one long table per kind."""

    scenarios: DataFrame          # scenario_id, response_stage, scenario_text, expected_*, required_response_elements
    runs: DataFrame               # RUN, latency_ms [, error]
    retrieved: DataFrame          # RUN, rank, chunk_id, section, content
    cited: DataFrame              # RUN, provision
    rubric: DataFrame             # key and definitions
    primary: DataFrame            # RUN, idx, element, status
    secondary: DataFrame          # same
    claims: DataFrame             # RUN, source_field, grounding
    calls: DataFrame              # RUN, label, model, input_tokens, output_tokens


def score_drafting(x: DraftingInputs) -> DataFrame:
    """One row of scalar metrics per (scenario, configuration).

    Also the offline re-scoring of stored records. All parts are aggregated on
    the run key, so the joins below reuse one partitioning.
    """
    per_run = x.runs.select(*RUN).join(x.scenarios, "scenario_id")
    expected = per_run.select(*RUN, F.explode("expected_provisions").alias("provision"))
    sections = per_run.select(*RUN, F.explode("expected_provision_sections").alias("section"))
    asked = per_run.select(*RUN, F.explode("required_response_elements").alias("element"))
    required = metrics.defined_elements(asked, x.rubric.select("key")).select(*RUN, "element")

    marks = metrics.marked(x.cited, RUN, metrics.CITED).unionByName(metrics.marked(expected, RUN, metrics.EXPECTED))
    provisions = metrics.provision_scores(marks.unionByName(metrics.marked_text(x.retrieved, RUN)), RUN)
    section = metrics.section_scores(x.retrieved, sections, RUN)
    coverage = metrics.rubric_scores(required, x.primary, RUN)
    agreement = metrics.rubric_agreement(required, x.primary, x.secondary, RUN)
    grounding = metrics.grounding_scores(x.claims, RUN, by_field=True)
    cost = metrics.run_costs(x.calls, RUN, [])
    n_required = per_run.select(*RUN, F.size("required_response_elements").cast("long").alias("n_required"))

    table = x.runs
    for part in (
        coverage.select(*RUN, "coverage", "present_count"), n_required,
        section.select(*RUN, F.col("precision").alias("section_precision"), F.col("recall").alias("section_recall")),
        provisions.select(
            *RUN, F.col("precision").alias("citation_precision"), "citation_recall", F.col("text_recall").alias("retrieved_provision_recall")
        ),
        grounding.select(*RUN, "grounded_pct", "grounded_pct_customer", "grounded_pct_handler", "ungrounded_pct"),
        agreement.select(*RUN, F.col("agreement").alias("inter_judge_agreement")), cost.select(*RUN, "total_cost"),
    ):
        table = table.join(part, RUN, "left")
    numbers = [f for f in schemas.SCENARIO_METRICS.fields if f.name not in RUN]
    gap = F.coalesce("retrieved_provision_recall", F.lit(0.0)) - F.coalesce("citation_recall", F.lit(0.0))
    filled = table.withColumn("drafting_gap", gap)
    error = [F.col("error")] if "error" in x.runs.columns else []
    return filled.select(*RUN, *[F.coalesce(F.col(f.name).cast(f.dataType), F.lit(0).cast(f.dataType)).alias(f.name) for f in numbers], *error)


@dataclass
class Judges:
    """Injected models; names are presets or ids."""

    draft: ModelFn
    judge: ModelFn
    draft_model: str = "sonnet"
    primary: str = "gpt-oss"
    secondary: str = "haiku"
    grounding: str = "gpt-oss"
    system: dict[str, str] = field(default_factory=dict)  # draft, rubric, grounding
    rubric_judges: int = 2  # 1: the primary one only, 0: none
    judge_grounding: bool = True


def run_drafting(
    scenarios: DataFrame, rubric: DataFrame, retrieved: DataFrame, models: Judges,
    configs: Sequence[str] | None = None, done: DataFrame | None = None, ledger: str | None = None,
) -> DraftingInputs:
    """Draft and judge every scenario under every configuration, also where nothing was retrieved.

    ``retrieved(RUN, rank, chunk_id, section, content, score)``. Without ``configs`` the
    configurations, a handful, are those found in ``retrieved``. Runs listed in ``done(RUN)`` are left out.
    ``ledger`` keeps the answers of all models, see :func:`call_model`.
    """
    if configs is None:
        configs = sorted(r[0] for r in retrieved.select("config_label").where("config_label IS NOT NULL").distinct().collect())
    labels = F.array(*[F.lit(c) for c in configs]).cast("array<string>")
    work = scenarios.select("scenario_id", F.explode(labels).alias("config_label"))
    if done is not None:
        work = work.join(done.select(*RUN), RUN, "left_anti")
        retrieved = retrieved.join(done.select(*RUN), RUN, "left_anti")

    def with_context(table, **options):
        blocks = retrieval.context_blocks(retrieved, RUN, **options)
        return table.join(blocks, RUN, "left").withColumn("context", F.coalesce("context", F.lit("")))

    def asked(table, model, system, prompt):
        return table.select(*RUN, model_id(F.lit(model)).alias("model"), F.lit(models.system.get(system, "")).alias("system"), prompt.alias("prompt"))

    tasks = with_context(work).join(scenarios, "scenario_id")
    drafted = call_model(asked(tasks, models.draft_model, "draft", prompts.drafting_message(F.col("context"), F.col("scenario_text"))), RUN, models.draft, ledger)
    parsed = drafted.withColumn("d", F.from_json("raw", DRAFT))
    runs = parsed.select(
        *RUN, "latency_ms",
        F.coalesce("error", F.when(F.col("d.handler_answer").isNull(), "response could not be read")).alias("error"), "d.*",
    )
    good = materialise(runs.where(F.col("error").isNull()))
    response = prompts.drafted_response(F.col("handler_answer"), F.col("customer_draft"))

    wanted = good.select(*RUN).join(scenarios, "scenario_id").select(*RUN, F.posexplode("required_response_elements").alias("_i", "element"))
    blocks = metrics.defined_elements(wanted, rubric).groupBy(*RUN).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_i", prompts.rubric_block().alias("_b")))), lambda b: b["_b"]), "\n\n").alias("elements")
    )
    rubric_tasks = good.join(scenarios.select("scenario_id", "scenario_text", "response_stage"), "scenario_id").join(blocks, RUN)
    message = prompts.rubric_message(F.col("scenario_text"), F.col("response_stage"), response, F.col("elements"))
    # A judge that is switched off gets no rows, so its tables are empty.
    first, second = (
        call_model(asked(rubric_tasks.where(F.lit(models.rubric_judges > i)), name, "rubric", message), RUN, models.judge, ledger)
        for i, name in enumerate((models.primary, models.secondary))
    )
    plain = with_context(good, with_score=False).where(F.lit(models.judge_grounding))
    grounding = call_model(
        asked(plain, models.grounding, "grounding", prompts.grounding_message(F.col("handler_answer"), F.col("customer_draft"), F.col("context"))), RUN, models.judge, ledger
    )

    def verdicts(table):
        # The outer forms keep the optimiser from parsing each response twice.
        rows = table.select(*RUN, F.posexplode_outer(responses.verdicts(F.col("raw"))).alias("idx", "v")).where(F.col("v").isNotNull())
        return rows.select(*RUN, "idx", "v.element", "v.status")

    graded = grounding.select(*RUN, F.explode_outer(responses.claims(F.col("raw"))).alias("c")).where(F.col("c").isNotNull())
    calls = usage_calls(drafted, RUN, "generation")
    for label, table in (("rubric_primary", first), ("rubric_secondary", second), ("grounding", grounding)):
        calls = calls.unionByName(usage_calls(table, RUN, label))
    return DraftingInputs(
        scenarios=scenarios, runs=runs.select(*RUN, "latency_ms", "error"), retrieved=retrieved,
        cited=good.select(*RUN, F.explode("cited_provisions").alias("c")).select(*RUN, "c.provision"), rubric=rubric,
        primary=verdicts(first), secondary=verdicts(second),
        claims=graded.select(*RUN, "c.source_field", "c.grounding"),
        calls=calls,
    )


#: Lists of a detail record and their fields; a record holds what belongs to one run, so its lists stay short.
DETAIL = {
    "retrieved": "rank int, chunk_id string, section string, content string",
    "cited": "provision string",
    "primary": "idx int, element string, status string",
    "secondary": "idx int, element string, status string",
    "claims": "source_field string, grounding string",
    "calls": "label string, model string, input_tokens bigint, output_tokens bigint",
}


def detail_records(x: DraftingInputs) -> DataFrame:
    """One nested record per run with all that its scores are made of: RUN, latency_ms, error and the lists of ``DETAIL``.

    Equal rows stay as often as they occur; a list without rows is empty. Written once (``records.write_run``), it is all that
    re-scoring needs beside the scenarios and the rubric.
    """
    error = F.col("error") if "error" in x.runs.columns else F.lit(None).cast("string")
    table = x.runs.select(*RUN, F.col("latency_ms").cast("double").alias("latency_ms"), error.alias("error"))
    for name, ddl in DETAIL.items():
        fields = [f.split() for f in ddl.split(", ")]
        item = F.struct(*[F.col(f).cast(kind).alias(f) for f, kind in fields])
        table = table.join(getattr(x, name).groupBy(*RUN).agg(F.array_sort(F.collect_list(item)).alias(name)), RUN, "left")
    empty = {name: f"array<struct<{', '.join(f.replace(' ', ':') for f in ddl.split(', '))}>>" for name, ddl in DETAIL.items()}
    return table.withColumns({name: F.coalesce(name, F.array().cast(kind)) for name, kind in empty.items()})


def from_detail(detail: DataFrame, scenarios: DataFrame, rubric: DataFrame) -> DraftingInputs:
    """Inputs of :func:`score_drafting` from stored records. Each table reads its own column only."""
    lists = {name: detail.select(*RUN, F.inline(name)) for name in DETAIL}
    return DraftingInputs(scenarios=scenarios, runs=detail.select(*RUN, "latency_ms", "error"), rubric=rubric, **lists)


QA_RUN = ["question_id", "config_label"]


ANSWER = "struct<answer:string,citations:array<string>,confidence:string,insufficient_context:boolean>"


@dataclass
class QuestionModels:
    """Injected models of the question run; names are presets or ids."""

    answer: ModelFn
    judge: ModelFn
    answer_model: str = "sonnet"
    primary: str = "opus"
    secondary: str = "gpt-oss"
    system: dict[str, str] = field(default_factory=dict)  # answer, claims
    judges: int = 2  # 1: the primary one only, 0: none


@dataclass
class QuestionRuns:
    """Stored results of question runs; all but ``answers`` are inputs of :func:`score_questions`."""

    runs: DataFrame       # QA_RUN, latency_ms, error
    answers: DataFrame    # QA_RUN, answer, confidence, insufficient_context
    citations: DataFrame  # QA_RUN, chunk_id
    primary: DataFrame    # QA_RUN, idx, grounding
    secondary: DataFrame  # same
    calls: DataFrame      # QA_RUN, label, model, input_tokens, output_tokens


def run_questions(
    questions: DataFrame, retrieved: DataFrame, models: QuestionModels, configs: Sequence[str],
    done: DataFrame | None = None, ledger: str | None = None,
) -> QuestionRuns:
    """Answer and judge ``questions(question_id, question)`` under every configuration, also where nothing was retrieved.

    ``retrieved(QA_RUN, rank, chunk_id, section, content, score)``. Runs in ``done(QA_RUN)`` are left out. A failed or unreadable
    answer is a run with an error, which no judge sees. ``ledger`` keeps the answers of all models.
    """
    labels = F.array(*[F.lit(c) for c in configs]).cast("array<string>")
    work = questions.select("question_id", "question", F.explode(labels).alias("config_label"))
    if done is not None:
        work = work.join(done.select(*QA_RUN), QA_RUN, "left_anti")
        retrieved = retrieved.join(done.select(*QA_RUN), QA_RUN, "left_anti")

    def asked(table, model, system, prompt):
        return table.select(*QA_RUN, model_id(F.lit(model)).alias("model"), F.lit(models.system.get(system, "")).alias("system"), prompt.alias("prompt"))

    blocks = materialise(retrieval.context_blocks(retrieved, QA_RUN))
    tasks = work.join(blocks, QA_RUN, "left").withColumn("context", F.coalesce("context", F.lit("")))
    answered = call_model(asked(tasks, models.answer_model, "answer", prompts.question_message(F.col("context"), F.col("question"))), QA_RUN, models.answer, ledger)
    read = F.try_variant_get(responses.json_document(F.col("raw")), "$", ANSWER)
    parsed = materialise(answered.withColumn("a", read).select(
        *QA_RUN, "latency_ms", F.coalesce("error", F.when(F.col("a.answer").isNull(), "response could not be read")).alias("error"), "a.*"
    ))
    good = parsed.where(F.col("error").isNull())
    plain = tasks.join(good.select(*QA_RUN, "answer"), QA_RUN)
    message = prompts.claims_message(F.col("question"), F.col("answer"), F.col("context"))
    # A judge that is switched off gets no rows, so its tables are empty.
    graded = [
        call_model(asked(plain.where(F.lit(models.judges > i)), name, "claims", message), QA_RUN, models.judge, ledger)
        for i, name in enumerate((models.primary, models.secondary))
    ]

    def claims(table):
        rows = table.select(*QA_RUN, F.posexplode_outer(responses.claims(F.col("raw"))).alias("idx", "c")).where(F.col("c").isNotNull())
        return rows.select(*QA_RUN, "idx", "c.grounding")

    calls = usage_calls(answered, QA_RUN, "generation")
    for label, table in zip(("judge_primary", "judge_secondary"), graded):
        calls = calls.unionByName(usage_calls(table, QA_RUN, label))
    return QuestionRuns(
        runs=parsed.select(*QA_RUN, "latency_ms", "error"), answers=good.select(*QA_RUN, "answer", "confidence", "insufficient_context"),
        citations=good.select(*QA_RUN, F.explode("citations").alias("chunk_id")),
        primary=claims(graded[0]), secondary=claims(graded[1]), calls=calls,
    )


def score_questions(
    questions: DataFrame, runs: DataFrame, retrieved: DataFrame, citations: DataFrame,
    primary: DataFrame, secondary: DataFrame, calls: DataFrame,
) -> DataFrame:
    """Question-answering metrics per (question, configuration).

    ``runs(QA_RUN, latency_ms [, error])``, ``retrieved(QA_RUN, chunk_id, section,
    document_title, source)``, ``citations(QA_RUN, chunk_id)``, judge claims
    ``(QA_RUN, idx, grounding)`` and ``calls`` as in the cost table.
    """
    marked = retrieved.join(questions.select("question_id", "source_sections"), "question_id").withColumn(
        "is_relevant",
        metrics.chunk_is_relevant(*[F.col(c) for c in ("source_sections", "chunk_id", "section", "document_title", "source")]),
    )
    parts = [
        metrics.hit_scores(marked, QA_RUN), metrics.answer_citation_scores(citations, marked, QA_RUN),
        metrics.grounding_scores(primary, QA_RUN),
        metrics.claim_agreement(primary, secondary, QA_RUN).withColumnRenamed("agreement", "inter_judge_agreement"),
        metrics.run_costs(calls, QA_RUN, ["generation", "judge_primary", "judge_secondary"]),
    ]
    table = runs
    for part in parts:
        table = table.join(part, QA_RUN, "left")
    return table.na.fill(0, [c for c in table.columns if c not in [*runs.columns]])


def retrieve_arms(queries: DataFrame, chunks: DataFrame, k: int = fixed.TOP_K) -> DataFrame:
    """Top-k per arm: ``chunks(arm, chunk_id, embedding)`` holds every arm; the configurations are few."""
    found = []
    for chunking, embedding in fixed.DRAFTING_CONFIGS:
        side = chunks.where(F.col("arm") == chunking)
        found.append(retrieval.top_k(queries, side, k).withColumn("config_label", F.lit(f"{chunking}-{embedding}")))
    every = found[0]
    for part in found[1:]:
        every = every.unionByName(part)
    return every
