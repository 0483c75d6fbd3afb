"""Curation jobs: question candidates of three families, and complaint scenarios."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ragspark import fixed
from ragspark.functions import responses
from ragspark.functions.numbers import model_id
from ragspark.functions.text import policy_source_ref, truncate
from ragspark.operators import curation, references
from ragspark.operators.model_calls import ModelFn, call_model
from ragspark.operators.ranking import number_rows
from ragspark.session import materialise


def question_plan(
    index: DataFrame, texts: DataFrame, policies: DataFrame, *, singles: int, pairs: int, policy_questions: int | None,
) -> DataFrame:
    """Work list of question candidates: ``type, position, sections, policy, material``.

    ``texts(section_id, text)``, ``policies(policy, content)``. Single and policy
    questions need sections with enough text; long texts are cut with a marker.
    Without ``policy_questions`` all policy candidates stay, so that ``generate_questions`` can make up for failures.
    """
    hits = materialise(references.policy_sections(policies, index))
    pool = materialise(references.section_pool(index, hits))
    eligible = pool.join(texts, "section_id")
    single = (
        pool.orderBy("section_id").limit(singles).join(texts, "section_id")
        .where(F.length("text") >= fixed.MIN_SUBSTANCE_CHARS)
        .select(F.lit("single-module").alias("type"), F.array("section_id").alias("sections"), F.lit(None).cast("string").alias("policy"),
                F.col("text").alias("material"), F.col("section_id").alias("sort_key"))
    )
    chosen = references.cross_module_pairs(pool, pairs)
    cut = truncate(F.col("text"), fixed.SECTION_PROMPT_CHARS)
    def side(letter):
        return texts.select(F.col("section_id").alias(f"section_{letter}"), cut.alias(f"text_{letter}"))
    cross = chosen.join(side("a"), "section_a").join(side("b"), "section_b").select(
        F.lit("cross-module").alias("type"), F.array("section_a", "section_b").alias("sections"), F.lit(None).cast("string").alias("policy"),
        F.concat_ws("\n\n---\n\n", "text_a", "text_b").alias("material"), F.lpad(F.col("position").cast("string"), 9, "0").alias("sort_key"),
    )
    order = Window.partitionBy("policy").orderBy("ref_ord", "section_id")
    two = (
        hits.join(eligible.select("section_id"), "section_id", "left_semi")
        .withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= 2)
    )
    body = policies.select("policy", truncate(F.col("content"), fixed.POLICY_PROMPT_CHARS, fixed.POLICY_TRUNCATION_MARK).alias("policy_text"))
    enough = two.join(texts, "section_id").where(F.length("text") >= fixed.MIN_SUBSTANCE_CHARS)
    if policy_questions is not None:
        enough = enough.orderBy("policy", "_r").limit(policy_questions)
    policy = (
        enough.join(body, "policy")
        .select(F.lit("policy-regulation").alias("type"),
                F.array("section_id", policy_source_ref(F.col("policy"))).alias("sections"), "policy",
                F.concat_ws("\n\n---\n\n", "policy_text", "text").alias("material"),
                F.concat_ws("|", "policy", F.col("_r").cast("string")).alias("sort_key"))
    )
    every = single.unionByName(cross).unionByName(policy)
    family = F.when(F.col("type") == "single-module", 0).when(F.col("type") == "cross-module", 1).otherwise(2)
    # All policies may take part, so the plan is numbered by ranges.
    return number_rows(every, [], [family, F.col("sort_key")], "position").drop("sort_key")


def curate_questions(candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Gated candidates ``(ord, question, …, critic)`` and the renumbered curated set."""
    gated = curation.gate_questions(candidates)
    curated = curation.renumber(gated.where("gate = 'pass'"), "q", "question_id")
    return gated, curated.drop("critic", "gate", "critic_verdict")


def curate_scenarios(records: DataFrame, skip_validation: bool = False) -> tuple[DataFrame, DataFrame]:
    """All records, last per seed with a verdict, and the renumbered curated set."""
    judged = curation.gate_scenarios(curation.scenario_defaults(curation.last_per_seed(records)), skip_validation)
    curated = curation.renumber(judged.where("verdict = 'pass'"), "c", "scenario_id")
    return judged, curated.withColumn("synthetic", F.lit(True)).drop("critic", "verdict")


# --- model steps ------------------------------------------------------------------------

QUESTION = "struct<question:string,answer:string,source_sections:array<string>,difficulty:string,type:string>"
QUESTION_CRITIC = (
    "struct<verdict:string,correctness:string,source_completeness:string,difficulty_reasonable:boolean,suggested_difficulty:string>"
)
SCENARIO = (
    "struct<scenario_text:string,expected_provisions:array<string>,response_stage:string,redress_warranted:boolean,"
    "timing_in_issue:boolean,vulnerability_present:boolean,difficulty:string>"
)
SCENARIO_CRITIC = "struct<realism:string,provisions_correct:string>"


def _ask(rows: DataFrame, key: str, model: str, system: str, prompt, fn: ModelFn, answer: str, ledger: str | None = None) -> DataFrame:
    """Rows that got a readable JSON object, as ``key, a``."""
    asked = rows.select(key, model_id(F.lit(model)).alias("model"), F.lit(system).alias("system"), prompt.alias("prompt"))
    read = F.try_variant_get(responses.json_document(F.col("raw")), "$", answer)
    return call_model(asked, [key], fn, ledger).select(key, read.alias("a"))


def generate_questions(
    plan: DataFrame, fn: ModelFn, model: str = "opus", system: str = "", targets: dict[str, int] | None = None, ledger: str | None = None,
) -> DataFrame:
    """Question candidates of a plan; an unreadable response gives none.

    A type in ``targets`` is asked in plan order until that many of its rows gave a question, or none is left: each
    round asks as many rows as are still wanting. Types without a target are asked once a row. ``ledger`` as for the model calls.
    """
    targets = targets or {}
    prompt = F.concat(F.lit("Question type: "), F.col("type"), F.lit("\nSections: "), F.array_join("sections", ", "), F.lit("\n\n"), F.col("material"))
    every = plan.where(~F.col("type").isin(list(targets)) | F.col("type").isNull()) if targets else plan
    got = _ask(every, "position", model, system, prompt, fn, QUESTION, ledger).where(F.col("a.question").isNotNull())
    for kind, target in targets.items():
        rest, found = materialise(plan.where(F.col("type") == kind)), 0
        while found < target:
            # As many rows as still want a question; the driver sees their number and the last position, never the rows.
            batch = materialise(rest.orderBy("position").limit(target - found))
            last = batch.agg(F.max("position")).first()[0]
            if last is None:
                break
            read = _ask(batch, "position", model, system, prompt, fn, QUESTION, ledger).where(F.col("a.question").isNotNull())
            found += read.count()
            got, rest = got.unionByName(read), rest.where(F.col("position") > last)
    return got.join(plan.select("position", F.col("type").alias("_t"), "sections"), "position").select(
        F.col("position").alias("ord"), "a.question", "a.answer", F.coalesce("a.source_sections", "sections").alias("source_sections"),
        F.coalesce("a.difficulty", F.lit("medium")).alias("difficulty"), F.coalesce("a.type", "_t").alias("type"),
    )


def criticise_questions(candidates: DataFrame, texts: DataFrame, fn: ModelFn, model: str = "gpt-oss", system: str = "", ledger: str | None = None) -> DataFrame:
    """Candidates with ``critic``; null where the critic gave nothing readable."""
    sources = curation.source_blocks(candidates, "ord", "source_sections", texts)
    prompt = F.concat(
        F.lit("Question: "), F.col("question"), F.lit("\nAnswer: "), F.col("answer"), F.lit("\nDifficulty: "), F.col("difficulty"),
        F.lit("\nType: "), F.col("type"), F.lit("\n\nSource material:\n\n"), F.coalesce("source_material", F.lit("")),
    )
    got = _ask(candidates.join(sources, "ord", "left"), "ord", model, system, prompt, fn, QUESTION_CRITIC, ledger)
    return candidates.join(got.select("ord", F.col("a").alias("critic")), "ord", "left")


def generate_scenarios(seeds: DataFrame, index: DataFrame, texts: DataFrame, fn: ModelFn, model: str = "opus", system: str = "", ledger: str | None = None) -> DataFrame:
    """Scenario candidates ``ord, seed_id, …`` for seeds not generated before."""
    named = texts.join(index.select("section_id", "section_name"), "section_id")
    title = F.concat(F.lit("### "), F.col("section_id"), F.lit(" — "), F.coalesce("section_name", F.lit("")))
    material = curation.source_blocks(
        seeds, "seed_id", "seed_sections", named, limit=fixed.SECTION_PROMPT_CHARS, missing=fixed.SEED_TEXT_MISSING, heading=title
    )
    prompt = F.concat(F.lit("Scenario type: "), F.col("complaint_type"), F.lit("\n\nSeed material:\n\n"), F.col("source_material"))
    tasks = seeds.join(material, "seed_id")
    got = _ask(tasks, "seed_id", model, system, prompt, fn, SCENARIO, ledger).where(F.col("a.scenario_text").isNotNull())
    return materialise(got.join(seeds, "seed_id").select(
        F.col("plan_ord").alias("ord"), "seed_id", "complaint_type", "a.*", F.col("seed_sections").alias("expected_provision_sections")
    ))


def criticise_scenarios(candidates: DataFrame, texts: DataFrame, fn: ModelFn, model: str = "gpt-oss", system: str = "", ledger: str | None = None) -> DataFrame:
    material = curation.source_blocks(
        candidates, "seed_id", "expected_provision_sections", texts, limit=fixed.SECTION_PROMPT_CHARS, missing=fixed.SEED_TEXT_MISSING
    )
    prompt = F.concat(
        F.lit("Scenario type: "), F.col("complaint_type"), F.lit("\n\nComplaint: "), F.col("scenario_text"), F.lit("\n\nexpected_provisions: "),
        F.array_join(F.coalesce("expected_provisions", F.array().cast("array<string>")), ", "), F.lit("\n\nSeed material:\n\n"),
        F.coalesce("source_material", F.lit("")),
    )
    got = _ask(candidates.join(material, "seed_id", "left"), "seed_id", model, system, prompt, fn, SCENARIO_CRITIC, ledger)
    return candidates.join(got.select("seed_id", F.col("a").alias("critic")), "seed_id", "left")
