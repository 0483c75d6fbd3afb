import json

import pytest
from pyspark.sql import functions as F

from ragspark.functions.packing import count_words
from ragspark.operators import metrics, model_calls
from ragspark.plans import conversation, corpus_build, evaluation
from ragspark.sources import records

PROVISIONS = [
    ("DISP 1.2.1R", "disp", "disp1", "disp1s2", "Awareness", "Rules", "A firm&nbsp;must  publish.", 0),
    ("DISP 1.2.2", "disp", "disp1", "disp1s2", "Awareness", "", "", 1),
    ("DISP 1.2.3G", "disp", "disp1", "disp1s2", "Awareness", "Guidance", "word " * 600, 2),
    ("DISP 1.3.1R", "disp", "disp1", "disp1s3", "", "Rules", "", 3),
]
DDL = "provision_id string, module string, chapter string, section string, section_name string, provision_type string, text string, ord int"


def test_regulation_corpus(spark):
    built = corpus_build.build_regulation(spark.createDataFrame(PROVISIONS, DDL))
    table = {r.section: r for r in built.sections.collect()}
    assert table["disp1s2"].provision_count == 3 and table["disp1s3"].heading == "# DISP — DISP 1.3" and table["disp1s2"].synthetic is False
    docs = {r.section: r.text for r in built.documents.collect()}
    long = ("word " * 600).strip()
    assert docs["disp1s2"] == f"# DISP — Awareness\n\n## DISP 1.2.1R (Rules)\n\nA firm must publish.\n\n## DISP 1.2.3G (Guidance)\n\n{long}\n"
    assert docs["disp1s3"] == "# DISP — DISP 1.3\n"
    chunks = built.chunks.orderBy("chunk_id").collect()
    # The oversize unit gives its heading, one token window cut at the character cap, and the rest.
    assert [c.chunk_id for c in chunks] == [f"disp1s2-{i:03d}" for i in range(5)]
    assert chunks[0].labels == ["DISP 1.2.1R"] and all(c.labels == ["DISP 1.2.3G"] for c in chunks[1:]) and chunks[0].provision_count == 1
    assert chunks[1].content == "# DISP — Awareness\n\n## DISP 1.2.3G (Guidance)"
    assert all(c.content.startswith("# DISP — Awareness\n\n") and count_words(c.content) <= 480 and len(c.content) <= 2000 for c in chunks)
    fixed = corpus_build.fixed_arm(built.documents, built.sections).orderBy("chunk_id").collect()
    assert {f.source_id for f in fixed} == {"disp1s2.md", "disp1s3.md"} and len(fixed) == 3


def test_policy_corpus(spark):
    content = "# Complaints Policy\nintro\n## 1. Scope\nSee DISP 1.2 and SYSC 3\n## 2. More\n" + "text here. " * 400
    got = corpus_build.build_policies(spark.createDataFrame([("complaints-policy", content)], "slug string, content string"), "m", "2026").orderBy("chunk_index").collect()
    assert got[0].document_title == "Complaints Policy" and got[0].fca_modules_count == 2 and got[0].word_count == len(content.split())
    assert got[0].section_heading == "preamble" and got[-1].section_heading == "## 2. More" and got[0].synthetic is True
    assert [g.chunk_id for g in got] == [f"complaints-policy-{i:03d}" for i in range(len(got))]


RUBRIC = [(k, f"l-{k}", "customer", "def", "p", "pa", "m", None if k == "a" else "never", "b") for k in "abc"]
RUBRIC_DDL = "key string, label string, audience string, definition string, present_if string, partial_if string, missing_if string, not_satisfied_by string, regulatory_basis string"


def draft_model(model, system, prompt):
    if "second complaint" in prompt:
        raise RuntimeError("service down")
    draft = {"handler_answer": "h", "customer_draft": "c", "human_review_required": False, "human_review_reason": "", "insufficient_context": False,
             "cited_provisions": [{"provision": "DISP 1.2.1", "provision_type": "Rule", "relevance": "r", "chunk_id": "x"}]}
    return {"text": json.dumps(draft), "input_tokens": 1000, "output_tokens": 1000, "total_tokens": 2000}


def judge_model(model, system, prompt):
    if "REQUIRED ELEMENTS" in prompt:
        assert "### a (audience: customer)" in prompt and "Not satisfied by: never" in prompt
        status = "PRESENT" if "haiku" in model else "PARTIAL"
        text = "```json\n" + json.dumps([{"element": "a", "status": "PRESENT"}, {"element": "b", "status": status}]) + "\n```"
    else:
        text = json.dumps([{"claim": "x", "source_field": "customer_draft", "grounding": "grounded"}, {"claim": "y", "source_field": "handler_answer", "grounding": "?"}])
    return {"text": text, "input_tokens": 0, "output_tokens": 0}


@pytest.fixture
def drafting(spark):
    scenarios = spark.createDataFrame(
        [("c001", "final", "first complaint", ["DISP 1.2.1R", "DISP 1.3.1R"], ["disp1s2", "disp1s3"], ["a", "b", "nope"]),
         ("c002", "final", "second complaint", ["DISP 1.2.1R"], ["disp1s2"], ["a"])],
        "scenario_id string, response_stage string, scenario_text string, expected_provisions array<string>, expected_provision_sections array<string>, required_response_elements array<string>")
    retrieved = spark.createDataFrame(
        [(s, "structure-titan", 1, "x", "disp1s2", "## DISP 1.2.1R (Rules)\n\ntext", 0.9) for s in ("c001", "c002")]
        + [("c001", "structure-titan", 2, "y", "other", "see DISP 1.3.1R", 0.8)],
        "scenario_id string, config_label string, rank int, chunk_id string, section string, content string, score double")
    rubric = spark.createDataFrame(RUBRIC, RUBRIC_DDL)
    return evaluation.run_drafting(scenarios, rubric, retrieved, evaluation.Judges(draft_model, judge_model))


def test_drafting_evaluation(drafting, spark, tmp_path):
    table = evaluation.score_drafting(drafting)
    got = {r.scenario_id: r for r in table.collect()}
    r = got["c001"]
    assert r.error is None and "service down" in got["c002"].error
    assert (r.coverage, r.present_count, r.n_required) == (0.75, 1, 3)
    assert (r.section_precision, r.section_recall, r.citation_precision, r.citation_recall) == (0.5, 0.5, 1.0, 0.5)
    assert (r.retrieved_provision_recall, r.drafting_gap) == (0.5, 0.0)
    assert (r.grounded_pct, r.grounded_pct_customer, r.grounded_pct_handler, r.ungrounded_pct) == (0.5, 1.0, 0.0, 0.5)
    assert r.inter_judge_agreement == 0.5 and r.total_cost == pytest.approx(0.018)
    aggregate = metrics.drafting_aggregate(table).first()
    assert aggregate.n_scenarios == 1 and aggregate.coverage_mean == 0.75
    # Stored metrics give the same aggregate when read back.
    records.write_run(table, str(tmp_path / "m"), "20260101_000000")
    again = metrics.drafting_aggregate(records.read_latest(spark, str(tmp_path / "m"))).first()
    assert again.coverage_mean == aggregate.coverage_mean and again.latency_p50_ms == aggregate.latency_p50_ms


def test_drafting_without_chunks_with_switches_and_resume(drafting, spark):
    retrieved = drafting.retrieved.where("scenario_id = 'c001'")
    bare = drafting.scenarios.withColumn("scenario_text", F.lit("first complaint")).withColumn(
        "required_response_elements", F.array(F.lit("a"), F.lit("b"))
    )
    models = evaluation.Judges(draft_model, judge_model, rubric_judges=1, judge_grounding=False)
    done = spark.createDataFrame([("c001", "structure-titan")], "scenario_id string, config_label string")
    got = evaluation.run_drafting(bare, drafting.rubric, retrieved, models, done=done)
    # The scenario without a chunk is drafted and scored; the finished one is not run again.
    assert [(r.scenario_id, r.error) for r in got.runs.collect()] == [("c002", None)]
    assert got.primary.count() == 2 and got.secondary.isEmpty() and got.claims.isEmpty()
    assert {r.label for r in got.calls.collect()} == {"generation", "rubric_primary"}
    r = evaluation.score_drafting(got).first()
    assert (r.scenario_id, r.coverage, r.section_precision, r.citation_precision) == ("c002", 0.75, 0.0, 1.0)


def test_model_failure_is_a_record(spark):
    prompts = spark.createDataFrame([(1, "m", "", "second complaint"), (2, "m", "", "ok")], "k int, model string, system string, prompt string")
    got = {r.k: r for r in model_calls.call_model(prompts, ["k"], draft_model).collect()}
    assert got[1].raw == "" and got[1].error == "service down" and got[1].input_tokens == 0
    assert got[2].error is None and got[2].total_tokens == 2000


def test_question_evaluation(spark):
    run = "question_id string, config_label string"
    questions = spark.createDataFrame([("q1", ["disp1s2"])], "question_id string, source_sections array<string>")
    runs = spark.createDataFrame([("q1", "fixed-titan", 5.0), ("q1", "structure-titan", 7.0)], f"{run}, latency_ms double")
    retrieved = spark.createDataFrame([("q1", "fixed-titan", "a", "disp1s2", None, None), ("q1", "fixed-titan", "b", "x", None, None)],
                                      f"{run}, chunk_id string, section string, document_title string, source string")
    citations = spark.createDataFrame([("q1", "fixed-titan", "a"), ("q1", "fixed-titan", "zz")], f"{run}, chunk_id string")
    primary = spark.createDataFrame([("q1", "fixed-titan", 0, "GROUNDED"), ("q1", "fixed-titan", 1, "UNGROUNDED")], f"{run}, idx int, grounding string")
    secondary = primary.where("idx = 0")
    calls = spark.createDataFrame([("q1", "fixed-titan", "generation", "sonnet", 1000, 0)], f"{run}, label string, model string, input_tokens int, output_tokens int")
    table = evaluation.score_questions(questions, runs, retrieved, citations, primary, secondary, calls)
    got = {r.config_label: r for r in table.collect()}
    r = got["fixed-titan"]
    assert (r.precision_at_k, r.recall_at_k, r.citation_precision, r.citation_recall, r.grounded_pct) == (0.5, 1.0, 0.5, 1.0, 0.5)
    assert (r.inter_judge_agreement, r.total_cost) == (1.0, pytest.approx(0.003))
    assert got["structure-titan"].precision_at_k == 0.0 and got["structure-titan"].total_cost == 0.0
    assert {r.config_label: r.median_ms for r in metrics.qa_aggregate(table).collect()} == {"fixed-titan": 5.0, "structure-titan": 7.0}


def test_retrieve_arms(spark):
    queries = spark.createDataFrame([("c1", [1.0, 0.0])], "query_id string, embedding array<float>")
    chunks = spark.createDataFrame([("fixed", "a", [1.0, 0.0]), ("fixed", "b", [0.0, 1.0]), ("structure", "c", [1.0, 1.0])], "arm string, chunk_id string, embedding array<float>")
    got = sorted((r.config_label, r.chunk_id, r.rank) for r in evaluation.retrieve_arms(queries, chunks).collect())
    assert got == [("fixed-titan", "a", 1), ("fixed-titan", "b", 2), ("structure-titan", "c", 1)]


def conversation_turns(spark):
    def turn(s, t, *texts):
        return (s, t, *texts, f"2026-06-0{t + 1}T00:00:00+00:00")
    turns = spark.createDataFrame(
        [turn("s", 0, "I am Jane Doe", "Reply to Jane Doe and Mr Bob Ray", "Hello, Jane Doe", ""), turn("s", 1, "mail jane@x.com", "ok", "", "Jane Doe is upset"),
         turn("t", 0, "no data", "fine", "", "")],
        "session_id string, turn bigint, raw_question string, handler_answer string, customer_draft string, human_review_reason string, timestamp string")
    return turns.select(
        "*", F.lit("m").alias("model_id"), F.array().cast("array<string>").alias("cited_provisions"), F.array().cast("array<string>").alias("retrieved_chunk_ids"),
        F.lit(False).alias("human_review_required"), F.lit(False).alias("insufficient_context"), F.lit(1.0).alias("latency_ms"),
        F.lit(1.0).alias("retrieval_latency_ms"), F.lit(1.0).alias("generation_latency_ms"),
        F.struct(F.lit(1).alias("input_tokens"), F.lit(1).alias("output_tokens"), F.lit(2).alias("total_tokens")).alias("usage"))


def test_conversation(spark, rows):
    full = conversation_turns(spark)
    done = conversation.redact_conversation(full, b"k")
    got = {(r.session_id, r.turn): r for r in done.turns.collect()}
    assert got["s", 0].masked_question == "I am [NAME_1]" and got["s", 0].masked_handler_answer == "Reply to [NAME_1] and [NAME_2]"
    assert got["s", 1].masked_question == "mail [EMAIL_1]" and got["s", 1].masked_review_reason == "[NAME_1] is upset"
    assert "raw_question" not in done.turns.columns
    audit = {(r.session_id, r.timestamp[:10]): r for r in done.audit.collect()}
    first = audit["s", "2026-06-01"]
    assert first.output == "Reply to [NAME_1] and [NAME_2]\n\n[Customer draft]\nHello, [NAME_1]"
    assert [tuple(d) for d in first.output_detections] == [("NAME", 3)] and [tuple(d) for d in first.input_detections] == [("NAME", 1)]
    assert audit["s", "2026-06-02"].human_review_reason == "[NAME_1] is upset"
    asking = spark.createDataFrame([("s", 2)], "session_id string, turn bigint")
    past = rows(conversation.history(done.turns, asking), "past_turn", "role", "text")
    assert past == [(0, "assistant", first.output), (0, "user", "I am [NAME_1]"), (1, "assistant", "ok"), (1, "user", "mail [EMAIL_1]")]


def test_rescoring_from_stored_detail(drafting, spark, tmp_path, rows):
    path = str(tmp_path / "detail")
    records.write_run(evaluation.detail_records(drafting), path, "20260101_000000")
    stored = records.read_latest(spark, path)
    again = evaluation.score_drafting(evaluation.from_detail(stored, drafting.scenarios, drafting.rubric))
    want = evaluation.score_drafting(drafting)
    assert again.columns == want.columns and rows(again, *want.columns) == rows(want, *want.columns)
    # The failed run has a record too, with empty lists.
    failed = stored.where("scenario_id = 'c002'").first()
    assert "service down" in failed.error and failed.primary == [] and len(failed.retrieved) == 1 and failed.calls
    claims = evaluation.from_detail(spark.read.parquet(path), drafting.scenarios, drafting.rubric).claims
    plan = claims._jdf.queryExecution().executedPlan().toString()
    assert "claims" in plan and "retrieved" not in plan


def answer_model(model, system, prompt):
    if "second question" in prompt:
        raise RuntimeError("service down")
    if "third question" in prompt:
        return {"text": "no object"}
    found = "x" if "chunk text" in prompt else "nothing"
    return {"text": "Here:\n" + json.dumps({"answer": f"from {found}", "citations": ["x", "zz"], "confidence": "high"}), "input_tokens": 1000, "output_tokens": 0}


def claims_judge(model, system, prompt):
    assert "QUESTION:\nfirst question" in prompt and "ANSWER:\nfrom " in prompt
    second = "GROUNDED" if "opus" in model else "UNGROUNDED"
    return {"text": json.dumps([{"claim": "a", "grounding": "grounded"}, {"claim": "b", "grounding": second}]), "input_tokens": 0, "output_tokens": 0}


def test_question_run(spark, rows, tmp_path):
    run = "question_id string, config_label string"
    questions = spark.createDataFrame([(f"q{i}", f"{w} question", ["disp1s2"]) for i, w in enumerate(["first", "second", "third"], 1)],
                                      "question_id string, question string, source_sections array<string>")
    retrieved = spark.createDataFrame([("q1", "fixed-titan", 1, "x", "disp1s2", "chunk text", 0.9, None, None)],
                                      f"{run}, rank int, chunk_id string, section string, content string, score double, document_title string, source string")
    models = evaluation.QuestionModels(answer_model, claims_judge)
    configs = ["fixed-titan", "structure-titan"]
    got = evaluation.run_questions(questions, retrieved, models, configs, ledger=str(tmp_path / "ledger"))
    errors = {(r.question_id, r.config_label): r.error for r in got.runs.collect()}
    assert errors == {(q, c): e for c in configs for q, e in (("q1", None), ("q2", "service down"), ("q3", "response could not be read"))}
    assert rows(got.answers, "question_id", "config_label", "answer") == [("q1", "fixed-titan", "from x"), ("q1", "structure-titan", "from nothing")]
    table = evaluation.score_questions(questions, got.runs, retrieved, got.citations, got.primary, got.secondary, got.calls)
    r = {(r.question_id, r.config_label): r for r in table.collect()}
    one = r["q1", "fixed-titan"]
    assert (one.precision_at_k, one.recall_at_k, one.citation_precision, one.grounded_pct, one.inter_judge_agreement) == (1.0, 1.0, 0.5, 1.0, 0.5)
    assert one.total_cost == pytest.approx(0.003) and r["q2", "fixed-titan"].total_cost == 0.0 and r["q2", "fixed-titan"].error == "service down"
    # Finished runs are left out, and a single judge leaves the second one's table empty.
    done = got.runs.where("question_id <> 'q1' OR config_label = 'fixed-titan'")
    models.judges = 1
    rest = evaluation.run_questions(questions, retrieved, models, configs, done=done)
    assert rows(rest.runs, "question_id", "config_label") == [("q1", "structure-titan")]
    assert rest.primary.count() == 2 and rest.secondary.isEmpty() and {r.label for r in rest.calls.collect()} == {"generation", "judge_primary"}
