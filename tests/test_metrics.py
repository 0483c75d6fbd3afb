import pytest
from pyspark.sql import functions as F

from ragspark import fixed
from ragspark.operators import metrics

RUN = ["run"]


def one(df):
    return df.first().asDict()


def test_citation_scores(spark, rows):
    cited = spark.createDataFrame([(1, "DISP 2.8.2R"), (1, "DISP 1.6.2R"), (1, "DISP 2.8.2"), (3, "x")], "run int, provision string")
    expected = spark.createDataFrame([(1, "DISP 2.8.2R"), (1, "DISP 2.8.3G"), (2, "DISP 1.2.1")], "run int, provision string")
    got = {r.run: r for r in metrics.citation_scores(cited, expected, RUN).collect()}
    assert (got[1].precision, got[1].recall, got[1].n_cited, got[1].n_matched) == (0.5, 0.5, 2, 1) and got[1].f1 == 0.5
    assert (got[2].precision, got[2].recall, got[2].n_cited) == (0.0, 0.0, 0) and got[3].n_cited == 0
    assert rows(metrics.citation_outcomes(cited, expected, RUN).where("run = 1"), "provision", "outcome") == [
        ("DISP 1.6.2", "cited_not_expected"), ("DISP 2.8.2", "matched"), ("DISP 2.8.3", "expected_not_cited")]


def test_text_recall_and_gap(spark):
    text = "## DISP 2.8.2 (Rules)\n\nx\n\n## DISP 2.8.3 (Guidance)\n\nsee DISP 1.6.2A R(2)(a)"
    retrieved = spark.createDataFrame([(1, text), (1, "nothing")], "run int, content string")
    expected = spark.createDataFrame([(1, "DISP 2.8.2R"), (1, "DISP 2.8.3G"), (2, "DISP 1.6.2AR")], "run int, provision string")
    cited = spark.createDataFrame([(1, "DISP 2.8.2R")], "run int, provision string")
    scores = metrics.retrieved_provision_scores(retrieved, expected, RUN)
    gap = {r.run: r for r in metrics.drafting_gap(scores, metrics.citation_scores(cited, expected, RUN), RUN).collect()}
    assert (gap[1].text_recall, gap[1].citation_recall, gap[1].drafting_gap) == (1.0, 0.5, 0.5)
    assert (gap[2].text_recall, gap[2].drafting_gap) == (0.0, 0.0)


def test_section_scores(spark, rows):
    retrieved = spark.createDataFrame(
        [(1, 1, "a/disp2s8-001.md", None), (1, 2, "x", "disp2s8"), (1, 3, "y", "disp1s6"), (2, 1, "z", None)],
        "run int, rank int, chunk_id string, section string")
    expected = spark.createDataFrame([(1, "disp2s8"), (1, "disp1s9"), (2, "disp1s6")], "run int, section string")
    got = {r.run: r for r in metrics.section_scores(retrieved, expected, RUN).collect()}
    assert (got[1].n_retrieved, got[1].n_relevant, got[1].recall) == (3, 2, 0.5) and got[1].precision == pytest.approx(2 / 3)
    assert (got[2].precision, got[2].recall) == (0.0, 0.0)
    assert rows(metrics.sections_in_rank_order(retrieved, RUN), "first_rank", "section") == [(1, "disp2s8"), (3, "disp1s6")]


def test_relevance_rule(spark):
    cases = [
        (["disp1s1"], "s3://b/disp1s18-001.md", None, None, None, True), (["disp1s1"], "s3://b/x.md", "disp1s1", None, None, True),
        (["disp1s1"], "s3://b/x.md", "disp1s18", None, None, False), (["synthetic_a-b-policy"], "s3://b/a-b-policy-000.md", None, None, None, True),
        (["synthetic_a-b-policy"], "c", None, "The A B Policy", "synthetic", True), (["synthetic_a-b-policy"], "c", None, "The A B Policy", "real", False),
        ([], "c", "s", None, None, False),
    ]
    df = spark.createDataFrame(cases, "w array<string>, chunk_id string, section string, title string, source string, want boolean")
    hit = metrics.chunk_is_relevant(*[F.col(c) for c in ("w", "chunk_id", "section", "title", "source")])
    assert all(r[0] == r[1] for r in df.select("want", hit).collect())


def test_hits_and_answer_citations(spark):
    got = spark.createDataFrame([(1, "a", True), (1, "a", True), (1, "b", False), (2, "c", False)], "run int, chunk_id string, is_relevant boolean")
    hits = {r.run: r for r in metrics.hit_scores(got, RUN).collect()}
    assert (hits[1].k, hits[1].relevant_retrieved, hits[1].recall_at_k) == (3, 1, 1.0) and hits[1].precision_at_k == pytest.approx(1 / 3)
    assert (hits[2].recall_at_k, hits[2].total_relevant) == (0.0, 1)
    known = one(metrics.hit_scores(got.where("run = 1").withColumn("n_truth", F.lit(4)), RUN))
    assert known["recall_at_k"] == 0.25
    cites = spark.createDataFrame([(1, "a"), (1, "a"), (1, "z")], "run int, chunk_id string")
    c = {r.run: r for r in metrics.answer_citation_scores(cites, got, RUN).collect()}
    assert (c[1].total_citations, c[1].valid_citations, c[1].citation_recall) == (3, 2, 2.0)
    assert (c[2].total_citations, c[2].citation_precision, c[2].citation_recall) == (0, 0.0, 0.0)


def test_grounding_and_agreement(spark):
    claims = spark.createDataFrame(
        [(1, 0, "handler_answer", "GROUNDED"), (1, 1, "customer_draft", "GROUNDED"), (1, 2, "customer_draft", "UNGROUNDED"), (1, 3, "unknown", "PARTIALLY_GROUNDED")],
        "run int, idx int, source_field string, grounding string")
    g = one(metrics.grounding_scores(claims, RUN, by_field=True))
    assert (g["grounded_pct"], g["partially_grounded_pct"], g["hallucination_rate"]) == (0.5, 0.25, 0.25)
    assert (g["grounded_pct_handler"], g["grounded_pct_customer"], g["ungrounded_pct_customer"]) == (1.0, 0.5, 0.5)
    other = spark.createDataFrame([(1, 0, "GROUNDED"), (1, 1, "UNGROUNDED"), (2, 0, "GROUNDED")], "run int, idx int, grounding string")
    a = {r.run: (r.n_compared, r.agreement) for r in metrics.claim_agreement(claims, other, RUN).collect()}
    assert a == {1: (2, 0.5), 2: (0, 0.0)}


def verdicts(spark, *items):
    return spark.createDataFrame([(1, i, e, s) for i, (e, s) in enumerate(items)], "run int, idx int, element string, status string")


def test_rubric_coverage_rules(spark):
    required = spark.createDataFrame([(1, e) for e in "abc"], "run int, element string")
    v = verdicts(spark, ("a", "MISSING"), ("a", "PRESENT"), ("b", "PARTIAL"), ("z", "PRESENT"))
    r = one(metrics.rubric_scores(required, v, RUN))
    assert (r["present_count"], r["partial_count"], r["missing_count"], r["n_required"]) == (1, 1, 1, 3) and r["coverage"] == 0.5
    none = one(metrics.rubric_scores(required, v.limit(0), RUN))
    assert (none["coverage"], none["missing_count"]) == (0.0, 3)
    rubric = spark.createDataFrame([("a", "d"), ("b", "d")], "key string, definition string")
    assert sorted(r.element for r in metrics.defined_elements(required, rubric).collect()) == ["a", "b"]


def test_rubric_agreement_rules(spark):
    required = spark.createDataFrame([(1, e) for e in "ab"], "run int, element string")
    p = verdicts(spark, ("a", "PRESENT"), ("b", "MISSING"))
    assert one(metrics.rubric_agreement(required, p, verdicts(spark, ("a", "PRESENT")), RUN))["agreement"] == 1.0
    assert one(metrics.rubric_agreement(required, p, verdicts(spark, ("b", "PARTIAL")), RUN))["agreement"] == 0.0
    assert one(metrics.rubric_agreement(required, p, p.limit(0), RUN))["agreement"] == 0.0


def test_costs(spark):
    calls = spark.createDataFrame(
        [(1, "generation", "sonnet", 1000, 1000), (1, "rubric_primary", "opus", 2000, 500), (1, "grounding", "opus", 2000, 500), (2, "generation", "?", 5, 5)],
        "run int, label string, model string, input_tokens int, output_tokens int")
    got = {r.run: r for r in metrics.run_costs(calls, RUN, ["generation", "grounding"]).collect()}
    assert got[1].total_cost == pytest.approx(0.153) and got[1].generation_cost == pytest.approx(0.018) and got[1].grounding_cost == pytest.approx(0.0675)
    assert got[2].total_cost == 0.0


def test_aggregates_and_comparison(spark):
    base = {c: 0.5 for c in metrics.DRAFTING_MEANS}
    data = [
        {**base, "config_label": "structure-titan", "coverage": 1.0, "drafting_gap": 0.4, "latency_ms": 1000.0, "total_cost": 0.1, "error": None},
        {**base, "config_label": "structure-titan", "coverage": 0.5, "drafting_gap": -0.6, "latency_ms": 3000.0, "total_cost": 0.2, "error": None},
        {**base, "config_label": "structure-titan", "coverage": 0.0, "drafting_gap": 0.0, "latency_ms": 9000.0, "total_cost": 9.0, "error": "boom"},
    ]
    ddl = "config_label string, latency_ms double, total_cost double, error string, " + ", ".join(f"{c} double" for c in metrics.DRAFTING_MEANS)
    df = spark.createDataFrame(data, ddl)
    agg = metrics.drafting_aggregate(df)
    row = one(agg)
    assert (row["n_scenarios"], row["coverage_mean"], row["latency_p50_ms"]) == (2, 0.75, 2000.0)
    assert row["cost_per_scenario_mean"] == pytest.approx(0.15)
    assert one(metrics.drafting_comparison(agg))["line"] == "| structure-titan | 75.0% | 50.0% | 50.0% / 50.0% | 50.0% | -10.0% | 50.0% | 50.0% |"
    qa = spark.createDataFrame(
        [("c", 0.5, 1.0, 0.5, 0.25, 1.0, 0.01, 0.0, 10.0), ("c", 0.5, 0.0, 0.5, 0.25, 0.0, 0.03, 0.8, 30.0)],
        "config_label string, precision_at_k double, recall_at_k double, grounded_pct double, ungrounded_pct double, citation_precision double, "
        "total_cost double, inter_judge_agreement double, latency_ms double")
    out = metrics.qa_aggregate(qa)
    assert one(out)["inter_judge_agreement"] == 0.8 and one(out)["p95_ms"] == 30.0
    assert one(metrics.qa_comparison(out))["line"] == "| c | 50.0% | 50.0% | 50.0% | 25.0% | 50.0% | 20ms | $0.0200 | 80.0% |"


def test_weights_are_complete():
    assert set(fixed.COVERAGE_WEIGHTS) == {"PRESENT", "PARTIAL", "MISSING"}


def test_one_run_may_hold_all_rows(spark):
    """A dominating run is counted by partial hash aggregation: nothing is collected, sorted or windowed."""
    n = 20000
    cited = spark.range(n).select(F.lit(1).alias("run"), F.concat(F.lit("DISP 1."), F.col("id") % 100, F.lit("R")).alias("provision"))
    expected = spark.range(n).select(F.lit(1).alias("run"), F.concat(F.lit("disp 1."), F.col("id") % 200).alias("provision"))
    required = spark.range(8).select(F.lit(1).alias("run"), F.concat(F.lit("e"), "id").alias("element"))
    given = spark.range(n).select(
        F.lit(1).alias("run"), F.col("id").alias("idx"), F.concat(F.lit("e"), F.col("id") % 4).alias("element"),
        F.when(F.col("id") < n - 2, "MISSING").otherwise("PRESENT").alias("status"))
    claims = spark.range(n).select(F.lit(1).alias("run"), F.col("id").alias("idx"), F.lit("GROUNDED").alias("grounding"), F.lit("x").alias("source_field"))
    frames = [
        (metrics.citation_scores(cited, expected, RUN), {"n_matched": 100, "precision": 1.0, "recall": 0.5}),
        (metrics.rubric_scores(required, given, RUN), {"present_count": 2, "n_required": 8}),
        (metrics.rubric_agreement(required, given, given, RUN), {"agreement": 1.0}),
        (metrics.claim_agreement(claims, claims.where("idx < 10"), RUN), {"n_compared": 10, "agreement": 1.0}),
        (metrics.grounding_scores(claims, RUN, by_field=True), {"total_claims": n, "grounded_pct": 1.0}),
    ]
    for df, want in frames:
        got = one(df)
        assert {k: got[k] for k in want} == want
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "partial_" in plan and not any(bad in plan for bad in ("SortAggregate", "Window", "collect_", "Cartesian", "NestedLoop")), plan


def test_provision_scores_in_one_pass_equal_the_separate_ones(spark):
    import random

    rng = random.Random(7)
    def refs(n):
        return spark.createDataFrame(
            [(rng.choice(["a", "b", "c", "d"]), rng.choice(["DISP 1.2.1R", "disp  1.2.1", "DISP 1.2.2", "SYSC 3.1.1G", None, "none"])) for _ in range(n)],
            "run string, provision string")
    cited, expected = refs(40).where("run <> 'd'"), refs(25).where("run <> 'c'")
    text = spark.createDataFrame([("a", "## DISP 1.2.2 (Rules)\n\nx"), ("e", "nothing"), ("d", "## SYSC 3.1.1 (Guidance)\n\ny")], "run string, content string")
    marks = metrics.marked(cited, ["run"], metrics.CITED).unionByName(metrics.marked(expected, ["run"], metrics.EXPECTED))
    got = {r.run: r for r in metrics.provision_scores(marks.unionByName(metrics.marked_text(text, ["run"])), ["run"]).collect()}
    assert set(got) == set("abcde")
    for r in metrics.citation_scores(cited, expected, ["run"]).collect():
        g = got[r.run]
        assert (g.n_cited, g.n_expected, g.n_matched, g.precision, g.citation_recall, g.f1) == (r.n_cited, r.n_expected, r.n_matched, r.precision, r.recall, r.f1)
    for r in metrics.retrieved_provision_scores(text, expected, ["run"]).collect():
        g = got[r.run]
        assert (g.n_in_text, g.n_present, g.text_recall) == (r.n_in_text, r.n_present, r.recall)
        assert g.drafting_gap == g.text_recall - g.citation_recall
