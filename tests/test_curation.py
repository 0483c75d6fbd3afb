import pytest
from pyspark.sql import functions as F

from ragspark import fixed
from ragspark.operators import curation, references
from ragspark.plans import curation as plans

INDEX = [
    ("disp1s2", "disp", "disp1", "Consumer awareness"), ("disp1s4", "disp", "disp1", "Resolution"), ("disp1s6", "disp", "disp1", "Time limits"),
    ("disp2s7", "disp", "disp2", "Eligible"), ("disp2s8", "disp", "disp2", "In time"), ("disp1s18", "disp", "disp1", "Annex"),
    ("bcobs2s2", "bcobs", "bcobs2", "Fair"), ("bcobs2s1", "bcobs", "bcobs2", "Application"), ("bcobs5s1", "bcobs", "bcobs5", "Post sale"),
    ("conc7s3", "conc", "conc7", "Arrears"), ("conc10s1", "conc", "conc10", "Prudential"), ("mcobsch1", "mcob", "mcob2", "Schedule"),
    ("sysc10s1", "sysc", "sysc10", "Conflicts"), ("sysc10s1a", "sysc", "sysc10", "More"), ("sysc10as2", "sysc", "sysc10a", "Other"),
    ("cocon1s1", "cocon", "cocon1", "Scope"), ("prin2as1", "prin", "prin2a", "Duty"), ("prin2s1", "prin", "prin2", "Principles"),
    ("cobs4s2", "cobs", "cobs4", "Fair"),
]


@pytest.fixture
def index(spark):
    return spark.createDataFrame(INDEX, "section_id string, module string, chapter string, section_name string")


def test_resolve_references(spark, index, rows):
    refs = spark.createDataFrame([(r,) for r in ("SYSC 10.1", "SYSC 10A.2", "SYSC 10", "PRIN 2A", "PRIN 2", "COCON", "DISP 1.1", "DISP 9.9", "CONC 7.3", " SYSC 10 ")], "ref string")
    got = {}
    for ref, section in rows(references.resolve_references(refs, index), "ref", "section_id"):
        got.setdefault(ref, []).append(section)
    assert got["SYSC 10.1"] == ["sysc10s1"] and got["SYSC 10A.2"] == ["sysc10as2"]
    assert got["SYSC 10"] == ["sysc10s1", "sysc10s1a"] == got[" SYSC 10 "]
    assert got["PRIN 2A"] == ["prin2as1"] and got["PRIN 2"] == ["prin2s1"] and got["COCON"] == ["cocon1s1"]
    assert got["DISP 1.1"] == ["disp1s18"] and "DISP 9.9" not in got and got["CONC 7.3"] == ["conc7s3"]


POLICY = "# P\n## 2. Regulatory Context\n| SYSC 10.1 | COBS 4.2 | **COCON** |\n## 3. End"


def test_policy_sections_and_pool(spark, index, rows):
    policies = spark.createDataFrame([("p.md", POLICY), ("q.md", "# none")], "policy string, content string")
    hits = references.policy_sections(policies, index)
    assert rows(hits, "ref_ord", "section_id") == [(0, "cobs4s2"), (1, "cocon1s1"), (2, "sysc10s1")]
    pool = references.section_pool(index, hits)
    assert rows(pool, "section_id") == [("cobs4s2",), ("cocon1s1",), ("prin2as1",), ("sysc10s1",)]


def test_cross_module_pairs(spark, rows):
    pool = spark.createDataFrame([(f"{m}{i}", m) for m in ("sysc", "prin", "cobs") for i in range(1, 5)] + [("cass1", "cass")], "section_id string, module string")
    got = rows(references.cross_module_pairs(pool, 8), "position", "section_a", "section_b")
    assert [g[1:] for g in got] == [
        ("sysc1", "prin1"), ("sysc1", "prin2"), ("sysc1", "prin3"), ("cobs1", "prin1"), ("cobs1", "prin2"), ("cobs1", "prin3"), ("sysc1", "cobs1"), ("sysc1", "cobs2")]


def reference_plan(index):
    """Plain model of the seed plan."""
    ids = {r[0]: r for r in INDEX}
    handling = [s for s in fixed.HANDLING_SECTIONS if s in ids]
    groups = {}
    for sid, module, chapter, name in sorted(INDEX):
        core = not any(x in sid for x in fixed.NON_CORE_FRAGMENTS)
        if core and chapter in fixed.SUBSTANTIVE_CHAPTERS.get(module, []) and not any(w in name.lower() for w in fixed.THIN_SECTION_WORDS):
            groups.setdefault(module, []).append(sid)
    cycle = [m for m in fixed.SUBSTANTIVE_MODULES if m in groups]
    multi = []
    for i in range(fixed.TARGET_MULTI * fixed.MULTI_STEP_LIMIT + 1):
        subs = groups[cycle[i % len(cycle)]]
        multi.append(sorted([handling[i % len(handling)], subs[i // len(cycle) % len(subs)]]))
    escal = [sorted([a, b]) for a in fixed.FINAL_RESPONSE_SECTIONS if a in ids for b in fixed.FOS_SECTIONS if b in ids]
    out = []
    for kind, seeds, cap in (("single", [[s] for s in handling], 99), ("multi", multi, fixed.TARGET_MULTI), ("escalation", escal, fixed.TARGET_ESCALATION)):
        unique = list(dict.fromkeys(map(tuple, seeds)))[:cap]
        out += [f"{kind}:{'+'.join(s)}" for s in unique]
    return out


def test_seed_plan(spark, index):
    got = [r.seed_id for r in curation.seed_plan(index).orderBy("plan_ord").collect()]
    assert got == reference_plan(INDEX)
    with pytest.raises(ValueError):
        curation.seed_plan(index.where("module = 'sysc'"))


def test_required_elements_and_defaults(spark):
    df = spark.createDataFrame(
        [("final", True, True, True, None), ("holding", True, False, False, "easy"), ("odd", None, None, None, None)],
        "response_stage string, redress_warranted boolean, timing_in_issue boolean, vulnerability_present boolean, difficulty string")
    got = curation.scenario_defaults(df).collect()
    assert got[0].required_response_elements == fixed.REQUIRED_ELEMENTS
    assert got[1].required_response_elements == ["acknowledgement", "fair_treatment"] and got[1].difficulty == "easy"
    assert got[2].response_stage == "final" and got[2].redress_warranted is False and got[2].difficulty == "medium"
    assert got[2].required_response_elements == ["acknowledgement", "decision_and_reasons", "fos_referral_rights", "six_month_referral_limit", "fair_treatment"]


CRITIC = "struct<verdict:string,difficulty_reasonable:boolean,suggested_difficulty:string>"


def test_question_gate_and_curation(spark):
    df = spark.createDataFrame(
        [(10, "easy", ("pass", False, "hard")), (11, "easy", ("pass", True, "hard")), (12, "easy", ("fail", False, "hard")), (13, "easy", None),
         (14, "easy", ("pass", None, "hard")), (15, "easy", ("pass", False, "easy"))],
        f"ord int, difficulty string, critic {CRITIC}")
    gated, curated = plans.curate_questions(df)
    got = {r.ord: (r.gate, r.difficulty, r.difficulty_original, r.critic_verdict) for r in gated.collect()}
    assert got == {10: ("pass", "hard", "easy", "pass"), 11: ("pass", "easy", None, "pass"), 12: ("fail", "easy", None, "fail"),
                   13: ("pass", "easy", None, "error"), 14: ("pass", "easy", None, "pass"), 15: ("pass", "easy", None, "pass")}
    assert [(r.question_id, r.ord) for r in curated.orderBy("ord").collect()] == [("q001", 10), ("q002", 11), ("q003", 13), ("q004", 14), ("q005", 15)]


def test_scenario_curation(spark):
    def record(o, seed, realism, provisions, text="t"):
        return (o, seed, text, "final", None, None, None, None, (realism, provisions) if realism else None)
    df = spark.createDataFrame(
        [record(1, "b", "pass", "fail"), record(2, "a", "pass", "pass"), record(3, "b", "pass", "pass", "again"), record(4, "c", "pass", "fail"), record(5, "d", None, None)],
        "ord int, seed_id string, scenario_text string, response_stage string, redress_warranted boolean, timing_in_issue boolean, "
        "vulnerability_present boolean, difficulty string, critic struct<realism:string,provisions_correct:string>")
    judged, curated = plans.curate_scenarios(df)
    assert {r.seed_id: r.verdict for r in judged.collect()} == {"a": "pass", "b": "pass", "c": "fail", "d": "error"}
    assert [(r.scenario_id, r.seed_id, r.scenario_text) for r in curated.orderBy("scenario_id").collect()] == [("c001", "b", "again"), ("c002", "a", "t")]
    assert plans.curate_scenarios(df, skip_validation=True)[1].count() == 0


def test_renumber_past_three_digits(spark):
    df = spark.range(1200).select((F.col("id") * 3).alias("ord"))
    got = [r[0] for r in curation.renumber(df, "q", "question_id", bucket_rows=100).orderBy("ord").select("question_id").collect()]
    assert got[0] == "q001" and got[998] == "q999" and got[999] == "q1000" and got[-1] == "q1200"


def test_summary_and_sources(spark, rows):
    df = spark.createDataFrame([("a", "easy", ["x", "y"]), ("a", "hard", ["x"])], "type string, difficulty string, e array<string>")
    assert rows(curation.frequency_summary(df, ["type", "difficulty"], "e"), "dimension", "value", "n") == [
        ("difficulty", "easy", 1), ("difficulty", "hard", 1), ("e", "x", 2), ("e", "y", 1), ("type", "a", 2)]
    texts = spark.createDataFrame([("s1", "one"), ("s2", "x" * 12)], "section_id string, text string")
    items = spark.createDataFrame([(1, ["s2", "s9", "s1"])], "k int, sections array<string>")
    got = curation.source_blocks(items, "k", "sections", texts, limit=10).first().source_material
    assert got == "### s2\n" + "x" * 10 + fixed.TRUNCATION_MARK + "\n\n---\n\n### s9\n" + fixed.QA_SOURCE_MISSING + "\n\n---\n\n### s1\none"


def test_question_plan(spark, index):
    texts = spark.createDataFrame([(r[0], (r[3] + " ") * (5 if r[0] == "cocon1s1" else 80)) for r in INDEX], "section_id string, text string")
    policies = spark.createDataFrame([("p.md", POLICY)], "policy string, content string")
    got = plans.question_plan(index, texts, policies, singles=10, pairs=5, policy_questions=5).orderBy("position").collect()
    assert [(r.type, r.sections) for r in got] == [
        ("single-module", ["cobs4s2"]), ("single-module", ["prin2as1"]), ("single-module", ["sysc10s1"]),
        ("cross-module", ["sysc10s1", "prin2as1"]), ("cross-module", ["cobs4s2", "prin2as1"]), ("cross-module", ["sysc10s1", "cobs4s2"]),
        ("cross-module", ["cocon1s1", "sysc10s1"]), ("policy-regulation", ["cobs4s2", "synthetic_p"])]


def question_model(model, system, prompt):
    if prompt.startswith("Question type"):
        if "cross-module" in prompt:
            return {"text": "sorry, no question"}
        return {"text": 'Sure:\n```json\n{"question": "q?", "answer": "a", "difficulty": "easy"}\n```'}
    if "cobs4s2" in prompt:
        raise RuntimeError("critic down")
    return {"text": '{"verdict": "pass", "difficulty_reasonable": false, "suggested_difficulty": "hard"}'}


def test_question_job(spark, index):
    texts = spark.createDataFrame([(r[0], (r[3] + " ") * 80) for r in INDEX], "section_id string, text string")
    policies = spark.createDataFrame([("p.md", POLICY)], "policy string, content string")
    plan = plans.question_plan(index, texts, policies, singles=2, pairs=1, policy_questions=1)
    candidates = plans.generate_questions(plan, question_model)
    assert [(r.ord, r.type, r.source_sections) for r in candidates.orderBy("ord").collect()] == [
        (1, "single-module", ["cobs4s2"]), (2, "single-module", ["cocon1s1"]), (4, "policy-regulation", ["cobs4s2", "synthetic_p"])]
    gated, curated = plans.curate_questions(plans.criticise_questions(candidates, texts, question_model))
    assert {r.ord: (r.gate, r.difficulty, r.critic_verdict) for r in gated.collect()} == {
        1: ("pass", "easy", "error"), 2: ("pass", "hard", "pass"), 4: ("pass", "easy", "error")}
    assert sorted(r.question_id for r in curated.collect()) == ["q001", "q002", "q003"]


def scenario_model(model, system, prompt):
    if "Complaint: " in prompt:
        return {"text": '{"realism": "pass", "provisions_correct": "%s"}' % ("fail" if "disp1s4" in prompt else "pass")}
    assert "### disp1s" in prompt and " — " in prompt
    return {"text": '{"scenario_text": "I complain", "expected_provisions": ["DISP 1.2.1R"], "timing_in_issue": true}'}


def test_scenario_job(spark, index):
    texts = spark.createDataFrame([(r[0], r[3]) for r in INDEX], "section_id string, text string")
    seeds = curation.seed_plan(index).where("complaint_type = 'single'")
    made = plans.generate_scenarios(seeds, index, texts, scenario_model)
    judged, curated = plans.curate_scenarios(plans.criticise_scenarios(made, texts, scenario_model))
    assert {r.seed_id: r.verdict for r in judged.collect()} == {"single:disp1s2": "pass", "single:disp1s4": "fail", "single:disp1s6": "pass"}
    row = curated.orderBy("scenario_id").first()
    assert (row.scenario_id, row.expected_provision_sections, row.synthetic) == ("c001", ["disp1s2"], True)
    assert "eight_week_timeline" in row.required_response_elements


def plain_resolution(ref, ids):
    """What a reference means, section by section."""
    module, _, nums = ref.strip().lower().partition(" ")
    if not nums:
        return {s for s, _ in ids if s.startswith(module)}
    if "." not in nums:
        return {s for s, c in ids if c == module + nums}
    chapter, section = nums.split(".")[:2]
    target = f"{module}{chapter}s{section}"
    return {s for s, _ in ids if s == target} or {s for s, _ in ids if s.startswith(target)}


def test_references_by_intervals_on_a_hot_module(spark, rows):
    # Most sections lie in one module, most policies name it, and one chapter is split by other ids.
    ids = [(f"sysc{c}s{i}", f"sysc{c}") for c in range(1, 6) for i in range(500)] + [("sysc1s7x", "cobs1"), ("cobs1s1", "cobs1"), ("sys", "sys"), ("syscé1s1", "syscé1")]
    index = spark.createDataFrame(ids + [("sysc1s8", "cobs1"), (None, "cobs1")], "section_id string, chapter string")
    every = ids + [("sysc1s8", "cobs1")]
    names = ["SYSC", "SYSC 1", "SYSC 1.7", "SYSC 1.49", "SYSC 1.4999", "COBS 1", "SYS", "SYSC 9", "NONE", "sysc 2.1"]
    got = {}
    for ref, section in rows(references.resolve_references(spark.createDataFrame([(n,) for n in names], "ref string"), index), "ref", "section_id"):
        got.setdefault(ref, set()).add(section)
    assert got == {n: w for n in names if (w := plain_resolution(n, every))}

    lists = [["SYSC"], ["SYSC 1", "SYSC"], ["SYSC 1.7", "SYSC 2", "SYSC 1"], ["COBS 1", "SYSC 1"], []] + [["SYSC"]] * 40
    policies = spark.createDataFrame(
        [(f"p{i}", "## 1. Regulatory Context\n" + "".join(f"| {r if ' ' in r else f'**{r}**'} " for r in refs) + "|\n## 2. End") for i, refs in enumerate(lists)], "policy string, content string")
    order = {(p, r): o for p, o, r in references._policy_refs(policies).select("policy", "ref_ord", "ref").collect()}
    want = {}
    for (p, r), o in order.items():
        for s in plain_resolution(r, every):
            want[p, s] = min(o, want.get((p, s), o))
    found = {(p, s): o for p, s, o in rows(references.policy_sections(policies, index), "policy", "section_id", "ref_ord")}
    assert found == want and len(order) == 48
    # Policies are a few intervals each, not a row for each of their sections.
    assert references.policy_intervals(policies, index)[0].count() < 60
    assert rows(references.referenced_sections(policies, index), "section_id") == sorted({(s,) for _, s in want})
