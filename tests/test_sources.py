import json

from pyspark.sql import functions as F

from ragspark import fixed
from ragspark.operators import audit
from ragspark.sources import corpus, records

TREE = [
    {"parts": [
        {"entityId": "disp", "parts": [
            {"entityId": "disp1", "parts": [{"entityId": "disp1s1"}, {"entityId": "disp1s2"}]}, {"entityId": "disp2", "parts": []}]},
        {"entityId": "sup", "parts": [{"entityId": "sup1", "parts": [{"entityId": "sup1s1"}]}]}]},
    {"parts": [{"entityId": "prin", "parts": [{"entityId": "prin1", "parts": [{"entityId": "prin1s1"}]}]}]},
]


def write(path, value):
    path.write_text(value if isinstance(value, str) else json.dumps(value))
    return str(path)


def test_tree_and_provisions(spark, tmp_path, rows):
    tree = corpus.read_tree(spark, write(tmp_path / "tree.json", TREE))
    assert rows(corpus.section_pairs(tree), "module", "chapter", "section") == [
        ("disp", "disp1", "disp1s1"), ("disp", "disp1", "disp1s2"), ("prin", "prin1", "prin1s1")]
    chapters = corpus.chapter_modules(tree)
    assert rows(chapters, "chapter", "module") == [("disp1", "disp"), ("disp2", "disp"), ("prin1", "prin")]
    raw = spark.createDataFrame(
        [("disp1", "disp1s1", "DISP 1.1.1R", None, "Name", "Rules", "text", '<a href="/handbook/PRIN/2">', "2026", 0), ("zz1", "zz1s1", None, None, None, None, None, None, None, 1)],
        "chapter string, section string, provisionName string, entityId string, sectionName string, provisionType string, contentText string, contentType string, timeline string, ord int")
    got = corpus.normalise_provisions(raw, chapters).orderBy("ord").collect()
    assert (got[0].module, got[0].cross_references, got[0].entity_id) == ("disp", ["PRIN/2"], "")
    assert (got[1].module, got[1].provision_id, got[1].cross_references) == ("zz1", "", [])


def test_index_store_and_union(spark, tmp_path, rows):
    meta = spark.createDataFrame([("a", "m", "c", None, None), ("b", "m", "c", "n", 3)], "section string, module string, chapter string, section_name string, provision_count int")
    docs = spark.createDataFrame([("a", 0), ("a", 1)], "section string, part int")
    index = corpus.section_index(meta, docs)
    assert [tuple(r) for r in index.collect()] == [("a", "m", "c", "", 0)]
    chunks = corpus.one_index(
        spark.createDataFrame([("x", "fixed", "s")], "chunk_id string, arm string, section string"),
        spark.createDataFrame([("y", "structure", "t")], "chunk_id string, arm string, document_title string"))
    store = str(tmp_path / "store")
    corpus.write_store(chunks, store)
    corpus.write_store(chunks, store)
    assert rows(spark.read.parquet(store), "chunk_id", "arm") == [("x", "fixed"), ("y", "structure")]
    assert "PartitionFilters: [isnotnull(arm" in spark.read.parquet(store).where("arm = 'fixed'")._jdf.queryExecution().executedPlan().toString()


def test_spot_check_repeats(spark):
    df = spark.range(100)
    pick = lambda seed: [r.id for r in corpus.spot_check(df, "id", 10, seed).collect()]
    assert pick("1") == pick("1") and pick("1") != pick("2") and len(set(pick("1"))) == 10


def test_ground_truth_files(spark, tmp_path):
    path = write(tmp_path / "s.json", [{"scenario_id": "c002", "scenario_text": "b"}, {"scenario_id": "c001", "expected_provisions": ["DISP 1.1"]}])
    assert records.read_scenarios(spark, path).count() == 2 and records.read_scenarios(spark, path, 0).count() == 2
    assert records.read_scenarios(spark, path, 1).first().scenario_id == "c001"
    path = write(tmp_path / "q.json", [{"question_id": "q1", "source_sections": ["a"]}])
    assert records.read_questions(spark, path).first().source_sections == ["a"]
    path = write(tmp_path / "r.json", {"_meta": {"x": 1}, "elements": {e: {"label": e, "audience": "customer"} for e in fixed.REQUIRED_ELEMENTS}})
    assert sorted(r.key for r in records.read_rubric(spark, path).collect()) == sorted(fixed.REQUIRED_ELEMENTS)
    path = write(tmp_path / "p.json", {"_comment": "x", "cases": [{"case_id": "1", "text": "t", "entities": [{"text": "t", "type": "NAME"}]}, {"case_id": "2", "text": "u"}]})
    got = {r.case_id: r for r in records.read_pii_cases(spark, path).collect()}
    assert got["1"].entities[0].is_pii is True and got["1"].source == "synthetic" and got["2"].entities == []


def trail(spark):
    none = F.array().cast("array<struct<entity_type:string,count:bigint>>")
    def found(kind, n):
        return F.array(F.struct(F.lit(kind).alias("entity_type"), F.lit(n).cast("long").alias("count")))
    rows = [("2026-06-01T09:00:00+00:00", "session-aaaa", "Mr John Smith complained", True), ("2026-06-02T09:00:00+00:00", "session-bbbb", "q", False),
            ("2026-06-03T09:00:00+00:00", "session-aaaa", "r", False)]
    df = spark.createDataFrame(rows, "timestamp string, session_id string, raw_question string, human_review_required boolean")
    return audit.audit_records(df.select(
        "*", found("NAME", 1).alias("input_detections"), found("NAME", 1).alias("answer_detections"), found("EMAIL", 2).alias("draft_detections"),
        none.alias("reason_detections"), F.lit("[NAME_1] answer").alias("masked_handler_answer"),
        F.when(F.col("human_review_required"), "dear").alias("masked_customer_draft"), F.lit("").alias("masked_review_reason"), F.lit("m").alias("model_id"),
        F.array(F.lit("DISP 1.6.2R")).alias("cited_provisions"), F.array(F.lit("c1")).alias("retrieved_chunk_ids"), F.lit(False).alias("insufficient_context"),
        F.lit(12.5).alias("latency_ms"), F.lit(1.0).alias("retrieval_latency_ms"), F.lit(2.0).alias("generation_latency_ms"),
        F.struct(F.lit(10).alias("input_tokens"), F.lit(None).cast("int").alias("output_tokens"), F.lit(30).alias("total_tokens")).alias("usage"),
    ), b"key")


def test_audit_trail(spark, tmp_path, rows):
    path = str(tmp_path / "audit")
    assert records.read_audit(spark, path).count() == 0
    records.append_audit(trail(spark), path)
    records.append_audit(trail(spark).limit(1), path)
    (tmp_path / "audit" / "blank.json").write_text("\n   \n")
    stored = records.read_audit(spark, path)
    assert stored.count() == 4
    first = stored.where("timestamp < '2026-06-02'").first()
    assert (first.output, first.input_tokens, first.output_tokens, first.total_tokens) == ("[NAME_1] answer\n\n[Customer draft]\ndear", 10, 0, 30)
    assert [tuple(d) for d in first.output_detections] == [("EMAIL", 2), ("NAME", 1)] and len(first.input_hash) == 64
    assert "John Smith" not in "".join(f.read_text() for f in (tmp_path / "audit").glob("part-*.json"))
    once = trail(spark)
    assert audit.filter_audit(once, until="2026-06-02").count() == 1
    assert audit.filter_audit(once, since="2026-06-02", session="session-aaaa").count() == 1
    assert audit.filter_audit(once, review_only=True).count() == 1
    assert [r.timestamp[:10] for r in audit.most_recent(once, "timestamp", 2).collect()] == ["2026-06-02", "2026-06-03"]
    assert audit.most_recent(once, "timestamp", 0).count() == 3
    line = once.orderBy("timestamp").select(audit.summary_line()).first()[0]
    assert line.startswith("2026-06-01T09:00:00+00:00  session-  REVIEW  tokens=30    12ms  input_pii=[NAME:1]  hash=") and line.endswith("...")


def test_results_resume_and_latest(spark, tmp_path, rows):
    items = spark.createDataFrame([("c1",), ("c2",)], "scenario_id string")
    planned = records.work_matrix(items, fixed.DRAFTING_CONFIGS)
    assert planned.count() == 4
    done = spark.createDataFrame([("c1", "fixed-titan", "boom"), ("c1", "fixed-titan", None)], "scenario_id string, config_label string, error string")
    left = records.remaining_work(planned, done, ["scenario_id", "config_label"])
    assert rows(left, "scenario_id", "config_label") == [("c1", "structure-titan"), ("c2", "fixed-titan"), ("c2", "structure-titan")]
    path = str(tmp_path / "detail")
    records.write_run(items, path, "20260101_000000")
    records.write_run(items.limit(1), path, "20260102_000000")
    assert records.read_latest(spark, path).count() == 1
    gated = spark.createDataFrame([("a", "pass"), ("b", "fail"), ("c", "error")], "k string, verdict string")
    records.write_curated(gated, str(tmp_path / "cur"), "verdict")
    sizes = {n: spark.read.parquet(str(tmp_path / "cur" / n)).count() for n in ("curated", "candidates", "failed")}
    assert sizes == {"curated": 1, "candidates": 3, "failed": 1}


def test_curated_sets_come_from_one_computation(spark, tmp_path):
    """A value that differs with every computation is the same in all three tables; other verdicts are candidates only."""
    gated = spark.range(20).selectExpr("id", "uuid() AS drawn", "CASE id % 3 WHEN 0 THEN 'pass' WHEN 1 THEN 'fail' END AS verdict")
    records.write_curated(gated, str(tmp_path), "verdict")
    tables = {n: {(r.id, r.drawn): r.verdict for r in spark.read.parquet(str(tmp_path / n)).collect()} for n in ("curated", "candidates", "failed")}
    for name, verdict in (("curated", "pass"), ("failed", "fail")):
        assert tables[name] == {k: v for k, v in tables["candidates"].items() if v == verdict} and tables[name]
    assert len(tables["candidates"]) == 20
