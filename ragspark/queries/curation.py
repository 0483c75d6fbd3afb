"""Curation gates, numbering and summaries on ``events`` and ``orders``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ragspark.operators import curation
from ragspark.queries.registry import query


def _k():
    return F.get_json_object("props", "$.k").cast("int")


@query("required_elements", """
WITH s AS (
  SELECT CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN 'final' WHEN o_orderpriority = '5-LOW' THEN 'holding' ELSE 'final' END AS stage,
         o_orderstatus = 'F' AS redress, o_totalprice > 150000 AS timing, o_custkey % 5 = 0 AS vulnerable,
         CASE WHEN o_custkey % 3 = 0 THEN 'medium' ELSE 'hard' END AS difficulty FROM orders),
e AS (
  SELECT 'required_response_elements' AS dimension, unnest(['acknowledgement', 'fair_treatment']
    || CASE WHEN stage = 'final' THEN ['decision_and_reasons', 'fos_referral_rights', 'six_month_referral_limit'] ELSE [] END
    || CASE WHEN timing THEN ['eight_week_timeline'] ELSE [] END
    || CASE WHEN stage = 'final' AND redress THEN ['redress_consideration'] ELSE [] END
    || CASE WHEN vulnerable THEN ['vulnerability_consideration'] ELSE [] END) AS value FROM s
  UNION ALL SELECT 'response_stage', stage FROM s UNION ALL SELECT 'difficulty', difficulty FROM s)
SELECT dimension, value, count(*) AS n FROM e GROUP BY dimension, value""")
def required_elements(t):
    """Orders as generated scenarios: priority gives the stage, status, price and customer the flags."""
    stage = F.when(F.col("o_orderpriority") == "5-LOW", "holding").when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "unclear").otherwise("final")
    generated = t.orders.select(
        stage.alias("response_stage"), (F.col("o_orderstatus") == "F").alias("redress_warranted"),
        (F.col("o_totalprice") > 150000).alias("timing_in_issue"),
        F.when(F.col("o_custkey") % 5 == 0, True).alias("vulnerability_present"),
        F.when(F.col("o_custkey") % 3 != 0, "hard").alias("difficulty"),
    )
    filled = curation.scenario_defaults(generated)
    return curation.frequency_summary(filled, ["response_stage", "difficulty"], "required_response_elements")


@query("element_lists", """
SELECT o_orderkey, array_to_string(list_filter([
  'acknowledgement', CASE WHEN o_orderstatus <> 'O' THEN 'decision_and_reasons' END, CASE WHEN o_orderstatus <> 'O' THEN 'fos_referral_rights' END,
  CASE WHEN o_orderstatus <> 'O' THEN 'six_month_referral_limit' END, CASE WHEN o_totalprice > 150000 THEN 'eight_week_timeline' END,
  'fair_treatment', CASE WHEN o_orderstatus = 'F' THEN 'redress_consideration' END,
  CASE WHEN o_custkey % 5 = 0 THEN 'vulnerability_consideration' END], lambda x: x IS NOT NULL), '|') AS elements
FROM orders""")
def element_lists(t):
    status = F.col("o_orderstatus")
    elements = curation.required_elements(
        F.when(status != "O", "final").otherwise("holding"), status == "F", F.col("o_totalprice") > 150000, F.col("o_custkey") % 5 == 0
    )
    return t.orders.select("o_orderkey", F.array_join(elements, "|").alias("elements"))


@query("curation_gate", """
WITH e AS (SELECT event_id AS ord, event_type || ':' || user_id AS seed_id, event_type, (props->>'k')::INT AS k FROM events),
l AS (SELECT seed_id, min(ord) AS ord, arg_max(event_type, ord) AS complaint_type, arg_max(k, ord) AS k FROM e GROUP BY seed_id),
g AS (SELECT *, CASE WHEN k % 11 = 0 THEN 'error' WHEN k % 4 <> 0 AND k % 5 <> 0 THEN 'pass' ELSE 'fail' END AS verdict FROM l),
n AS (SELECT *, row_number() OVER (ORDER BY ord) AS n FROM g WHERE verdict = 'pass')
SELECT CASE WHEN n < 1000 THEN 'c' || lpad(n::VARCHAR, 3, '0') ELSE 'c' || n END AS scenario_id, seed_id, complaint_type, k, ord FROM n""")
def curation_gate(t):
    """Events as critic results: last record per seed, gated, renumbered in first-seen order."""
    k = F.col("k")
    def mark(ok):
        return F.when(ok, "pass").otherwise("fail")
    rows = t.events.select(
        F.col("event_id").alias("ord"), F.concat_ws(":", "event_type", F.col("user_id").cast("string")).alias("seed_id"),
        F.col("event_type").alias("complaint_type"), _k().alias("k"),
    )
    critic = F.struct(mark(k % 4 != 0).alias("realism"), mark(k % 5 != 0).alias("provisions_correct"))
    judged = curation.last_per_seed(rows).withColumn("critic", F.when(k % 11 != 0, critic))
    passed = curation.gate_scenarios(judged).where("verdict = 'pass'")
    return curation.renumber(passed, "c", "scenario_id").select("scenario_id", "seed_id", "complaint_type", "k", "ord")


@query("question_gate", """
WITH e AS (SELECT event_id, event_type AS difficulty, (props->>'k')::INT AS k FROM events),
g AS (SELECT *, CASE WHEN k % 7 = 0 OR k % 3 <> 0 THEN 'pass' ELSE 'fail' END AS gate,
             k % 7 <> 0 AND k % 3 <> 0 AND k % 2 = 0 AND difficulty <> 'view' AS override FROM e)
SELECT gate, CASE WHEN override THEN 'view' ELSE difficulty END AS difficulty,
       CASE WHEN override THEN difficulty END AS difficulty_original,
       CASE WHEN k % 7 = 0 THEN 'error' WHEN k % 3 <> 0 THEN 'pass' ELSE 'fail' END AS critic_verdict, count(*) AS n
FROM g GROUP BY ALL""")
def question_gate(t):
    """Events as question candidates with a critic who suggests one difficulty."""
    k = F.col("k")
    critic = F.struct(
        F.when(k % 3 != 0, "pass").otherwise("fail").alias("verdict"), (k % 2 != 0).alias("difficulty_reasonable"),
        F.lit("view").alias("suggested_difficulty"),
    )
    rows = t.events.select(F.col("event_type").alias("difficulty"), _k().alias("k")).withColumn("critic", F.when(k % 7 != 0, critic))
    gated = curation.gate_questions(rows)
    return gated.groupBy("gate", "difficulty", "difficulty_original", "critic_verdict").agg(F.count("*").alias("n"))


@query("source_material", """
WITH r AS (SELECT l_orderkey, generate_subscripts(s, 1) AS i, unnest(s) AS id FROM (
  SELECT DISTINCT l_orderkey, [l_orderkey % n, (l_orderkey * 7) % n] AS s
  FROM lineitem, (SELECT count(*) + count(*) // 4 AS n FROM documents)))
SELECT l_orderkey, md5(string_agg('### ' || id || chr(10) || CASE WHEN d.text IS NULL THEN '[seed text unavailable]'
  WHEN len(d.text) > 5000 THEN substr(d.text, 1, 5000) || chr(10) || chr(10) || '[... truncated ...]' ELSE d.text END,
  chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY i)) AS material_md5
FROM r LEFT JOIN documents d ON d.doc_id = r.id GROUP BY l_orderkey""")
def source_material(t):
    """Source blocks per order; documents past the end of the table are missing texts."""
    from ragspark import fixed

    size = t.documents.count()
    n = size + size // 4
    rows = t.lineitem.select("l_orderkey").distinct().withColumn(
        "sections", F.array(F.col("l_orderkey") % n, F.col("l_orderkey") * 7 % n).cast("array<string>")
    )
    texts = t.documents.select(F.col("doc_id").cast("string").alias("section_id"), "text")
    blocks = curation.source_blocks(
        rows, "l_orderkey", "sections", texts, limit=fixed.SECTION_PROMPT_CHARS, missing=fixed.SEED_TEXT_MISSING
    )
    return blocks.select("l_orderkey", F.md5("source_material").alias("material_md5"))
