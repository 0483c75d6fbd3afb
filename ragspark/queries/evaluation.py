"""Evaluation metrics on ``events``, ``conversations``, ``labels``, ``lineitem`` and ``orders``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ragspark import fixed
from ragspark.functions import responses
from ragspark.functions.numbers import usage
from ragspark.functions.text import strip
from ragspark.operators import metrics, reports
from ragspark.operators.ranking import latency_stats
from ragspark.queries.registry import query

ELEMENTS = "[" + ", ".join(f"'{e}'" for e in fixed.REQUIRED_ELEMENTS) + "]"

# An event is a verdict: its user is the run, k picks the element, the type the status.
VERDICTS_SQL = f"""
v AS (SELECT user_id AS run_id, event_id AS idx, (props->>'k')::INT AS k, {ELEMENTS}[(props->>'k')::INT % 8 + 1] AS element,
             CASE event_type WHEN 'click' THEN 'PRESENT' WHEN 'view' THEN 'PARTIAL' WHEN 'signup' THEN 'PRESENT' ELSE 'MISSING' END AS status
      FROM events),
req AS (SELECT DISTINCT u.user_id AS run_id, {ELEMENTS}[e + 1] AS element
        FROM (SELECT DISTINCT user_id FROM events) u, range(8) r(e) WHERE (u.user_id + e) % 3 <> 0)
"""


def _k():
    return F.get_json_object("props", "$.k").cast("int")


def _verdicts(t):
    names = F.array(*[F.lit(e) for e in fixed.REQUIRED_ELEMENTS])
    kind = F.col("event_type")
    raw = (
        F.when(kind == "click", "present").when(kind == "view", "Partial").when(kind == "signup", "PRESENT")
        .when(kind == "error", " present ").otherwise("weird")
    )
    return t.events.select(
        F.col("user_id").alias("run_id"), F.col("event_id").alias("idx"), _k().alias("k"),
        F.element_at(names, _k() % 8 + 1).alias("element"), responses.status_label(raw).alias("status"),
    )


def _required(t):
    names = F.array(*[F.lit(e) for e in fixed.REQUIRED_ELEMENTS])
    runs = t.events.select(F.col("user_id").alias("run_id")).distinct()
    return runs.select("run_id", F.posexplode(names).alias("e", "element")).where((F.col("run_id") + F.col("e")) % 3 != 0).drop("e")


@query("rubric_coverage", f"""
WITH {VERDICTS_SQL},
last AS (SELECT run_id, element, arg_max(status, idx) AS status FROM v GROUP BY ALL),
s AS (SELECT r.run_id, coalesce(l.status, 'MISSING') AS status FROM req r LEFT JOIN last l USING (run_id, element))
SELECT run_id, count(*) AS n_required, count_if(status = 'PRESENT')::BIGINT AS present_count, count_if(status = 'PARTIAL')::BIGINT AS partial_count,
       count_if(status = 'MISSING')::BIGINT AS missing_count,
       round(avg(CASE status WHEN 'PRESENT' THEN 1.0 WHEN 'PARTIAL' THEN 0.5 ELSE 0.0 END), 6) AS coverage
FROM s GROUP BY run_id""")
def rubric_coverage(t):
    scores = metrics.rubric_scores(_required(t), _verdicts(t), ["run_id"])
    return scores.withColumn("coverage", F.round("coverage", 6))


@query("rubric_agreement", f"""
WITH {VERDICTS_SQL},
a AS (SELECT run_id, element, arg_max(status, idx) AS status FROM v WHERE k < 50 GROUP BY ALL),
b AS (SELECT run_id, element, arg_max(status, idx) AS status FROM v WHERE k >= 50 GROUP BY ALL)
SELECT r.run_id, round(avg((coalesce(a.status, 'MISSING') = coalesce(b.status, 'MISSING'))::INT)
       * (r.run_id IN (SELECT run_id FROM a) AND r.run_id IN (SELECT run_id FROM b))::INT, 6) AS agreement
FROM req r LEFT JOIN a USING (run_id, element) LEFT JOIN b USING (run_id, element) GROUP BY r.run_id""")
def rubric_agreement(t):
    """Two rubric judges: k below and from fifty."""
    v = _verdicts(t)
    scores = metrics.rubric_agreement(_required(t), v.where("k < 50"), v.where("k >= 50"), ["run_id"])
    return scores.withColumn("agreement", F.round("agreement", 6))


# Sentences of a turn are claims, graded by their length.
CLAIMS_SQL = r"""
c AS (
  SELECT conv_id, turn, role, generate_subscripts(p, 1) - 1 AS idx, unnest(p) AS s
  FROM (SELECT *, list_filter(string_split(text, '.'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g') <> '') AS p FROM conversations)),
g AS (SELECT conv_id, turn, role, idx, CASE len(s) % 4 WHEN 0 THEN 'GROUNDED' WHEN 1 THEN 'PARTIALLY_GROUNDED' ELSE 'UNGROUNDED' END AS grounding FROM c)
"""


def _claims(t):
    kept = F.filter(F.split("text", r"\."), lambda s: strip(s) != "")
    sentences = t.conversations.select("conv_id", "turn", "role", F.posexplode_outer(kept).alias("idx", "s")).where(F.col("s").isNotNull())
    n = F.length("s") % 4
    raw = F.when(n == 0, "grounded").when(n == 1, "partially grounded").when(n == 2, "UNGROUNDED").otherwise("nonsense")
    field = F.when(F.col("role") == "assistant", "handler_answer").when(F.col("role") == "user", " customer_draft").otherwise("both")
    return sentences.select(
        "conv_id", "turn", "idx", responses.grounding_label(raw).alias("grounding"),
        responses.source_field_label(field).alias("source_field"),
    )


@query("grounding_rates", f"""
WITH {CLAIMS_SQL}
SELECT conv_id, count(*) AS total_claims, round(avg((grounding = 'GROUNDED')::INT), 6) AS grounded_pct,
       round(avg((grounding = 'PARTIALLY_GROUNDED')::INT), 6) AS partially_grounded_pct,
       round(avg((grounding = 'UNGROUNDED')::INT), 6) AS ungrounded_pct, round(avg((grounding = 'UNGROUNDED')::INT), 6) AS hallucination_rate,
       round(coalesce(avg((grounding = 'GROUNDED')::INT) FILTER (role = 'assistant'), 0), 6) AS grounded_pct_handler,
       round(coalesce(avg((grounding = 'UNGROUNDED')::INT) FILTER (role = 'assistant'), 0), 6) AS ungrounded_pct_handler,
       round(coalesce(avg((grounding = 'GROUNDED')::INT) FILTER (role = 'user'), 0), 6) AS grounded_pct_customer,
       round(coalesce(avg((grounding = 'UNGROUNDED')::INT) FILTER (role = 'user'), 0), 6) AS ungrounded_pct_customer
FROM g GROUP BY conv_id""")
def grounding_rates(t):
    scores = metrics.grounding_scores(_claims(t), ["conv_id"], by_field=True)
    return scores.select("conv_id", "total_claims", *[F.round(c, 6).alias(c) for c in scores.columns[2:]])


@query("claim_agreement", f"""
WITH {CLAIMS_SQL},
p AS (SELECT conv_id, turn // 2 AS pair, idx, grounding FROM g WHERE turn % 2 = 0),
s AS (SELECT conv_id, turn // 2 AS pair, idx, grounding FROM g WHERE turn % 2 = 1),
b AS (SELECT coalesce(p.conv_id, s.conv_id) AS conv_id, coalesce(p.pair, s.pair) AS pair, p.grounding AS a, s.grounding AS b
      FROM p FULL JOIN s ON p.conv_id = s.conv_id AND p.pair = s.pair AND p.idx = s.idx)
SELECT conv_id, pair, count_if(a IS NOT NULL AND b IS NOT NULL)::BIGINT AS n_compared,
       round(coalesce(count_if(a = b) / nullif(count_if(a IS NOT NULL AND b IS NOT NULL), 0), 0.0), 6) AS agreement
FROM b GROUP BY conv_id, pair""")
def claim_agreement(t):
    """Even turns against odd turns, claim by claim."""
    claims = _claims(t).withColumn("pair", F.floor(F.col("turn") / 2))
    scores = metrics.claim_agreement(claims.where("turn % 2 = 0"), claims.where("turn % 2 = 1"), ["conv_id", "pair"])
    return scores.select("conv_id", "pair", "n_compared", F.round("agreement", 6).alias("agreement"))


@query("label_agreement", """
SELECT d.source AS run_id, count(*) AS n_required, round(avg((quality = 1 - toxic)::INT), 6) AS agreement
FROM labels l JOIN documents d USING (doc_id) GROUP BY d.source""")
def label_agreement(t):
    """Two judges over labelled documents: quality, and absence of toxicity."""
    rows = t.labels.join(t.documents.select("doc_id", F.col("source").alias("run_id")), "doc_id").select(
        "run_id", F.col("doc_id").alias("element"), F.col("doc_id").alias("idx"),
        F.when(F.col("quality") == 1, "PRESENT").otherwise("MISSING").alias("a"),
        F.when(F.col("toxic") == 0, "PRESENT").otherwise("MISSING").alias("b"),
    )
    required = rows.select("run_id", "element")
    scores = metrics.rubric_agreement(
        required, rows.withColumnRenamed("a", "status"), rows.withColumnRenamed("b", "status"), ["run_id"]
    )
    sizes = required.groupBy("run_id").agg(F.count("*").alias("n_required"))
    return sizes.join(scores, "run_id").select("run_id", "n_required", F.round("agreement", 6).alias("agreement"))


@query("tolerant_json", """
WITH e AS (SELECT event_id, event_type, (props->>'k')::INT AS k FROM events)
SELECT event_type, count(*) AS n_responses, sum(CASE WHEN event_id % 5 < 4 THEN 2 ELSE 0 END)::BIGINT AS n_items,
       count_if(event_id % 5 = 4)::BIGINT AS n_unreadable, sum(CASE WHEN event_id % 5 < 4 THEN k ELSE 0 END)::BIGINT AS sum_k,
       count_if(event_id % 5 < 4 AND k % 3 = 0)::BIGINT AS n_present
FROM e GROUP BY event_type""")
def tolerant_json(t):
    """Responses wrapped in fences, preambles and noise, parsed back into objects."""
    body = F.concat(
        F.lit('[{"element": "x", "status": "'), F.when(_k() % 3 == 0, "present").otherwise("partial"), F.lit('", "k": '),
        _k(), F.lit('}, "junk", 42, '), F.col("props"), F.lit("]"),
    )
    form = F.col("event_id") % 5
    raw = (
        F.when(form == 0, body).when(form == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(form == 2, F.concat(F.lit("Here you go:\n"), body, F.lit("\nHope that helps.")))
        .when(form == 3, F.concat(F.lit("  ```\n"), body, F.lit("\n```  "))).otherwise(F.concat(F.lit("no list: "), F.col("props")))
    )
    read = t.spread("events").select("event_type", responses.json_items(raw).alias("items"))
    first_k = F.coalesce(F.try_variant_get(F.get("items", F.lit(0)), "$.k", "int"), F.lit(0))
    first = F.get(responses.verdicts_of(F.slice("items", 1, 1)), F.lit(0))
    return read.select(
        "event_type", F.size("items").alias("n"), first_k.alias("k"), (first["status"] == "PRESENT").alias("present"),
    ).groupBy("event_type").agg(
        F.count("*").alias("n_responses"), F.sum("n").cast("long").alias("n_items"), F.count_if(F.col("n") == 0).alias("n_unreadable"),
        F.sum("k").alias("sum_k"), F.count_if("present").alias("n_present"),
    )


PRICES_SQL = ", ".join(f"('{m}', {i}, {o})" for m, (i, o) in fixed.TOKEN_PRICES.items())


@query("usage_cost", f"""
WITH prices(model, pin, pout) AS (VALUES {PRICES_SQL}),
calls AS (
  SELECT l_orderkey AS run_id, CASE WHEN l_linenumber <= 2 THEN 'generation' WHEN l_linenumber <= 4 THEN 'rubric' ELSE 'grounding' END AS label,
         CASE l_returnflag WHEN 'A' THEN '{fixed.MODEL_PRESETS['sonnet']}' WHEN 'N' THEN '{fixed.MODEL_PRESETS['opus']}' ELSE 'unlisted' END AS model,
         l_quantity * 100 AS tin, l_linenumber * 50 AS tout FROM lineitem),
c AS (SELECT run_id, label, tin / 1000 * coalesce(pin, 0) + tout / 1000 * coalesce(pout, 0) AS cost FROM calls LEFT JOIN prices USING (model))
SELECT run_id, round(sum(cost), 6) AS total_cost, round(coalesce(sum(cost) FILTER (label = 'generation'), 0), 6) AS generation_cost,
       round(coalesce(sum(cost) FILTER (label = 'rubric'), 0), 6) AS rubric_cost,
       round(coalesce(sum(cost) FILTER (label = 'grounding'), 0), 6) AS grounding_cost
FROM c GROUP BY run_id""")
def usage_cost(t):
    """Lines as model calls: quantity and line number are the token counts."""
    line = F.col("l_linenumber")
    calls = t.lineitem.select(
        F.col("l_orderkey").alias("run_id"),
        F.when(line <= 2, "generation").when(line <= 4, "rubric").otherwise("grounding").alias("label"),
        F.when(F.col("l_returnflag") == "A", "sonnet").when(F.col("l_returnflag") == "N", "opus").otherwise("unlisted").alias("model"),
        (F.col("l_quantity") * 100).alias("input_tokens"), (line * 50).alias("output_tokens"),
    )
    costs = metrics.run_costs(calls, ["run_id"], ["generation", "rubric", "grounding"])
    return costs.select("run_id", *[F.round(c, 6).alias(c) for c in costs.columns[1:]])


@query("latency_stats", """
WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS pos,
                  count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, max(n) AS n, round(avg(value), 6) AS mean_ms, round(median(value), 6) AS median_ms,
       round(max(CASE WHEN pos = least(floor(n * 0.95), n - 1) THEN value END), 6) AS p95_ms,
       round(min(value), 6) AS min_ms, round(max(value), 6) AS max_ms
FROM r GROUP BY event_type""")
def latency(t):
    stats = latency_stats(t.events, ["event_type"], "value")
    return stats.select("event_type", "n", *[F.round(c, 6).alias(c) for c in stats.columns[2:]])


def _unit(k: str, m: int) -> str:
    return f"(({k} * {m}) % 101) / 100.0"


DRAFTING_COLUMNS = dict(zip([*metrics.DRAFTING_MEANS, "total_cost"], [3, 7, 11, 13, 17, 19, 23, 29, 31, 37, 41, 43]))


@query("config_aggregate_drafting", f"""
WITH e AS (SELECT event_type AS config_label, (props->>'k')::INT AS k, value FROM events WHERE value <= 200)
SELECT config_label, count(*) AS n_scenarios,
       {', '.join(f"round(avg({_unit('k', m)}), 6) AS {c}_mean" for c, m in list(DRAFTING_COLUMNS.items())[:-1])},
       round(avg({_unit('k', 43)}), 6) AS cost_per_scenario_mean, round(median(value), 6) AS latency_p50_ms
FROM e GROUP BY config_label""")
def config_aggregate_drafting(t):
    out = metrics.drafting_aggregate(_drafting_records(t))
    return out.select("config_label", "n_scenarios", *[F.round(c, 6).alias(c) for c in out.columns[2:]])


def _drafting_records(t):
    """Events as scenario records: the type is the arm, slow ones are failed records."""
    e = t.events.withColumn("k", _k())
    return e.select(
        F.col("event_type").alias("config_label"), F.col("value").alias("latency_ms"),
        F.when(F.col("value") > 200, F.lit("timeout")).alias("error"),
        *[F.expr(_unit("k", m)).cast("double").alias(c) for c, m in DRAFTING_COLUMNS.items()],
    )


QA_COLUMNS = {"precision_at_k": 3, "recall_at_k": 7, "grounded_pct": 11, "ungrounded_pct": 13, "citation_precision": 17, "total_cost": 19}


@query("config_aggregate_qa", f"""
WITH e AS (SELECT event_type AS config_label, (props->>'k')::INT AS k, value FROM events WHERE value <= 200),
r AS (SELECT *, row_number() OVER (PARTITION BY config_label ORDER BY value) - 1 AS pos, count(*) OVER (PARTITION BY config_label) AS n FROM e)
SELECT config_label, count(*) AS n_queries, round(avg({_unit('k', 3)}), 6) AS retrieval_precision_mean,
       round(avg({_unit('k', 7)}), 6) AS retrieval_recall_mean, round(avg({_unit('k', 11)}), 6) AS grounded_pct_mean,
       round(avg({_unit('k', 13)}), 6) AS ungrounded_pct_mean, round(avg({_unit('k', 17)}), 6) AS citation_precision_mean,
       round(avg({_unit('k', 19)}), 6) AS cost_per_query_mean,
       round(avg(CASE WHEN k % 4 > 0 THEN (k % 4) / 4.0 END), 6) AS inter_judge_agreement,
       round(avg(value), 6) AS mean_ms, round(median(value), 6) AS median_ms,
       round(max(CASE WHEN pos = least(floor(n * 0.95), n - 1) THEN value END), 6) AS p95_ms,
       round(min(value), 6) AS min_ms, round(max(value), 6) AS max_ms
FROM r GROUP BY config_label""")
def config_aggregate_qa(t):
    e = t.events.withColumn("k", _k())
    records = e.select(
        F.col("event_type").alias("config_label"), F.col("value").alias("latency_ms"),
        F.when(F.col("value") > 200, F.lit("timeout")).alias("error"), (F.col("k") % 4 / 4.0).alias("inter_judge_agreement"),
        *[F.expr(_unit("k", m)).cast("double").alias(c) for c, m in QA_COLUMNS.items()],
    )
    out = metrics.qa_aggregate(records)
    return out.select("config_label", "n_queries", *[F.round(c, 6).alias(c) for c in out.columns[2:]])


COMPARISON_SQL = f"""
WITH e AS (SELECT event_type AS config_label, (props->>'k')::INT AS k FROM events WHERE value <= 200),
a AS (SELECT config_label, {', '.join(f"100 * avg({_unit('k', m)}) AS {c}" for c, m in DRAFTING_COLUMNS.items())},
             100 * avg({_unit('k', 23)}) AS gap FROM e GROUP BY config_label)
SELECT config_label, '| ' || config_label || ' | ' || printf('%.1f%%', coverage) || ' | ' || printf('%.1f%%', section_precision) || ' | '
  || printf('%.1f%%', citation_precision) || ' / ' || printf('%.1f%%', citation_recall) || ' | ' || printf('%.1f%%', retrieved_provision_recall)
  || ' | ' || printf('%+.1f%%', drafting_gap) || ' | ' || printf('%.1f%%', grounded_pct) || ' | ' || printf('%.1f%%', inter_judge_agreement) || ' |' AS line
FROM a"""


@query("comparison_report", f"""
WITH c AS ({COMPARISON_SQL}),
n AS (SELECT event_type, count(*) AS n FROM events WHERE value <= 200 GROUP BY event_type),
lines AS (
  SELECT 0 AS part, '' AS label, '# Drafting evaluation' AS line
  UNION ALL SELECT 1, '', '| {' | '.join(reports.DRAFTING_HEAD)} |' UNION ALL SELECT 2, '', '|' || repeat('---|', {len(reports.DRAFTING_HEAD)})
  UNION ALL SELECT 3, config_label, line FROM c
  UNION ALL SELECT 4, '', 'Scenarios per configuration: ' || arg_min(n, event_type) FROM n)
SELECT row_number() OVER (ORDER BY part, label) AS line_no, line FROM lines""")
def comparison_report(t):
    """The comparison of the arms with its head and sample size."""
    return reports.drafting_report(metrics.drafting_aggregate(_drafting_records(t)))


@query("comparison_lines", COMPARISON_SQL)
def comparison_lines(t):
    """The comparison table of the arms, one Markdown row each."""
    return metrics.drafting_comparison(metrics.drafting_aggregate(_drafting_records(t)))


@query("response_texts", """
SELECT event_type, count(*) AS n, count_if(event_id % 4 = 0)::BIGINT AS n_text, count_if(event_id % 4 = 1)::BIGINT AS n_reasoning,
       count_if(event_id % 4 = 2)::BIGINT AS n_array, sum(CASE WHEN event_id % 3 = 0 THEN 0 ELSE (props->>'k')::INT END)::BIGINT AS output_tokens
FROM events GROUP BY event_type""")
def response_texts(t):
    """Answer text from text blocks, reasoning blocks or an array-like value; usage with defaults."""
    form, none = F.col("event_id") % 4, F.lit(None).cast("string")
    block = F.struct(
        none.alias("type"), F.when(form == 0, F.concat(F.lit("T"), F.col("props"))).alias("text"),
        F.when(form == 1, F.struct(F.struct(F.concat(F.lit("R"), F.col("props")).alias("text")).alias("reasoningText"))).alias("reasoningContent"),
        F.when(form == 2, F.concat(F.lit(" ["), F.col("props"), F.lit("]"))).otherwise(F.lit("plain")).alias("other"),
    )
    used = F.struct(F.lit(1).alias("inputTokens"), F.when(F.col("event_id") % 3 != 0, _k()).alias("outputTokens"), F.lit(1).alias("totalTokens"))
    read = t.events.select("event_type", responses.response_text(F.array(block)).alias("text"), usage(used).alias("u"))
    return read.groupBy("event_type").agg(
        F.count("*").alias("n"), F.count_if(F.col("text").startswith("T")).alias("n_text"), F.count_if(F.col("text").startswith("R")).alias("n_reasoning"),
        F.count_if(F.col("text").startswith(" [")).alias("n_array"), F.sum("u.output_tokens").alias("output_tokens"),
    )
