"""Scores of runs. Every frame is long: one row per retrieved chunk, citation, verdict or claim.

The set metrics share one shape. Both sides are unioned, counted per (run, item)
and then per run, so copies of an item are combined before the shuffle and no
run's items are ever collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragspark import fixed
from ragspark.functions.numbers import call_cost, f1, model_id, ratio, share
from ragspark.functions.provisions import chunk_section, defined_provisions, provision_key
from ragspark.operators.ranking import latency_stats

# --- provisions -----------------------------------------------------------------


def _sides(left: DataFrame, right: DataFrame, keys: list[str], item: str) -> DataFrame:
    """(keys, item, n_left, n_right): multiplicity of an item on each side."""
    one, none = F.lit(1), F.lit(0)
    both = left.select(*keys, item, one.alias("_l"), none.alias("_r")).unionByName(
        right.select(*keys, item, none.alias("_l"), one.alias("_r"))
    )
    return both.groupBy(*keys, item).agg(F.sum("_l").alias("n_left"), F.sum("_r").alias("n_right"))


def _keyed(refs: DataFrame, keys: list[str]) -> DataFrame:
    return refs.select(*keys, provision_key(F.col("provision")).alias("provision"))


def citation_outcomes(cited: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """Per (run, provision key): matched, cited_not_expected or expected_not_cited."""
    sides = _sides(_keyed(cited, keys), _keyed(expected, keys), keys, "provision")
    known = F.col("provision").isNotNull()
    outcome = (
        F.when(known & (F.col("n_left") > 0) & (F.col("n_right") > 0), "matched")
        .when(known & (F.col("n_left") > 0), "cited_not_expected")
        .when(known & (F.col("n_right") > 0), "expected_not_cited")
    )
    # A filter on the key itself would move below the counts and compute every key twice.
    return sides.select(*keys, "provision", outcome.alias("outcome")).where(F.col("outcome").isNotNull())


def _counts(sides: DataFrame, keys: list[str], left: str, right: str, matched: str) -> DataFrame:
    """Distinct items per side; references without a key count nowhere."""
    known = F.col("provision").isNotNull()
    has_left, has_right = known & (F.col("n_left") > 0), known & (F.col("n_right") > 0)
    return sides.groupBy(*keys).agg(
        F.count_if(has_left).alias(left), F.count_if(has_right).alias(right),
        F.count_if(has_left & has_right).alias(matched),
    )


def citation_scores(cited: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """Precision, recall and F1 of cited provision sets."""
    sides = _sides(_keyed(cited, keys), _keyed(expected, keys), keys, "provision")
    n = _counts(sides, keys, "n_cited", "n_expected", "n_matched")
    precision, recall = ratio(F.col("n_matched"), F.col("n_cited")), ratio(F.col("n_matched"), F.col("n_expected"))
    return n.select(
        *keys, "n_cited", "n_expected", "n_matched",
        precision.alias("precision"), recall.alias("recall"), f1(precision, recall).alias("f1"),
    )


def retrieved_provision_scores(retrieved: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """Recall of expected provisions over rule text present in the retrieved ``content``."""
    present = retrieved.select(*keys, F.explode_outer(defined_provisions(F.col("content"))).alias("provision"))
    sides = _sides(present, _keyed(expected, keys), keys, "provision")
    n = _counts(sides, keys, "n_in_text", "n_expected", "n_present")
    return n.withColumn("recall", ratio(F.col("n_present"), F.col("n_expected")))


#: Sides a reference of a run can be seen on, as bits.
CITED, EXPECTED, IN_TEXT = 1, 2, 4


def marked(refs: DataFrame, keys: list[str], side: int) -> DataFrame:
    """References ``(keys, provision)`` by key, on one side."""
    return _keyed(refs, keys).withColumn("sides", F.lit(side))


def marked_text(retrieved: DataFrame, keys: list[str]) -> DataFrame:
    """Provisions whose rule text is in the retrieved ``content``."""
    found = retrieved.select(*keys, F.explode_outer(defined_provisions(F.col("content"))).alias("provision"))
    return found.withColumn("sides", F.lit(IN_TEXT))


def provision_scores(marks: DataFrame, keys: list[str]) -> DataFrame:
    """Citation scores, text recall and drafting gap per run, from one table ``(keys, provision, sides)``.

    The sides of a provision are merged bitwise, map-side first, so each input is read once and moves at most one row a run and
    provision. A run has a row if any side does; a null provision counts nowhere.
    """
    merged = marks.groupBy(*keys, "provision").agg(F.bit_or("sides").alias("sides"))
    on = lambda bits: F.col("provision").isNotNull() & (F.col("sides").bitwiseAND(bits) == bits)
    n = merged.groupBy(*keys).agg(
        F.count_if(on(CITED)).alias("n_cited"), F.count_if(on(EXPECTED)).alias("n_expected"), F.count_if(on(IN_TEXT)).alias("n_in_text"),
        F.count_if(on(CITED | EXPECTED)).alias("n_matched"), F.count_if(on(IN_TEXT | EXPECTED)).alias("n_present"),
    )
    precision, recall = ratio(F.col("n_matched"), F.col("n_cited")), ratio(F.col("n_matched"), F.col("n_expected"))
    text = ratio(F.col("n_present"), F.col("n_expected"))
    return n.select(
        "*", precision.alias("precision"), recall.alias("citation_recall"), f1(precision, recall).alias("f1"),
        text.alias("text_recall"), (text - recall).alias("drafting_gap"),
    )


def drafting_gap(text_scores: DataFrame, citation: DataFrame, keys: list[str]) -> DataFrame:
    """Retrieved-text recall minus citation recall."""
    joined = text_scores.select(*keys, F.col("recall").alias("text_recall")).join(
        citation.select(*keys, F.col("recall").alias("citation_recall")), keys, "full"
    )
    text, cited = F.coalesce("text_recall", F.lit(0.0)), F.coalesce("citation_recall", F.lit(0.0))
    return joined.select(
        *keys, text.alias("text_recall"), cited.alias("citation_recall"), (text - cited).alias("drafting_gap")
    )


# --- sections ---------------------------------------------------------------------


def section_scores(retrieved: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """Section precision over chunks and section recall over distinct expected sections.

    ``retrieved(keys, chunk_id, section)``, ``expected(keys, section)``.
    """
    found = retrieved.select(*keys, chunk_section(F.col("section"), F.col("chunk_id").cast("string")).alias("section"))
    sides = _sides(found, expected, keys, "section")
    wanted = (F.col("n_right") > 0) & F.col("section").isNotNull()
    n = sides.groupBy(*keys).agg(
        F.sum("n_left").alias("n_retrieved"),
        F.sum(F.when(wanted, F.col("n_left")).otherwise(0)).alias("n_relevant"),
        F.count_if(wanted).alias("n_expected"),
        F.count_if(wanted & (F.col("n_left") > 0)).alias("n_matched"),
    )
    return n.withColumns({
        "precision": ratio(F.col("n_relevant"), F.col("n_retrieved")),
        "recall": ratio(F.col("n_matched"), F.col("n_expected")),
    })


def sections_in_rank_order(retrieved: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct sections of a run with the rank at which each first appears."""
    section = chunk_section(F.col("section"), F.col("chunk_id").cast("string"))
    named = retrieved.select(*keys, "rank", section.alias("section")).where(F.col("section").isNotNull())
    return named.groupBy(*keys, "section").agg(F.min("rank").alias("first_rank"))


# --- question answering -------------------------------------------------------------


def chunk_is_relevant(source_sections: Column, chunk_id: Column, section: Column, title: Column, source: Column) -> Column:
    """Whether a retrieved chunk belongs to one of the ground-truth sections of its run."""
    def hit(wanted):
        slug = F.replace(wanted, F.lit("synthetic_"), F.lit(""))
        words = F.lower(F.replace(slug, F.lit("-"), F.lit(" ")))
        policy = chunk_id.contains(slug) | ((source == "synthetic") & F.contains(F.lower(title), words))
        regulation = (section == wanted) | F.contains(chunk_id, F.concat(F.lit("/"), wanted))
        return F.coalesce(F.when(wanted.startswith("synthetic_"), policy).otherwise(regulation), F.lit(False))
    return F.exists(source_sections, hit)


def hit_scores(retrieved: DataFrame, keys: list[str]) -> DataFrame:
    """Precision@k and recall@k from ``retrieved(keys, chunk_id, is_relevant)``.

    Relevant chunks count once, k counts rows. A run may carry ``n_truth``, the
    size of its known relevant set; without it recall is 1 on any hit.
    """
    per_chunk = retrieved.groupBy(*keys, "chunk_id").agg(
        F.count("*").alias("_rows"), F.max("is_relevant").alias("_hit"),
        *([F.max("n_truth").alias("_truth")] if "n_truth" in retrieved.columns else []),
    )
    truth = F.max("_truth") if "n_truth" in retrieved.columns else F.greatest(F.count_if("_hit"), F.lit(1))
    n = per_chunk.groupBy(*keys).agg(
        F.sum("_rows").alias("k"), F.count_if("_hit").alias("relevant_retrieved"), truth.alias("total_relevant")
    )
    return n.withColumns({
        "precision_at_k": ratio(F.col("relevant_retrieved"), F.col("k")),
        "recall_at_k": ratio(F.col("relevant_retrieved"), F.col("total_relevant")),
    })


def answer_citation_scores(citations: DataFrame, retrieved: DataFrame, keys: list[str]) -> DataFrame:
    """Citation precision and recall with list semantics: repeated citations count.

    ``citations(keys, chunk_id)``, ``retrieved(keys, chunk_id, is_relevant)``.
    """
    both = citations.select(*keys, "chunk_id", F.lit(1).alias("_c"), F.lit(0).alias("_r"), F.lit(False).alias("_rel")).unionByName(
        retrieved.select(*keys, "chunk_id", F.lit(0).alias("_c"), F.lit(1).alias("_r"), F.col("is_relevant").alias("_rel"))
    )
    item = both.groupBy(*keys, "chunk_id").agg(F.sum("_c").alias("c"), F.max("_r").alias("r"), F.max("_rel").alias("rel"))
    n = item.groupBy(*keys).agg(
        F.sum("c").alias("total_citations"),
        F.sum(F.when(F.col("r") > 0, F.col("c")).otherwise(0)).alias("valid_citations"),
        F.sum(F.when(F.col("rel"), F.col("c")).otherwise(0)).alias("_cited_relevant"),
        F.count_if("rel").alias("_relevant"),
    )
    return n.select(
        *keys, "total_citations", "valid_citations",
        ratio(F.col("valid_citations"), F.col("total_citations")).alias("citation_precision"),
        ratio(F.col("_cited_relevant"), F.col("_relevant")).alias("citation_recall"),
    )


# --- claims -------------------------------------------------------------------------


def grounding_scores(claims: DataFrame, keys: list[str], by_field: bool = False) -> DataFrame:
    """Grounded, partial and ungrounded shares, optionally per source field (the drift view)."""
    label = F.col("grounding")
    aggs = [
        F.count("*").alias("total_claims"),
        share(label == "GROUNDED").alias("grounded_pct"),
        share(label == "PARTIALLY_GROUNDED").alias("partially_grounded_pct"),
        share(label == "UNGROUNDED").alias("ungrounded_pct"),
        share(label == "UNGROUNDED").alias("hallucination_rate"),
    ]
    for field in fixed.SOURCE_FIELDS if by_field else []:
        here = F.col("source_field") == field
        for name in ("GROUNDED", "UNGROUNDED"):
            aggs.append(
                F.coalesce(F.avg(F.when(here, (label == name).cast("double"))), F.lit(0.0))
                .alias(f"{name.lower()}_pct_{field.split('_')[0]}")
            )
    return claims.groupBy(*keys).agg(*aggs)


def claim_agreement(primary: DataFrame, secondary: DataFrame, keys: list[str]) -> DataFrame:
    """Share of positions on which two judges agree, over the shorter list.

    Both sides are ``(keys, idx, grounding)``. Runs without a common position score 0.
    """
    def code(df):
        return df.select(*keys, "idx", F.array_position(F.array(*[F.lit(g) for g in fixed.GROUNDING_LABELS]), F.col("grounding")).alias("_g"))

    # Labels travel as numbers: maxima of numbers stay in hash aggregation, maxima of strings sort.
    none = F.lit(None).cast("long")
    both = code(primary).withColumnRenamed("_g", "_p").withColumn("_s", none).unionByName(
        code(secondary).withColumnRenamed("_g", "_s").withColumn("_p", none)
    )
    at = both.groupBy(*keys, "idx").agg(F.max("_p").alias("p"), F.max("_s").alias("s"))
    paired = F.col("p").isNotNull() & F.col("s").isNotNull()
    return at.groupBy(*keys).agg(
        F.count_if(paired).alias("n_compared"),
        ratio(F.count_if(F.col("p") == F.col("s")), F.count_if(paired)).alias("agreement"),
    )


# --- rubric -------------------------------------------------------------------------


def defined_elements(required: DataFrame, rubric: DataFrame) -> DataFrame:
    """Required elements that the rubric defines, with their definition, order kept.

    The planner broadcasts the rubric if its size allows; unknown keys drop out here, so the judge's
    denominator is the result of this join.
    """
    return required.join(rubric.withColumnRenamed("key", "element"), "element")


_STATUSES = list(fixed.COVERAGE_WEIGHTS)


def _dated(status: Column, idx: Column) -> Column:
    """Position and status of a verdict in one number, so that the last verdict is a maximum."""
    code = F.array_position(F.array(*[F.lit(s) for s in _STATUSES]), status)
    return idx.cast("long") * 4 + code


def _status(dated: Column) -> Column:
    """Status of the last verdict; MISSING without one."""
    code = F.pmod(dated, F.lit(4)).cast("int")
    found = F.try_element_at(F.array(*[F.lit(s) for s in _STATUSES]), F.nullif(code, F.lit(0)))
    return F.coalesce(found, F.lit("MISSING"))


def element_status(required: DataFrame, verdicts: DataFrame, keys: list[str]) -> DataFrame:
    """Status of each required element: the last verdict, MISSING without one.

    ``required(keys, element)``, ``verdicts(keys, idx, element, status)``.
    """
    both = required.select(*keys, "element", F.lit(True).alias("_req"), F.lit(None).cast("long").alias("_v")).unionByName(
        verdicts.select(*keys, "element", F.lit(False).alias("_req"), _dated(F.col("status"), F.col("idx")).alias("_v"))
    )
    last = both.groupBy(*keys, "element").agg(F.max("_req").alias("_req"), F.max("_v").alias("_v"))
    return last.where("_req").select(*keys, "element", _status(F.col("_v")).alias("status"))


def rubric_scores(required: DataFrame, verdicts: DataFrame, keys: list[str]) -> DataFrame:
    """Weighted coverage with present, partial and missing counts."""
    weight = F.lit(0.0)
    for status, w in fixed.COVERAGE_WEIGHTS.items():
        weight = F.when(F.col("status") == status, F.lit(w)).otherwise(weight)
    return element_status(required, verdicts, keys).groupBy(*keys).agg(
        F.count("*").alias("n_required"),
        *[F.count_if(F.col("status") == s).alias(f"{s.lower()}_count") for s in fixed.COVERAGE_WEIGHTS],
        F.coalesce(F.avg(weight), F.lit(0.0)).alias("coverage"),
    )


def rubric_agreement(required: DataFrame, primary: DataFrame, secondary: DataFrame, keys: list[str]) -> DataFrame:
    """Share of required elements with the same status; 0 unless both judges returned verdicts."""
    none = F.lit(None).cast("long")

    def side(df, judge):
        dated = _dated(F.col("status"), F.col("idx"))
        return df.select(*keys, "element", F.lit(False).alias("_req"), *[(dated if j == judge else none).alias(j) for j in ("a", "b")])
    asked = required.select(*keys, "element", F.lit(True).alias("_req"), none.alias("a"), none.alias("b"))
    both = asked.unionByName(side(primary, "a")).unionByName(side(secondary, "b"))
    item = both.groupBy(*keys, "element").agg(F.max("_req").alias("_req"), F.max("a").alias("a"), F.max("b").alias("b"))
    same = _status(F.col("a")) == _status(F.col("b"))
    judged = F.max(F.col("a").isNotNull()) & F.max(F.col("b").isNotNull())
    return item.groupBy(*keys).agg(
        F.when(judged, ratio(F.count_if(F.col("_req") & same), F.count_if("_req"))).otherwise(0.0).alias("agreement")
    )


# --- cost and aggregates --------------------------------------------------------------


def run_costs(calls: DataFrame, keys: list[str], labels: list[str], prices=None) -> DataFrame:
    """Cost per run, in total and per call label. ``calls(keys, label, model, input_tokens, output_tokens)``."""
    cost = call_cost(model_id(F.col("model")), F.col("input_tokens"), F.col("output_tokens"), prices)
    return calls.withColumn("_cost", cost).groupBy(*keys).agg(
        F.sum("_cost").alias("total_cost"),
        *[F.coalesce(F.sum(F.when(F.col("label") == name, F.col("_cost"))), F.lit(0.0)).alias(f"{name}_cost") for name in labels],
    )


DRAFTING_MEANS = [
    "coverage", "section_precision", "section_recall", "citation_precision", "citation_recall",
    "retrieved_provision_recall", "drafting_gap", "grounded_pct", "grounded_pct_customer", "ungrounded_pct",
    "inter_judge_agreement",
]


def drafting_aggregate(metrics: DataFrame) -> DataFrame:
    """Means per configuration with the median latency; failed records are left out."""
    ok = metrics.where(F.col("error").isNull()) if "error" in metrics.columns else metrics
    means = ok.groupBy("config_label").agg(
        F.count("*").alias("n_scenarios"),
        *[F.avg(c).alias(f"{c}_mean") for c in DRAFTING_MEANS],
        F.avg("total_cost").alias("cost_per_scenario_mean"),
    )
    latency = latency_stats(ok, ["config_label"], "latency_ms").select(
        "config_label", F.col("median_ms").alias("latency_p50_ms")
    )
    return means.join(latency, "config_label", "left")


def qa_aggregate(metrics: DataFrame) -> DataFrame:
    """Question-answering means per configuration; agreement averages only values above zero."""
    ok = metrics.where(F.col("error").isNull()) if "error" in metrics.columns else metrics
    agreement = F.col("inter_judge_agreement")
    means = ok.groupBy("config_label").agg(
        F.count("*").alias("n_queries"),
        F.avg("precision_at_k").alias("retrieval_precision_mean"),
        F.avg("recall_at_k").alias("retrieval_recall_mean"),
        F.avg("grounded_pct").alias("grounded_pct_mean"),
        F.avg("ungrounded_pct").alias("ungrounded_pct_mean"),
        F.avg("citation_precision").alias("citation_precision_mean"),
        F.avg("total_cost").alias("cost_per_query_mean"),
        F.coalesce(F.avg(F.when(agreement > 0, agreement)), F.lit(0.0)).alias("inter_judge_agreement"),
    )
    return means.join(latency_stats(ok, ["config_label"], "latency_ms").drop("n"), "config_label", "left")


def percent(value: Column, signed: bool = False) -> Column:
    """One-decimal percentage."""
    return F.format_string(("%+.1f" if signed else "%.1f") + "%%", value * 100)


def drafting_comparison(aggregate: DataFrame) -> DataFrame:
    """One Markdown table row per configuration."""
    cells = [
        F.col("config_label"), percent(F.col("coverage_mean")), percent(F.col("section_precision_mean")),
        F.concat_ws(" / ", percent(F.col("citation_precision_mean")), percent(F.col("citation_recall_mean"))),
        percent(F.col("retrieved_provision_recall_mean")), percent(F.col("drafting_gap_mean"), signed=True),
        percent(F.col("grounded_pct_mean")), percent(F.col("inter_judge_agreement_mean")),
    ]
    return aggregate.select("config_label", F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def qa_comparison(aggregate: DataFrame) -> DataFrame:
    cells = [
        F.col("config_label"), percent(F.col("retrieval_precision_mean")), percent(F.col("retrieval_recall_mean")),
        percent(F.col("grounded_pct_mean")), percent(F.col("ungrounded_pct_mean")),
        percent(F.col("citation_precision_mean")), F.format_string("%.0fms", "median_ms"),
        F.format_string("$%.4f", "cost_per_query_mean"), percent(F.col("inter_judge_agreement")),
    ]
    return aggregate.select("config_label", F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))
