"""Ground-truth curation: seed plans, gates, de-duplication, numbering, summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragspark import fixed
from ragspark.operators.ranking import number_rows
from ragspark.operators.references import is_core

# --- elements and defaults ------------------------------------------------------------


def required_elements(stage: Column, redress: Column, timing: Column, vulnerable: Column) -> Column:
    """Required response elements in vocabulary order, from stage and flags."""
    final = stage == "final"
    rules = {
        "decision_and_reasons": final, "fos_referral_rights": final, "six_month_referral_limit": final,
        "eight_week_timeline": timing, "redress_consideration": final & redress,
        "vulnerability_consideration": vulnerable,
    }
    chosen = [F.when(rules.get(name, F.lit(True)), F.lit(name)) for name in fixed.REQUIRED_ELEMENTS]
    return F.array_compact(F.array(*chosen))


def scenario_defaults(generated: DataFrame) -> DataFrame:
    """Fill stage, flags and difficulty of generated scenarios and derive their elements."""
    stage = F.when(F.col("response_stage").isin("holding", "final"), F.col("response_stage")).otherwise("final")
    flags = ["redress_warranted", "timing_in_issue", "vulnerability_present"]
    filled = generated.withColumns({
        "response_stage": stage,
        "difficulty": F.coalesce("difficulty", F.lit("medium")),
        **{f: F.coalesce(F.col(f).cast("boolean"), F.lit(False)) for f in flags},
    })
    return filled.withColumn(
        "required_response_elements", required_elements(F.col("response_stage"), *[F.col(f) for f in flags])
    )


def seed_id(complaint_type: Column, sections: Column) -> Column:
    return F.concat(complaint_type, F.lit(":"), F.array_join(F.array_sort(sections), "+"))


# --- seed plan --------------------------------------------------------------------------


def substantive_sections(index: DataFrame, chapters: Mapping[str, Sequence[str]], skip_words: Sequence[str]) -> DataFrame:
    """Core sections of listed chapters whose name holds no stop-word."""
    spark = index.sparkSession
    allowed = spark.createDataFrame([(m, c) for m, cs in chapters.items() for c in cs], "module string, chapter string")
    thin = F.lit(False)
    for word in skip_words:
        thin = thin | F.lower("section_name").contains(word)
    return index.where(is_core(F.col("section_id")) & ~F.coalesce(thin, F.lit(False))).join(
        F.broadcast(allowed), ["module", "chapter"], "left_semi"
    )


def seed_plan(
    index: DataFrame, *, handling: Sequence[str] = fixed.HANDLING_SECTIONS,
    final_response: Sequence[str] = fixed.FINAL_RESPONSE_SECTIONS, escalation: Sequence[str] = fixed.FOS_SECTIONS,
    modules: Sequence[str] = fixed.SUBSTANTIVE_MODULES, chapters: Mapping[str, Sequence[str]] = fixed.SUBSTANTIVE_CHAPTERS,
    skip_words: Sequence[str] = fixed.THIN_SECTION_WORDS, target_multi: int = fixed.TARGET_MULTI,
    target_escalation: int = fixed.TARGET_ESCALATION,
) -> DataFrame:
    """Seeds ``plan_ord, complaint_type, seed_sections, seed_id`` from allow-lists.

    ``index(section_id, module, chapter, section_name)`` may be large. The driver
    learns only which allow-listed sections exist and how many sections each
    listed module offers; the sections themselves are joined in by position.
    """
    spark = index.sparkSession
    steps = target_multi * fixed.MULTI_STEP_LIMIT + 1
    names = sorted({*handling, *final_response, *escalation})
    found = {r[0] for r in index.where(F.col("section_id").isin(names)).select("section_id").distinct().collect()}
    handling, final_response, escalation = (
        [s for s in listed if s in found] for listed in (handling, final_response, escalation)
    )
    if not handling:
        raise ValueError("none of the handling sections is in the index")

    pool = substantive_sections(index, chapters, skip_words).where(F.col("module").isin(list(modules)))
    sizes = {r["module"]: r["count"] for r in pool.groupBy("module").count().collect()}
    cycle = [m for m in modules if m in sizes]
    order = Window.partitionBy("module").orderBy("section_id")
    heads = pool.select("module", "section_id").withColumn("nth", F.row_number().over(order) - 1).where(F.col("nth") < steps)

    plan = [(0, i, "single", s, None, None, None) for i, s in enumerate(handling)]
    for i in range(steps if cycle else 0):
        module = cycle[i % len(cycle)]
        plan.append((1, i, "multi", handling[i % len(handling)], None, module, i // len(cycle) % sizes[module]))
    pairs = [(a, b) for a in final_response for b in escalation]
    plan += [(2, i, "escalation", a, b, None, None) for i, (a, b) in enumerate(pairs)]
    drafted = spark.createDataFrame(
        plan, "part int, i int, complaint_type string, a string, b string, module string, nth int"
    )
    every = drafted.join(heads, ["module", "nth"], "left").select(
        "part", "i", "complaint_type", F.array_sort(F.array_compact(F.array("a", "b", "section_id"))).alias("seed_sections")
    )
    first = every.groupBy("part", "complaint_type", "seed_sections").agg(F.min("i").alias("i"))
    caps = F.when(F.col("part") == 1, target_multi).when(F.col("part") == 2, target_escalation).otherwise(steps)
    kept = first.withColumn("_r", F.row_number().over(Window.partitionBy("part").orderBy("i"))).where(F.col("_r") <= caps)
    # At most a few dozen seeds are numbered here.
    return kept.select(
        F.row_number().over(Window.orderBy("part", "i")).alias("plan_ord"), "complaint_type", "seed_sections",
        seed_id(F.col("complaint_type"), F.col("seed_sections")).alias("seed_id"),
    )


# --- gates ------------------------------------------------------------------------------


def gate_questions(candidates: DataFrame) -> DataFrame:
    """``gate`` of a question candidate and the critic's difficulty override.

    ``critic`` is a struct (verdict, difficulty_reasonable, suggested_difficulty),
    null when the critic failed: such a candidate is kept.
    """
    critic = F.col("critic")
    passed = critic["verdict"] == "pass"
    gate = F.when(critic.isNull() | passed, "pass").otherwise("fail")
    suggested = critic["suggested_difficulty"]
    override = F.coalesce(
        passed & (suggested != "") & ~suggested.eqNullSafe(F.col("difficulty"))
        & ~F.coalesce(critic["difficulty_reasonable"], F.lit(True)), F.lit(False)
    )
    return candidates.withColumns({
        "gate": gate,
        "difficulty_original": F.when(override, F.col("difficulty")),
        "difficulty": F.when(override, suggested).otherwise(F.col("difficulty")),
        "critic_verdict": F.when(critic.isNull(), "error").otherwise(critic["verdict"]),
    })


def gate_scenarios(candidates: DataFrame, skip_validation: bool = False) -> DataFrame:
    """``verdict`` of a scenario: pass only if realism and provisions pass."""
    if skip_validation:
        return candidates.withColumn("verdict", F.lit("skipped"))
    critic = F.col("critic")
    ok = (critic["realism"] == "pass") & (critic["provisions_correct"] == "pass")
    return candidates.withColumn(
        "verdict", F.when(critic.isNull(), "error").when(ok, "pass").otherwise("fail")
    )


def last_per_seed(rows: DataFrame, ord_col: str = "ord", key: str = "seed_id") -> DataFrame:
    """Last record per seed at the seed's first position; copies combine before the shuffle."""
    rest = [c for c in rows.columns if c not in (key, ord_col)]
    kept = rows.groupBy(key).agg(
        F.max_by(F.struct(*rest), ord_col).alias("_row"), F.min(ord_col).alias(ord_col)
    )
    return kept.select(key, "_row.*", ord_col)


def renumber(rows: DataFrame, prefix: str, out: str, ord_col: str = "ord", bucket_rows: int | None = None) -> DataFrame:
    """Sequential ids ``q001`` … in the order of a column of any sortable type, without one global sort.

    ``bucket_rows`` is the size of a range that is sorted at once; without it there are as many as shuffle partitions.
    """
    ranges = None if bucket_rows is None else max(1, -(-rows.count() // bucket_rows))
    numbered = number_rows(rows, [], [F.col(ord_col)], "_n", ranges)
    digits = F.when(F.col("_n") < 1000, F.lpad(F.col("_n").cast("string"), 3, "0")).otherwise(F.col("_n").cast("string"))
    return numbered.withColumn(out, F.concat(F.lit(prefix), digits)).drop("_n")


def frequency_summary(rows: DataFrame, columns: Sequence[str], list_column: str | None = None) -> DataFrame:
    """Counts per value of each column and per element of a list column, in one pass."""
    pairs = [F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in columns]
    every = F.array(*pairs)
    if list_column:
        every = F.concat(every, F.transform(
            F.col(list_column), lambda e: F.struct(F.lit(list_column).alias("dimension"), e.alias("value"))
        ))
    return rows.select(F.explode(every).alias("p")).groupBy("p.dimension", "p.value").agg(F.count("*").alias("n"))


# --- source texts -------------------------------------------------------------------------


def source_blocks(rows: DataFrame, key: str, sections: str, texts: DataFrame, *, limit: int | None = None,
                  missing: str = fixed.QA_SOURCE_MISSING, heading: Column | None = None) -> DataFrame:
    """Source material of each row: ``### id`` blocks in list order, a marker where text is missing.

    ``sections`` is an array column, so a row gathers only its own short list. ``key`` is unique. Rows with equal lists share
    their material: it is put together once a list, so texts move as often as there are lists, not rows.
    """
    from ragspark.functions.text import truncate

    lists = rows.select(F.col(sections).alias("_list")).distinct()
    asked = lists.select("_list", F.posexplode("_list").alias("_i", "section_id"))
    body = F.coalesce(F.col("text"), F.lit(missing))
    if limit:
        # Cut before the join, so that only what is shown moves.
        texts = texts.withColumn("text", truncate(F.col("text"), limit))
    title = F.concat(F.lit("### "), F.col("section_id")) if heading is None else heading
    joined = asked.join(texts, "section_id", "left").select(
        "_list", "_i", F.concat(title, F.lit("\n"), body).alias("_b")
    )
    material = joined.groupBy("_list").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_b"))), lambda s: s["_b"]), "\n\n---\n\n")
        .alias("source_material")
    )
    return rows.select(key, F.col(sections).alias("_list")).join(material, "_list").select(key, "source_material")
