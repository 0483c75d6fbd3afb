"""Provision references and section resolution on ``lineitem``, ``part`` and ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ragspark import fixed
from ragspark.functions.provisions import defined_provisions, parse_provision, provision_key
from ragspark.functions.text import policy_references
from ragspark.operators import curation, metrics, references
from ragspark.queries.registry import query
from ragspark.session import materialise

# A reference written in one of several spellings, and its key, in SQL.
REF_SQL = """('disp  ' || (l_orderkey % 9 + 1) || '.' || l_linenumber || '.' || (l_partkey % 7)
  || CASE l_returnflag WHEN 'R' THEN 'R' WHEN 'A' THEN 'ag' ELSE '' END
  || CASE WHEN l_linenumber % 2 = 0 THEN ' (2)(a)' ELSE '' END)"""
KEY_SQL = r"""regexp_replace(regexp_replace(regexp_replace(upper({ref}), '(\([^()]*\))+\s*$', ''), '\s+$', ''), '^([A-Z]+)\s+', '\1 ')"""


def _ref():
    status = F.when(F.col("l_returnflag") == "R", "R").when(F.col("l_returnflag") == "A", "ag").otherwise("")
    tail = F.when(F.col("l_linenumber") % 2 == 0, " (2)(a)").otherwise("")
    return F.concat(
        F.lit("disp  "), F.col("l_orderkey") % 9 + 1, F.lit("."), F.col("l_linenumber"), F.lit("."),
        F.col("l_partkey") % 7, status, tail,
    )


def _key_sql(ref: str) -> str:
    return "regexp_replace(" + KEY_SQL.format(ref=ref) + ", '[RGE]$', '')"


@query("reference_keys", f"""
SELECT {_key_sql(REF_SQL)} AS provision, count(*) AS n, count(DISTINCT {REF_SQL}) AS n_spellings,
       count_if(l_returnflag = 'R')::BIGINT AS n_rules, count_if(l_returnflag = 'A')::BIGINT AS n_guidance
FROM lineitem GROUP BY 1""")
def reference_keys(t):
    refs = t.lineitem.select(_ref().alias("ref"))
    # Spellings are few, so they are counted before keys are computed.
    spellings = refs.groupBy("ref").agg(F.count("*").alias("n")).select(
        provision_key(F.col("ref")).alias("provision"), parse_provision(F.col("ref"))["status"].alias("status"), "n"
    )
    def by(status):
        return F.sum(F.when(F.col("status") == status, F.col("n")).otherwise(0))
    return spellings.groupBy("provision").agg(
        F.sum("n").alias("n"), F.count("*").alias("n_spellings"), by("R").alias("n_rules"), by("G").alias("n_guidance")
    )


def _line_sets(t):
    """Cited and expected references per order."""
    lines = t.spread("lineitem").select(
        F.col("l_orderkey").alias("run_id"), _ref().alias("provision"), "l_linestatus", "l_quantity", "l_discount"
    )
    cited = lines.where("l_linestatus = 'F'").select("run_id", "provision")
    expected = lines.where("l_quantity >= 25").select("run_id", "provision")
    return lines, cited, expected


SETS_SQL = f"""
k AS (SELECT l_orderkey AS run_id, {_key_sql(REF_SQL)} AS provision, l_linestatus = 'F' AS c, l_quantity >= 25 AS e,
             l_discount >= 0.05 AS d FROM lineitem),
items AS (SELECT run_id, provision, bool_or(c) AS c, bool_or(e) AS e, bool_or(d) AS d FROM k GROUP BY ALL)
"""


@query("citation_prf", f"""
WITH {SETS_SQL},
n AS (SELECT run_id, count_if(c)::BIGINT AS n_cited, count_if(e)::BIGINT AS n_expected, count_if(c AND e)::BIGINT AS n_matched
      FROM items WHERE c OR e GROUP BY run_id),
pr AS (SELECT *, coalesce(n_matched / nullif(n_cited, 0), 0.0) AS p, coalesce(n_matched / nullif(n_expected, 0), 0.0) AS r FROM n)
SELECT run_id, n_cited, n_expected, n_matched, round(p, 6) AS precision, round(r, 6) AS recall,
       round(coalesce(2 * p * r / nullif(p + r, 0), 0.0), 6) AS f1 FROM pr""")
def citation_prf(t):
    _, cited, expected = _line_sets(t)
    scores = metrics.citation_scores(cited, expected, ["run_id"])
    return scores.select("run_id", "n_cited", "n_expected", "n_matched", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("citation_outcomes", f"""
WITH {SETS_SQL}
SELECT run_id, provision,
       CASE WHEN c AND e THEN 'matched' WHEN c THEN 'cited_not_expected' ELSE 'expected_not_cited' END AS outcome
FROM items WHERE c OR e""")
def citation_outcomes(t):
    _, cited, expected = _line_sets(t)
    return metrics.citation_outcomes(cited, expected, ["run_id"])


@query("drafting_gap", f"""
WITH {SETS_SQL},
n AS (SELECT run_id, count_if(e)::BIGINT AS ne, count_if(c AND e)::BIGINT AS nc, count_if(d AND e)::BIGINT AS nd FROM items WHERE c OR e OR d GROUP BY run_id)
SELECT run_id, round(coalesce(nd / nullif(ne, 0), 0.0), 6) AS text_recall, round(coalesce(nc / nullif(ne, 0), 0.0), 6) AS citation_recall,
       round(coalesce(nd / nullif(ne, 0), 0.0) - coalesce(nc / nullif(ne, 0), 0.0), 6) AS drafting_gap FROM n""")
def drafting_gap(t):
    """Text recall against citation recall; discounted lines are the ones whose rule text was retrieved."""
    header = F.concat(F.lit("## "), provision_key(F.col("provision")), F.lit(" (Rules) text, see DISP 9.9.9 R (2)"))
    sides = F.when(F.col("l_linestatus") == "F", metrics.CITED).otherwise(0) + F.when(F.col("l_quantity") >= 25, metrics.EXPECTED).otherwise(0)
    # A spelling of a run is read once, whatever sides it is on, and so is the text it stands for.
    seen = _line_sets(t)[0].groupBy("run_id", "provision").agg(
        F.bit_or(sides).alias("sides"), F.max(F.col("l_discount") >= 0.05).alias("retrieved")
    )
    texts = F.when(F.col("retrieved"), defined_provisions(header))
    named = F.when(F.col("sides") > 0, F.array(F.struct(provision_key(F.col("provision")).alias("provision"), "sides")))
    in_text = F.transform(texts, lambda p: F.struct(p.alias("provision"), F.lit(metrics.IN_TEXT).alias("sides")))
    none = F.array().cast("array<struct<provision:string,sides:int>>")
    marks = seen.select("run_id", F.explode_outer(F.concat(F.coalesce(named, none), F.coalesce(in_text, none))).alias("m"))
    gap = metrics.provision_scores(marks.where(F.col("m").isNotNull()).select("run_id", "m.*"), ["run_id"])
    return gap.select("run_id", *[F.round(c, 6).alias(c) for c in ("text_recall", "citation_recall", "drafting_gap")])


@query("reference_definitions", """
WITH d AS (SELECT source, 'DISP ' || (doc_id % 50 + 1) || '.' || (n_chars % 7) AS provision FROM documents),
x AS (SELECT source, 'DISP ' || (doc_id % 60 + 1) || '.' || (n_chars % 5) AS provision FROM documents),
i AS (SELECT source, provision, max(p) AS p, max(e) AS e FROM (
        SELECT source, provision, 1 AS p, 0 AS e FROM d UNION ALL SELECT source, provision, 0, 1 FROM x) GROUP BY ALL)
SELECT source, sum(p)::BIGINT AS n_in_text, sum(e)::BIGINT AS n_expected, sum(p * e)::BIGINT AS n_present,
       round(sum(p * e) / sum(e), 6) AS recall FROM i GROUP BY source""")
def reference_definitions(t):
    """Rule headers present in whole texts, per source; the trailing mention must not count."""
    docs = t.spread("documents")
    content = F.concat(
        F.lit("## DISP "), F.col("doc_id") % 50 + 1, F.lit("."), F.col("n_chars") % 7, F.lit(" (Rules)\n\n"),
        F.col("text"), F.lit("\nsee DISP 99.1.1 R (2)"),
    )
    expected = docs.select("source", F.concat(
        F.lit("disp "), F.col("doc_id") % 60 + 1, F.lit("."), F.col("n_chars") % 5, F.lit("R(1)")).alias("provision"))
    scores = metrics.retrieved_provision_scores(docs.select("source", content.alias("content")), expected, ["source"])
    return scores.select("source", "n_in_text", "n_expected", "n_present", F.round("recall", 6).alias("recall"))


# --- sections from parts -------------------------------------------------------------

SEED_MODULES = ["disp", *fixed.SUBSTANTIVE_MODULES]


def _index_sql(modules, chapters):
    names = "[" + ", ".join(f"'{m}'" for m in modules) + "]"
    return f"""
idx AS (
  SELECT section_id, min(module) AS module, min(chapter) AS chapter, min_by(p_name, p_partkey) AS section_name FROM (
    SELECT *, chapter || 's' || ((p_partkey // {chapters}) % 9 + 1) AS section_id FROM (
      SELECT p_partkey, p_name, {names}[p_size % {len(modules)} + 1] AS module,
             {names}[p_size % {len(modules)} + 1] || (p_partkey % {chapters} + 1) AS chapter FROM part)) GROUP BY section_id)
"""


INDEX_SQL = _index_sql(fixed.TARGET_MODULES, 12)


def _index(t, modules=fixed.TARGET_MODULES, chapters=12):
    """Parts as sections: size picks the module, number the chapter and section."""
    names = F.array(*[F.lit(m) for m in modules])
    parts = t.part.select(
        "p_partkey", "p_name", F.element_at(names, F.col("p_size") % len(modules) + 1).alias("module"),
        (F.col("p_partkey") % chapters + 1).alias("c"), (F.floor(F.col("p_partkey") / chapters) % 9 + 1).alias("s"),
    ).withColumn("chapter", F.concat("module", "c")).withColumn("section_id", F.concat("chapter", F.lit("s"), "s"))
    return materialise(parts.groupBy("section_id").agg(
        F.min("module").alias("module"), F.min("chapter").alias("chapter"), F.min_by("p_name", "p_partkey").alias("section_name")
    ))


def _policies(t):
    """Documents with a regulatory-context block whose references follow from their number."""
    d = F.col("doc_id")
    block = F.concat(
        F.lit("# T\n## 1. Regulatory Context\n| SYSC "), d % 13 + 1, F.lit("."), d % 10 + 1, F.lit(".3R | COBS "), d % 14 + 1,
        F.lit(" | PRIN 2A |"), F.when(d % 50 == 0, " **COCON** |").otherwise(""), F.lit("\n## 2. Other\nCASS 1.1\n"), F.col("text"),
    )
    return t.documents.select(d.alias("policy"), block.alias("content"))


REFS_SQL = f"""
WITH {INDEX_SQL},
refs AS (
  SELECT doc_id AS policy, unnest(list_sort(['SYSC ' || (doc_id % 13 + 1) || '.' || (doc_id % 10 + 1), 'COBS ' || (doc_id % 14 + 1), 'PRIN 2A']
    || CASE WHEN doc_id % 50 = 0 THEN ['COCON'] ELSE [] END)) AS ref FROM documents),
numbered AS (SELECT policy, ref, row_number() OVER (PARTITION BY policy ORDER BY ref) - 1 AS ref_ord FROM refs),
d AS (SELECT DISTINCT ref, lower(split_part(ref, ' ', 1)) AS m, lower(split_part(ref, ' ', 2)) AS n FROM refs),
t AS (SELECT ref, m, n, m || split_part(n, '.', 1) || 's' || split_part(n, '.', 2) AS sid FROM d),
hits AS (
  SELECT ref, section_id FROM t JOIN idx ON n = '' AND starts_with(section_id, m)
  UNION ALL SELECT ref, section_id FROM t JOIN idx ON n <> '' AND NOT contains(n, '.') AND chapter = m || n
  UNION ALL SELECT ref, section_id FROM t JOIN idx ON contains(n, '.') AND section_id = sid
  UNION ALL SELECT ref, section_id FROM t JOIN idx ON contains(n, '.') AND starts_with(section_id, sid)
            WHERE sid NOT IN (SELECT section_id FROM idx))
"""


@query("ref_to_section", REFS_SQL + """
SELECT policy, section_id, min(ref_ord)::INT AS ref_ord FROM numbered JOIN hits USING (ref) GROUP BY policy, section_id""")
def ref_to_section(t):
    return references.policy_sections(_policies(t), _index(t)).select("policy", "section_id", "ref_ord")


@query("section_pool", REFS_SQL + f"""
SELECT module, count(*) AS n, min(section_id) AS first_section, max(section_id) AS last_section FROM idx
WHERE section_id IN (SELECT section_id FROM hits UNION SELECT unnest({fixed.SUPPLEMENTARY_SECTIONS}))
  AND module IN (SELECT unnest({fixed.CORE_MODULES}))
  AND NOT contains(section_id, 'sch') AND NOT contains(section_id, 'tp') AND NOT contains(section_id, 'app')
GROUP BY module""")
def section_pool(t):
    """Core sections that some policy references, grouped by module."""
    index = _index(t)
    pool = references.section_pool(index, references.referenced_sections(_policies(t), index))
    return pool.groupBy("module").agg(
        F.count("*").alias("n"), F.min("section_id").alias("first_section"), F.max("section_id").alias("last_section")
    )


PAIR_LIST = ", ".join(f"({i}, '{a}', '{b}')" for i, (a, b) in enumerate(fixed.PRIORITY_MODULE_PAIRS))


@query("cross_pairs", f"""
WITH {INDEX_SQL},
p(pair, module_a, module_b) AS (VALUES {PAIR_LIST}),
j AS (
  SELECT pair, module_a, module_b, a.section_id AS section_a, b.section_id AS section_b,
         row_number() OVER (PARTITION BY pair ORDER BY a.section_id, b.section_id) AS r
  FROM p JOIN idx a ON a.module = module_a JOIN idx b ON b.module = module_b),
o AS (SELECT *, row_number() OVER (ORDER BY pair, section_a, section_b)::INT AS position FROM j WHERE r <= 3)
SELECT position, module_a, module_b, section_a, section_b FROM o WHERE position <= 25""")
def cross_pairs(t):
    return references.cross_module_pairs(_index(t).select("section_id", "module"), 25)


CHAPTERS = ", ".join(f"('{m}', '{c}')" for m, cs in fixed.SUBSTANTIVE_CHAPTERS.items() for c in cs)


def _listed(names):
    return ", ".join(f"({i}, '{s}')" for i, s in enumerate(names))


@query("seed_plan", f"""
WITH {_index_sql(SEED_MODULES, 4)},
h AS (SELECT row_number() OVER (ORDER BY o) - 1 AS pos, s FROM (VALUES {_listed(fixed.HANDLING_SECTIONS)}) v(o, s)
      WHERE s IN (SELECT section_id FROM idx)),
f AS (SELECT o, s FROM (VALUES {_listed(fixed.FINAL_RESPONSE_SECTIONS)}) v(o, s) WHERE s IN (SELECT section_id FROM idx)),
g AS (SELECT o, s FROM (VALUES {_listed(fixed.FOS_SECTIONS)}) v(o, s) WHERE s IN (SELECT section_id FROM idx)),
ok AS (SELECT *, row_number() OVER (PARTITION BY module ORDER BY section_id) - 1 AS nth, count(*) OVER (PARTITION BY module) AS size
       FROM idx WHERE (module, chapter) IN (VALUES {CHAPTERS}) AND NOT contains(section_name, 'anvil')
         AND NOT contains(section_id, 'sch') AND NOT contains(section_id, 'tp') AND NOT contains(section_id, 'app')),
m AS (SELECT row_number() OVER (ORDER BY o) - 1 AS pos, s AS module FROM (VALUES {_listed(fixed.SUBSTANTIVE_MODULES)}) v(o, s)
      WHERE s IN (SELECT module FROM ok)),
cnt AS (SELECT (SELECT count(*) FROM h) AS nh, (SELECT count(*) FROM m) AS nm),
steps AS (SELECT i, i % nh AS hp, i % nm AS mp, i // nm AS turn FROM cnt, range(121) r(i)),
multi AS (SELECT i, list_sort([h.s, ok.section_id]) AS seed FROM steps JOIN h ON h.pos = hp JOIN m ON m.pos = mp
          JOIN ok ON ok.module = m.module AND ok.nth = turn % ok.size),
every AS (
  SELECT 0 AS part, pos AS i, 'single' AS complaint_type, [s] AS seed FROM h
  UNION ALL SELECT 1, i, 'multi', seed FROM multi
  UNION ALL SELECT 2, f.o * 3 + g.o, 'escalation', list_sort([f.s, g.s]) FROM f, g),
first AS (SELECT part, complaint_type, seed, min(i) AS i FROM every GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY i) AS r FROM first)
SELECT row_number() OVER (ORDER BY part, i)::INT AS plan_ord, complaint_type, complaint_type || ':' || array_to_string(seed, '+') AS seed_id
FROM ranked WHERE r <= CASE part WHEN 1 THEN 20 WHEN 2 THEN 9 ELSE 7 END""")
def seed_plan(t):
    plan = curation.seed_plan(_index(t, SEED_MODULES, 4), skip_words=["anvil"])
    return plan.select("plan_ord", "complaint_type", "seed_id")


@query("policy_references", r"""
WITH b AS (
  SELECT doc_id, 'PRIN ' || (doc_id % 11 + 1) || ', SYSC ' || (doc_id % 6 + 1) || '.1.' || (doc_id % 3) || 'R and '
    || CASE WHEN doc_id % 2 = 0 THEN 'COBS' ELSE 'xCOBS' END || '. ' || text AS content FROM documents)
SELECT doc_id, len(r) AS n_references, array_to_string(r, '|') AS refs FROM (
  SELECT doc_id, list_sort(['PRIN ' || (doc_id % 11 + 1), 'SYSC ' || (doc_id % 6 + 1) || '.1.' || (doc_id % 3) || 'R']
    || CASE WHEN doc_id % 2 = 0 THEN ['COBS'] ELSE [] END) AS r FROM b)""")
def policy_refs(t):
    """References of whole documents with a written prefix."""
    d = F.col("doc_id")
    content = F.concat(
        F.lit("PRIN "), d % 11 + 1, F.lit(", SYSC "), d % 6 + 1, F.lit(".1."), d % 3, F.lit("R and "),
        F.when(d % 2 == 0, "COBS").otherwise("xCOBS"), F.lit(". "), F.col("text"),
    )
    found = t.spread("documents").select("doc_id", policy_references(content).alias("r"))
    return found.select("doc_id", F.size("r").cast("long").alias("n_references"), F.array_join("r", "|").alias("refs"))
