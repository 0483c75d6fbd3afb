"""Corpus build on ``documents``, ``pages`` and ``part``."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ragspark import fixed
from ragspark.functions.text import clean_text, links, slug, truncate, word_count
from ragspark.operators import chunking, packers, sections
from ragspark.operators.references import is_core
from ragspark.queries.registry import query
from ragspark.session import shared_folder
from ragspark.sources import corpus, records

STRIP = r"'^\s+|\s+$', '', 'g'"
WORDS = r"list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')"
# Word and punctuation tokens, as the default counter sees them.
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
# Documents in a file of JSON lines.
FILE_ROWS = 25_000


@query("fixed_chunks", f"""
WITH w AS (SELECT doc_id, {WORDS} AS words FROM documents),
s AS (SELECT doc_id, words, unnest(range(0, greatest(len(words) - 51, 1), 461)) AS start FROM w WHERE len(words) > 0)
SELECT doc_id, (start // 461)::INT AS chunk_index, doc_id || '-' || lpad((start // 461)::VARCHAR, 3, '0') AS chunk_id,
       least(512, len(words) - start)::INT AS n_words, md5(array_to_string(words[start + 1:start + 512], ' ')) AS text_md5
FROM s""")
def fixed_chunks(t):
    chunks = chunking.fixed_windows(t.spread("documents"), "doc_id", "text")
    return chunks.select("doc_id", "chunk_index", "chunk_id", "n_words", F.md5("text").alias("text_md5"))


# Greedy packing as recursion over the lines of a document. Lines over a cap are
# first replaced by their pieces, each of which stands alone in its chunk.
STRUCTURE_SQL = rf"""
WITH RECURSIVE raw AS (
  SELECT doc_id, generate_subscripts(l, 1) - 1 AS line_no, unnest(l) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
lines AS (
  SELECT *, len(regexp_extract_all(body, '{TOKEN}')) AS toks, len(body) AS chars
  FROM (SELECT doc_id, line_no, regexp_replace(line, {STRIP}) AS body FROM raw) WHERE body <> ''),
big AS (SELECT * FROM lines WHERE toks > 480 OR chars > 2000),
sent AS (
  SELECT doc_id, line_no, row_number() OVER (PARTITION BY doc_id, line_no ORDER BY i) AS s_no, s,
         len(regexp_extract_all(s, '{TOKEN}')) AS toks
  FROM (SELECT doc_id, line_no, generate_subscripts(p, 1) AS i, regexp_replace(unnest(p), {STRIP}) AS s
        FROM (SELECT doc_id, line_no, string_split(regexp_replace(body, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS p
              FROM big WHERE toks > 480)) WHERE s <> ''),
srun AS (
  SELECT doc_id, line_no, s_no, 1 AS run, toks AS used, toks > 480 AS closed FROM sent WHERE s_no = 1
  UNION ALL
  SELECT n.doc_id, n.line_no, n.s_no,
         CASE WHEN r.closed OR n.toks > 480 OR r.used + n.toks > 480 THEN r.run + 1 ELSE r.run END,
         CASE WHEN r.closed OR n.toks > 480 OR r.used + n.toks > 480 THEN n.toks ELSE r.used + n.toks END,
         n.toks > 480
  FROM srun r JOIN sent n ON n.doc_id = r.doc_id AND n.line_no = r.line_no AND n.s_no = r.s_no + 1),
runs AS (
  SELECT r.doc_id, r.line_no, r.run, bool_or(r.closed) AS closed, string_agg(s.s, ' ' ORDER BY r.s_no) AS body
  FROM srun r JOIN sent s USING (doc_id, line_no, s_no) GROUP BY ALL),
windows AS (
  SELECT doc_id, line_no, run, generate_subscripts(w, 1) AS w_no, regexp_replace(unnest(w), {STRIP}) AS body
  FROM (SELECT *, CASE WHEN closed THEN list_transform(range(0, len(items), 480), lambda i: array_to_string(items[i + 1:i + 480], ''))
                       ELSE [body] END AS w FROM (SELECT *, regexp_extract_all(body, '\s*(?:{TOKEN})') AS items FROM runs))
  UNION ALL SELECT doc_id, line_no, 1, 1, body FROM big WHERE toks <= 480),
pieces AS (
  SELECT doc_id, line_no, row_number() OVER (PARTITION BY doc_id, line_no ORDER BY run, w_no, off) AS p_no,
         substr(body, off + 1, 2000) AS body
  FROM (SELECT *, unnest(range(0, len(body), 2000)) AS off FROM windows)),
units AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no, p_no) AS u_no FROM (
    SELECT doc_id, line_no, 0 AS p_no, body, toks, chars, false AS alone FROM lines WHERE toks <= 480 AND chars <= 2000
    UNION ALL SELECT doc_id, line_no, p_no, body, 0, 0, true FROM pieces)),
packed AS (
  SELECT doc_id, u_no, 0 AS chunk, toks AS used_t, chars AS used_c, alone FROM units WHERE u_no = 1
  UNION ALL
  SELECT n.doc_id, n.u_no,
         CASE WHEN p.alone OR n.alone OR p.used_t + n.toks > 480 OR p.used_c + 2 + n.chars > 2000 THEN p.chunk + 1 ELSE p.chunk END,
         CASE WHEN p.alone OR n.alone OR p.used_t + n.toks > 480 OR p.used_c + 2 + n.chars > 2000 THEN n.toks ELSE p.used_t + n.toks END,
         CASE WHEN p.alone OR n.alone OR p.used_t + n.toks > 480 OR p.used_c + 2 + n.chars > 2000 THEN n.chars ELSE p.used_c + 2 + n.chars END,
         n.alone
  FROM packed p JOIN units n ON n.doc_id = p.doc_id AND n.u_no = p.u_no + 1)
SELECT doc_id, chunk AS chunk_index, count(DISTINCT line_no) AS n_labels,
       md5(string_agg(body, chr(10) || chr(10) ORDER BY u_no)) AS text_md5
FROM packed JOIN units USING (doc_id, u_no) GROUP BY doc_id, chunk"""


@query("structure_chunks", STRUCTURE_SQL)
def structure_chunks(t):
    """Documents packed by line under the default caps."""
    chunks = chunking.chunk_documents(t.documents, "doc_id", chunking.line_units(F.col("text")), F.lit(""))
    return chunks.select(
        "doc_id", "chunk_index", F.size("labels").cast("long").alias("n_labels"), F.md5("text").alias("text_md5")
    )


@query("structure_chunks_table_function", STRUCTURE_SQL)
def structure_chunks_table_function(t):
    """The same documents by the packer's table function, called from SQL on their lines."""
    lines = t.spread("documents").select(
        F.col("doc_id").alias("parent"), F.posexplode(F.split("text", "\n")).alias("ord", "text")
    ).select("parent", "ord", F.col("ord").cast("string").alias("label"), "text", F.lit("").alias("header"))
    name = packers.register_packer(t.spark)
    chunks = t.spark.sql(f"SELECT * FROM {name}(TABLE({{units}}) PARTITION BY parent ORDER BY ord)", units=lines)
    return chunks.select(
        F.col("parent").cast("long").alias("doc_id"), "chunk_index", F.size("labels").cast("long").alias("n_labels"), F.md5("text").alias("text_md5")
    )


@query("provisions_in_file_order", """
SELECT doc_id::VARCHAR AS provision_id, source AS section, row_number() OVER (ORDER BY doc_id) - 1 AS ord, md5(text) AS text_md5
FROM documents""")
def provisions_in_file_order(t):
    """Documents as JSON lines without a position, in several files, and loaded again in their order."""
    folder = f"{shared_folder(t.spark).rstrip('/')}/ragspark/{uuid.uuid4().hex}"
    # Files of bounded size, as a file is not always read in splits.
    files = max(5, t.documents.count() // FILE_ROWS)
    lines = _as_provisions(t).repartitionByRange(files, "ord").sortWithinPartitions("ord").drop("ord")
    lines.write.json(folder)
    loaded = corpus.load_provisions(t.spark, folder)
    return loaded.select("provision_id", "section", "ord", F.md5("text").alias("text_md5"))


BY_SOURCE_SQL = rf"""
WITH RECURSIVE lines AS (
  SELECT source, doc_id, regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), {STRIP}) AS body FROM documents),
units AS (
  SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS u_no, doc_id,
         len('## ' || doc_id || chr(10) || chr(10) || body) AS chars,
         len(regexp_extract_all('## ' || doc_id || ' ' || body, '{TOKEN}')) AS toks, source AS head
  FROM lines WHERE body <> ''),
room AS (SELECT *, 2000 - len('# ' || upper(source) || ' — ' || source) - 2 AS c_room,
                480 - len(regexp_extract_all('# ' || upper(source) || ' — ' || source, '{TOKEN}')) AS t_room FROM units),
flagged AS (SELECT *, toks > t_room OR chars > c_room AS alone FROM room),
packed AS (
  SELECT source, u_no, 0 AS chunk, toks AS used_t, chars AS used_c, alone FROM flagged WHERE u_no = 1
  UNION ALL
  SELECT n.source, n.u_no,
         CASE WHEN p.alone OR n.alone OR p.used_t + n.toks > n.t_room OR p.used_c + 2 + n.chars > n.c_room THEN p.chunk + 1 ELSE p.chunk END,
         CASE WHEN p.alone OR n.alone OR p.used_t + n.toks > n.t_room OR p.used_c + 2 + n.chars > n.c_room THEN n.toks ELSE p.used_t + n.toks END,
         CASE WHEN p.alone OR n.alone OR p.used_t + n.toks > n.t_room OR p.used_c + 2 + n.chars > n.c_room THEN n.chars ELSE p.used_c + 2 + n.chars END,
         n.alone
  FROM packed p JOIN flagged n ON n.source = p.source AND n.u_no = p.u_no + 1)
SELECT source, first_doc, n_docs FROM (
  SELECT source, chunk, min(f.doc_id) AS first_doc, count(*) AS n_docs FROM packed JOIN flagged f USING (source, u_no) GROUP BY ALL)"""


@query("structure_chunks_by_source", BY_SOURCE_SQL)
def structure_chunks_by_source(t):
    """Documents of a source packed as provisions of one section, one row per unit.

    A source holds many documents, so this runs the blocked packer. The pieces of
    an oversize document count once, under its first piece.
    """
    return _first_documents(chunking.pack_units(_section_units(t)))


@query("structure_chunks_in_blocks", BY_SOURCE_SQL)
def structure_chunks_in_blocks(t):
    """The same by the packer that takes any counter: small blocks, packed on speculation and checked."""
    return _first_documents(packers.pack_in_blocks(_section_units(t), block_units=64, overlap=16))


def _section_units(t):
    provisions = _as_provisions(t)
    table = sections.section_table(provisions)
    return sections.provision_units(provisions).join(table.select("section", "heading"), "section").select(
        F.col("section").alias("parent"), "ord", "label", "text", F.col("heading").alias("header")
    )


def _first_documents(chunks):
    return (
        chunks.groupBy(F.col("parent").alias("source"), F.element_at("labels", 1).cast("long").alias("first_doc"))
        .agg(F.max(F.size("labels")).cast("long").alias("n_docs"))
    )


def _as_provisions(t):
    """Documents as provisions: language is the module, source the section, number the order."""
    return t.spread("documents").select(
        F.col("doc_id").cast("string").alias("provision_id"), F.col("source").alias("module"),
        F.col("lang").alias("chapter"), F.col("source").alias("section"), F.lit("").alias("section_name"),
        F.lit("").alias("provision_type"), "text", F.col("doc_id").alias("ord"),
    )


@query("section_documents", rf"""
WITH p AS (
  SELECT source, doc_id, regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), {STRIP}) AS body FROM documents),
b AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos FROM p WHERE body <> '')
SELECT source AS section, pos // 16 AS part, count(*) AS n_units,
       md5((CASE WHEN pos // 16 = 0 THEN '# ' || upper(source) || ' — ' || source || chr(10) ELSE '' END)
           || string_agg(chr(10) || '## ' || doc_id || chr(10) || chr(10) || body || chr(10), '' ORDER BY pos)) AS text_md5
FROM b GROUP BY source, pos // 16""")
def section_documents(t):
    """Whole-section documents in parts of sixteen provisions."""
    provisions = _as_provisions(t)
    docs = sections.section_documents(sections.provision_units(provisions), sections.section_table(provisions), units_per_part=16)
    return docs.select("section", "part", F.col("n_units").cast("long").alias("n_units"), F.md5("text").alias("text_md5"))


@query("section_rollup", """
WITH s AS (
  SELECT lang || '-' || source AS section, arg_min(lang, doc_id) AS module, count(*) AS n FROM documents GROUP BY 1)
SELECT coalesce(upper(module), 'TOTAL') AS module, count(*) AS n_sections, sum(n)::BIGINT AS n_provisions
FROM s GROUP BY ROLLUP (module)""")
def section_rollup(t):
    provisions = _as_provisions(t).withColumns({
        "module": F.col("chapter"), "section": F.concat_ws("-", "chapter", "section"),
    })
    return sections.module_counts(sections.section_table(provisions))


@query("policy_split", rf"""
WITH l AS (
  SELECT doc_id, generate_subscripts(x, 1) - 1 AS i, unnest(x) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)),
u AS (SELECT *, sum((i % 4 = 2)::INT) OVER (PARTITION BY doc_id ORDER BY i) AS sec FROM l),
g AS (
  SELECT doc_id, sec, max(CASE WHEN i % 4 = 2 THEN regexp_replace('## ' || line, {STRIP}) END) AS head,
         regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (i % 4 NOT IN (0, 2)), ''), {STRIP}) AS body
  FROM u GROUP BY doc_id, sec),
title AS (SELECT doc_id, regexp_replace('# ' || line, {STRIP}) AS title FROM l WHERE i = 0)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY sec)::INT - 1 AS unit_index, md5(title) AS title_md5,
       md5(coalesce(head, 'preamble')) AS label_md5,
       md5(CASE WHEN head IS NULL THEN body ELSE head || chr(10) || chr(10) || body END) AS text_md5
FROM g JOIN title USING (doc_id) WHERE body <> ''""")
def policy_split(t):
    """Documents with headings added by line number, split again into titled units."""
    def heading(line, i):
        return F.when(i % 4 == 0, F.concat(F.lit("# "), line)).when(i % 4 == 2, F.concat(F.lit("## "), line)).otherwise(line)
    policies = t.spread("documents").select("doc_id", F.array_join(F.transform(F.split("text", "\n"), heading), "\n").alias("content"))
    units = policies.select(
        "doc_id", F.md5(chunking.policy_title(F.col("content"))).alias("title_md5"),
        F.posexplode_outer(chunking.policy_units(F.col("content"))).alias("unit_index", "u"),
    ).where(F.col("u").isNotNull())
    return units.select(
        "doc_id", "unit_index", "title_md5", F.md5("u.label").alias("label_md5"), F.md5("u.text").alias("text_md5")
    )


@query("module_filter_index", """
WITH s AS (
  SELECT p_brand AS module, p_brand || '/' || p_type AS chapter, replace(p_name, ' ', '') || 's' || p_partkey AS section
  FROM part WHERE p_brand NOT IN ('Brand#3', 'Brand#4'))
SELECT module, count(*) AS n_sections, count(DISTINCT chapter) AS n_chapters,
       count_if(NOT contains(section, 'sch') AND NOT contains(section, 'tp') AND NOT contains(section, 'app'))::BIGINT AS n_core
FROM s GROUP BY module""")
def module_filter_index(t):
    """Parts as a document tree (brand, type, part), flattened and filtered to target modules."""
    modules = [f"Brand#{i}" for i in range(1, 26) if i not in (3, 4)]
    section = F.struct(F.concat(F.replace("p_name", F.lit(" "), F.lit("")), F.lit("s"), F.col("p_partkey")).alias("entityId"))
    chapter = F.struct(F.concat_ws("/", "p_brand", "p_type").alias("entityId"), F.array(section).alias("parts"))
    tree = t.part.select(F.array(F.struct(F.col("p_brand").alias("entityId"), F.array(chapter).alias("parts"))).alias("parts"))
    pairs = corpus.section_pairs(tree, modules)
    chapters = corpus.chapter_modules(tree, modules).groupBy("module").agg(F.count("*").alias("n_chapters"))
    counts = pairs.groupBy("module").agg(
        F.count("*").alias("n_sections"), F.count_if(is_core(F.col("section"))).alias("n_core")
    )
    return counts.join(chapters, "module").select("module", "n_sections", "n_chapters", "n_core")


@query("clean_text_profile", rf"""
WITH c AS (
  SELECT page_id, regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(html, '&quot;', '"'), '&copy;', '©'),
    '&middot;', '·'), '&amp;?', '&', 'g'), '[ \t]+', ' ', 'g'), {STRIP}) AS text, url FROM pages)
SELECT page_id, len(text) AS n_chars, len({WORDS}) AS n_words, len(text) >= 200 AS is_substantial,
       md5(CASE WHEN len(text) > 5000 THEN substr(text, 1, 5000) || chr(10) || chr(10) || '[... truncated ...]' ELSE text END) AS prompt_md5,
       regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug
FROM c""")
def clean_text_profile(t):
    """Pages after entity decoding, with the substance filter's flag and the prompt cut."""
    cleaned = t.spread("pages").select("page_id", clean_text(F.col("html")).alias("text"), "url")
    text = F.col("text")
    return cleaned.select(
        "page_id", F.length(text).cast("long").alias("n_chars"), word_count(text).cast("long").alias("n_words"),
        (F.length(text) >= fixed.MIN_SUBSTANCE_CHARS).alias("is_substantial"),
        F.md5(truncate(text, fixed.SECTION_PROMPT_CHARS)).alias("prompt_md5"), slug(F.col("url")).alias("slug"),
    )


@query("cross_references", """
WITH l AS (
  SELECT page_id, list_filter(list_transform(regexp_extract_all(html, 'href="(/[^"]+)"', 1), lambda r: replace(r, '/', '')),
                              lambda r: r <> '') AS refs FROM pages)
SELECT page_id, len(list_distinct(refs)) AS n_links,
       array_to_string(list_filter(refs, lambda r, i: list_position(refs, r) = i), '|') AS links
FROM l""")
def cross_references(t):
    found = t.pages.select("page_id", links(F.col("html"), prefix="/").alias("refs"))
    return found.select("page_id", F.size("refs").cast("long").alias("n_links"), F.array_join("refs", "|").alias("links"))


@query("spot_check", """
SELECT doc_id, source FROM documents ORDER BY sha256('7:' || doc_id), doc_id LIMIT 10""")
def spot_check(t):
    return corpus.spot_check(t.documents, "doc_id", 10, seed="7").select("doc_id", "source")


@query("resume_work", """
SELECT d.doc_id, c.config_label FROM documents d
CROSS JOIN (VALUES ('fixed-titan'), ('structure-titan')) c(config_label)
WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND
                  (c.config_label = 'fixed-titan' OR (l.quality = 1 AND c.config_label = 'structure-titan')))""")
def resume_work(t):
    """Documents times arms, minus what labels record as done."""
    planned = records.work_matrix(t.documents.select("doc_id"), fixed.DRAFTING_CONFIGS).select("doc_id", "config_label")
    done = t.labels.select("doc_id", F.lit("fixed-titan").alias("config_label")).unionByName(
        t.labels.where("quality = 1").select("doc_id", F.lit("structure-titan").alias("config_label"))
    )
    return records.remaining_work(planned, done, ["doc_id", "config_label"])


@query("one_index", """
SELECT kind, source, count(*) AS n, count(title) AS n_titled, sum(len(content))::BIGINT AS n_chars FROM (
  SELECT 'regulation' AS kind, source, NULL AS title, text AS content FROM documents
  UNION ALL SELECT 'policy', 'synthetic', url, html FROM pages) GROUP BY kind, source""")
def one_index(t):
    """Two corpora with different metadata under one index."""
    regulation = t.documents.select(F.lit("regulation").alias("kind"), "source", F.col("text").alias("content"))
    policy = t.pages.select(
        F.lit("policy").alias("kind"), F.lit("synthetic").alias("source"), F.col("url").alias("title"), F.col("html").alias("content")
    )
    return corpus.one_index(regulation, policy).groupBy("kind", "source").agg(
        F.count("*").alias("n"), F.count("title").alias("n_titled"), F.sum(F.length("content")).alias("n_chars")
    )


@query("section_index", """
SELECT p_brand AS module, count(*) AS n, sum(CASE WHEN p_size % 2 = 0 THEN 0 ELSE p_size END)::BIGINT AS n_provisions,
       count_if(p_partkey % 3 = 0)::BIGINT AS n_unnamed
FROM part WHERE p_partkey IN (SELECT doc_id FROM documents WHERE lang <> 'de') GROUP BY p_brand""")
def section_index(t):
    """Parts as section metadata, kept where a document exists."""
    metadata = t.part.select(
        F.col("p_partkey").alias("section"), F.col("p_brand").alias("module"), F.col("p_type").alias("chapter"),
        F.when(F.col("p_partkey") % 3 != 0, F.col("p_name")).alias("section_name"),
        F.when(F.col("p_size") % 2 != 0, F.col("p_size")).alias("provision_count"),
    )
    index = corpus.section_index(metadata, t.documents.where("lang <> 'de'").select(F.col("doc_id").alias("section")))
    return index.groupBy("module").agg(
        F.count("*").alias("n"), F.sum("provision_count").alias("n_provisions"), F.count_if(F.col("section_name") == "").alias("n_unnamed")
    )


@query("provision_records", """
SELECT coalesce(CASE WHEN page_id % 7 < 5 THEN 'module' || (page_id % 7 % 2) END, 'chapter' || (page_id % 7)) AS module, count(*) AS n,
       count_if(page_id % 4 = 0)::BIGINT AS n_untyped, sum(len(list_distinct(list_filter(list_transform(regexp_extract_all(html, 'href="(/[^"]+)"', 1),
         lambda r: replace(r, '/', '')), lambda r: r <> ''))))::BIGINT AS n_links
FROM pages GROUP BY 1""")
def provision_records(t):
    """Pages as landed responses; links are moved under the handbook path, chapters five and six have no module."""
    html = F.regexp_replace("html", r'href="/', 'href="/handbook/')
    raw = t.spread("pages").select(
        F.concat(F.lit("chapter"), F.col("page_id") % 7).alias("chapter"), F.lit("s").alias("section"), F.lit("P").alias("provisionName"),
        F.lit(None).cast("string").alias("entityId"), F.col("url").alias("sectionName"), F.when(F.col("page_id") % 4 != 0, "Rules").alias("provisionType"),
        F.col("html").alias("contentText"), html.alias("contentType"), F.lit(None).cast("string").alias("timeline"), F.col("page_id").alias("ord"),
    )
    chapters = raw.select("chapter").distinct().select(
        "chapter", F.concat(F.lit("module"), F.substring("chapter", 8, 1).cast("int") % 2).alias("module")
    ).where(F.substring("chapter", 8, 1).cast("int") < 5)
    made = corpus.normalise_provisions(raw, chapters)
    return made.groupBy("module").agg(
        F.count("*").alias("n"), F.count_if(F.col("provision_type") == "").alias("n_untyped"), F.sum(F.size("cross_references")).alias("n_links")
    )


@query("fixed_chunks_by_source", rf"""
WITH p AS (
  SELECT source, doc_id, regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), {STRIP}) AS body FROM documents),
d AS (
  SELECT source, '# ' || upper(source) || ' — ' || source || chr(10)
         || string_agg(chr(10) || '## ' || doc_id || chr(10) || chr(10) || body || chr(10), '' ORDER BY doc_id) AS text
  FROM p WHERE body <> '' GROUP BY source),
w AS (SELECT source, {WORDS} AS words FROM d),
o AS (SELECT source, generate_subscripts(words, 1) - 1 AS i, unnest(words) AS word, len(words) AS n FROM w),
m AS (SELECT source, i, word, n, unnest(CASE WHEN i % 461 < 51 AND i >= 461 THEN [i // 461, i // 461 - 1] ELSE [i // 461] END) AS k FROM o)
SELECT source, k::INT AS chunk_index, count(*)::INT AS n_words, md5(string_agg(word, ' ' ORDER BY i)) AS text_md5
FROM m WHERE k = 0 OR k * 461 < n - 51 GROUP BY source, k""")
def fixed_chunks_by_source(t):
    """Fixed windows over whole-section documents that come in parts of 128 provisions."""
    provisions = _as_provisions(t)
    table = sections.section_table(provisions)
    docs = sections.section_documents(sections.provision_units(provisions), table, units_per_part=128)
    windows = chunking.fixed_windows_of_parts(docs, "section")
    return windows.select(F.col("section").alias("source"), "chunk_index", "n_words", F.md5("text").alias("text_md5"))
