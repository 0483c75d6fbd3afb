"""Registered queries of the training-data operators, with SQL where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragspark.llm import (
    chat, frames, jaccard, langid, licenses, linedup, neardup, packing, phrases, rules, subword, tokens, topk, whitening,
)
from ragspark.session import materialise, shared_folder, tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a job ``f(table) -> DataFrame``, where ``table(name)`` reads one of the given tables."""
    def add(job):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            tune(spark)
            return job(lambda table: spark.read.parquet(f"{folder.rstrip('/')}/{table}.parquet"))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return job
    return add


CHAT_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n,
    length(text) + length(text) - length(replace(replace(replace(text, chr(92), ''), '<', ''), '[', ''))
    + length(role) + length(role) - length(replace(replace(replace(replace(role, chr(92), ''), '<', ''), '[', ''), chr(10), ''))
    + 8 + 1 + 8 AS size
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), grown AS (SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY i) AS upto FROM sized)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(upto) FILTER (role = 'assistant' OR i = n) AS BIGINT) AS formatted_chars
FROM grown GROUP BY conv_id
"""


@query("op1_packing")
def op1_packing(table):
    """All documents in sequences of 2048 tokens."""
    return packing.pack(table("documents"), tokens.default_path())


@query("op2_license_scan")
def op2_license_scan(table):
    """Licences of all documents, laid out as files.

    The tables have no paths. A document lies in source/(id div 400)/(id div 100);
    every fifth id is a licence file, and lies one level higher.
    """
    docs = table("documents")
    is_licence = F.col("doc_id") % 5 == 0
    level = F.when(~is_licence, F.floor(F.col("doc_id") / 100))
    folder = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.floor(F.col("doc_id") / 400), level)
    name = F.when(is_licence, F.concat(F.lit("LICENSE."), F.col("doc_id"))).otherwise(F.concat(F.col("doc_id"), F.lit(".txt")))
    found = licenses.scan(docs.select(F.concat(folder, F.lit("/"), name).alias("path"), "text"))
    number = lambda c: F.regexp_extract(c, r"([0-9]+)(\.txt)?$", 1).try_cast("long")
    return found.select(number("path").alias("doc_id"), "licence", "similarity", "origin", number("inherited_from").alias("inherited_from"))


@query("op3_language_id")
def op3_language_id(table):
    """Language of every whole text, learned from the rows that are not held out."""
    docs = table("documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(~langid.held_out()))
    judged = langid.predict(docs.select("doc_id", "text"), model)
    return judged.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


@query("op4_token_frames")
def op4_token_frames(table):
    """All documents written as frame files under the shared folder and read back."""
    docs = table("documents")
    spark = docs.sparkSession
    folder = f"{shared_folder(spark).rstrip('/')}/ragspark/frames-{uuid.uuid4().hex}"
    return frames.read_files(spark, frames.write_files(docs, folder, tokens.default_path()), folder)


@query("op5_embedding_near_dup")
def op5_embedding_near_dup(table):
    """Near-duplicate components of all vectors."""
    return neardup.near_duplicates(table("embeddings"))


@query("op6_chat_format", CHAT_SQL)
def op6_chat_format(table):
    """Every conversation and conversation -7, formatted and read back."""
    turns = table("conversations")
    said = "</s>[INST] ok [/INST]"
    more = turns.sparkSession.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"),
    )
    return chat.read_back(chat.examples(turns.select(more.columns).unionByName(more)))


@query("op7_merge_dropout")
def op7_merge_dropout(table):
    """Every whole text in merges with dropout, decoded again from its ids."""
    path = subword.default_path()
    back = subword.decode(subword.encode(table("documents"), path), path)
    return back.select("doc_id", "n_tokens", "ids_crc32", F.sha2("text", 256).alias("text_sha256"))


LINES_SQL = r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (
  SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i, unnest(list_transform(ls, lambda x:
    len(list_filter(string_split_regex(x, '[\x20\x09-\x0D]+'), lambda y: y <> '')))) AS w
  FROM docs
), sums AS (
  SELECT *, coalesce(sum(w) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s,
    sum(w) OVER (PARTITION BY doc_id ORDER BY i) AS e
  FROM lines
), spans AS (
  SELECT a.doc_id, a.i AS lo, min(b.i) AS hi FROM sums a JOIN sums b ON a.doc_id = b.doc_id AND b.i >= a.i AND b.e - a.s >= 50
  GROUP BY ALL
  UNION SELECT a.doc_id, max(a.i), b.i FROM sums a JOIN sums b ON a.doc_id = b.doc_id AND b.i >= a.i AND b.e - a.s >= 50
  GROUP BY a.doc_id, b.i
), told AS (
  SELECT p.doc_id, lo, hi, row_number() OVER (PARTITION BY array_to_string(d.ls[lo:hi], chr(10)), hi - lo ORDER BY p.doc_id, lo) AS copy
  FROM spans p JOIN docs d USING (doc_id)
), gone AS (SELECT DISTINCT doc_id, unnest(range(lo, hi + 1)) AS i FROM told WHERE copy > 1),
kept AS (
  SELECT l.doc_id, count(*) AS n_lines, count(g.i) AS n_removed, string_agg(l.ls[l.i], chr(10) ORDER BY l.i) FILTER (g.i IS NULL) AS text
  FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.i = g.i GROUP BY l.doc_id
)
SELECT doc_id, n_lines, n_removed, coalesce(text, '') AS text FROM kept
"""


@query("op8_line_dedup", LINES_SQL)
def op8_line_dedup(table):
    """Every document without the later copies of runs of 50 words or more."""
    docs = table("documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    lines = F.size(F.split("text", "\n")).cast("long")
    sized = docs.withColumn("n_lines", lines)
    return linedup.dedup(sized).select("doc_id", "n_lines", F.size("_removed").cast("long").alias("n_removed"), "text")


JACCARD_SQL = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM docs
), items AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM items a JOIN items b ON a.x = b.x AND a.doc_id <> b.doc_id
    AND 4 * least(a.n, b.n) >= 3 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), reach AS (
  SELECT doc_id AS id, doc_id AS r FROM docs UNION SELECT reach.id, pairs.b FROM reach JOIN pairs ON reach.r = pairs.a
)
SELECT s.doc_id, len(s.s) AS n_shingles, min(r.r) AS component_id FROM sets s JOIN reach r ON r.id = s.doc_id GROUP BY s.doc_id, s.s
"""


@query("op9_jaccard_join", JACCARD_SQL)
def op9_jaccard_join(table):
    """Near-duplicate components of all documents."""
    return jaccard.near_duplicates(table("documents"))


@query("op10_quality_rules")
def op10_quality_rules(table):
    """Statistics of every whole text and the verdict of the decision list learned from ``labels``."""
    stats = materialise(rules.statistics(table("documents")))
    learned = rules.train(stats, table("labels"))
    failed = rules.base_failed()
    return stats.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & rules.verdict(learned)).alias("kept"),
    )


@query("op11_embedding_whitening")
def op11_embedding_whitening(table):
    """Sixteen whitened components of every usable vector."""
    return whitening.whiten(table("embeddings"))


PHRASES_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), runs AS (
  SELECT lang, row_number() OVER () AS piece, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces
), placed AS (SELECT lang, piece, unnest(w) AS w1, generate_subscripts(w, 1) AS i FROM runs),
next AS (
  SELECT lang, w1, lead(w1, 1) OVER p AS w2, lead(w1, 2) OVER p AS w3, lead(w1, 3) OVER p AS w4
  FROM placed WINDOW p AS (PARTITION BY piece ORDER BY i)
), grams AS (
  SELECT lang, 1 AS k, w1 AS phrase FROM next UNION ALL SELECT lang, 2, w1 || ' ' || w2 FROM next WHERE w2 IS NOT NULL
  UNION ALL SELECT lang, 3, concat_ws(' ', w1, w2, w3) FROM next WHERE w3 IS NOT NULL
  UNION ALL SELECT lang, 4, concat_ws(' ', w1, w2, w3, w4) FROM next WHERE w4 IS NOT NULL
), f AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
many AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE f >= 30),
cuts AS (
  SELECT m.lang, m.phrase, m.f AS a, c.cut, l.f AS l, r.f AS r, CAST(2000000::HUGEINT * m.f // (l.f + r.f) AS BIGINT) AS score
  FROM many m JOIN (VALUES (1), (2), (3)) AS c(cut) ON c.cut < m.k
  JOIN f l ON l.lang = m.lang AND l.phrase = array_to_string(m.w[1:c.cut], ' ')
  JOIN f r ON r.lang = m.lang AND r.phrase = array_to_string(m.w[c.cut + 1:m.k], ' ')
), best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inner_runs AS (
  SELECT m.lang, array_to_string(m.w[p.i:p.i + s.size - 1], ' ') AS phrase, max(m.f) AS more
  FROM many m JOIN (VALUES (2), (3)) AS s(size) ON s.size < m.k JOIN (VALUES (1), (2), (3)) AS p(i) ON p.i + s.size - 1 <= m.k
  GROUP BY ALL
), ranked AS (
  SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank
  FROM best b LEFT JOIN inner_runs i ON b.lang = i.lang AND b.phrase = i.phrase
  WHERE i.more IS NULL OR 100::HUGEINT * i.more < 80::HUGEINT * b.a
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""


@query("op12_phrase_collocations", PHRASES_SQL)
def op12_phrase_collocations(table):
    """The 2000 best phrases of each language in all documents."""
    return phrases.collocations(table("documents"))


TOP_SQL = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


@query("op13_exact_top_k", TOP_SQL)
def op13_exact_top_k(table):
    """The five highest integer inner products of every vector whose id is divisible by 50."""
    vectors = table("embeddings")
    asked = vectors.where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    return topk.top_k(asked, vectors)
