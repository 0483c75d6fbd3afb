"""Retrieval on ``embeddings``: every vector is a query, its label is the section it needs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ragspark.operators import ann, metrics, retrieval
from ragspark.queries.registry import query
from ragspark.session import materialise

# Shared SQL: exact top 10 of every vector against all others.
TOP10 = """
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS chunk_id,
         round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) AS score
  FROM embeddings q JOIN embeddings c ON q.vec_id <> c.vec_id),
top10 AS (
  SELECT query_id, chunk_id, score, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scored)
  WHERE rank <= 10)
"""


def _queries(t, embedding="embedding"):
    return t.embeddings.select(F.col("vec_id").alias("query_id"), F.expr(embedding).alias("embedding"))


def _chunks(t, embedding="embedding"):
    return t.embeddings.select(F.col("vec_id").alias("chunk_id"), F.expr(embedding).alias("embedding"), "label")


def _top10(t, embedding="embedding"):
    return retrieval.top_k(_queries(t, embedding), _chunks(t, embedding), 10, exclude_self=True)


def _labelled(t, found):
    """Retrieved chunks with their section, and the section each query expects."""
    labels = t.embeddings.select("vec_id", F.col("label").cast("string").alias("section"))
    retrieved = found.join(labels.withColumnRenamed("vec_id", "chunk_id"), "chunk_id")
    return retrieved, labels.withColumnRenamed("vec_id", "query_id")


@query("knn_topk", f"WITH {TOP10} SELECT query_id, chunk_id, score, rank::INT AS rank FROM top10")
def knn_topk(t):
    return _top10(t)


@query("knn_topk_cells", f"WITH {TOP10} SELECT query_id, chunk_id, score, rank::INT AS rank FROM top10")
def knn_topk_cells(t):
    """The plan for query sets too large to broadcast, on the same vectors."""
    return retrieval.top_k(_queries(t), _chunks(t), 10, exclude_self=True, broadcast_queries=0, group_rows=256)


@query("knn_recall")
def knn_recall(t):
    """Per query: how many of its exact top ten the approximate form finds when it asks three quarters of eight cells."""
    found = retrieval.top_k(_queries(t), _chunks(t), 10, exclude_self=True, group_rows=256, cells=8, probes=6)
    found = found.select("query_id", "chunk_id", F.lit(1).alias("hit"))
    return _top10(t).join(found, ["query_id", "chunk_id"], "left").groupBy("query_id").agg(
        F.count("*").alias("n_exact"), F.count("hit").alias("n_found")
    )


def _indexed(t):
    """Approximate top ten of every vector by codes, and how many vectors each query scores exactly."""
    index = ann.build(_chunks(t))
    candidates = ann.calibrate(index, 10, 0.975)
    return ann.search(_queries(t), index, 10, candidates=candidates, exclude_self=True), candidates, index.total


@query("knn_index", f"""
WITH {TOP10}
SELECT count(DISTINCT query_id) AS n_queries, count(*) AS n_exact, round(sum(score), 3) AS exact_scores,
  true AS recall_reached, true AS under_a_tenth_scored
FROM top10""")
def knn_index(t):
    """Whether the calibrated index finds 95 % of all exact top tens while it scores under a tenth of the vectors."""
    found, candidates, total = _indexed(t)
    both = _top10(t).join(found.select("query_id", "chunk_id", F.lit(1).alias("hit")), ["query_id", "chunk_id"], "left")
    return both.agg(
        F.count_distinct("query_id").alias("n_queries"), F.count("*").alias("n_exact"), F.round(F.sum("score"), 3).alias("exact_scores"),
        (F.count("hit") >= 0.95 * F.count("*")).alias("recall_reached"), F.lit(10 * candidates < total).alias("under_a_tenth_scored"),
    )


@query("knn_index_recall")
def knn_index_recall(t):
    """Per query: exact neighbours, those the index finds, and the vectors it scored."""
    found, candidates, _ = _indexed(t)
    return _top10(t).join(found.select("query_id", "chunk_id", F.lit(1).alias("hit")), ["query_id", "chunk_id"], "left").groupBy("query_id").agg(
        F.count("*").alias("n_exact"), F.count("hit").alias("n_found"), F.lit(candidates).alias("n_scored")
    )


@query("knn_topk_filtered", """
WITH scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS chunk_id,
         round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) AS score
  FROM embeddings q JOIN (SELECT * FROM embeddings WHERE label = 3) c ON q.vec_id <> c.vec_id)
SELECT query_id, chunk_id, score, rank::INT AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scored)
WHERE rank <= 10""")
def knn_topk_filtered(t):
    return retrieval.top_k(_queries(t), _chunks(t).where("label = 3"), 10, exclude_self=True)


@query("retrieval_section_metrics", f"""
WITH {TOP10},
hits AS (
  SELECT t.query_id, (c.label = q.label)::INT AS hit
  FROM top10 t JOIN embeddings c ON c.vec_id = t.chunk_id JOIN embeddings q ON q.vec_id = t.query_id)
SELECT query_id, count(*) AS n_retrieved, sum(hit)::BIGINT AS n_relevant,
       round(avg(hit), 6) AS precision, max(hit)::DOUBLE AS recall
FROM hits GROUP BY query_id""")
def retrieval_section_metrics(t):
    retrieved, expected = _labelled(t, _top10(t))
    scores = metrics.section_scores(retrieved, expected, ["query_id"])
    return scores.select("query_id", "n_retrieved", "n_relevant", F.round("precision", 6).alias("precision"), "recall")


@query("retrieval_arm_comparison", """
WITH pairs AS (
  SELECT vec_id // 2 AS chunk_id, arg_min(label, vec_id) AS label, arg_min(embedding, vec_id)::DOUBLE[] AS x, arg_max(embedding, vec_id)::DOUBLE[] AS y
  FROM embeddings GROUP BY 1),
chunks AS (
  SELECT 'structure' AS config_label, vec_id AS chunk_id, label, embedding::DOUBLE[] AS e FROM embeddings
  UNION ALL SELECT 'fixed', chunk_id, label, list_transform(range(1, len(x) + 1), lambda i: x[i] + y[i]) FROM pairs),
scored AS (
  SELECT c.config_label, q.vec_id AS query_id, c.chunk_id, (q.label = c.label)::INT AS hit,
         round(list_cosine_similarity(q.embedding::DOUBLE[], c.e), 6) AS score
  FROM embeddings q JOIN chunks c ON c.config_label = 'fixed' OR q.vec_id <> c.chunk_id),
top10 AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY config_label, query_id ORDER BY score DESC, chunk_id) AS rank
                 FROM scored) WHERE rank <= 10),
runs AS (
  SELECT config_label, query_id, avg(hit) AS p, max(hit)::DOUBLE AS r FROM top10 GROUP BY ALL)
SELECT config_label, count(*) AS n_scenarios, round(avg(p), 6) AS section_precision_mean,
       round(avg(r), 6) AS section_recall_mean FROM runs GROUP BY config_label""")
def retrieval_arm_comparison(t):
    """Mean section precision and recall of two arms over the same scenarios: single chunks, and windows over two neighbours each."""
    e = t.embeddings
    first, last = (F.transform(f("embedding", "vec_id"), lambda x: x.cast("double")) for f in (F.min_by, F.max_by))
    windows = e.groupBy(F.floor(F.col("vec_id") / 2).alias("chunk_id")).agg(
        F.zip_with(first, last, lambda x, y: x + y).alias("embedding"), F.min_by("label", "vec_id").alias("label")
    )
    wanted = e.select(F.col("vec_id").alias("query_id"), F.col("label").cast("string").alias("section"))
    arms = []
    for name, chunks in (("structure", _chunks(t)), ("fixed", windows)):
        found = retrieval.top_k(_queries(t), chunks, 10, exclude_self=name == "structure")
        retrieved = found.join(chunks.select("chunk_id", F.col("label").cast("string").alias("section")), "chunk_id")
        scores = metrics.section_scores(retrieved, wanted, ["query_id"])
        arms.append(scores.withColumn("config_label", F.lit(name)))
    return arms[0].unionByName(arms[1]).groupBy("config_label").agg(
        F.count("*").alias("n_scenarios"), F.round(F.avg("precision"), 6).alias("section_precision_mean"),
        F.round(F.avg("recall"), 6).alias("section_recall_mean"),
    )


@query("retrieval_hit_metrics", f"""
WITH {TOP10},
named AS (
  SELECT t.query_id, t.rank, 's3://kb/sec' || c.label || 's' || (c.vec_id % 20) || '-' || c.vec_id || '.md' AS chunk_id,
         'sec' || q.label || 's1' AS wanted, 'sec' || c.label || 's' || (c.vec_id % 20) AS section
  FROM top10 t JOIN embeddings c ON c.vec_id = t.chunk_id JOIN embeddings q ON q.vec_id = t.query_id),
rel AS (SELECT *, (section = wanted OR contains(chunk_id, '/' || wanted))::INT AS hit FROM named),
cited AS (
  SELECT query_id, chunk_id FROM rel WHERE rank % 2 = 1
  UNION ALL SELECT query_id, chunk_id FROM rel WHERE rank = 1
  UNION ALL SELECT vec_id, 's3://kb/elsewhere.md' FROM embeddings),
runs AS (SELECT query_id, count(*) AS k, sum(hit)::BIGINT AS n FROM rel GROUP BY query_id),
cites AS (
  SELECT c.query_id, count(*) AS total, count(r.chunk_id) AS valid, sum(coalesce(r.hit, 0))::BIGINT AS cited_rel
  FROM cited c LEFT JOIN rel r ON r.query_id = c.query_id AND r.chunk_id = c.chunk_id GROUP BY c.query_id)
SELECT r.query_id, k, n AS relevant_retrieved, greatest(n, 1) AS total_relevant,
       round(n / k, 6) AS precision_at_k, round(n / greatest(n, 1), 6) AS recall_at_k,
       total AS total_citations, valid AS valid_citations, round(valid / total, 6) AS citation_precision,
       CASE WHEN n = 0 THEN 0.0 ELSE round(cited_rel / n, 6) END AS citation_recall
FROM runs r JOIN cites c ON c.query_id = r.query_id""")
def retrieval_hit_metrics(t):
    """Precision@k, recall@k and answer citations with ids that name the section in the path."""
    e = t.embeddings
    chunks = e.select(
        F.col("vec_id").alias("c"), F.format_string("sec%ds%d", "label", F.col("vec_id") % 20).alias("section"),
        F.format_string("s3://kb/sec%ds%d-%d.md", "label", F.col("vec_id") % 20, "vec_id").alias("chunk_id"),
    )
    wanted = e.select(F.col("vec_id").alias("query_id"), F.array(F.format_string("sec%ds1", "label")).alias("wanted"))
    found = _top10(t).withColumnRenamed("chunk_id", "c").join(chunks, "c").join(wanted, "query_id")
    none = F.lit(None).cast("string")
    relevant = materialise(found.withColumn(
        "is_relevant", metrics.chunk_is_relevant(F.col("wanted"), F.col("chunk_id"), F.col("section"), none, none)
    ))
    cited = (
        relevant.where("rank % 2 = 1").select("query_id", "chunk_id")
        .unionByName(relevant.where("rank = 1").select("query_id", "chunk_id"))
        .unionByName(e.select(F.col("vec_id").alias("query_id"), F.lit("s3://kb/elsewhere.md").alias("chunk_id")))
    )
    hits = metrics.hit_scores(relevant, ["query_id"])
    cites = metrics.answer_citation_scores(cited, relevant, ["query_id"])
    rounded = ["precision_at_k", "recall_at_k", "citation_precision", "citation_recall"]
    return hits.join(cites, "query_id").select(
        "query_id", "k", "relevant_retrieved", "total_relevant", "total_citations", "valid_citations",
        *[F.round(c, 6).alias(c) for c in rounded],
    )


@query("scope_merge", f"""
WITH {TOP10},
turns AS (
  SELECT conv_id AS session_id, turn, (conv_id * 7 + turn * 3) % (SELECT count(*) FROM embeddings) AS query_id
  FROM conversations),
got AS (SELECT t.session_id, t.turn, k.chunk_id, k.score, k.rank FROM turns t JOIN top10 k ON k.query_id = t.query_id),
best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id, chunk_id ORDER BY score DESC, turn, rank) AS b,
                        min((turn, rank)) OVER (PARTITION BY session_id, chunk_id) AS seen
                 FROM got) WHERE b = 1)
SELECT session_id, chunk_id, score, turn, scope_rank::INT AS scope_rank FROM (
  SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY score DESC, turn, seen, chunk_id) AS scope_rank FROM best)
WHERE scope_rank <= 15""")
def scope_merge(t):
    """Chunks in scope of each conversation; a turn asks with one of the vectors."""
    size = t.embeddings.count()
    turns = t.conversations.select(
        F.col("conv_id").alias("session_id"), "turn",
        ((F.col("conv_id") * 7 + F.col("turn") * 3) % size).alias("query_id"),
    )
    # Only vectors that a turn asks with are queries.
    queries = _queries(t).join(turns.select("query_id").distinct(), "query_id", "left_semi")
    found = retrieval.top_k(queries, _chunks(t), 10, exclude_self=True)
    retrieved = turns.join(found, "query_id").drop("query_id")
    return retrieval.session_scope(retrieved).select("session_id", "chunk_id", "score", "turn", "scope_rank")


@query("prompt_table", f"""
WITH {TOP10},
size AS (SELECT count(*) AS n FROM embeddings),
j AS (SELECT d.doc_id AS query_id, t.chunk_id, t.score, c.source, c.text, row_number() OVER (PARTITION BY d.doc_id ORDER BY t.rank) AS i
      FROM documents d JOIN size ON true JOIN top10 t ON t.query_id = d.doc_id % n
      LEFT JOIN documents c ON c.doc_id = t.chunk_id + n * (d.doc_id // n))
SELECT query_id, count(*) AS n_chunks, md5(string_agg(
  '--- Provision ' || i || ' (chunk_id: ' || chunk_id || ') ---' || chr(10) || 'Section: ' || coalesce(source, 'unknown') || chr(10)
  || 'Score: ' || printf('%.4f', round(score::DECIMAL(18, 6), 4)) || chr(10) || chr(10) || coalesce(text, ''),
  chr(10) || chr(10) ORDER BY i)) AS context_md5
FROM j GROUP BY query_id""")
def prompt_table(t):
    """Context block per document. The vectors stand for each stretch of as many documents, so every document is asked for and cited."""
    n = t.embeddings.count()
    part = F.floor(F.col("doc_id") / n)
    asked = t.documents.select(F.col("doc_id").alias("asker"), (F.col("doc_id") % n).alias("query_id"), part.alias("part"))
    docs = t.documents.select((F.col("doc_id") % n).alias("chunk_id"), part.alias("part"), retrieval.packed(F.col("text").cast("binary")).alias("content"), F.col("source").alias("section"))

    def blocks(found):
        found = found.select(F.col("asker").alias("query_id"), "rank", "chunk_id", "section", "score", "content")
        texts = lambda some: F.transform(retrieval.unpacked(some), lambda x: F.coalesce(x.cast("string"), F.lit("")))
        told = retrieval.context_blocks(found, ["query_id"], unpack=texts)
        return told.select("query_id", F.col("n_chunks").cast("long").alias("n_chunks"), F.md5("context").alias("context_md5"))

    return retrieval.in_slices(asked, materialise(_top10(t)), docs, ["chunk_id", "part"], "asker", blocks)


@query("cited_in_scope", f"""
WITH {TOP10}
SELECT t.query_id, count(*) AS n_in_scope, count_if(c.label = q.label)::BIGINT AS n_cited
FROM top10 t JOIN embeddings c ON c.vec_id = t.chunk_id JOIN embeddings q ON q.vec_id = t.query_id
GROUP BY t.query_id""")
def cited_in_scope(t):
    """Flag chunks in scope that the answer cites; here it cites those of its own label."""
    retrieved, expected = _labelled(t, materialise(_top10(t)))
    cited = retrieved.join(expected, ["query_id", "section"], "left_semi").select("query_id", "chunk_id")
    marked = retrieval.mark_cited(retrieved, cited, ["query_id", "chunk_id"])
    return marked.groupBy("query_id").agg(F.count("*").alias("n_in_scope"), F.count_if("is_cited").alias("n_cited"))


@query("sections_in_rank_order", f"""
WITH {TOP10}
SELECT t.query_id, c.label::VARCHAR AS section, min(t.rank)::INT AS first_rank
FROM top10 t JOIN embeddings c ON c.vec_id = t.chunk_id GROUP BY ALL""")
def sections_in_rank_order(t):
    retrieved, _ = _labelled(t, _top10(t))
    return metrics.sections_in_rank_order(retrieved, ["query_id"]).select("query_id", "section", "first_rank")
