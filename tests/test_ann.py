import numpy as np
import pytest
from pyspark.sql import functions as F

from ragspark.operators import ann, retrieval


def chunks(spark, x, ids=None):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame([(i, None if v is None else [float(c) for c in v]) for i, v in zip(ids, x)], "chunk_id string, embedding array<float>" if isinstance(
        next(iter(ids), 0), str) else "chunk_id long, embedding array<float>")


def test_calibrated_recall_and_exact_scores(spark):
    """Unstructured vectors, the hardest case: the wanted recall while a small share is scored, over several slices and blocks."""
    x = np.random.default_rng(0).standard_normal((1500, 32))
    rows = chunks(spark, x).repartition(3)
    index = ann.build(rows, parts=8, slice_rows=256)
    assert index.slices.count() >= 3 and index.slices.select(F.explode("chunk_ids")).count() == 1500
    few = ann.calibrate(index, 10, 0.96, trial_queries=200)
    assert 10 <= few < 150
    queries = rows.withColumnRenamed("chunk_id", "query_id")
    got = {(r.query_id, r.chunk_id): r.score for r in ann.search(queries, index, 10, candidates=few, exclude_self=True).collect()}
    want = {(r.query_id, r.chunk_id): r.score for r in retrieval.top_k(queries, rows, 10, exclude_self=True).collect()}
    assert len(got) == len(want) and sum(p in got for p in want) >= 0.95 * len(want)
    assert all(got[p] == want[p] for p in want if p in got)


def test_all_candidates_are_the_exact_answer(spark):
    x = [*np.random.default_rng(1).standard_normal((60, 7)), np.zeros(7), None, np.ones(7), np.ones(7)]
    rows = chunks(spark, x, [f"c{i:02d}" for i in range(64)])
    index = ann.build(rows, parts=3, centres=5, slice_rows=16)
    assert index.total == 63
    queries = rows.withColumnRenamed("chunk_id", "query_id")
    for exclude in (False, True):
        got = ann.search(queries, index, 4, candidates=63, exclude_self=exclude)
        want = retrieval.top_k(queries, rows, 4, exclude_self=exclude)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_index_edges(spark):
    rows = chunks(spark, np.eye(3))
    queries = rows.withColumnRenamed("chunk_id", "query_id")
    none = ann.build(rows.limit(0))
    assert none.total == 0 and ann.calibrate(none) == 10 and ann.search(queries, none, 2, candidates=5).count() == 0
    index = ann.build(rows)
    assert ann.search(queries.limit(0), index, 2, candidates=2).count() == 0
    assert {(r.query_id, r.chunk_id) for r in ann.search(queries, index, 1, candidates=9).collect()} == {(0, 0), (1, 1), (2, 2)}
    with pytest.raises(ValueError, match="byte"):
        ann.build(rows, centres=300)
