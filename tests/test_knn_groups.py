"""The cell plan of the nearest neighbours: few large groups, same rows as sorting all scores."""

import numpy as np
import pytest

from ragspark.operators import retrieval


def frames(spark, n, dims=8, seed=3):
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(np.random.default_rng(seed).normal(size=(n, dims)).astype("float32"))]
    return spark.createDataFrame(rows, "query_id bigint, embedding array<float>"), spark.createDataFrame(rows, "chunk_id bigint, embedding array<float>")


def test_a_row_is_sent_to_few_groups(spark):
    q, c = frames(spark, 1200)
    # Each group a query is sent to gives up to five rows; 300 cells of four rows were a group each.
    assert retrieval._by_cells(q, c, 5, False, 16, 1024, None).count() < 1200 * 5 * 20


@pytest.mark.parametrize("exclude_self", [False, True])
def test_group_equals_sorting_all_scores(exclude_self):
    rng = np.random.default_rng(1)
    c = rng.normal(size=(3000, 16))
    c[::3] = c[0]  # copies: ties go to the smaller id
    c[5::400] = c[4::400] + 1e-9
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    c[7] = np.nan
    ids = rng.permutation(3000)
    got = [tuple(r) for part in retrieval._best_of_group(ids[:700], c[:700], ids, c, 6, exclude_self) for r in part.itertuples(index=False)]
    scores = np.rint(c[:700] @ c.T * 10**6) / 10**6
    want = []
    for i in range(700):
        order = [j for j in np.lexsort((ids, -scores[i])) if j != 7 and i != 7 and not (exclude_self and j == i)]
        want += [(ids[i], ids[j], scores[i, j]) for j in order[:6]]
    assert sorted(got) == sorted(want)


def test_candidate_lists_of_several_cells_move_no_vector_for_a_pair(spark, monkeypatch):
    from ragspark.operators import ann

    q, c = frames(spark, 1000, dims=16)
    index = ann.build(c.repartition(4), parts=4, slice_rows=64)
    one = sorted(map(tuple, ann.search(q, index, 5, candidates=40, exclude_self=True).collect()))
    monkeypatch.setattr(ann, "GROUP_CODES", 300)
    monkeypatch.setattr(ann, "GROUP_QUERIES", 300)
    assert ann._grid(index, 1000)[1] >= 3 and ann._grid(index, 1000)[2] >= 3
    # A list for each query and cell, where there was a row for each query and candidate of every slice.
    assert ann._lists(q, index, 41).count() <= 1000 * 5
    assert ann._trimmed(ann._lists(q, index, 41), 41).selectExpr("sum(size(chunk_ids))").first()[0] == 41_000
    assert sorted(map(tuple, ann.search(q, index, 5, candidates=40, exclude_self=True).collect())) == one
