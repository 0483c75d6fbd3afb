"""Components of sets grow round by round; links inside a component or between two that are linked already count once."""

from ragspark.llm import components, jaccard


def test_many_links_of_two_groups_are_one(spark):
    frame = lambda rows: spark.createDataFrame(rows, "a long, b long")
    groups = [(10 * g, 10 * g + i) for g in (1, 2, 3) for i in range(1, 10)]
    rest = [(10 + i, 20 + j) for i in range(10) for j in range(10)] + [(12, 15), (31, 40), (41, 40)]
    label = jaccard._merged(None, frame(groups))
    assert sorted(map(tuple, jaccard._contracted(frame(rest), label).collect())) == [(10, 20), (30, 40), (40, 41)]
    got = {tuple(r) for r in jaccard._merged(label, frame(rest)).select("cls", "comp").collect()}
    assert got == {tuple(r) for r in components.components(frame(groups + rest)).select("id", "component_id").collect()}
    assert dict(got)[29] == 10 and dict(got)[41] == 30


def test_links_of_near_copies_are_fewer_than_pairs(spark, monkeypatch):
    """Two groups that one round leaves apart: what is handed to the components is a tree, not all similar pairs."""
    import numpy as np

    base = np.random.default_rng(2).integers(0, 2**63, 60).astype(np.uint64)
    sets = [np.unique(np.concatenate([base, np.array([i], np.uint64)])) for i in range(30)]
    rows = [(i, len(s), bytearray(jaccard._sketch(s)), bytearray(jaccard._fine(s)), s.view(np.int64).tolist()) for i, s in enumerate(sets)]
    close = spark.createDataFrame(rows, "cls long, n long, sketch binary, fine binary, found array<long>")
    links = jaccard._links(close, 0.75, rounds=1)
    assert links.count() < 60
    assert {r.component_id for r in components.components(links).collect()} == {0}


def test_near_copies_merge_before_all_their_pairs_come(spark, monkeypatch):
    """Sets that nearly all link, in as many components: their nearest pairs merge them, so few pairs are let out and compared."""
    import numpy as np

    rng = np.random.default_rng(4)
    base, far = (rng.integers(0, 2**63, 100).astype(np.uint64) for _ in range(2))
    draw = lambda kept: np.unique(np.concatenate([rng.choice(base, kept, replace=False), rng.integers(0, 2**63, 100 - kept).astype(np.uint64)]))
    sets = [draw(94) for _ in range(60)] + [draw(70) for _ in range(5)] + [far]
    rows = [(i, len(s), bytearray(jaccard._sketch(s)), bytearray(jaccard._fine(s)), s.view(np.int64).tolist()) for i, s in enumerate(sets)]
    close = spark.createDataFrame(rows, "cls long, n long, sketch binary, fine binary, found array<long>")
    links = {(i, j) for i in range(66) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 75 * len(np.union1d(sets[i], sets[j]))}
    compared, plain = [], jaccard._verified
    monkeypatch.setattr(jaccard, "_verified", lambda pairs, *a, **b: compared.append(pairs.count()) or plain(pairs, *a, **b))
    got = jaccard._links(close, 0.75, rounds=0)
    want = components.components(spark.createDataFrame([(int(i), int(j)) for i, j in links], "a long, b long"))
    assert {tuple(r) for r in components.components(got).collect()} == {tuple(r) for r in want.collect()}
    assert len(links) > 1000 and got.count() < 150 and sum(compared) < 300
