"""Embedding near-duplicates against all pairs by brute force, on planted near vectors, copies and unusable ones."""

import numpy as np

from ragspark.llm import neardup


def planted():
    rng = np.random.default_rng(8)
    unit = lambda v: v / np.linalg.norm(v)
    rows = [unit(rng.standard_normal(64)) for _ in range(300)]
    for base in range(40):
        for cosine in (0.97, 0.93, 0.85):
            away = rng.standard_normal(64)
            away = unit(away - (away @ rows[base]) * rows[base])
            rows.append(3.0 * (cosine * rows[base] + np.sqrt(1 - cosine**2) * away))
    rows += [2.0 * rows[0], rows[1].copy(), rows[1].copy()]
    return [(i, v.tolist()) for i, v in enumerate(rows)] + [(900, None), (901, [0.0] * 64), (902, [float("nan")] * 64), (903, [None] * 64), (904, [])]


def test_links_and_components_equal_brute_force(spark):
    rows = planted()
    sound = [(i, np.array(v)) for i, v in rows if i < 900]
    m = np.array([v / np.linalg.norm(v) for _, v in sound])
    near = (m @ m.T >= 0.9) & ~np.eye(len(m), dtype=bool)
    assert near.sum() > 160
    root = list(range(len(m)))
    for _ in range(6):
        root = [min([root[i], *(root[j] for j in np.flatnonzero(near[i]))]) for i in range(len(m))]
    frame = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, label int, cls string")
    got = {r.vec_id: r for r in neardup.near_duplicates(frame).collect()}
    assert len(got) == len(rows)
    # No link below the threshold; those above it are at 0.93 or more here, far enough to be found.
    assert {i: got[i].n_links for i in range(len(m))} == {i: int(near[i].sum()) for i in range(len(m))}
    assert {i: got[i].component_id for i in range(len(m))} == dict(enumerate(root))
    assert all(got[i].kept == (root[i] == i) for i in range(len(m)))
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i in range(900, 905))


def test_empty_table(spark):
    frame = spark.createDataFrame([], "vec_id long, embedding array<double>, extra int")
    assert neardup.near_duplicates(frame).count() == 0
