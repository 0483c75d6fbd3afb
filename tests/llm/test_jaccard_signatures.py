import numpy as np
import pytest
from pyspark.sql import functions as F

from ragspark.llm import jaccard


def pair(rng, n, m, shared):
    draw = lambda k: rng.integers(0, 2**63, k).astype(np.uint64)
    both = draw(shared)
    return np.concatenate([both, draw(n - shared)]), np.concatenate([both, draw(m - shared)])


def common(a, b):
    return len(np.intersect1d(jaccard.signatures(a, 0.75), jaccard.signatures(b, 0.75)))


def test_pairs_at_the_threshold_always_meet():
    """Sizes of one band and of two, with just as many shared shingles as a link needs."""
    rng = np.random.default_rng(3)
    tried = 0
    for _ in range(1500):
        n = int(rng.integers(1, 700))
        m = int(rng.integers(int(np.ceil(0.75 * n)), int(n / 0.75) + 1))
        shared = min(int(np.ceil(3 * (n + m) / 7)), n, m)
        if 100 * shared >= 75 * (n + m - shared):
            tried += 1
            assert common(*pair(rng, n, m, shared)) > 0, (n, m, shared)
    assert tried > 1000


def test_signatures_select():
    """Share of pairs that meet, mean of common signatures, and signatures a set; unrelated sets hardly ever meet."""
    rng = np.random.default_rng(4)
    for n in (60, 250, 1000):
        line = [f"{n} shingles, {len(jaccard.signatures(pair(rng, n, n, 0)[0], 0.75))} signatures"]
        for similarity in (0.0, 0.3, 0.5, 0.7):
            met = [common(*pair(rng, n, n, round(2 * n * similarity / (1 + similarity)))) for _ in range(100)]
            line.append(f"{similarity}: {np.mean(np.array(met) > 0):.2f} / {np.mean(met):.1f}")
            assert similarity or np.mean(np.array(met) > 0) < 0.05
        print("; ".join(line))


@pytest.mark.parametrize("slice_size", [256, 3])
def test_cells_hold_every_pair_that_may_link(spark, monkeypatch, slice_size):
    """Pairs of two components that share a signature, against all pairs; also with signatures cut into many slices."""
    monkeypatch.setattr(jaccard, "SLICE", slice_size)
    rng = np.random.default_rng(6)
    base = rng.integers(0, 2**63, 40).astype(np.uint64)
    found = [np.unique(np.concatenate([base[: int(k)], rng.integers(0, 2**63, 40 - int(k)).astype(np.uint64)])) for k in rng.integers(20, 41, 30)]
    sets = spark.createDataFrame([(i, bytearray(jaccard._sketch(f))) for i, f in enumerate(found)], "cls long, sketch binary")
    rows = [(s, i, len(found[i]), i % 4 if s % 2 else i) for s in range(4) for i in range(30) if (i + s) % 3]
    near = spark.createDataFrame(rows, "sig long, cls long, n long, comp long")
    got = {(r.a, r.b) for r in jaccard._meeting(near, sets, 0.75).collect()}
    want, similar = set(), set()
    for sig, a, n, comp in rows:
        for other, b, m, to in rows:
            if sig == other and a < b and comp != to:
                shared = len(np.intersect1d(found[a], found[b]))
                bound = int(np.minimum(*(np.frombuffer(jaccard._sketch(found[i]), "<u4") for i in (a, b))).sum())
                similar |= {(a, b)} if 100 * shared >= 75 * (n + m - shared) else set()
                want |= {(a, b)} if 100 * bound >= 75 * (n + m - bound) else set()
    assert got == want and similar and similar <= got
    assert jaccard._meeting(near.where(F.lit(False)), sets, 0.75).count() == 0


def test_a_pair_leaves_its_blocks_once(spark, monkeypatch):
    """However many signatures two sets share, and however many blocks there are, one row leaves for them, and none if the fine sketches rule them out."""
    monkeypatch.setattr(jaccard, "SLICE", 2)
    rng = np.random.default_rng(8)
    base = rng.integers(0, 2**63, 1000).astype(np.uint64)
    draw = lambda k: np.unique(np.concatenate([base[:k], rng.integers(0, 2**63, 1000 - k).astype(np.uint64)]))
    found = [draw(950) for _ in range(25)] + [draw(700) for _ in range(15)]
    rows = [(i, bytearray(jaccard._sketch(f)), bytearray(jaccard._fine(f))) for i, f in enumerate(found)]
    sets = spark.createDataFrame(rows, "cls long, sketch binary, fine binary")
    near = spark.range(60).selectExpr("id AS sig").crossJoin(spark.range(40).selectExpr("id AS cls")).selectExpr("sig", "cls", "1000L AS n", "cls AS comp")
    got = [(r.a, r.b) for r in jaccard._meeting(near, sets, 0.75).collect()]
    assert sorted(got) == [(a, b) for a in range(25) for b in range(a + 1, 25)]


def test_sets_without_a_pair_do_not_move(spark):
    """A short list of pairs fetches its own sets and hardly any others."""
    sets = spark.range(20000).select(F.col("id").alias("a"), F.array("id").alias("found"))
    wanted = spark.range(0, 20000, 200).select(F.col("id").alias("a"))
    got = {r.a for r in jaccard._maybe(sets, wanted, "a").select("a").collect()}
    assert set(range(0, 20000, 200)) <= got and len(got) < 120
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "a long, b long")
    two = spark.createDataFrame([(1, [1, 2, 3, 4], None), (2, [1, 2, 3, 4, 5], None), (3, [1, 7], None), (4, [1], None)], "cls long, found array<long>, fine binary")
    assert [tuple(r) for r in jaccard._verified(pairs, two, 0.75).collect()] == [(1, 2)]


def test_texts_meet_the_bitmap_before_they_are_shuffled(spark):
    """The join with the listed ids stays above the bitmap, also where the ids are too many to broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        rows = spark.range(5000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
        kept = jaccard._only(rows, spark.range(0, 5000, 50).select(F.col("id").alias("doc_id")))
        joins = [x for x in kept._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join " in x]
        assert "getbit" not in joins[0] and "getbit" in joins[1]
        assert sorted(r.doc_id for r in kept.collect()) == list(range(0, 5000, 50))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
