import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from ragspark.functions.packing import count_words, pack_blocks
from ragspark.operators import chunking, ranking, retrieval


# --- ranking ---------------------------------------------------------------------------


def test_row_numbers_with_hot_group(spark):
    rows = [("hot" if i % 3 else "cold", i) for i in range(500)] + [(None, i) for i in range(7)]
    df = spark.createDataFrame(rows, "g string, ord int").repartition(4)
    out = ranking.row_numbers(df, ["g"], F.floor(F.col("ord") / 16), [F.col("ord")], "n").collect()
    for g in ("hot", "cold", None):
        mine = sorted((r.ord, r.n) for r in out if r.g == g)
        assert [n for _, n in mine] == list(range(1, len(mine) + 1))
    whole = ranking.row_numbers(df.where("g is not null"), [], F.floor(F.col("ord") / 16), [F.col("ord")], "n").collect()
    assert sorted(r.n for r in whole) == list(range(1, 501))


@pytest.mark.parametrize("make", [lambda i: float(i), lambda i: 1.0, lambda i: float(i % 3), lambda i: random.Random(i).lognormvariate(0, 3)])
def test_latency_stats_are_exact(spark, make):
    random.seed(1)
    values = [("a", make(i)) for i in range(1000)] + [("b", make(i)) for i in range(20)] + [("c", make(5))]
    df = spark.createDataFrame(values, "g string, v double")
    for bins, few in ((4096, 100_000), (8, 16), (64, 0)):  # the number of passes must not change the result
        got = {r.g: r for r in ranking.latency_stats(df, ["g"], "v", bins, few).collect()}
        for g in "abc":
            v = sorted(x for k, x in values if k == g)
            r = got[g]
            want = (len(v), statistics.mean(v), statistics.median(v), v[min(int(len(v) * 0.95), len(v) - 1)], v[0], v[-1])
            assert (r.n, r.mean_ms, r.median_ms, r.p95_ms, r.min_ms, r.max_ms) == pytest.approx(want)


# --- retrieval -------------------------------------------------------------------------


def vectors(n, seed, dims=8, copies=0):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, dims)).astype("float32")
    v[:copies] = v[0]
    return [(i, [float(x) for x in row]) for i, row in enumerate(v)]


def brute(queries, chunks, k, exclude_self):
    out = []
    for qi, q in queries:
        scored = []
        for ci, c in chunks:
            if exclude_self and qi == ci:
                continue
            a, b = np.array(q, float), np.array(c, float)
            scored.append((-round(float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)), 6), ci))
        out += [(qi, ci, -s, r) for r, (s, ci) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("exclude_self,copies", [(False, 0), (True, 100)])
def test_top_k_both_plans_equal_brute_force(spark, exclude_self, copies):
    data = vectors(300, 7, copies=copies)
    q = spark.createDataFrame(data, "query_id bigint, embedding array<float>").repartition(3)
    c = spark.createDataFrame(data, "chunk_id bigint, embedding array<float>").repartition(3)
    want = brute(data, data, 5, exclude_self)
    for options in ({}, {"broadcast_queries": 10, "group_rows": 16}):
        got = sorted(tuple(r) for r in retrieval.top_k(q, c, 5, exclude_self=exclude_self, **options).collect())
        assert [g[:2] + g[3:] for g in got] == [w[:2] + w[3:] for w in want]
        assert [g[2] for g in got] == pytest.approx([w[2] for w in want])


def test_top_k_of_nothing_and_of_few(spark):
    data = vectors(3, 1)
    q = spark.createDataFrame(data, "query_id bigint, embedding array<float>")
    c = spark.createDataFrame(data, "chunk_id bigint, embedding array<float>")
    assert retrieval.top_k(q.limit(0), c).count() == 0
    assert retrieval.top_k(q, c.where("chunk_id < 0")).count() == 0
    assert retrieval.top_k(q, c.where("chunk_id < 0"), broadcast_queries=1).count() == 0
    assert retrieval.top_k(q, c, 10, broadcast_queries=1).count() == 9


def test_probes_trade_recall_for_work(spark):
    data = vectors(300, 7)
    q = spark.createDataFrame(data, "query_id bigint, embedding array<float>")
    c = spark.createDataFrame(data, "chunk_id bigint, embedding array<float>")
    exact = {r[:2] for r in map(tuple, retrieval.top_k(q, c, 5).collect())}
    found = {n: {r[:2] for r in map(tuple, retrieval.top_k(q, c, 5, group_rows=64, cells=8, probes=n).collect())} for n in (1, 6, 8)}
    assert found[8] == exact and len(found[6] & exact) >= 0.9 * len(exact) and len(found[1] & exact) >= 300


def test_top_k_plan_limits_before_the_shuffle(spark):
    data = vectors(30, 2)
    q = spark.createDataFrame(data, "query_id bigint, embedding array<float>")
    c = spark.createDataFrame(data, "chunk_id bigint, embedding array<float>")
    plan = retrieval.top_k(q, c)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_session_scope_equals_running_merge(spark):
    rng = random.Random(5)
    rows = []
    for s in range(6):
        for t in range(5):
            picked = rng.sample(range(40), 10)
            scores = sorted((rng.random() for _ in picked), reverse=True)
            rows += [(f"s{s}", t, r, f"c{c}", sc) for r, (c, sc) in enumerate(zip(picked, scores), 1)]
    df = spark.createDataFrame(rows, "session_id string, turn int, rank int, chunk_id string, score double")
    got = {}
    for r in retrieval.session_scope(df).collect():
        got.setdefault(r.session_id, []).append((r.scope_rank, r.chunk_id, r.score))
    for s in range(6):
        held = {}
        for t in range(5):
            for r in (r for r in rows if r[0] == f"s{s}" and r[1] == t):
                if r[3] not in held or r[4] > held[r[3]]:
                    held[r[3]] = r[4]
            held = dict(sorted(held.items(), key=lambda i: -i[1])[:15])
        assert sorted(got[f"s{s}"]) == [(i, c, v) for i, (c, v) in enumerate(held.items(), 1)]


def test_scope_can_be_deduplicated_by_file(spark):
    df = spark.createDataFrame(
        [("s", 0, 1, "f-001", "f", 0.9), ("s", 0, 2, "f-002", "f", 0.8), ("s", 1, 1, "g-001", "g", 0.85)],
        "session_id string, turn int, rank int, chunk_id string, source_id string, score double",
    )
    got = [(r.source_id, r.chunk_id) for r in retrieval.session_scope(df, dedupe_key="source_id").orderBy("scope_rank").collect()]
    assert got == [("f", "f-001"), ("g", "g-001")]


def test_context_block_and_metadata(spark):
    df = spark.createDataFrame(
        [(1, 2, "b", None, "two", 0.5), (1, 1, "a", "s1", "one", 0.25)], "q int, rank int, chunk_id string, section string, content string, score double"
    )
    row = retrieval.context_blocks(df, ["q"]).first()
    assert row.context == (
        "--- Provision 1 (chunk_id: a) ---\nSection: s1\nScore: 0.2500\n\none\n\n--- Provision 2 (chunk_id: b) ---\nSection: unknown\nScore: 0.5000\n\ntwo"
    )
    meta = spark.range(1).select(retrieval.public_metadata(F.create_map(F.lit("x-amz-bedrock-kb-id"), F.lit("1"), F.lit("section"), F.lit("s")))).first()[0]
    assert meta == {"section": "s"}


# --- chunking --------------------------------------------------------------------------


def test_packing_rules():
    small = pack_blocks([("a", "alpha"), ("b", ""), ("c", "charlie"), ("a", "again")], "# Heading", 100, 500)
    assert small == [("# Heading\n\nalpha\n\ncharlie\n\nagain", ["a", "c"])]
    many = pack_blocks([(str(i), f"Sentence number {i} with a little extra text here.") for i in range(8)], "", 20, 2000)
    assert len(many) > 1 and all(count_words(t) <= 20 for t, _ in many)
    big = pack_blocks([("x", "tiny"), ("big", "\n\n".join(["This is a sentence. " * 8] * 8)), ("y", "end")], "", 30, 2000)
    assert all(count_words(t) <= 30 for t, _ in big) and [ls for _, ls in big[1:-1]] == [["big"]] * (len(big) - 2)
    assert all(len(t) <= 200 for t, _ in pack_blocks([("blob", "ha " * 1500)], "", 100000, 200))
    assert all(len(t) <= 2000 for t, _ in pack_blocks([("blob", "supercalifragilistic" * 800)], "", 25, 2000))
    with pytest.raises(ValueError):
        pack_blocks([("u", "x")], "a b c d", 3, 100)


def test_packing_with_a_subword_counter():
    counter = lambda t: (len(t) + 3) // 4
    chunks = pack_blocks([("blob", "supercalifragilistic" * 80), ("t", "some words here")], "", 25, 2000, counter)
    assert all(counter(t) <= 25 for t, _ in chunks)


@pytest.mark.parametrize("tokens,chars", [(480, 2000), (60, 300)])
def test_blocked_packer_equals_sequential(spark, tokens, chars):
    """Long parents, equal units whose chains never meet, and oversize units inside."""
    rng = random.Random(3)
    make = {
        "uniform": (3500, lambda i: "abcd efg hij klm " * 2), "tiny": (2500, lambda i: "x"), "one": (1, lambda i: "ha " * 1500),
        "rand": (3000, lambda i: "w " * rng.choice([0, 1, 2, 5, 30, 200, 3000 if i % 50 == 0 else 3])),
    }
    rows = [(p, i, f"l{i % 7}", f(i), "# H " + p) for p, (n, f) in make.items() for i in range(n)]
    units = spark.createDataFrame(rows, "parent string, ord int, label string, text string, header string").repartition(4)
    out = chunking.pack_units(units, max_tokens=tokens, max_chars=chars).collect()
    for p in make:
        want = pack_blocks([(r[2], r[3]) for r in rows if r[0] == p], "# H " + p, tokens, chars)
        got = sorted((r.chunk_index, r.text, r.labels) for r in out if r.parent == p)
        assert got == [(i, t, ls) for i, (t, ls) in enumerate(want)], p


def test_fixed_windows(spark):
    docs = spark.createDataFrame([("a", " ".join(str(i) for i in range(25))), ("b", ""), ("c", "one two")], "k string, text string")
    out = {(r.k, r.chunk_index): r for r in chunking.fixed_windows(docs, "k", "text", size=10, overlap=0.1).collect()}
    assert sorted(out) == [("a", 0), ("a", 1), ("a", 2), ("c", 0)]
    assert out["a", 1].text.split()[0] == "9" and out["a", 2].text.split()[-1] == "24" and out["a", 2].n_words == 7


def test_windows_of_parts_equal_windows_of_documents(spark):
    rng = random.Random(4)
    whole, parts = [], []
    for d in range(12):
        pieces = [" ".join(f"w{rng.randrange(999)}" for _ in range(rng.randrange(10, 60))) for _ in range(rng.randrange(0, 6))]
        pieces.append(" ".join("z" for _ in range(rng.randrange(0, 25))))
        whole.append((f"d{d}", "\n".join(pieces)))
        parts += [(f"d{d}", i, p + "\n") for i, p in enumerate(pieces)]
    docs = spark.createDataFrame(whole, "k string, text string")
    cut = spark.createDataFrame(parts, "k string, part bigint, text string").repartition(3)
    columns = ["k", "chunk_index", "chunk_id", "text", "n_words"]
    for size, overlap in ((10, 0.1), (10, 0.5), (7, 0.0)):
        want = chunking.fixed_windows(docs, "k", "text", size=size, overlap=overlap).select(columns)
        got = chunking.fixed_windows_of_parts(cut, "k", size=size, overlap=overlap).select(columns)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    with pytest.raises(Exception, match="fewer than"):
        chunking.fixed_windows_of_parts(cut, "k", size=100).count()


def test_policy_units(spark):
    content = "intro\n# T one\n## A\nbody a\n# dropped\nmore\n## B\n\n## C\nlast"
    df = spark.createDataFrame([(content,), ("## Only\nx",)], "c string")
    got = df.select(chunking.policy_title(F.col("c")).alias("t"), chunking.policy_units(F.col("c")).alias("u")).collect()
    assert got[0].t == "# T one" and got[1].t == "# Policy"
    assert [tuple(u) for u in got[0].u] == [("preamble", "intro"), ("## A", "## A\n\nbody a\nmore"), ("## C", "## C\n\nlast")]
