"""Whitening, phrase mining and exact top-k against brute force, on edge cases and planted rows."""

import math
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from ragspark.llm import phrases, topk, whitening

VECTORS = "vec_id long, embedding array<double>, label int, n long, dim int, score long, block string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, 3, 4, "x") for i, v in rows], VECTORS)


def odd_vectors():
    rng = np.random.default_rng(4)
    rows = [(i, (rng.standard_normal(24) * np.linspace(3, 0.2, 24)).tolist()) for i in range(300)]
    rows += [(i, rows[i % 7][1]) for i in range(300, 420)]  # copies
    rows += [(420, None), (421, []), (422, [float("nan")] * 24), (423, [math.inf] * 24), (424, [None] + [1.0] * 23)]
    rows += [(425, [0.0] * 24), (426, rows[0][1]), (426, rows[0][1]), (None, rows[5][1])]
    return rows


def sound(v):
    return bool(v) and all(c is not None and math.isfinite(c) for c in v)


@pytest.mark.parametrize("spread", [1.0, 1e-3, 1e-6])
def test_spectrum(spread):
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 17, 64):
        q, _ = np.linalg.qr(rng.standard_normal((n, n)))
        for values in (np.geomspace(1, spread, n), np.sort(rng.standard_normal(n)) * 1e5, np.r_[np.ones(n // 2), np.full(n - n // 2, 2.0)], np.zeros(n)):
            a = (q * values) @ q.T
            got, x = whitening.eigen(a)
            scale = max(np.abs(values).max(), 1e-300)
            assert np.allclose(got, np.sort(values)[::-1], atol=1e-13 * n * scale, rtol=0)
            assert np.abs(x.T @ x - np.eye(n)).max() < 1e-13 * n
            assert np.abs(a @ x - x * got).max() <= 1e-13 * n * scale


def test_polar_is_the_sign():
    rng = np.random.default_rng(2)
    q, _ = np.linalg.qr(rng.standard_normal((20, 20)))
    values = np.r_[np.geomspace(1e-9, 5, 12), -np.geomspace(1e-6, 3, 8)]
    sign = whitening.polar((q * values) @ q.T)
    assert np.abs(sign - (q * np.sign(values)) @ q.T).max() < 1e-6
    assert np.abs(sign @ sign - np.eye(20)).max() < 1e-12


def test_whitening(spark):
    rows = odd_vectors()
    got = whitening.whiten(vectors(spark, rows)).collect()
    x = {}
    kept = [(i, tuple(math.floor(64 * c) + 1000000 for c in v)) for i, v in rows if sound(v)]
    distinct = np.array(sorted({v for _, v in kept}), object)
    n, sums = len(distinct), distinct.sum(0)
    centred = np.array([[float(Fraction(int(n * c - s), n)) for c, s in zip(v, sums)] for v in distinct])
    cov = centred.T @ centred / n
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    assert len(got) == 16 * len(kept)
    for i, v in kept:
        x.setdefault(i, np.array([float(Fraction(int(n * c - s), n)) for c, s in zip(v, sums)]))
    signs = {}
    for r in got:
        k = r.component - 1
        want = x[r.vec_id] @ axes[:, k] / math.sqrt(values[k])
        if abs(want) > 1e-6:
            assert signs.setdefault(k, np.sign(want * r.whitened)) * want == pytest.approx(r.whitened, rel=1e-7, abs=1e-9)
        assert r.explained == pytest.approx(values[k] / np.trace(cov), rel=1e-10)
        assert r.n == n and 0 <= r.identity_error < 1e-9
    exact = {i: sum((n * c - int(s)) ** 2 for c, s in zip(v, sums)) for i, v in kept}
    assert {r.vec_id: r.deviation for r in got} == exact
    assert Counter(r.vec_id for r in got)[426] == 32


def test_whitening_edges(spark):
    some = vectors(spark, odd_vectors())
    assert whitening.whiten(some.limit(0)).count() == 0
    assert whitening.whiten(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    # Vectors of other lengths are fitted apart, and constant dimensions give no component.
    mixed = [(i, [float(i % 5), float(i * i % 7), 1.0]) for i in range(30)] + [(100 + i, [float(i)]) for i in range(6)]
    got = whitening.whiten(vectors(spark, mixed)).collect()
    assert {(r.vec_id >= 100, r.component) for r in got} == {(False, 1), (False, 2), (True, 1)}
    assert {r.n for r in got if r.vec_id >= 100} == {6}
    big = [(1, [2.0**39, 0.0]), (2, [0.0, 1.0]), (3, [2.0**41, 0.0])]
    with pytest.raises(Exception, match="(?i)overflow|too large|int"):
        whitening.whiten(vectors(spark, big)).collect()


def brute_top(rows, asked, k):
    whole = [(i, [math.floor(256 * c) for c in v]) for i, v in rows if i is not None and sound(v)]
    out = Counter()
    for i, q in whole:
        if not asked(i):
            continue
        scored = sorted((-sum(a * b for a, b in zip(q, c)), j) for j, c in whole if j != i and len(c) == len(q))
        out.update((i, rank, j, -s) for rank, (s, j) in enumerate(scored[:k], 1))
    return out


@pytest.mark.parametrize("sizes", [(65536, 2048), (16, 4)])
def test_top_k(spark, sizes):
    rows = odd_vectors() + [(500, [1.5, 2.0]), (505, [0.5, -1.0]), (510, [3.0] * 5), (600, [-1.0] * 24), (605, [1e5] * 24)]
    frame = vectors(spark, rows).repartition(3)
    asked = frame.where("vec_id % 5 = 0").withColumnRenamed("vec_id", "query_id")
    got = topk.top_k(asked, frame, block_rows=sizes[0], block_queries=sizes[1])
    assert Counter(tuple(r) for r in got.collect()) == brute_top(rows, lambda i: i % 5 == 0, 5)


def test_top_k_edges(spark):
    frame = vectors(spark, odd_vectors())
    asked = frame.withColumnRenamed("vec_id", "query_id")
    assert topk.top_k(asked.limit(0), frame).count() == 0 and topk.top_k(asked, frame.limit(0)).count() == 0
    # Whole numbers beyond 2^53 stay exact; ties of very many rows are cut in the slice.
    big = [(0, [2.0**22 + 1, 3.0]), (1, [2.0**20 + 1, 5.0]), (2, [2.0**20 + 1, 5.0]), (3, [2.0**20, 7.0])]
    frame = vectors(spark, big)
    got = topk.top_k(frame.where("vec_id = 0").withColumnRenamed("vec_id", "query_id"), frame, k=2)
    assert Counter(tuple(r) for r in got.collect()) == Counter({k: v for k, v in brute_top(big, lambda i: i == 0, 2).items()})
    same = vectors(spark, [(i, [1.0, -1.0, 0.5]) for i in range(400)])
    got = topk.top_k(same.where("vec_id < 3").withColumnRenamed("vec_id", "query_id"), same, k=3)
    assert [r.vec_id for r in got.orderBy("query_id", "rank").collect()] == [1, 2, 3, 0, 2, 3, 0, 1, 3]
    with pytest.raises(Exception, match="(?i)overflow|too large"):
        huge = vectors(spark, [(0, [1e30, 1.0]), (1, [1e30, 2.0])])
        topk.top_k(huge.where("vec_id = 0").withColumnRenamed("vec_id", "query_id"), huge).collect()


def brute_phrases(rows, least, top, longest=4):
    f = Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lower = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower):
            w = re.findall("[^ \t]+", piece)
            for k in range(1, longest + 1):
                f.update((lang, tuple(w[i:i + k])) for i in range(len(w) - k + 1))
    n = Counter()
    for (lang, w), c in f.items():
        n[lang] += c if len(w) == 1 else 0
    many = {key: c for key, c in f.items() if c >= least and len(key[1]) > 1}
    gone = set()
    for (lang, w), c in many.items():
        for k in range(2, len(w)):
            gone |= {(lang, w[i:i + k]) for i in range(len(w) - k + 1) if 100 * c >= 80 * f[lang, w[i:i + k]]}
    out = []
    for lang in n:
        scored = []
        for (other, w), a in many.items():
            if other == lang and (lang, w) not in gone:
                score, _, l, r = min((2000000 * a // (f[lang, w[:i]] + f[lang, w[i:]]), i, f[lang, w[:i]], f[lang, w[i:]]) for i in range(1, len(w)))
                scored.append((-score, -a, " ".join(w).encode(), l, r))
        for rank, (s, a, phrase, l, r) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, n[lang], -s))
    return sorted(out)


def phrase_rows(seed=1):
    r = random.Random(seed)
    vocab = ["ab", "Cd", "ef", "é", "x", "the", "of", "zz", " ", "a-b"]
    rows = [(None, "en"), ("", "en"), (". , ;\n\x0b!", None), ("The THE the the the the", "en"), ("é É", "fr")]
    for i in range(120):
        words = r.choices(vocab, [1, 1, 2, 1, 1, 6, 4, 1, 1, 1], k=r.randint(0, 40))
        text = "".join(w + r.choice([" ", " ", " ", "\t ", ", ", ".", "\n", "\x0c"]) for w in words)
        rows += [(text, r.choice(["en", "en", "en", "fr", None, "und"]))] * (4 if i % 30 == 0 else 1)
    rows.append((" ".join(r.choices(vocab, k=3000)), "long"))
    rows += [("only the words of a planted phrase stand here", "en")] * 9
    return rows


DOCS = "doc_id long, text string, lang string, k int, phrase string, f long, h long"


@pytest.mark.parametrize("options", [
    {"fraction": 0.0}, {"fraction": 0.3}, {"fraction": 1.0}, {"fraction": 0.0, "bits": 16}, {"fraction": 0.3, "chunk": 64, "segment": 50}])
def test_phrases(spark, options, monkeypatch):
    """The result is the same whatever the sample proposes, nothing included, and wherever texts are cut."""
    for name in ("chunk", "segment"):
        if name in options:
            monkeypatch.setattr(phrases, name.upper(), options[name])
    rows = phrase_rows()
    docs = spark.createDataFrame([(i if i % 11 else None, t, lang, 1, "p", 2, 3) for i, (t, lang) in enumerate(rows)], DOCS)
    more = {k: v for k, v in options.items() if k in ("fraction", "bits")} | {"bits": options.get("bits", 18)}
    got = phrases.collocations(docs, least=5, top=40, **more)
    assert sorted(tuple(r) for r in got.collect()) == brute_phrases(rows, 5, 40)


def test_phrases_empty(spark):
    docs = spark.createDataFrame([], DOCS)
    assert phrases.collocations(docs, bits=16).count() == 0


def test_border_failures_are_counted(spark):
    """Phrases the sample cannot know reach the result through the border, in as many passes as they have words."""
    docs = spark.createDataFrame([(i, "one two three four", "en") for i in range(40)], "doc_id long, text string, lang string")
    got = phrases.collocations(docs, fraction=0.0, bits=16).collect()
    assert [(r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got] == [("one two three four", 40, 40, 40, 160, 1000000)]
