"""Numbering by range, provisions in file order, and spans that meet."""

import json
import random
from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ragspark.operators import curation, pii_eval, ranking
from ragspark.sources import corpus


def numbered(rows, group):
    out = {}
    for r in rows:
        out.setdefault(group(r), []).append(r)
    return out


@pytest.mark.parametrize("kind, make", [
    ("timestamp", lambda i: datetime(2026, 1, 1) + timedelta(seconds=i * i)), ("long", lambda i: i * 10**15), ("string", lambda i: f"{i:05d}"),
    ("double", lambda i: -1.0 / (i + 1))])
def test_numbers_by_range_with_a_hot_group(spark, kind, make):
    """Orders that no bucket width suits; a group over many ranges, small groups inside one, a null group and null keys."""
    rng = random.Random(5)
    rows = [("hot", make(i)) for i in range(900)] + [(f"g{i % 9}", make(i)) for i in range(90)] + [(None, make(i)) for i in range(5)] + [("hot", None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, f"g string, at {kind}").repartition(5)
    for group in (["g"], []):
        out = ranking.number_rows(df, group, [F.col("at")], "n", partitions=7)
        assert out.columns == ["g", "at", "n"]
        for mine in numbered(out.collect(), lambda r: r.g if group else 0).values():
            mine.sort(key=lambda r: r.n)
            assert [r.n for r in mine] == list(range(1, len(mine) + 1))
            keys = [r["at"] for r in mine]
            assert keys == sorted(keys, key=lambda x: (x is not None, x))
    assert ranking.number_rows(df.limit(0), ["g"], [F.col("at")], "n").count() == 0


def test_numbers_have_no_global_window(spark):
    df = spark.range(1000).withColumn("x", F.col("id") * 7 % 1000)
    plan = ranking.number_rows(df, [], [F.col("x")], "n")._jdf.queryExecution().optimizedPlan().toString()
    rows_window = [line for line in plan.splitlines() if "Window" in line]
    # The one window adds up the counts of the ranges.
    assert len(rows_window) == 1 and "_n" in rows_window[0] and "row_number" not in plan


def test_renumber_by_time(spark):
    rows = [(datetime(2026, 1, 1) + timedelta(days=(7 * i) % 31), i) for i in range(31)]
    out = curation.renumber(spark.createDataFrame(rows, "ord timestamp, v int"), "q", "qid").orderBy("ord").collect()
    assert [r.qid for r in out] == [f"q{i:03d}" for i in range(1, 32)]


def test_provisions_load_in_file_order(spark, tmp_path):
    """Several files, the first cut into many splits, and no position in the lines."""
    names, want = ["a.jsonl", "b.jsonl", "c.jsonl"], []
    for name, size in zip(names, (3000, 1, 400)):
        ids = [f"{name}-{random.Random(i).random()}" for i in range(size)]
        (tmp_path / name).write_text("".join(json.dumps({"provision_id": i, "section": "S", "text": "x" * 50}) + "\n" for i in ids))
        want += ids
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        assert corpus.read_provisions(spark, str(tmp_path)).rdd.getNumPartitions() > 8
        got = corpus.load_provisions(spark, str(tmp_path))
        assert got.columns == corpus.read_provisions(spark, str(tmp_path)).columns
        assert [(r.ord, r.provision_id) for r in got.orderBy("ord").collect()] == list(enumerate(want))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def brute(text, gold, masks):
    def spans(s):
        return [(i, i + len(s)) for i in range(len(text or "")) if s and text.startswith(s, i)]

    def meet(a, b):
        return any(x < v and u < y for x, y in spans(a) for u, v in spans(b))

    hit = [any(meet(g["text"], m) for m in masks) for g in gold]
    true = [any(g["is_pii"] and meet(m, g["text"]) for g in gold) for m in masks]
    negative = [next((i for i, g in enumerate(gold) if g["is_pii"] is False and meet(m, g["text"])), None) for m in masks]
    return hit, true, negative


part = st.text("abé", max_size=4)


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.none(), st.text("abé ", max_size=40)), st.lists(st.tuples(st.one_of(st.none(), part), st.sampled_from([True, False, None])), max_size=7),
       st.lists(part, max_size=6))
def test_spans_that_meet_equal_brute_force(text, gold, masks):
    """Overlapping, nested, repeated, empty and null strings; spans that touch do not meet."""
    gold = [{"text": g, "is_pii": p} for g, p in gold]
    assert pii_eval._meet(text, gold, masks) == brute(text, gold, masks)


def test_spans_in_time_that_follows_the_text():
    """A thousand strings with a span at almost every place: no string is compared with every span."""
    text = "ab" * 20_000
    gold = [{"text": "ab" * k, "is_pii": k % 2 == 0} for k in range(1, 12)] + [{"text": f"x{i}", "is_pii": True} for i in range(1000)]
    hit, true, negative = pii_eval._meet(text, gold, ["ba", "b" * 3])
    assert hit[:11] == [True] * 11 and not any(hit[11:]) and true == [True, False] and negative == [0, None]


def test_outcomes_with_overlaps_and_misses(spark):
    cases = [
        ("1", "Mr John Smith Ltd wrote to jane@x.com", [("John Smith Ltd", "ORG", False), ("jane@x.com", "EMAIL", True), ("Smith", "NAME", True)]),
        ("2", "Mr John Smith wrote", [("Mr John Smith wrote", "QUOTE", False), ("wrote", "VERB", False), ("nobody", "NAME", True), (None, "NAME", True)]),
        ("3", None, [("x", "NAME", True)]), ("4", "plain", None),
    ]
    frame = spark.createDataFrame(cases, "case_id string, text string, entities array<struct<text:string,type:string,is_pii:boolean>>")
    out = {r.case_id: r for r in pii_eval.outcomes(frame).collect()}
    assert [g.detected for g in out["1"].gold] == [True, True] and all(m.true_positive and m.category is None for m in out["1"].masks)
    assert [g.detected for g in out["2"].gold] == [False, False] and {m.category for m in out["2"].masks} == {"QUOTE"}
    assert [g.detected for g in out["3"].gold] == [False] and out["3"].masks == [] and out["4"].gold == []
