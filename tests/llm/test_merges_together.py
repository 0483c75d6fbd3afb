"""Units that merge together give the ids of merging one by one, whatever their characters and skips."""

import random

from ragspark.llm import subword


def test_together_equals_one_by_one():
    model = subword.merger(subword.default_path())
    draw = random.Random(8)
    letters = "abcdeilnorst" * 4 + "äßéñ.,-09 Ж日▁\u0000\U0001F600́"
    words = ["".join(draw.choices(letters, k=draw.randint(1, 40))) for _ in range(3000)] + [" information", "internationalisation", "x", " "]
    skips = [[draw.randint(0, 4) for _ in range(draw.randint(0, 5))] for _ in words]
    # A skip that never comes, as the word has merged before, is no path of a node; ``unit`` stops the same way.
    assert model.skipping(words, skips) == [model.unit(w, iter(s)) for w, s in zip(words, skips)]
    assert list(model.unskipped(words)) == [model.unit(w, iter(())) for w in words]
    assert model.skipping([], []) == []


def test_few_units_merge_one_by_one(monkeypatch):
    """A cold cache: known words, new skips; only very long units are left to the Python merges."""
    model = subword.Merger(subword.default_path())
    calls = []
    monkeypatch.setattr(model, "unit", lambda word, skips, of=model.unit: calls.append(word) or of(word, skips))
    texts = [" ".join(f"word{i} somewhat different{i} naïve" for i in range(300))]
    model.encode_all(texts, 1, ["7"], 0.3)
    assert not calls


def test_a_batch_is_cut_into_calls(spark, monkeypatch):
    from pyspark.sql import functions as F

    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 7 != 3, F.concat_ws(" ", F.lit("some words of"), F.col("id"))).alias("text")).coalesce(1)
    whole = sorted(map(tuple, subword.encode(docs, subword.default_path()).collect()))
    monkeypatch.setattr(subword, "_CHARS", 50)
    assert sorted(map(tuple, subword.encode(docs, subword.default_path()).collect())) == whole and len(whole) == 40
    assert subword.encode(docs.limit(0), subword.default_path()).collect() == []


def test_new_units_are_added_in_bulk(monkeypatch):
    """A call adds its new units at once and the nodes after a skip by the batch, not one by one; ids are those of single units."""
    import numpy as np

    model = subword.Merger(subword.default_path())
    words = [f" word{i}tion" for i in range(500)]
    keys, places = np.full(500, 7, np.uint64), np.arange(500)
    table = subword.thresholds(0.3)
    added, plain = [], subword.Units._add
    monkeypatch.setattr(subword.Units, "_add", lambda self, *a: added.append(1) or plain(self, *a))
    got = model.units.ids(words, keys, places, table)
    assert got == [model.unit(w, subword.one_by_one(keys[i : i + 1], places[i : i + 1], table))[0] for i, w in enumerate(words)]
    assert len(added) < 30
