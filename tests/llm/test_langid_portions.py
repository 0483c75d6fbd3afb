"""Counting n-grams holds a bounded number of them, whatever a batch holds."""

import pandas as pd

from ragspark.llm import langid


def test_counts_in_portions(monkeypatch):
    monkeypatch.setattr(langid, "PORTION", 100, raising=False)
    texts = [f"some words of text number {'abcdefghij'[i % 10]}" for i in range(60)]
    batch = pd.DataFrame({"lang": ["en", "de"] * 30, "text": texts})
    held, plain, found = [], langid.np.concatenate, langid.np.unique

    def unique(values, **options):
        held.append(len(values))
        return found(values, **options)

    monkeypatch.setattr(langid.np, "unique", unique)
    counted = pd.concat(list(langid._count(iter([batch]))))
    largest = max(len(langid.grams(t)[0]) for t in texts)
    assert max(held) < 100 + largest
    every = plain([langid.grams(t)[0] for t in texts])
    assert counted["n"].sum() == len(every)
    assert set(counted["gram"]) == set(every.view("int64"))
