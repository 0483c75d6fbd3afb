"""What a task of op12 holds does not grow with the texts that it reads."""

import gc
from collections import defaultdict
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.parquet as pq

from ragspark.llm import phrases
from ragspark.session import written

TEXTS = [" ".join(f"w{(i * j) % 23}" for j in range(60)) + f". line {i % 5} of it" for i in range(120)]


def test_chunks_leave_nothing_behind(monkeypatch):
    class Frame:
        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            return run

    monkeypatch.setattr(phrases, "CHUNK", 64)
    batch = pa.RecordBatch.from_pydict({"lang": ["en"] * 120, "sample": [False] * 120, "text": TEXTS})
    words = lambda: sum(type(x) is defaultdict and b"." in x for x in gc.get_objects())
    run = phrases.tokenise(Frame())
    gc.collect()
    gc.disable()
    try:
        assert sum(1 for _ in run(iter([batch]))) > 40
        assert words() == 0
    finally:
        gc.enable()


def test_row_groups_hold_few_chunks(spark, monkeypatch):
    groups = []

    @contextmanager
    def noted(df, **options):
        with written(df, **options) as out:
            if "ids" in out.columns:
                for file in out.inputFiles():
                    meta = pq.ParquetFile(file.removeprefix("file:")).metadata
                    groups.extend(meta.row_group(i).num_rows for i in range(meta.num_row_groups))
            yield out

    monkeypatch.setattr(phrases, "CHUNK", 64)
    monkeypatch.setattr(phrases, "written", noted)
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").selectExpr("*", "'en' AS lang").coalesce(1)
    assert phrases.collocations(docs, least=5).count() > 0
    assert sum(groups) > 40 and max(groups) <= 8


def test_full_buffers_change_nothing(spark, monkeypatch, rows):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").selectExpr("*", "'en' AS lang")
    whole = phrases.collocations(docs, least=5)
    expected = rows(whole, *whole.columns)
    monkeypatch.setattr(phrases, "HELD", 50)
    monkeypatch.setattr(phrases, "PORTION", 7)
    got = phrases.collocations(docs, least=5)
    assert expected and rows(got, *got.columns) == expected
