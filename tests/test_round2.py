"""Small cases of earlier faults."""

from pyspark.sql import functions as F

from ragspark.functions import pii
from ragspark.operators import redaction, retrieval


def test_masking_takes_any_letters(spark):
    text = "ꙮꙁꙃꙅꙇ㐀㐁 write to jo@example.com or jo@example.com"
    got = spark.createDataFrame([(text,)], "text string").select(pii.masked(F.col("text"), pii.only("EMAIL")).alias("m")).first().m
    assert list(got.slots) == [0, 0]
    assert "jo@example.com".join(got.pieces) == text


def test_token_issued_twice_stays(spark):
    vault = spark.createDataFrame(
        [("s", "[NAME_1]", "Jo"), ("s", "[NAME_1]", "Al"), ("s", "[NAME_2]", "Bo"), ("s", "[NAME_2]", "Bo")],
        "session_id string, token string, value string",
    )
    texts = spark.createDataFrame([("s", 1, "[NAME_1] met [NAME_2]")], "session_id string, turn int, clean_text string")
    assert redaction.rehydrate(texts, vault, ["session_id", "turn"]).first().rehydrated == "[NAME_1] met Bo"


def test_scope_ties_keep_first_sight(spark):
    rows = [("s", 1, 1, "X", 0.3), ("s", 2, 1, "Y", 0.5), ("s", 2, 2, "X", 0.5)]
    df = spark.createDataFrame(rows, "session_id string, turn int, rank int, chunk_id string, score double")
    got = retrieval.session_scope(df).orderBy("scope_rank").collect()
    assert [r.chunk_id for r in got] == ["X", "Y"]
