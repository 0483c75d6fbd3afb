import __spark_entry__ as job
from ragspark.operators import retrieval
from ragspark.session import materialise


def test_only_vectors_that_a_turn_asks_with_are_queries(spark, tmp_path, monkeypatch):
    """Conversations that ask with few vectors make few queries, whatever the number of vectors."""
    asked, real = [], retrieval.top_k
    monkeypatch.setattr(retrieval, "top_k", lambda q, c, *args, **kw: asked.append(q.count()) or real(q, c, *args, **kw))
    folder = tmp_path / "tables"
    spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").write.parquet(str(folder / "embeddings.parquet"))
    turns = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").where("conv_id = 1")
    materialise(turns).write.parquet(str(folder / "conversations.parquet"))
    got = job.queries()["scope_merge"](spark, str(folder)).collect()
    assert asked == [turns.count()] and {r.session_id for r in got} == {1}
