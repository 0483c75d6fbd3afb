import random

from pyspark.sql import functions as F

from ragspark.operators import redaction, retrieval
from ragspark.sources import records
from ragspark.plans import conversation
from ragspark.streaming import sessions, sinks
from ragspark.streaming.conversation import conversation_sink
from test_plans import conversation_turns


def feed(spark, tmp_path, batches, run):
    """Write each batch as it arrives and drain the stream after it."""
    source = tmp_path / "in"
    for i, batch in enumerate(batches):
        batch.coalesce(1).write.parquet(str(source / f"b{i}"))
        run(spark.readStream.schema(batch.schema).parquet(str(source / "*")))


def drain(tmp_path, name):
    def start(df):
        df.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-ck")).trigger(
            availableNow=True).start().awaitTermination()
    return start


def test_vault_stream_equals_batch(spark, tmp_path, rows):
    texts = ["Jane Doe, jane@x.com", "John Roe met Jane Doe; card 4242 4242 4242 4242", "", "JANE@x.com and Mr Bob Ray", "nothing", "Bob Ray, John Roe"]
    data = [(f"s{s}", t, 0, texts[(s + t) % len(texts)]) for s in range(3) for t in range(6)]
    df = spark.createDataFrame(data, "session_id string, turn bigint, pass_no int, text string")
    go = drain(tmp_path, "out")
    feed(spark, tmp_path, [df.where("turn < 3"), df.where("turn >= 3")], lambda s: go(sessions.redact_stream(s)))
    got = spark.read.parquet(str(tmp_path / "out"))
    want = redaction.redact(df)
    assert rows(got, "session_id", "turn", "clean_text") == rows(want.texts, "session_id", "turn", "clean_text")
    issued = got.select("session_id", F.explode("issued").alias("i")).select("session_id", "i.*")
    columns = ["session_id", "token", "value", "key", "entity_type", "n"]
    assert rows(issued, *columns) == rows(want.vault, *columns)


TURNS = "session_id string, turn bigint, pass_no int, text string, at timestamp"


def timed_turns(spark, data):
    return spark.createDataFrame(data, "session_id string, turn bigint, pass_no int, text string, at string").withColumn("at", F.col("at").cast("timestamp"))


def test_session_ends_as_a_whole_and_no_token_comes_twice(spark, tmp_path):
    """Idle by event time: the value returns with a new number; a session that goes on keeps its tokens, over restarts."""
    def batch(turn, day, *texts):
        return timed_turns(spark, [(s, turn, 0, t, f"2026-01-{day:02d} 10:00:00") for s, t in texts])

    batches = [
        batch(0, 1, ("a", "jane@x.com and Jane Doe"), ("b", "bob@x.com")),
        batch(1, 2, ("b", "bob@x.com, eve@x.com")),
        batch(2, 3, ("b", "bob@x.com")),
        batch(3, 4, ("a", "jane@x.com; new@x.com"), ("b", "eve@x.com")),
        batch(4, 4, ("a", "Jane Doe; jane@x.com")),
    ]
    go = drain(tmp_path, "out")
    feed(spark, tmp_path, batches, lambda s: go(sessions.redact_stream(s, time="at", idle="30 hours", late="1 hour")))
    got = spark.read.parquet(str(tmp_path / "out"))
    text = {(r.session_id, r.turn): r.clean_text for r in got.collect()}
    assert text["a", 0] == "[EMAIL_1] and [NAME_1]" and text["a", 3] == "[EMAIL_2]; [EMAIL_3]" and text["a", 4] == "[NAME_2]; [EMAIL_2]"
    assert [text["b", t] for t in range(4)] == ["[EMAIL_1]", "[EMAIL_1], [EMAIL_2]", "[EMAIL_1]", "[EMAIL_2]"]
    issued = got.select("session_id", F.explode("issued").alias("i")).select("session_id", "i.*").collect()
    tokens = [(r.session_id, r.token) for r in issued]
    assert len(set(tokens)) == len(tokens) and all(r.token == f"[{r.entity_type}_{r.n}]" for r in issued)


def test_vault_stream_goes_on_from_the_batch_vault(spark, tmp_path, rows):
    """Part of the turns by a batch job, the rest by a new stream: as if one job had seen all."""
    texts = ["Jane Doe, jane@x.com", "John Roe met Jane Doe", "", "JANE@x.com and Mr Bob Ray", "new@x.com Bob Ray", "John Roe, other@x.com"]
    data = [(f"s{s}", t, 0, texts[(s + t) % 6]) for s in range(3) for t in range(6)] + [("late", 5, 0, "jane@x.com")]
    df = spark.createDataFrame(data, "session_id string, turn bigint, pass_no int, text string")
    before = redaction.redact(df.where("turn < 3"))
    go = drain(tmp_path, "out")
    feed(spark, tmp_path, [df.where("turn in (3, 4)"), df.where("turn = 5")], lambda s: go(sessions.redact_stream(s, vault=before.vault)))
    got, want = spark.read.parquet(str(tmp_path / "out")), redaction.redact(df)
    assert rows(got, "session_id", "turn", "clean_text") == rows(want.texts.where("turn >= 3"), "session_id", "turn", "clean_text")
    columns = ["session_id", "token", "value", "key", "entity_type", "n"]
    issued = got.select("session_id", F.explode("issued").alias("i")).select("session_id", "i.*")
    assert rows(issued.select(columns).unionByName(before.vault.select(columns)), *columns) == rows(want.vault, *columns)


def test_scope_goes_on_and_ends(spark, tmp_path):
    start = spark.createDataFrame([("s", 1, "c1", 0.9), ("s", 2, "c2", 0.5)], "session_id string, scope_rank long, chunk_id string, score double")
    def turn(n, day, *found):
        rows = [(s, n, r, c, x, f"2026-01-{day:02d} 00:00:00") for s, r, c, x in found]
        return spark.createDataFrame(rows, "session_id string, turn bigint, rank int, chunk_id string, score double, at string").withColumn("at", F.col("at").cast("timestamp"))

    go = drain(tmp_path, "out")
    batches = [turn(0, 1, ("s", 1, "c3", 0.7)), turn(1, 5, ("t", 1, "x", 0.1)), turn(2, 6, ("t", 1, "y", 0.2)), turn(3, 6, ("s", 1, "c4", 0.3))]
    feed(spark, tmp_path, batches, lambda s: go(sessions.scope_stream(s, time="at", idle="2 days", scope=start)))
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("session_id", "turn", "scope_rank").collect()
    assert [(r.session_id, r.turn, r.chunk_id) for r in got] == [
        ("s", 0, "c1"), ("s", 0, "c3"), ("s", 0, "c2"), ("s", 3, "c4"), ("t", 1, "x"), ("t", 2, "y"), ("t", 2, "x")]


def test_scope_stream_equals_batch(spark, tmp_path):
    rng = random.Random(2)
    data = []
    for s in range(3):
        for t in range(4):
            scores = sorted((rng.random() for _ in range(8)), reverse=True)
            data += [(f"s{s}", t, r, f"c{c}", sc) for r, (c, sc) in enumerate(zip(rng.sample(range(25), 8), scores), 1)]
    df = spark.createDataFrame(data, "session_id string, turn bigint, rank int, chunk_id string, score double")
    go = drain(tmp_path, "out")
    feed(spark, tmp_path, [df.where("turn < 2"), df.where("turn >= 2")], lambda s: go(sessions.scope_stream(s)))
    got = spark.read.parquet(str(tmp_path / "out"))
    for t in range(4):
        want = retrieval.session_scope(df.where(F.col("turn") <= t)).select("session_id", "scope_rank", "chunk_id", "score")
        mine = got.where(F.col("turn") == t).select("session_id", "scope_rank", "chunk_id", "score")
        assert sorted(map(tuple, mine.collect())) == sorted(map(tuple, want.collect()))


def test_audit_sink_and_incremental_evaluation(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "session_id string, n int")
    feed(spark, tmp_path / "audit", [df, df.withColumn("n", F.col("n") + 10)],
         lambda s: sinks.audit_sink(s, str(tmp_path / "trail"), str(tmp_path / "trail-ck")).awaitTermination())
    assert sorted(r.n for r in spark.read.json(str(tmp_path / "trail")).collect()) == [1, 2, 11, 12]

    out = str(tmp_path / "scores")

    def done():
        try:
            return spark.read.parquet(out)
        except Exception:
            return spark.createDataFrame([], "id string")
    calls = spark.createDataFrame([("c1",), ("c2",)], "id string")
    more = spark.createDataFrame([("c2",), ("c3",)], "id string")
    feed(spark, tmp_path / "eval", [calls, more],
         lambda s: sinks.evaluate_stream(s, lambda w: w.withColumn("score", F.lit(1.0)), done, out, str(tmp_path / "scores-ck"), ["id"]).awaitTermination())
    got = spark.read.parquet(out)
    assert sorted((r.id, r.run_ts) for r in got.collect()) == [("c1", "batch-000000000"), ("c2", "batch-000000000"), ("c3", "batch-000000001")]
    assert records.read_latest(spark, out).count() == 1


def test_conversation_stream_equals_batch(spark, tmp_path, rows):
    turns = conversation_turns(spark)
    out = str(tmp_path / "out")
    feed(spark, tmp_path, [turns.where("turn = 0"), turns.where("turn = 1")],
         lambda s: conversation_sink(s, b"k", out, str(tmp_path / "ck")).awaitTermination())
    want = conversation.redact_conversation(turns, b"k")
    audit = records.read_audit(spark, f"{out}/audit")
    columns = ["session_id", "timestamp", "input_hash", "output", "human_review_reason", "total_tokens", "latency_ms"]
    assert rows(audit, *columns) == rows(want.audit, *columns)
    detected = F.to_json("output_detections").alias("d")
    assert rows(audit.select("session_id", "timestamp", detected), "session_id", "timestamp", "d") == rows(
        want.audit.select("session_id", "timestamp", detected), "session_id", "timestamp", "d")
    assert rows(spark.read.parquet(f"{out}/vault"), "session_id", "token", "value") == rows(want.vault, "session_id", "token", "value")
    masked = ["session_id", "turn", "masked_question", "masked_handler_answer", "masked_review_reason"]
    assert rows(spark.read.parquet(f"{out}/turns"), *masked) == rows(want.turns, *masked)
