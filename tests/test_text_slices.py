"""Texts move packed and slice by slice: the blocks are those of plain texts, and no shuffle files stay."""

import time

from pyspark.sql import functions as F

from ragspark.operators import retrieval


def shuffles(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f for f in files.mkString("\n").split("\n") if "/shuffle_" in f}


def test_slices_of_packed_texts(spark, rows):
    texts = [(i, "" if i == 3 else None if i == 4 else f"text é\U0001f600 {i} " * i, None if i == 5 else f"s{i % 3}") for i in range(12)]
    chunks = spark.createDataFrame(texts + texts[7:8], "chunk_id long, content string, section string")
    asked = spark.createDataFrame([(100 + i, i % 5) for i in range(40)], "asker long, query_id long")
    # Chunk 12 is in no table.
    top = spark.createDataFrame([(q, (q * 3 + r * 2) % 13, 1 / (r + 1), r) for q in range(5) for r in range(1, 7)], "query_id long, chunk_id long, score double, rank int")
    named = lambda found, *more: found.select(F.col("asker").alias("q"), "rank", "chunk_id", "section", "score", *more)
    plain = asked.join(top, "query_id").join(chunks, "chunk_id", "left")
    plain = retrieval.context_blocks(named(plain, F.coalesce("content", F.lit("")).alias("content")), ["q"])
    opened = lambda some: F.transform(retrieval.unpacked(some), lambda x: F.coalesce(x.cast("string"), F.lit("")))
    finish = lambda found: retrieval.context_blocks(named(found, "content"), ["q"], unpack=opened)
    small = chunks.withColumn("content", retrieval.packed(F.col("content").cast("binary")))
    expected = rows(plain, "q", "context", "n_chunks")
    assert len(expected) == 40
    before = shuffles(spark)
    got = retrieval.in_slices(asked, top, small, ["chunk_id"], "asker", finish, slices=3)
    for _ in range(40):
        if shuffles(spark) <= before:
            break
        time.sleep(0.25)
    # What dealt the chunks out was read by all slices; the three slices themselves leave nothing.
    left = {f.rsplit("/shuffle_", 1)[1].split("_")[0] for f in shuffles(spark) - before}
    assert len(left) <= 1
    assert rows(got, "q", "context", "n_chunks") == expected
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
