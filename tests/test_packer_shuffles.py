"""The blocked packer moves its texts no more often than it has to."""

from pyspark.sql import functions as F

from ragspark.operators import packers


def test_blocks_are_packed_without_a_join(spark, monkeypatch):
    """The first packing takes each block as it lies, and no chunk's text is written again to be numbered."""
    written, plain = [], packers.materialise
    monkeypatch.setattr(packers, "materialise", lambda df: written.append(df) or plain(df))
    units = spark.range(300).select(
        (F.col("id") % 2).alias("parent"), F.col("id").alias("ord"), F.col("id").cast("string").alias("label"),
        F.concat(F.lit("word "), F.repeat(F.lit("more words "), (F.col("id") % 40).cast("int"))).alias("text"), F.lit("head").alias("header"),
    )
    def count(text):
        return len(text.split())

    got = packers.pack_in_blocks(units, max_tokens=90, max_chars=900, count=count, block_units=16, overlap=8).collect()
    frames = [df for df in written if any(f.name == "c" for f in df.schema.fields)]
    assert "Join" not in frames[0]._jdf.queryExecution().optimizedPlan().toString()
    assert not any("pieces" in df.columns for df in written)
    from ragspark.functions.packing import pack_blocks

    rows = {p: [(r.label, r.text) for r in units.where(F.col("parent") == p).orderBy("ord").collect()] for p in (0, 1)}
    for p in (0, 1):
        want = pack_blocks(rows[p], "head", 90, 900, count)
        mine = sorted((r.chunk_index, r.text, r.labels) for r in got if r.parent == p)
        assert mine == [(i, t, ls) for i, (t, ls) in enumerate(want)]
