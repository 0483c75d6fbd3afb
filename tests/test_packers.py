import random

import pytest
from pyspark.sql import functions as F

from ragspark.functions.packing import count_words, pack_blocks
from ragspark.operators import chunking, packers


def pairs(text):
    """A counter that does not add up: distinct pairs of neighbouring characters."""
    return len(set(zip(text, text[1:])))


def unit_rows(parents, seed=1):
    rng = random.Random(seed)
    out = []
    for parent, n in parents.items():
        for i in range(n):
            text = " ".join(rng.choice(["ab", "cde", "fgh ij.", "k", "lmn\n\nop"]) for _ in range(rng.choice([0, 1, 3, 8, 8, 60])))
            out.append((parent, 10 * i + rng.randrange(10), f"l{i // 2}", text if rng.random() > 0.05 else None, f"# {parent}" if parent != "bare" else None))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "parent string, ord long, label string, text string, header string").repartition(3)


def sequential(rows, tokens, chars, count):
    out = []
    for parent in {r[0] for r in rows}:
        mine = sorted(r for r in rows if r[0] == parent)
        packed = pack_blocks([(r[2], r[3]) for r in mine], mine[0][4] or "", tokens, chars, count)
        out += [(parent, i, text, tuple(labels)) for i, (text, labels) in enumerate(packed)]
    return sorted(out)


def collected(df):
    return sorted((r.parent, r.chunk_index, r.text, tuple(r.labels)) for r in df.collect())


ROWS = unit_rows({"long": 700, "a": 3, "bare": 40, "none": 0})


@pytest.mark.parametrize("count, tokens, chars, block, overlap", [
    (pairs, 30, 200, 32, 8), (pairs, 25, 4000, 64, 4), (count_words, 40, 150, 16, 2), (pairs, 30, 200, 4096, 64), (pairs, 60, 5000, 8, 1)])
def test_blocks_on_speculation_equal_the_sequential_packer(spark, count, tokens, chars, block, overlap):
    """Blocks that agree at once, blocks that have to be joined (small overlaps), oversize units, parents of one block."""
    got = packers.pack_in_blocks(frame(spark, ROWS), max_tokens=tokens, max_chars=chars, count=count, block_units=block, overlap=overlap)
    assert collected(got) == sequential(ROWS, tokens, chars, count)


def test_blocks_that_never_agree_are_joined(spark):
    """Equal units, three to a chunk: chains that begin elsewhere stay apart for good."""
    rows = [("p", i, str(i), "abcdef", "") for i in range(200)]
    got = packers.pack_in_blocks(frame(spark, rows), max_tokens=100, max_chars=22, block_units=16, overlap=2)
    assert collected(got) == sequential(rows, 100, 22, count_words)


def test_table_function_from_sql(spark):
    """Equal to the sequential packer and to pack_units, one exchange of the texts."""
    units = frame(spark, ROWS)
    units.createOrReplaceTempView("units_of_parents")
    name = packers.register_packer(spark)
    got = spark.sql(f"SELECT * FROM {name}(TABLE(units_of_parents) PARTITION BY parent ORDER BY (ord), 40, 150)")
    assert collected(got) == sequential(ROWS, 40, 150, count_words)
    same = chunking.pack_units(units, max_tokens=40, max_chars=150)
    assert collected(same) == collected(got)
    mine = packers.register_packer(spark, "pack_by_pairs", pairs)
    got = spark.sql(f"SELECT * FROM {mine}(TABLE(units_of_parents) PARTITION BY parent ORDER BY (ord), 30, 200)")
    assert collected(got) == sequential(ROWS, 30, 200, pairs)
    plain = spark.createDataFrame(ROWS, "parent string, ord long, label string, text string, header string")
    plain.createOrReplaceTempView("units_of_parents")
    plan = spark.sql(f"SELECT * FROM {name}(TABLE(units_of_parents) PARTITION BY parent ORDER BY ord)")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_large_caps_and_empty_tables(spark):
    rows = ROWS[:60]
    assert collected(chunking.pack_units(frame(spark, rows), max_tokens=3000, max_chars=9000)) == sequential(rows, 3000, 9000, count_words)
    assert packers.pack_in_blocks(frame(spark, rows).limit(0)).count() == 0
    with pytest.raises(ValueError, match="overlap"):
        packers.pack_in_blocks(frame(spark, rows), overlap=0)
    with pytest.raises(Exception, match="no room"):
        packers.pack_in_blocks(frame(spark, rows).withColumn("header", F.lit("x " * 500))).collect()
