"""Rows with equal lists of sections share one block of source texts."""

from pyspark.sql import functions as F

from ragspark.operators import curation


def test_material_is_put_together_once_a_list(spark):
    asked = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def heading(section):
        asked.add(1)
        return "# " + section

    texts = spark.createDataFrame([("a", "A"), ("b", "B")], "section_id string, text string")
    rows = spark.createDataFrame([(i, [["a", "b"], ["b", "x"], [], None][i % 4]) for i in range(400)], "k int, sections array<string>")
    got = curation.source_blocks(rows, "k", "sections", texts, missing="-", heading=heading("section_id")).collect()
    gap = "\n\n---\n\n"
    assert {r.k: r.source_material for r in got} == {i: [f"# a\nA{gap}# b\nB", f"# b\nB{gap}# x\n-"][i % 4] for i in range(400) if i % 4 < 2}
    assert asked.value <= 8  # 400 with a block for each row
