"""Line dedup: repeated runs of lines found by prefix doubling over line-ID sequences.

The suffixes of all documents (one per line) are named level by level: at level
k two suffixes get the same name exactly if their first 2^k lines agree, and a
name is the first position that has it. A group with one name is an interval of
the suffix array whose longest common prefix has at least 2^k lines. The order
between different prefixes is never needed, so names replace sorted ranks and no
global sort takes place. A suffix alone in its group leaves at once: nothing
longer can repeat there.

A line is deleted if it lies in a run of at least ``min_words`` words that also
occurs at an earlier position; the first copy stays. The union of all such maximal
runs is found through the shortest run of enough words that begins at each line
and the shortest that ends at each line: every line of a maximal repeated run lies
in one of those, and equal contents give equal shortest runs, so that a run of m
lines is told by two overlapping names of its level and one grouping.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragspark.llm.common import BLANKS, bind, fresh
from ragspark.session import materialise

DOC = ["_d", "_h"]
POS = [*DOC, "_i"]


def _key() -> list[Column]:
    """A document by id and content: rows that repeat both are one document and share their fate."""
    return [
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("_d"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("_h"),
    ]


def line_table(docs: DataFrame) -> DataFrame:
    """_d, _h, _i (0-based line), _a and _b (128-bit line ID), _w (words) of every line of every document."""
    rows = docs.select(*_key(), F.coalesce("text", F.lit("")).alias("_text"))
    lines = bind(rows, _lines=F.split("_text", "\n")).select(*DOC, F.posexplode("_lines").alias("_i", "_line"))
    count = F.size(F.array_remove(F.split("_line", BLANKS), ""))
    ids = [F.xxhash64("_line").alias("_a"), F.xxhash64(F.lit("second"), "_line").alias("_b")]
    return lines.select(*POS, *ids, count.alias("_w"))


def _named(rows: DataFrame, prefix: list[str]) -> DataFrame:
    """Positions whose prefix occurs more than once, with its first position as ``name``."""
    groups = rows.groupBy(*prefix).agg(F.count("*").alias("_n"), F.min(F.struct(*POS)).alias("name"))
    return rows.join(groups.where(F.col("_n") > 1).drop("_n"), prefix).select(*POS, "name")


def _spans(lines: DataFrame, min_words: int) -> DataFrame:
    """Shortest runs of enough words that begin or end at each line: _d, _h, _i (first line), _m (lines)."""
    doc = Window.partitionBy(*DOC)
    upto = F.sum("_w").over(doc.orderBy("_i").rowsBetween(Window.unboundedPreceding, 0))
    rows = lines.select(*POS, "_w", upto.alias("_end")).withColumn("_start", F.col("_end") - F.col("_w"))
    reach = F.max("_i").over(doc.orderBy("_start").rangeBetween(0, min_words - 1))
    before = F.max("_i").over(doc.orderBy("_end").rangeBetween(Window.unboundedPreceding, -min_words))
    total = F.max("_end").over(doc)
    rows = rows.select(*POS, "_start", "_end", reach.alias("_reach"), before.alias("_before"), total.alias("_total"))
    forward = F.when(F.col("_start") + min_words <= F.col("_total"), F.struct(F.col("_i"), (F.col("_reach") - F.col("_i") + 1).alias("_m")))
    first = F.coalesce(F.col("_before") + 1, F.lit(0))
    backward = F.when(F.col("_end") >= min_words, F.struct(first.alias("_i"), (F.col("_i") - first + 1).alias("_m")))
    both = rows.select(*DOC, F.explode(F.array_compact(F.array(forward, backward))).alias("_s"))
    return both.select(*DOC, F.col("_s._i").alias("_i"), F.col("_s._m").alias("_m")).distinct()


def repeated_lines(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """_d, _h, _i of every line inside a run of ``min_words`` words or more that occurs earlier.

    Earlier means smaller (document id, content hash, line); a null id comes
    first; runs never cross documents but may overlap their first copy. Null
    text counts as one empty line. An empty table gives no rows.
    """
    lines = materialise(line_table(docs).dropDuplicates(POS))
    level = materialise(_named(lines, ["_a", "_b"]))
    # A run can only repeat if its first line does.
    spans = materialise(_spans(lines, min_words).join(level.select(*POS), POS, "left_semi"))
    longest = spans.agg(F.max("_m")).first()[0] or 0
    found, k = None, 0
    while 2**k <= longest:
        size = 2**k
        mine = spans.where((F.col("_m") >= size) & (F.col("_m") < 2 * size))
        name = level.select(*POS, F.col("name").alias("_one"))
        told = mine.join(name, POS).withColumn("_to", F.col("_i") + F.col("_m") - size)
        other = level.select(*DOC, F.col("_i").alias("_to"), F.col("name").alias("_two"))
        told = told.join(other, [*DOC, "_to"])
        here = F.struct(*POS)
        first = told.groupBy("_m", "_one", "_two").agg(F.min(here).alias("_first"))
        later = told.join(first, ["_m", "_one", "_two"]).where(F.col("_first") != here).select(*POS, "_m")
        found = later if found is None else found.unionByName(later)
        k += 1
        if 2**k <= longest:
            ahead = level.select(*DOC, (F.col("_i") - size).alias("_i"), F.col("name").alias("_next"))
            level = materialise(_named(level.withColumnRenamed("name", "_name").join(ahead, POS), ["_name", "_next"]))
    if found is None:
        return lines.select(*POS).limit(0)
    run = F.sequence(F.col("_i"), F.col("_i") + F.col("_m") - 1)
    return found.select(*DOC, F.explode(run).alias("_i")).distinct()


def dedup(docs: DataFrame, min_words: int = 50, drop_emptied: bool = False) -> DataFrame:
    """``docs`` with the later copies of repeated runs deleted, plus ``_removed`` (deleted lines, array) at the end, with more
    underscores if there is such a column already.

    Texts without a deletion, null ones too, stay as they are. With
    ``drop_emptied`` a document that consisted of later copies alone goes. Other columns
    keep their values; names that clash with ours are safe.
    """
    safe = [f"_doc{i}" for i in range(len(docs.columns))]
    text, key = (f"_doc{docs.columns.index(c)}" for c in ("text", "doc_id"))
    gone = repeated_lines(docs.select("doc_id", "text"), min_words).groupBy(*DOC).agg(F.sort_array(F.collect_list("_i")).alias("_removed"))
    rows = docs.toDF(*safe).withColumn("doc_id", F.col(key)).withColumn("text", F.col(text)).select(*safe, *_key())
    rows = rows.join(gone, DOC, "left").drop(*DOC)
    left = F.filter(F.split(text, "\n"), lambda line, i: ~F.array_contains("_removed", i))
    rows = bind(rows, _left=F.when(F.col("_removed").isNotNull(), left))
    if drop_emptied:
        rows = rows.where(F.col("_removed").isNull() | (F.size("_left") > 0))
    kept = F.when(F.col("_removed").isNull(), F.col(text)).otherwise(F.concat_ws("\n", "_left"))
    rows = rows.withColumn(text, kept).select(*safe, F.coalesce("_removed", F.array().cast("array<int>")).alias("_removed"))
    return rows.toDF(*docs.columns, fresh(docs, "_removed"))
