"""Two more ways to run the structure packer: as a table function, and in blocks for counters that do not add up."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import Row

from ragspark import fixed
from ragspark.functions.packing import Packer, count_words, pack_blocks
from ragspark.functions.text import strip
from ragspark.operators.ranking import row_numbers
from ragspark.session import materialise, spread

PACKED = "parent string, chunk_index int, text string, labels array<string>"


def register_packer(spark: SparkSession, name: str = "pack_units", count: Callable[[str], int] = count_words) -> str:
    """Register the packer as a table function and return its name.

    ``SELECT * FROM pack_units(TABLE(units) PARTITION BY parent ORDER BY (ord) [, max_tokens [, max_chars]])`` over
    ``units(parent, ord, label, text, header)``. The units of a parent stream through the packer, which holds no more
    than an open chunk; the texts are shuffled once. A parent is one task's work: for parents that hold a large
    share of all units take :func:`pack_in_blocks`.
    """
    class Pack:
        def __init__(self):
            self._packer, self._made = None, 0

        def _rows(self, chunks) -> Iterator[tuple]:
            for text, labels in chunks:
                yield self._parent, self._made, text, labels
                self._made += 1

        def eval(self, row: Row, max_tokens: int = fixed.MAX_TOKENS, max_chars: int = fixed.MAX_CHARS):
            if self._packer is None:
                self._parent = None if row["parent"] is None else str(row["parent"])
                self._packer = Packer(row["header"] or "", max_tokens, max_chars, count)
            yield from self._rows(self._packer.push(row["label"], row["text"]))

        def terminate(self):
            if self._packer is not None:
                yield from self._rows(self._packer.finish())

    spark.udtf.register(name, F.udtf(Pack, returnType=PACKED))
    return name


def pack_in_blocks(
    units: DataFrame, *, max_tokens: int = fixed.MAX_TOKENS, max_chars: int = fixed.MAX_CHARS, count: Callable[[str], int] = count_words,
    block_units: int = 1024, overlap: int = 64,
) -> DataFrame:
    """Structure packing of ``units(parent, ord, label, text, header)`` with any counter, however long a parent is.

    Returns ``parent, chunk_index, text, labels``; (parent, ord) is unique. Where a chunk starts depends on all
    units before it, and a counter that does not add up (a sub-word one) cannot be summed ahead. So each block
    of units is packed on speculation, beginning ``overlap`` units early. Greedy packing from one start is always
    the same; where the block before it starts a chunk at the same unit, both agree from there on, and the block takes
    over. This is checked for each pair: blocks without a common start are joined and packed again, until all
    agree. The result is that of the sequential packer. Texts are shuffled once, and again only for joined blocks.
    """
    if not 0 < overlap < block_units:
        raise ValueError("overlap must be positive and below block_units")
    trimmed = spread(units).select(
        "parent", F.col("ord").cast("long").alias("ord"), "label", strip(F.coalesce("text", F.lit(""))).alias("text"), "header"
    ).where(F.col("text") != "")
    placed = materialise(
        row_numbers(trimmed, ["parent"], F.floor(F.col("ord") / 4096), [F.col("ord")], "pos").withColumn("pos", F.col("pos") - 1)
    ).withColumn("block", F.floor(F.col("pos") / block_units))

    @F.pandas_udf("array<struct<start:bigint,pieces:array<string>,labels:array<string>>>")
    def pack(rows: pd.Series, headers: pd.Series) -> pd.Series:
        out = []
        for row, header in zip(rows, headers):
            chunks = []
            for text, at in pack_blocks([(i, u["text"]) for i, u in enumerate(row)], header or "", max_tokens, max_chars, count):
                start = row[at[0]]["pos"]
                if chunks and chunks[-1]["start"] == start:
                    chunks[-1]["pieces"].append(text)
                else:
                    chunks.append({"start": start, "pieces": [text], "labels": list(dict.fromkeys(row[i]["label"] for i in at))})
            out.append(chunks)
        return pd.Series(out)

    def packed(homes: DataFrame | None = None) -> DataFrame:
        """Chunks of each home, a run of blocks (parent, home, last), with the units shortly before it; without ``homes``, of each block."""
        inside = F.col("pos") - F.col("block") * block_units
        seen = placed.withColumn("block", F.explode(F.when(
            inside >= block_units - overlap, F.array(F.col("block"), F.col("block") + 1)).otherwise(F.array(F.col("block")))))
        if homes is None:
            # No join, so that the texts are shuffled once; units before a block that is not there make no home.
            kept = seen.where(F.col("parent").isNotNull()).withColumns({"home": F.col("block"), "last": F.col("block")})
            return grouped(kept).where(F.col("end") >= F.col("home") * block_units).select(*outcome)
        # A block that follows another one of its home has those units already.
        of = homes.withColumn("block", F.explode(F.sequence("home", "last")))
        joined = seen.alias("s").join(of.alias("h"), (F.col("s.parent") == F.col("h.parent")) & (F.col("s.block") == F.col("h.block")))
        kept = joined.where((F.col("s.block") == F.col("home")) | (F.col("pos") >= F.col("s.block") * block_units))
        return grouped(kept.select("s.*", "home", "last")).select(*outcome)

    def grouped(kept: DataFrame) -> DataFrame:
        return kept.groupBy("parent", "home", "last").agg(
            F.array_sort(F.collect_list(F.struct("pos", "label", "text"))).alias("u"), F.first("header", ignorenulls=True).alias("header"),
            F.max("pos").alias("end"),
        )

    outcome = ["parent", "home", "last", F.explode_outer(F.array(pack("u", "header"))).alias("c")]
    done = materialise(packed())
    order = Window.partitionBy("parent").orderBy("home")
    while True:
        starts = done.select("parent", "home", "last", F.transform("c", lambda c: c["start"]).alias("s"))
        both = starts.withColumn("before", F.lag("s").over(order))
        cut = F.when(F.col("before").isNull(), F.lit(0)).otherwise(
            F.array_min(F.array_intersect(F.filter("s", lambda p: p < F.col("home") * block_units), F.filter("before", lambda p: p >= F.col("home") * block_units - overlap)))
        )
        cuts = materialise(both.select("parent", "home", "last", cut.cast("long").alias("cut")))
        if cuts.where(F.col("cut").isNull()).isEmpty():
            break
        # Runs of homes that do not agree with the one before them become one home.
        run = cuts.withColumn("to", F.last(F.when(F.col("cut").isNotNull(), F.col("home")), ignorenulls=True).over(order))
        merged = run.groupBy("parent", F.col("to").alias("home")).agg(F.max("last").alias("last"), F.count("*").alias("n"))
        again = packed(merged.where("n > 1").drop("n"))
        same = done.join(merged.where("n = 1").select("parent", "home"), ["parent", "home"], "left_semi")
        done = materialise(same.unionByName(again))
    ends = cuts.select("parent", "home", "cut", F.lead("cut").over(order).alias("until"))

    def own(chunks: str):
        """The chunks of a home from where it takes over to where the next one does."""
        return F.filter(chunks, lambda c: (c["start"] >= F.col("cut")) & (F.col("until").isNull() | (c["start"] < F.col("until"))))

    # Only numbers of pieces are summed; the texts join once.
    sizes = done.select("parent", "home", F.transform("c", lambda c: F.struct(c["start"].alias("start"), F.size(c["pieces"]).alias("n"))).alias("s"))
    totals = sizes.join(ends, ["parent", "home"]).withColumn("n", F.aggregate(own("s"), F.lit(0).cast("long"), lambda n, c: n + c["n"]))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    # Written, so that its size is known: a short list goes to the texts, which then need no shuffle.
    homes = materialise(totals.select("parent", "home", "cut", "until", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")))
    pieces = F.flatten(F.transform(own("c"), lambda c: F.transform(c["pieces"], lambda p: F.struct(p.alias("text"), c["labels"].alias("labels")))))
    found = done.join(homes, ["parent", "home"]).select("parent", "base", F.posexplode_outer(pieces).alias("_p", "x"))
    return found.where(F.col("x").isNotNull()).select("parent", (F.col("base") + F.col("_p")).cast("int").alias("chunk_index"), "x.text", "x.labels")
