"""Connected components of link tables, with no component gathered anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragspark.session import materialise


def components(links: DataFrame, merge: bool = False) -> DataFrame:
    """``id`` and ``component_id`` (smallest id reachable) of every end of ``links`` (a, b: long).

    Each round hooks every root to its smallest neighbouring root if that is smaller,
    follows the hooks to their ends by pointer jumping and keeps the links between
    different roots. Every component with a link merges, so rounds are logarithmic in
    its size. Links with a null end and loops link nothing. ``merge``: joins merge, so that hooks never
    pass through the driver; otherwise hooks that the planner takes for small are broadcast.
    """
    far = (lambda rows: rows.hint("merge")) if merge else (lambda rows: rows)
    ends = links.where(F.col("a").isNotNull() & F.col("b").isNotNull())
    left = materialise(ends.where("a <> b").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct())
    label = materialise(left.select(F.explode(F.array("lo", "hi")).alias("id")).distinct().withColumn("root", F.col("id")))
    while not left.isEmpty():
        hooks = materialise(left.groupBy(F.col("hi").alias("id")).agg(F.min("lo").alias("root")))
        while True:
            up = hooks.select(F.col("id").alias("root"), F.col("root").alias("above"))
            jumped = materialise(hooks.join(far(up), "root", "left").select(
                "id", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")
            ))
            hooks = jumped.select("id", "root")
            if jumped.where("moved").isEmpty():
                break
        def move(rows: DataFrame, column: str) -> DataFrame:
            to = hooks.select(F.col("id").alias(column), F.col("root").alias("_to"))
            return rows.join(far(to), column, "left").withColumn(column, F.coalesce("_to", column)).drop("_to")

        label = materialise(move(label, "root"))
        moved = move(move(left, "lo"), "hi").where("lo <> hi")
        left = materialise(moved.select(F.least("lo", "hi").alias("lo"), F.greatest("lo", "hi").alias("hi")).distinct())
    return label.select("id", F.col("root").alias("component_id"))
