"""Ordinals and order statistics that stay exact when one group holds most rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragspark.session import materialise


def row_numbers(df: DataFrame, group: list[str], bucket: Column, order: list[Column], out: str) -> DataFrame:
    """1-based position of each row in its group.

    ``bucket`` must not decrease along ``order``. Rows are sorted only within
    (group, bucket); bucket counts, already combined map-side, give the offsets.
    A hot group, or no group at all, is therefore spread over its buckets.
    """
    keyed = df.withColumn("_bucket", bucket)
    keys = [*group, "_bucket"]
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        keyed.groupBy(*keys).agg(F.count("*").alias("_n"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    local = keyed.withColumn("_pos", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    joined = local.alias("l").join(
        offsets.alias("o"),
        [F.col(f"l.{k}").eqNullSafe(F.col(f"o.{k}")) for k in keys],
    )
    kept = [F.col(f"l.{c}") for c in df.columns]
    return joined.select(*kept, (F.col("_pos") + F.col("_offset")).cast("long").alias(out))


def number_rows(df: DataFrame, group: list[str], order: list[Column], out: str, partitions: int | None = None) -> DataFrame:
    """1-based position of each row in its group, in an order of any type: time stamps, sparse keys, several columns.

    Rows are dealt into ranges of (group, order) and sorted there, so a group of any size spreads over as many ranges as it
    fills; a row's number is its place in the range plus the rows of its group in earlier ranges. Only those counts, one row a
    range and group, are added up in order. ``order`` should tell rows apart: equal rows stay in one range, in any order.
    """
    spark = df.sparkSession
    ranges = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = [*[F.col(g).asc_nulls_first() for g in group], *order]
    # The id counts rows within a range; written down, ranges and ids stay what they are.
    dealt = df.repartitionByRange(ranges, *by).sortWithinPartitions(*by).withColumn("_id", F.monotonically_increasing_id())
    placed = materialise(dealt).withColumn("_range", F.shiftright("_id", 33))
    keys = [*group, "_range"]
    before = Window.partitionBy(*(group or [F.lit(0)])).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    offsets = counts.select(*keys, (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1).alias("_offset"))
    joined = placed.alias("l").join(offsets.alias("o"), [F.col(f"l.{k}").eqNullSafe(F.col(f"o.{k}")) for k in keys])
    return joined.select(*[F.col(f"l.{c}") for c in df.columns], (F.col("_id") + F.col("_offset")).cast("long").alias(out))


def first_per_group(df: DataFrame, group: list[str], order: list[Column], limit: int) -> DataFrame:
    """Rows ranked at most ``limit`` in their group, with ``rank``.

    The rank filter becomes a group limit before the shuffle, so each task sends
    at most ``limit`` rows per group.
    """
    window = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= limit)


def latency_stats(df: DataFrame, group: list[str], value: str, bins: int = 4096, few: int = 100_000) -> DataFrame:
    """Mean, median, p95, min and max per group, exact.

    p95 is the value at 0-based rank ``min(floor(0.95 n), n - 1)``. The three ranks
    are found by :func:`_at_ranks`, all groups and ranks in the same passes.
    """
    if not group:
        return latency_stats(df.withColumn("_all", F.lit(0)), ["_all"], value, bins, few).drop("_all")
    v = F.col(value).cast("double")
    rows = df.where(v.isNotNull()).select(*group, v.alias("_v"))
    stats = materialise(rows.groupBy(*group).agg(
        F.count("*").alias("n"), F.avg("_v").alias("mean_ms"), F.min("_v").alias("min_ms"), F.max("_v").alias("max_ms"),
    ))
    n = F.col("n")
    ranks = {"lo": F.floor((n - 1) / 2), "hi": F.floor(n / 2), "p95": F.least(F.floor(n * F.lit(0.95)), n - 1)}
    asked = stats.select(*group, F.col("n").alias("_c"), F.col("min_ms").alias("_a"), F.col("max_ms").alias("_b"),
                         F.explode(F.array(*[F.struct(F.lit(k).alias("_k"), r.cast("long").alias("_r")) for k, r in ranks.items()])).alias("_q"))
    found = _at_ranks(rows, asked.select(*group, "_c", "_a", "_b", "_q.*"), group, bins, few)
    wide = found.groupBy(*group).agg(*[F.max(F.when(F.col("_k") == k, F.col("_v"))).alias(f"_{k}") for k in ranks])
    both = stats.alias("s").join(wide.alias("f"), _same("s", "f", group))
    return both.select(
        *[F.col(f"s.{g}") for g in group], "n", "mean_ms", ((F.col("_lo") + F.col("_hi")) / 2).alias("median_ms"),
        F.col("_p95").alias("p95_ms"), "min_ms", "max_ms",
    )


def _same(a: str, b: str, keys: list[str]) -> list[Column]:
    return [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys]


def _at_ranks(rows: DataFrame, asked: DataFrame, group: list[str], bins: int, few: int) -> DataFrame:
    """Values ``_v`` of ``rows(group, _v)`` at the 0-based ranks ``asked(group, _k, _r, _c, _a, _b)``: group, _k, _v.

    Every rank starts with the whole group: ``_c`` values from ``_a`` to ``_b``. A pass counts
    the values of all intervals by bins of equal width and moves each rank into its bin, whose smallest and largest value
    become the next interval; the rank then counts from the first value there. An interval of at most ``few`` values is
    counted by value instead, and an interval of one value is the answer. The counts combine map-side, and no window holds more
    than ``max(bins, few)`` rows of an interval. Each pass separates the smallest from the largest value, so the loop ends.
    """
    largest = 1.7976931348623157e308
    # Infinite values and NaN are beyond the bins and get bins of their own.
    v, a, b = F.col("_v"), F.greatest(F.col("_a"), F.lit(-largest)), F.least(F.col("_b"), F.lit(largest))
    # Halves, because the difference of the ends may overflow; it is zero only where the ends differ by less than a half can say.
    width = b / 2 - a / 2
    bin_at = F.least(F.floor((v / 2 - a / 2) / width * bins), F.lit(bins - 1)).cast("double")
    inside = F.when(F.isnan("_v"), bins + 1.0).when(v > b, bins + 0.0).when(v < a, -1.0).otherwise(bin_at)
    # The end of the type itself, met as a value, and the values of a narrow interval stay what they are.
    by_value = (F.col("_c") <= few) | (width <= 0)
    state = asked
    while True:
        state = materialise(state)
        open_ranks = state.where("_a <> _b")
        if open_ranks.isEmpty():
            return state.select(*group, "_k", F.col("_a").alias("_v"))
        marks = open_ranks.select(*group, "_a", "_b", "_c").distinct()
        # At most as many intervals a group as ranks, and no two that overlap, so no row is met twice.
        inside_of = (F.col("r._v") >= F.col("m._a")) & (F.col("r._v") <= F.col("m._b"))
        met = rows.alias("r").join(marks.alias("m"), [*_same("r", "m", group), inside_of]).select(
            *[F.col(f"r.{g}") for g in group], "r._v", "m._a", "m._b", "m._c"
        )
        binned = met.withColumn("_bin", F.when(by_value, v).otherwise(inside))
        counts = binned.groupBy(*group, "_a", "_bin").agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        upto = Window.partitionBy(*group, "_a").orderBy("_lo").rowsBetween(Window.unboundedPreceding, 0)
        ended = counts.withColumn("_end", F.sum("_n").over(upto))
        here = (F.col("_end") - F.col("_n") <= F.col("_r")) & (F.col("_r") < F.col("_end"))
        moved = open_ranks.alias("o").join(ended.alias("e"), [*_same("o", "e", [*group, "_a"]), here]).select(
            *[F.col(f"o.{g}") for g in group], F.col("_n").alias("_c"), F.col("_lo").alias("_a"), F.col("_hi").alias("_b"), "_k",
            (F.col("_r") - F.col("_end") + F.col("_n")).alias("_r"),
        )
        state = state.where("_a = _b").select(*asked.columns).unionByName(moved.select(*asked.columns))
