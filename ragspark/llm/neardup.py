"""Embedding near-duplicates by counting collisions of one-dimensional projections.

Each distinct vector is projected on many seeded Gaussian directions and enters the
sorted lists of those few on which it lies farthest out; there, lists are sparse,
and vectors at a small angle stand close together. In every list each entry collides
with the entries within a window centred on it. Pairs with enough collisions
are compared exactly. The number of collisions asked for is calibrated on random
pairs at exactly the threshold, so that a stated share of such pairs passes.

All joins are merge joins: a table that grows with the input is never broadcast, so none passes through the
driver, where one whose columns compress well takes many times the size that the planner reads off its files.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragspark.llm.common import worker_state
from ragspark.llm.components import components
from ragspark.session import materialise


def directions(dim: int, count: int, seed: int) -> np.ndarray:
    """(dim, count) Gaussian directions, kept by the worker between tasks."""
    kept = worker_state().setdefault("directions", {})
    if (dim, count, seed) not in kept:
        kept.clear()
        kept[dim, count, seed] = np.random.default_rng([seed, dim]).standard_normal((dim, count), np.float32)
    return kept[dim, count, seed]


def entries(units: np.ndarray, lists: int, per_vector: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Per unit vector its ``per_vector`` farthest projections: list number (signed side) and position."""
    numbers, places = [], []
    for at in range(0, len(units), 128):
        h = units[at : at + 128].astype(np.float32) @ directions(units.shape[1], lists, seed)
        size = np.abs(h)
        top = np.argpartition(-size, min(per_vector, lists - 1), axis=1)[:, :per_vector].astype(np.int32)
        value = np.take_along_axis(h, top, 1)
        numbers.append(np.where(value < 0, -top - 1, top))
        places.append(np.abs(value))
    return np.concatenate(numbers), np.concatenate(places)


def calibrated(dim: int, threshold: float, recall: float, lists: int, per_vector: int, window: float, seed: int, trials: int = 1000) -> int:
    """Largest number of collisions that at least ``recall`` of random pairs at the threshold reach; at least one."""
    rng = np.random.default_rng(seed + 1)
    u = rng.standard_normal((trials, dim))
    u /= np.linalg.norm(u, axis=1)[:, None]
    if dim == 1:
        return 1
    z = rng.standard_normal((trials, dim))
    z -= (z * u).sum(1)[:, None] * u
    z /= np.linalg.norm(z, axis=1)[:, None]
    v = threshold * u + np.sqrt(1 - threshold**2) * z
    (nu, hu), (nv, hv) = entries(u, lists, per_vector, seed), entries(v, lists, per_vector, seed)
    counts = np.array([
        sum(abs(dict(zip(a, x))[k] - y) <= window for k, y in zip(b, z_) if k in set(a.tolist()))
        for a, x, b, z_ in zip(nu, hu, nv, hv)
    ])
    best = 1
    while (counts >= best + 1).mean() >= recall:
        best += 1
    return best


def _read(vectors: DataFrame) -> DataFrame:
    """vec_id, d1, d2 (digest of the vector, null if it links with nothing), dim, unit (64-bit floats)."""
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for vec in batch["embedding"]:
                x = np.array([np.nan if c is None else c for c in vec], np.float64) if vec is not None else np.empty(0)
                top = np.abs(x).max() if len(x) and np.isfinite(x).all() else 0.0
                if not top:
                    rows.append((None, None, None, None))
                    continue
                raw = xxhash.xxh3_128_digest((x + 0.0).tobytes())
                # Divided by its largest component first, so that no norm overflows or vanishes.
                x = x / top
                x /= np.linalg.norm(x)
                one, two = (int.from_bytes(raw[i : i + 8], "little", signed=True) for i in (0, 8))
                rows.append((one, two, len(x), x.tobytes()))
            out = pd.DataFrame(rows, columns=["d1", "d2", "dim", "unit"])
            for c in ("d1", "d2", "dim"):
                out[c] = pd.array([None if r is None or r != r else int(r) for r in [x[("d1", "d2", "dim").index(c)] for x in rows]], "Int64")
            out.insert(0, "vec_id", batch["vec_id"].astype("Int64").to_numpy(object))
            yield out

    plain = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return plain.mapInPandas(read, "vec_id long, d1 long, d2 long, dim long, unit binary")


def linked_pairs(
    distinct: DataFrame, threshold: float, recall: float = 0.97, lists: int = 32768, per_vector: int = 12, window: float = 0.8,
    seed: int = 7,
) -> DataFrame:
    """Pairs a < b of the distinct vectors (cls, dim, unit) found with a cosine of at least the threshold."""
    dims = [r[0] for r in distinct.select("dim").distinct().collect()]
    asked = {d: calibrated(d, threshold, recall, lists, per_vector, window, seed) for d in dims}

    def enter(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, part in batch.groupby("dim"):
                units = np.frombuffer(b"".join(part["unit"]), np.float64).reshape(-1, int(dim))
                number, place = entries(units, lists, per_vector, seed)
                yield pd.DataFrame({
                    "dim": int(dim), "list": number.ravel(), "place": place.ravel().astype(float),
                    "cls": np.repeat(part["cls"].to_numpy(), number.shape[1]),
                })

    listed = materialise(distinct.select("cls", "dim", "unit").mapInPandas(enter, "dim long, list int, place double, cls long"))
    cell = F.floor(F.col("place") / window)
    left = listed.select("dim", "list", cell.alias("cell"), F.col("cls").alias("x"), F.col("place").alias("px"))
    # The window reaches into the next cell at most; an entry of that cell is listed in both.
    right = listed.select(
        "dim", "list", F.explode(F.array(cell, cell - 1)).alias("cell"), cell.alias("own"), F.col("cls").alias("y"), F.col("place").alias("py")
    )
    met = left.join(right.hint("merge"), ["dim", "list", "cell"]).where(
        (F.abs(F.col("px") - F.col("py")) <= window) & ((F.col("own") > F.col("cell")) | (F.col("x") < F.col("y")))
    )
    counted = met.groupBy("dim", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).count()
    enough = F.lit(1)
    for d, least in asked.items():
        enough = F.when(F.col("dim") == d, least).otherwise(enough)
    pairs = counted.where(F.col("count") >= enough).select("a", "b")

    @F.pandas_udf("double")
    def cosine(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([float(np.frombuffer(p, np.float64) @ np.frombuffer(q, np.float64)) for p, q in zip(x, y)], dtype=float)

    side = lambda n: distinct.select(F.col("cls").alias(n), F.col("unit").alias(f"u{n}")).hint("merge")
    return pairs.join(side("a"), "a").join(side("b"), "b").where(cosine("ua", "ub") >= threshold).select("a", "b")


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, **options) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``vectors`` (vec_id, embedding; extra columns are ignored).

    Vectors that are null, empty, zero or hold null or non-finite components link with
    nothing, nor do vectors of different lengths with each other. Equal vectors
    always link; repeated rows count as vectors of their own in ``n_links``. A row without an id links
    with nothing.
    """
    rows = materialise(_read(vectors))
    usable = rows.where(F.col("d1").isNotNull() & F.col("vec_id").isNotNull())
    one = usable.groupBy("d1", "d2").agg(F.min(F.struct("vec_id", "dim", "unit")).alias("m"), F.count("*").alias("size"))
    distinct = materialise(one.select("d1", "d2", F.col("m.vec_id").alias("cls"), F.col("m.dim").alias("dim"), F.col("m.unit").alias("unit"), "size"))
    pairs = materialise(linked_pairs(distinct, threshold, **options))
    ends = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("cls"), F.col("b").alias("other")), F.struct(F.col("b").alias("cls"), F.col("a").alias("other")))).alias("e"))
    sizes = distinct.select(F.col("cls").alias("other"), "size")
    near = ends.select("e.cls", "e.other").join(sizes.hint("merge"), "other").groupBy("cls").agg(F.sum("size").alias("more"))
    known = distinct.select("d1", "d2", "cls", "size").join(near.hint("merge"), "cls", "left")
    member = rows.select("vec_id", "d1", "d2").join(known.hint("merge"), ["d1", "d2"], "left")
    member = materialise(member.select("vec_id", "cls", (F.col("size") - 1 + F.coalesce("more", F.lit(0))).alias("links")))
    same = member.where("cls <> vec_id").select(F.col("cls").alias("a"), F.col("vec_id").alias("b"))
    label = components(pairs.unionByName(same), merge=True).withColumnRenamed("id", "vec_id")
    out = member.join(label.hint("merge"), "vec_id", "left").select(
        "vec_id", F.when(F.col("vec_id").isNull(), 0).otherwise(F.coalesce("links", F.lit(0))).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
    )
    return out.withColumn("kept", F.col("vec_id").isNotNull() & (F.col("vec_id") == F.col("component_id")))
