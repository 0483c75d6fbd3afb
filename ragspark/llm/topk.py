"""Exact top-k inner products by a three-phase uniform threshold.

A score is the sum of its parts over blocks of dimensions; each block of dimensions is a
list of local scores. Rows are kept in slices that hold their part of every list.

1. Each list of each slice names the k rows that score highest in it. Their whole scores are
   known to exist, so the k-th best of them over all slices is a safe cutoff for a query.
2. The cutoff goes back with the queries. A row that reaches it must reach its m-th part
   in one of the m lists at least, so only those entries are collected.
3. The missing scores of collected entries are resolved in their slice, where the vectors are,
   and only rows that reach the cutoff leave it, k a query and slice at most.

Scores are whole numbers throughout, so nothing is lost at the cutoff.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ragspark.session import materialise, written

#: Rows and queries of one multiplication; bounds what a task holds of scores.
TILE_ROWS, TILE_QUERIES = 8192, 256
LOWEST = np.iinfo(np.int64).min


def _blocks(rows: DataFrame, size: int, scale: float) -> DataFrame:
    """Rows (id, v) packed into blocks of at most ``size`` of one length: block, dim, ids, cells (bytes), wide.

    Cells are 16-bit whole numbers, or doubles (which hold whole numbers) where one needs more.
    """
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        kept: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def emit(dim: int, parts: list) -> pa.RecordBatch:
            nonlocal made
            ids, cells = (np.concatenate(c) for c in zip(*parts))
            wide = bool(np.abs(cells).max(initial=0) > 32767)
            made += 1
            return pa.RecordBatch.from_pydict({
                "block": [f"{part}-{made}"], "dim": pa.array([dim], pa.int32()), "ids": [ids.tobytes()],
                "cells": [(cells if wide else cells.astype(np.int16)).tobytes()], "wide": [wide],
            })

        for batch in batches:
            sizes = batch.column("dim").to_numpy()
            for dim in np.unique(sizes):
                at = pa.array(np.flatnonzero(sizes == dim))
                flat = batch.column("v").take(at).flatten().to_numpy(zero_copy_only=False)
                cells = np.floor(flat * scale).reshape(-1, dim)
                ids = batch.column("id").take(at).to_numpy()
                sound = np.isfinite(cells).all(1)
                parts = kept.setdefault(int(dim), [])
                parts.append((ids[sound], cells[sound]))
                if sum(len(p[0]) for p in parts) + len(batch) > size:
                    yield emit(int(dim), kept.pop(int(dim)))
        for dim, parts in kept.items():
            if any(len(p[0]) for p in parts):
                yield emit(dim, parts)

    plain = rows.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"))
    usable = (F.size("v") > 0) & F.forall("v", lambda c: c.isNotNull() & (F.abs(c) < float("inf")))
    sound = plain.where(F.col("id").isNotNull() & F.col("v").isNotNull() & F.coalesce(usable, F.lit(False)))
    return sound.select("id", F.size("v").alias("dim"), "v").mapInArrow(
        pack, "block string, dim int, ids binary, cells binary, wide boolean"
    )


def _matrix(cells: bytes, wide: bool, dim: int) -> np.ndarray:
    return np.frombuffer(cells, np.float64 if wide else np.int16).reshape(-1, dim)


def _product(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products as 64-bit whole numbers, exact; an error where one does not fit."""
    bound = float(np.abs(q.astype(np.float64)).max(initial=0)) * float(np.abs(c.astype(np.float64)).max(initial=0)) * q.shape[1]
    if bound < 2**53:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    whole = lambda m: np.array([[int(v) for v in row] for row in m.tolist()], object).reshape(m.shape)
    return (whole(q) @ whole(c).T).astype(np.int64)


def _tiles(row: dict, lists: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]]:
    """(first query, query ids, row ids, local scores of each list, own rows) of the tiles of one block pair."""
    dim = row["dim"]
    q, c = _matrix(row["q_cells"], row["q_wide"], dim), _matrix(row["cells"], row["wide"], dim)
    q_ids, ids = np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["ids"], np.int64)
    edges = np.linspace(0, dim, min(lists, dim) + 1).astype(int)
    for y in range(0, len(c), TILE_ROWS):
        some, names = c[y : y + TILE_ROWS], ids[y : y + TILE_ROWS]
        for x in range(0, len(q), TILE_QUERIES):
            asked, asking = q[x : x + TILE_QUERIES], q_ids[x : x + TILE_QUERIES]
            local = [_product(asked[:, a:b], some[:, a:b]) for a, b in zip(edges, edges[1:])]
            own = np.zeros(local[0].shape, bool)
            for i in np.flatnonzero(np.isin(asking, names)):
                own[i] = names == asking[i]
            yield x, asking, names, local, own


def _best(total: np.ndarray, k: int) -> np.ndarray:
    return total if total.shape[1] <= k else np.partition(total, total.shape[1] - k, axis=1)[:, -k:]


def _gather(k: int, lists: int):
    """Phase 1: whole scores of the rows that lead a local list, the k best of each query and block pair."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                best: dict[int, np.ndarray] = {}
                for first, _, _, local, own in _tiles(row, lists):
                    total = sum(local)
                    total[own] = LOWEST
                    lead = []
                    for scores in local:
                        scores = np.where(own, LOWEST, scores)
                        width = scores.shape[1]
                        lead.append(np.argpartition(scores, width - k, axis=1)[:, -k:] if width > k else np.tile(np.arange(width), (len(scores), 1)))
                    at = np.sort(np.hstack(lead), axis=1)
                    found = np.take_along_axis(total, at, 1)
                    # A row that leads several lists counts once.
                    found[:, 1:][at[:, 1:] == at[:, :-1]] = LOWEST
                    best[first] = _best(np.hstack([best[first], found]) if first in best else found, k)
                for first, found in best.items():
                    i, j = np.nonzero(found != LOWEST)
                    yield pa.RecordBatch.from_pydict({
                        "q_block": pa.repeat(row["q_block"], len(i)), "place": (first + i).astype(np.int32), "score": found[i, j],
                    })
    return run


def _collect(k: int, lists: int):
    """Phases 2 and 3: entries that reach an equal part of the cutoff in a list, resolved; the k best of each query and block pair."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                cutoffs = np.full(len(row["q_ids"]) // 8, LOWEST, np.int64)
                for c in row["cutoffs"] or []:
                    cutoffs[c["place"]] = c["cutoff"]
                best: dict[int, list[tuple[np.ndarray, ...]]] = {}
                for first, asking, names, local, own in _tiles(row, lists):
                    cutoff = cutoffs[first : first + len(asking), None]
                    # The part is rounded up; without a cutoff every row is collected.
                    share = np.where(cutoff == LOWEST, LOWEST, -(-cutoff // len(local)))
                    i, j = np.nonzero(np.logical_or.reduce([s >= share for s in local]) & ~own)
                    score = sum(s[i, j] for s in local)
                    keep = score >= cutoff[i, 0]
                    best.setdefault(first, []).append((i[keep], score[keep], names[j[keep]]))
                    best[first] = [_leaders(best[first], k)]
                for first, [(i, score, names)] in best.items():
                    yield pa.RecordBatch.from_pydict({
                        "q_block": pa.repeat(row["q_block"], len(i)), "place": (first + i).astype(np.int32),
                        "query_id": np.frombuffer(row["q_ids"], np.int64)[first + i], "vec_id": names, "score": score,
                    })
    return run


def _leaders(parts: list[tuple[np.ndarray, ...]], k: int) -> tuple[np.ndarray, ...]:
    """Entries (query, score, row id) of rank k or better in their query."""
    i, score, names = (np.concatenate(c) for c in zip(*parts))
    order = np.lexsort((names, -score, i))
    i, score, names = i[order], score[order], names[order]
    start = np.searchsorted(i, i)
    keep = np.arange(len(i)) - start < k
    return i[keep], score[keep], names[keep]


def top_k(
    queries: DataFrame, rows: DataFrame, k: int = 5, scale: float = 256.0, lists: int = 2, block_rows: int = 65536, block_queries: int = 2048
) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows (vec_id, embedding) of highest inner product with each query (query_id, embedding).

    Components are scaled and rounded down to whole numbers, so scores are whole. Equal scores rank by smaller vec_id.
    Rows that carry the query's id are not its candidates. Null ids, vectors that are null, empty or hold null or
    non-finite components (after scaling) and queries without a candidate of their length give no rows. A repeated row is a candidate each time, a
    repeated query is answered each time. Extra columns are ignored. A score beyond 64 bits ends the job with an error.

    Blocks of queries meet slices of rows; ``block_rows`` and ``block_queries`` bound what a task holds. Each
    query and slice sends k scores at most in either phase, however many rows tie.
    """
    asked = queries.select(F.col("query_id").alias("id"), F.col("embedding").alias("v"))
    groups = max(1, -(-asked.count() // block_queries))
    with (
        written(_blocks(rows.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), block_rows, scale)) as slices,
        written(_blocks(asked.repartition(groups), block_queries, scale)) as blocks,
    ):
        across, down = max(1, slices.count()), max(1, blocks.count())
        # Each slice goes to one row of a grid, each query block to one column; they meet in one cell.
        own = lambda column, size: F.pmod(F.xxhash64(column), F.lit(size))
        all_of = lambda size: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(size - 1).cast("long")))
        laid = slices.select("dim", "ids", "cells", "wide", own("block", across).alias("a"), all_of(down).alias("b"))
        named = blocks.select(*[F.col(c).alias(f"q_{c}" if c != "dim" else c) for c in blocks.columns])

        def meet(side: DataFrame) -> DataFrame:
            put = side.select("*", own("q_block", down).alias("b"), all_of(across).alias("a"))
            return laid.join(put, ["dim", "a", "b"]).drop("a", "b")

        lead = meet(named).mapInArrow(_gather(k, lists), "q_block string, place int, score long")
        nth = F.row_number().over(Window.partitionBy("q_block", "place").orderBy(F.col("score").desc()))
        safe = lead.withColumn("nth", nth).where(F.col("nth") <= k).where(F.col("nth") == k)
        cutoffs = safe.groupBy("q_block").agg(F.collect_list(F.struct("place", F.col("score").alias("cutoff"))).alias("cutoffs"))
        with written(named.join(cutoffs, "q_block", "left")) as cut:
            found = meet(cut).mapInArrow(_collect(k, lists), "q_block string, place int, query_id long, vec_id long, score long")
            rank = F.row_number().over(Window.partitionBy("q_block", "place").orderBy(F.col("score").desc(), "vec_id"))
            best = found.withColumn("rank", rank).where(F.col("rank") <= k)
            return materialise(best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
