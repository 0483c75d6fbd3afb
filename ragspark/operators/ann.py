"""Approximate nearest neighbours: product-quantised codes, then exact scores of a calibrated few.

An index holds a code of a few bytes for every chunk, in slices. Queries meet codes in groups; a group looks its codes up once and
multiplies. Only the chunks with the best code scores are scored exactly: lists of them, not pairs, go to the groups that hold
their vectors. How many that takes for a wanted recall is measured on the index itself with :func:`calibrate`, not assumed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragspark import fixed
from ragspark.operators.ranking import first_per_group
from ragspark.operators.retrieval import SCORE_DIGITS, _points, _unit, top_k
from ragspark.session import materialise

#: Queries and codes whose scores a task holds at once.
TILE_QUERIES, TILE_CODES = 256, 8192
#: Codes and queries of a group, and numbers in the vectors of its chunks.
GROUP_CODES, GROUP_QUERIES, GROUP_VALUES = 1 << 17, 1 << 14, 8 << 20


@dataclass(frozen=True)
class Index:
    """``slices(slice, chunk_ids, codes, vectors)``, the ``rows(chunk_id, embedding)`` behind them, their number, and a codebook for each part."""

    slices: DataFrame
    rows: DataFrame
    total: int
    books: tuple[np.ndarray, ...]
    edges: tuple[int, ...]


def _codebook(part: np.ndarray, size: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """At most ``size`` centres of the rows of one part, by Lloyd's rounds; a centre that loses all rows moves to a random one."""
    distinct = np.unique(part, axis=0)
    if len(distinct) <= size:
        return distinct
    centres = distinct[rng.choice(len(distinct), size, replace=False)]
    for _ in range(rounds):
        nearest = _nearest(part, centres)
        weight = np.bincount(nearest, minlength=size)
        total = np.stack([np.bincount(nearest, part[:, j], size) for j in range(part.shape[1])], axis=1)
        lost = weight == 0
        centres = total / np.maximum(weight, 1)[:, None]
        centres[lost] = part[rng.choice(len(part), int(lost.sum()))]
    return centres


def _nearest(part: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmax(part @ centres.T - (centres * centres).sum(1) / 2, axis=1)


def build(
    chunks: DataFrame, *, parts: int = 16, centres: int = 256, sample_rows: int = 16384, rounds: int = 10, slice_rows: int = 16384, seed: int = 11
) -> Index:
    """Index of ``chunks(chunk_id, embedding)``; ids are unique, rows without a vector are left out, and all vectors have one length.

    Codebooks are learned from at most ``sample_rows`` rows taken by a hash of the id; every row is coded.
    Coding needs no shuffle. At most 256 ``centres`` a part, so that a code takes one byte for each of ``parts``.
    """
    if not 1 <= centres <= 256:
        raise ValueError("a code is one byte: 1 to 256 centres")
    rows = chunks.select("chunk_id", "embedding").where(F.col("embedding").isNotNull())
    total = rows.count()
    # Some more than asked for on average; the limit keeps the bound.
    share = min(1.0, 1.2 * sample_rows / max(total, 1))
    picked = rows.where(F.pmod(F.xxhash64("chunk_id"), F.lit(1 << 30)) < int(share * (1 << 30))).limit(sample_rows).select("embedding").toPandas()
    dim = len(picked["embedding"].iloc[0]) if len(picked) else 1
    units = _unit(picked["embedding"]) if len(picked) else np.zeros((1, dim))
    edges = tuple(int(e) for e in np.linspace(0, dim, min(parts, dim) + 1))
    rng = np.random.default_rng(seed)
    number = _number(rows)
    books = tuple(_codebook(units[:, a:b], centres, rounds, rng) for a, b in zip(edges, edges[1:]))

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, made, held, size = TaskContext.get().partitionId(), 0, [], 0

        def emit() -> pd.DataFrame:
            ids, codes, vectors = (np.concatenate(c) for c in zip(*held))
            return pd.DataFrame({"slice": [f"{task}-{made}"], "chunk_ids": [ids.tolist()], "codes": [codes.tobytes()], "vectors": [vectors.tobytes()]})

        for batch in batches:
            if not len(batch):
                continue
            x = _unit(batch["embedding"])
            codes = np.stack([_nearest(x[:, a:b], c) for a, b, c in zip(edges, edges[1:], books)], axis=1).astype(np.uint8)
            held.append((batch["chunk_id"].to_numpy(), codes, np.stack([np.asarray(v, dtype=number) for v in batch["embedding"]])))
            size += len(batch)
            if size >= slice_rows:
                yield emit()
                made, held, size = made + 1, [], 0
        if held:
            yield emit()

    schema = T.StructType([
        T.StructField("slice", T.StringType()), T.StructField("chunk_ids", T.ArrayType(rows.schema["chunk_id"].dataType)), T.StructField("codes", T.BinaryType()),
        T.StructField("vectors", T.BinaryType()),
    ])
    return Index(materialise(rows.mapInPandas(encode, schema)), rows, total, books, edges)


def _number(rows: DataFrame) -> np.dtype:
    """Type that holds the entries of the vectors."""
    return np.dtype("<f4" if isinstance(rows.schema["embedding"].dataType.elementType, T.FloatType) else "<f8")


def _grid(index: Index, n_queries: int) -> tuple[DataFrame, int, int, int]:
    """Cell ``_a`` of each slice, the number of cells and of query shares, and of tasks for their groups. One row a slice reaches the driver."""
    cores = index.slices.sparkSession.sparkContext.defaultParallelism
    dim = index.edges[-1]
    most = max(1, min(GROUP_CODES, GROUP_VALUES // max(1, dim)))
    cell, held, table = 0, 0, []
    for row in index.slices.select("slice", F.size("chunk_ids").alias("n")).orderBy("slice").toLocalIterator():
        if held and held + row.n > most:
            cell, held = cell + 1, 0
        held += row.n
        table.append((row.slice, cell))
    down = max(1, -(-n_queries // GROUP_QUERIES), min(-(-2 * cores // (cell + 1)), -(-n_queries // TILE_QUERIES)))
    cells = F.broadcast(index.slices.sparkSession.createDataFrame(table, "slice string, _a int"))
    return cells, cell + 1, down, min(8192, max(cores, 2 * (cell + 1) * down))


def _best(score: np.ndarray, bar: np.ndarray, y: int, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and values of a tile that may be among the ``keep`` best of their row."""
    if y == 0 and score.shape[1] > keep:
        cols = np.argpartition(-score, keep - 1, axis=1)[:, :keep]
        rows = np.repeat(np.arange(len(score)), keep)
        cols = cols.ravel()
    else:
        rows, cols = np.divmod(np.flatnonzero(score > bar[:, None]), score.shape[1])
    return rows, cols + y, score[rows, cols]


def _lists(queries: DataFrame, index: Index, keep: int) -> DataFrame:
    """Of each query and cell the ``keep`` chunks of best code score at most: query_id, _a, chunk_ids, scores."""
    books, edges = index.books, index.edges
    kind, chunk_kind = queries.schema["query_id"].dataType, index.rows.schema["chunk_id"].dataType
    cells, across, down, tasks = _grid(index, queries.count())
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    codes = index.slices.select("slice", "chunk_ids", "codes").join(cells, "slice").select("_a", every(down).alias("_b"), "chunk_ids", "codes")
    asked = queries.select(every(across).alias("_a"), F.pmod(F.xxhash64("query_id"), F.lit(down)).cast("int").alias("_b"), "query_id", "embedding")
    out = T.StructType([
        T.StructField("query_id", kind), T.StructField("_a", T.IntegerType()), T.StructField("chunk_ids", T.ArrayType(chunk_kind)),
        T.StructField("scores", T.ArrayType(T.FloatType())),
    ])

    def scan(key: tuple, q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if q.empty or c.empty:
            return pd.DataFrame(columns=out.fieldNames())
        code = np.concatenate([np.frombuffer(b, np.uint8) for b in c["codes"]]).reshape(-1, len(books))
        near = np.hstack([book.astype(np.float32)[code[:, m]] for m, book in enumerate(books)])
        chunk_ids, units = np.concatenate([np.asarray(i) for i in c["chunk_ids"]]), _unit(q["embedding"]).astype(np.float32)
        ids, scores = [], []
        for x in range(0, len(units), TILE_QUERIES):
            some = units[x : x + TILE_QUERIES]
            bar = np.full(len(some), -np.inf, np.float32)
            rows, at, best = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32)
            for y in range(0, len(near), TILE_CODES):
                found = _best(some @ near[y : y + TILE_CODES].T, bar, y, keep)
                rows, at, best = (np.concatenate(p) for p in zip((rows, at, best), found))
                by = np.lexsort((-best, rows))
                rows, at, best = rows[by], at[by], best[by]
                place = np.arange(len(rows)) - np.searchsorted(rows, rows)
                bar[rows[place == keep - 1]] = best[place == keep - 1]
                rows, at, best = (p[place < keep] for p in (rows, at, best))
            ends = np.searchsorted(rows, np.arange(1, len(some)))
            ids += np.split(chunk_ids[at], ends)
            scores += np.split(best, ends)
        return pd.DataFrame({"query_id": q["query_id"], "_a": np.int32(key[0]), "chunk_ids": ids, "scores": scores})

    keys = ["_a", "_b"]
    # A fixed number of tasks: a group is little data and much work.
    return asked.repartition(tasks, *keys).groupBy(*keys).cogroup(codes.repartition(tasks, *keys).groupBy(*keys)).applyInPandas(scan, out)


def _candidates(queries: DataFrame, index: Index, keep: int) -> DataFrame:
    """The ``keep`` chunks of best code score of each query: query_id, chunk_id, score, rank (of the code)."""
    pairs = _lists(queries, index, keep).select("query_id", F.explode(F.arrays_zip("chunk_ids", "scores")).alias("p"))
    found = pairs.select("query_id", F.col("p.chunk_ids").alias("chunk_id"), F.col("p.scores").cast("double").alias("score"))
    return first_per_group(found, ["query_id"], [F.col("score").desc(), F.col("chunk_id")], keep)


def _trimmed(lists: DataFrame, keep: int) -> DataFrame:
    """Lists of all cells of a query, cut together to its ``keep`` best by (score descending, chunk id): query_id, _a, chunk_ids."""
    whole = lists.groupBy("query_id").agg(F.collect_list(F.struct("_a", "chunk_ids", "scores")).alias("_l")).select(
        "query_id", F.transform("_l", lambda e: e["_a"]).alias("cells"), F.transform("_l", lambda e: F.size(e["chunk_ids"])).alias("sizes"),
        F.flatten(F.transform("_l", lambda e: e["chunk_ids"])).alias("chunk_ids"), F.flatten(F.transform("_l", lambda e: e["scores"])).alias("scores"),
    )
    out = T.StructType([lists.schema["query_id"], lists.schema["_a"], lists.schema["chunk_ids"]])

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done = []
            for row in batch.itertuples(index=False):
                ids, cell = np.asarray(row.chunk_ids), np.repeat(row.cells, row.sizes)
                kept = np.lexsort((ids, -np.asarray(row.scores)))[:keep]
                done += [(row.query_id, c, ids[kept[cell[kept] == c]]) for c in np.unique(cell[kept])]
            yield pd.DataFrame(done, columns=out.fieldNames())

    return whole.mapInPandas(cut, out)


def search(queries: DataFrame, index: Index, k: int = fixed.TOP_K, *, candidates: int, exclude_self: bool = False) -> DataFrame:
    """Nearest chunks of ``queries(query_id, embedding)``: query_id, chunk_id, score, rank, as :func:`retrieval.top_k` gives, but approximate.

    ``candidates`` chunks a query (see :func:`calibrate`) are scored exactly; scores and the order among
    them are exact, a neighbour whose code ranks lower is missed. Query ids are unique; rows without a vector are left out.
    """
    asked = queries.select("query_id", "embedding").where(F.col("embedding").isNotNull())
    keep = candidates + int(exclude_self)
    cells, _, down, tasks = _grid(index, asked.count())
    number, dim = _number(index.rows), index.edges[-1]
    near = _trimmed(_lists(asked, index, keep), keep).join(asked, "query_id").select(
        "_a", F.pmod(F.xxhash64("query_id"), F.lit(down)).cast("int").alias("_b"), "query_id", "embedding", "chunk_ids"
    )
    vectors = index.slices.select("slice", "chunk_ids", "vectors").join(cells, "slice").select(
        "_a", F.explode(F.sequence(F.lit(0), F.lit(down - 1))).alias("_b"), "chunk_ids", "vectors"
    )
    out = T.StructType([
        T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField("chunk_id", index.rows.schema["chunk_id"].dataType),
        T.StructField("score", T.DoubleType()),
    ])

    def score(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if q.empty or c.empty:
            return pd.DataFrame(columns=out.fieldNames())
        chunk_ids = np.concatenate([np.asarray(i) for i in c["chunk_ids"]])
        x = _unit(np.concatenate([np.frombuffer(v, number) for v in c["vectors"]]).reshape(-1, dim))
        rows, ids = np.repeat(np.arange(len(q)), q["chunk_ids"].map(len)), np.concatenate([np.asarray(i) for i in q["chunk_ids"]])
        query_ids = q["query_id"].to_numpy()
        if exclude_self:
            others = query_ids[rows] != ids
            rows, ids = rows[others], ids[others]
        points = _points(_unit(q["embedding"]), x, rows, pd.Index(chunk_ids).get_indexer(pd.Index(ids)))
        by = np.lexsort((ids, -points, rows))
        rows, ids, points = rows[by], ids[by], points[by]
        best = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
        return pd.DataFrame({"query_id": query_ids[rows[best]], "chunk_id": ids[best], "score": points[best] / 10**SCORE_DIGITS})

    keys = ["_a", "_b"]
    scored = near.repartition(tasks, *keys).groupBy(*keys).cogroup(vectors.repartition(tasks, *keys).groupBy(*keys)).applyInPandas(score, out)
    return first_per_group(scored, ["query_id"], [F.col("score").desc(), F.col("chunk_id")], k)


def calibrate(index: Index, k: int = fixed.TOP_K, recall: float = 0.95, *, trial_queries: int = 256) -> int:
    """Fewest candidates with which trial queries find a mean share ``recall`` of their exact ``k`` nearest.

    Trial queries are at most ``trial_queries`` chunks, taken by a hash of their id; each is searched exactly
    among all chunks but itself. Where too few candidates were looked at, twice as many are, up to all.
    """
    if not index.total:
        return k
    share = min(1.0, 2.0 * trial_queries / index.total)
    some = F.pmod(F.xxhash64("chunk_id", F.lit("trial")), F.lit(1 << 30)) < int(share * (1 << 30))
    trial = materialise(index.rows.where(some).limit(trial_queries).withColumnRenamed("chunk_id", "query_id"))
    exact = materialise(top_k(trial, index.rows, k, exclude_self=True).select("query_id", "chunk_id"))
    keep = min(index.total, 8 * k + 1)
    while True:
        ranked = _candidates(trial, index, keep).where(F.col("query_id") != F.col("chunk_id")).withColumnRenamed("rank", "_code")
        at = exact.join(ranked, ["query_id", "chunk_id"], "left").select("_code").toPandas()["_code"]
        wanted = int(np.ceil(recall * len(at)))
        if at.notna().sum() >= wanted or keep >= index.total:
            break
        keep = min(index.total, 2 * keep)
    found = np.sort(at.dropna().to_numpy())
    if not len(found):
        return k
    return max(k, int(found[min(wanted, len(found)) - 1]))
