"""Top-k cosine retrieval over a vector table, and the conversation scope."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import zstandard
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragspark import fixed
from ragspark.operators.ranking import first_per_group
from ragspark.session import written_and_freed

SCORE_DIGITS = 6
# Upper bound of scores held at once by a task (rows of one side times rows of the other).
BLOCK_SCORES = 4_000_000
# Numbers in the vectors of one side of a group of the cell plan: 65,536 vectors of 64 dimensions.
GROUP_VALUES = 4 << 20
# Queries and chunks whose scores are compared at once there, and pairs scored exactly at once.
TILE_QUERIES, TILE_CHUNKS, EXACT_PAIRS = 512, 1024, 1 << 16


def _unit(vectors) -> np.ndarray:
    """Float64 matrix of unit rows; a zero vector stays zero and scores 0."""
    m = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norm == 0, 1.0, norm)


def _best(qids, cids, scores: np.ndarray, k: int, exclude_self: bool, floor: np.ndarray | None = None) -> pd.DataFrame:
    """Best k per row of a score block, by (score descending, chunk id), in no order.

    Score and column go into one integer, so copies of a chunk, whose scores tie,
    are cut to k as well. Rows below ``floor`` points of their query are left out.
    """
    qids, cids = np.asarray(qids), np.asarray(cids)
    by_id = np.argsort(cids, kind="stable")
    cids, points = cids[by_id], np.rint(scores[:, by_id] * 10 ** SCORE_DIGITS).astype(np.int64)
    n, never = len(cids), np.iinfo(np.int64).max
    key = np.arange(n) - points * n
    if exclude_self:
        key[qids[:, None] == cids[None, :]] = never
    cols = np.argpartition(key, k - 1, axis=1)[:, :k] if n > k else np.tile(np.arange(n), (len(qids), 1))
    kept = np.take_along_axis(key, cols, 1) != never
    if floor is not None:
        kept &= np.take_along_axis(points, cols, 1) >= floor[:, None]
    r, j = np.nonzero(kept)
    c = cols[r, j]
    return pd.DataFrame({"query_id": qids[r], "chunk_id": cids[c], "score": points[r, c] / 10 ** SCORE_DIGITS})


def _points(q: np.ndarray, c: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Rounded cosines of pairs of unit rows, in units of the last digit."""
    found = np.empty(len(rows), dtype=np.int64)
    for at in range(0, len(rows), EXACT_PAIRS):
        some = slice(at, at + EXACT_PAIRS)
        found[some] = np.rint(np.einsum("ij,ij->i", q[rows[some]], c[cols[some]]) * 10 ** SCORE_DIGITS)
    return found


def _best_of_group(qids, q: np.ndarray, cids, c: np.ndarray, k: int, exclude_self: bool) -> Iterator[pd.DataFrame]:
    """Best k of a group of chunks for each of a group of queries, as :func:`_best` finds them, without sorting all scores.

    Single precision and the k-th best score so far rule most pairs out, with slack for its rounding; what is left is scored in
    double precision. Chunks come by id, so a later one has to score more than the k-th best, and of chunks with equal
    vectors only the first ones can be among the best.
    """
    qids, cids = np.asarray(qids), np.asarray(cids)
    wanted = k + int(exclude_self)
    order = np.argsort(cids, kind="stable")
    order = order[np.isfinite(c[order]).all(axis=1)]
    alike = pd.Series([row.tobytes() for row in c[order] + 0.0])
    order = order[(alike.groupby(alike, sort=False).cumcount() < wanted).to_numpy()]
    cids, c = cids[order], c[order]
    own = pd.Index(cids).get_indexer(pd.Index(qids)) if exclude_self else None
    q32, c32 = q.astype(np.float32), np.zeros((len(c) + -len(c) % 8, q.shape[1]), dtype=np.float32)
    c32[:len(c)] = c
    slack = (q.shape[1] + 8) * 2.0 ** -23 + 0.5 / 10 ** SCORE_DIGITS
    # Held for all tiles and small enough for a core's cache; eight marks are tested at once.
    held = np.empty(TILE_QUERIES * TILE_CHUNKS, dtype=np.float32)
    marks = np.empty(TILE_QUERIES * TILE_CHUNKS, dtype=bool)
    for x in range(0, len(q), TILE_QUERIES):
        some = q32[x:x + TILE_QUERIES]
        floor = np.full(len(some), -np.inf, dtype=np.float32)
        rows, cols, points = (np.empty(0, dtype=np.int64) for _ in range(3))
        y, waiting, found = 0, 0, []
        while y < len(c):
            width = min(TILE_CHUNKS, len(c32) - y)
            scores = np.matmul(some, c32[y:y + width].T, out=held[:len(some) * width].reshape(len(some), width))
            if y == 0 and len(c) > wanted:
                floor = np.partition(scores[:, :len(c)], -wanted, axis=1)[:, -wanted] - np.float32(2 * slack)
            hit = np.greater_equal(scores, floor[:, None], out=marks[:len(some) * width].reshape(len(some), width))
            eights = np.flatnonzero(hit.reshape(-1).view(np.uint64))
            eight, one = np.nonzero(hit.reshape(-1, 8)[eights])
            new_rows, new_cols = np.divmod(eights[eight] * 8 + one, width)
            found.append((new_rows, new_cols + y))
            waiting += len(new_rows)
            y += width
            # Scored exactly once there are enough, or when the floor still rises fast.
            if y < len(c) and y > 8 * TILE_CHUNKS and waiting < k * len(some):
                continue
            new_rows, new_cols = (np.concatenate(part) for part in zip(*found))
            waiting, found = 0, []
            # The last rows of ``c32`` only fill it up.
            kept = new_cols < len(c)
            if exclude_self:
                kept &= own[x + new_rows] != new_cols
            new_rows, new_cols = new_rows[kept], new_cols[kept]
            if not len(new_rows):
                continue
            points = np.concatenate([points, _points(q, c, x + new_rows, new_cols)])
            rows, cols = np.concatenate([rows, new_rows]), np.concatenate([cols, new_cols])
            by = np.lexsort((cols, -points, rows))
            rows, cols, points = rows[by], cols[by], points[by]
            place = np.arange(len(rows)) - np.searchsorted(rows, rows)
            full = place == k - 1
            floor[rows[full]] = (points[full] + 1) / 10 ** SCORE_DIGITS - slack
            rows, cols, points = (a[place < k] for a in (rows, cols, points))
        yield pd.DataFrame({"query_id": qids[x + rows], "chunk_id": cids[cols], "score": points / 10 ** SCORE_DIGITS})


def _top(rows: pd.DataFrame, k: int) -> pd.DataFrame:
    ordered = rows.sort_values(["query_id", "score", "chunk_id"], ascending=[True, False, True])
    return ordered.groupby("query_id", sort=False).head(k)


def top_k(
    queries: DataFrame,
    chunks: DataFrame,
    k: int = fixed.TOP_K,
    *,
    exclude_self: bool = False,
    broadcast_queries: int = 4096,
    group_rows: int = 16384,
    cells: int = 1024,
    probes: int | None = None,
) -> DataFrame:
    """Nearest chunks per query: ``query_id, chunk_id, score, rank``; exact unless ``probes`` is set.

    ``queries(query_id, embedding)`` and ``chunks(chunk_id, embedding)`` have
    unique ids; rows without a vector are left out. Filter the chunk side first
    when metadata restricts it. The score is the cosine
    rounded to six digits, ties go to the smaller chunk id.

    Up to ``broadcast_queries`` queries travel to the chunks, which then need no
    shuffle. More queries take the cell plan of :func:`_by_cells`; 0 asks for it at
    any size. Either way no pair is ever emitted: each task keeps only the best k per query.

    ``group_rows`` is the least number of rows a side of its groups, a quarter of it the wanted size of a cell.
    ``cells`` bounds the pivots of the cell plan, which the driver and every task hold;
    it changes the work, not the result. ``probes`` makes the cell plan approximate: a
    query asks only that many nearest cells, so it may miss neighbours, and gets
    fewer than k rows where those cells hold fewer. Measure the recall with the exact form.
    """
    if probes is not None:
        broadcast_queries = 0
    queries = queries.select("query_id", "embedding").where(F.col("embedding").isNotNull())
    chunks = chunks.select("chunk_id", "embedding").where(F.col("embedding").isNotNull())
    head = queries.limit(broadcast_queries + 1).toPandas()
    if head.empty:
        return chunks.sparkSession.createDataFrame([], _schema(queries, chunks, rank=True))
    if len(head) <= broadcast_queries:
        best = _by_broadcast(head, queries, chunks, k, exclude_self)
    else:
        best = _by_cells(queries, chunks, k, exclude_self, group_rows, cells, probes)
    order = [F.col("score").desc(), F.col("chunk_id")]
    return first_per_group(best, ["query_id"], order, k)


def _schema(queries: DataFrame, chunks: DataFrame, rank: bool = False) -> T.StructType:
    fields = [
        T.StructField("query_id", queries.schema["query_id"].dataType),
        T.StructField("chunk_id", chunks.schema["chunk_id"].dataType),
        T.StructField("score", T.DoubleType()),
    ]
    return T.StructType(fields + ([T.StructField("rank", T.IntegerType())] if rank else []))


def _by_broadcast(head: pd.DataFrame, queries, chunks, k, exclude_self) -> DataFrame:
    shared = chunks.sparkSession.sparkContext.broadcast(
        (head["query_id"].to_numpy(), _unit(head["embedding"]))
    )

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        qids, q = shared.value
        row_of = pd.Series(np.arange(len(qids)), index=qids)
        step = max(1, BLOCK_SCORES // len(qids))
        floor = np.full(len(qids), np.iinfo(np.int64).min)
        best, waiting = [], 0

        def merge() -> None:
            nonlocal best, waiting
            best, waiting = [_top(pd.concat(best), k)], 0
            full = best[0].groupby("query_id")["score"].agg(["size", "min"])
            full = full[full["size"] >= k]
            floor[row_of[full.index]] = np.rint(full["min"] * 10 ** SCORE_DIGITS)

        for batch in batches:
            for at in range(0, len(batch), step):
                part = batch.iloc[at:at + step]
                found = _best(qids, part["chunk_id"], q @ _unit(part["embedding"]).T, k, exclude_self, floor)
                best.append(found)
                waiting += len(found)
                # Once every query has k candidates, few new rows pass its floor.
                if waiting > 4 * k * len(qids):
                    merge()
        if best:
            merge()
            yield best[0]

    return chunks.mapInPandas(scan, _schema(queries, chunks))


def _by_cells(queries, chunks, k, exclude_self, group_rows, most_cells, probes) -> DataFrame:
    """Cell plan for query sets too large to broadcast.

    Chunks are assigned to the nearest of at most ``most_cells`` pivots. For a
    query the triangle inequality bounds the distance of its k-th neighbour from
    cell sizes and radii alone, and rules out every cell that lies beyond it;
    with ``probes`` only the cells of the nearest pivots are asked instead.
    Small cells share a block (not with ``probes``, which asks for single cells), a
    large one is cut into slices, the queries of a block into shares, and slices meet shares
    in groups. A group has ``group_rows`` rows a side at least, where there are so many, and ``GROUP_VALUES`` numbers a side
    where that leaves enough groups for the cores; every row is sent to as many groups as the other
    side has, so large groups keep the shuffle small, and none grows with the data.
    """
    spark = chunks.sparkSession
    total = chunks.count()
    # Small cells prune well but send each query to many places; a quarter of a group is the middle.
    n_cells = int(min(most_cells, max(1, 4 * total // group_rows)))
    seeds = chunks.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(n_cells).select("embedding").toPandas()
    if seeds.empty:
        return spark.createDataFrame([], _schema(queries, chunks))
    units = _unit(seeds["embedding"])
    pivots = spark.sparkContext.broadcast(units)

    def distances(vectors) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (_unit(vectors) @ pivots.value.T)))

    def assign(batches):
        for batch in batches:
            if len(batch):
                d = distances(batch["embedding"])
                yield batch.assign(cell=d.argmin(axis=1).astype("int32"), gap=d.min(axis=1))

    fields = [*chunks.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("gap", T.DoubleType())]
    placed = chunks.mapInPandas(assign, T.StructType(fields))
    # One row per cell, so at most ``most_cells`` rows reach the driver.
    cells = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("gap").alias("radius")).toPandas()
    cores = spark.sparkContext.defaultParallelism
    side = int(np.ceil(np.sqrt(4 * cores)))
    rows = max(1, group_rows, min(GROUP_VALUES // max(1, units.shape[1]), -(-total // side)))
    if probes is None:
        # Neighbouring cells share blocks.
        cells = cells.iloc[np.argsort(units[cells["cell"]] @ units[0], kind="stable")].reset_index(drop=True)
    block, held = [], 0
    for n in cells["n"]:
        if block and (probes is not None or held + n > rows):
            block, held = [*block, block[-1] + 1], 0
        else:
            block = [*block, block[-1] if block else 0]
        held += n
    cells["block"] = block
    stats = spark.sparkContext.broadcast(tuple(cells[c].to_numpy() for c in ("cell", "n", "radius", "block")))
    wanted = k + (1 if exclude_self else 0)

    def plan(batches):
        ids, sizes, radii, blocks = stats.value
        starts = np.flatnonzero(np.diff(blocks, prepend=-1))
        for batch in batches:
            for at in range(0, len(batch), 1024):
                part = batch.iloc[at:at + 1024]
                d = distances(part["embedding"])[:, ids]
                if probes is not None:
                    yield part.assign(blocks=list(blocks[np.argsort(d, axis=1)[:, :probes]].astype("int32")))
                    continue
                reach = d + radii
                order = np.argsort(reach, axis=1)
                covered = np.cumsum(sizes[order], axis=1)
                enough = (covered >= wanted).argmax(axis=1)
                enough = np.where(covered[:, -1] >= wanted, enough, len(ids) - 1)
                limit = np.take_along_axis(reach, np.take_along_axis(order, enough[:, None], 1), 1)
                # Slack for rounding of distances and of the reported score.
                near = np.logical_or.reduceat(d - radii <= limit + 1e-3, starts, axis=1)
                yield part.assign(blocks=[np.flatnonzero(r).astype("int32") for r in near])

    fields = [*queries.schema.fields, T.StructField("blocks", T.ArrayType(T.IntegerType()))]
    aimed = queries.mapInPandas(plan, T.StructType(fields))
    # Again at most one row per cell.
    asked = aimed.select(F.explode("blocks").alias("block")).groupBy("block").agg(F.count("*").alias("asked")).toPandas()
    parts = cells.groupby("block", as_index=False)["n"].sum().merge(asked, on="block")
    table = [(int(b), -(-int(n) // rows), -(-int(q) // rows)) for b, n, q in zip(parts["block"], parts["n"], parts["asked"])]
    shares = F.broadcast(spark.createDataFrame(table, "block int, c_parts int, q_parts int"))
    home = F.broadcast(spark.createDataFrame([(int(c), int(b)) for c, b in zip(cells["cell"], cells["block"])], "cell int, block int"))
    left = (
        aimed.select("query_id", "embedding", F.explode("blocks").alias("block")).join(shares, "block")
        .withColumn("q_part", F.pmod(F.xxhash64("query_id"), F.col("q_parts")).cast("int"))
        .withColumn("c_part", F.explode(F.sequence(F.lit(0), F.col("c_parts") - 1)))
        .select("block", "q_part", "c_part", "query_id", "embedding")
    )
    right = (
        placed.join(home, "cell").join(shares, "block")
        .withColumn("c_part", F.pmod(F.xxhash64("chunk_id"), F.col("c_parts")).cast("int"))
        .withColumn("q_part", F.explode(F.sequence(F.lit(0), F.col("q_parts") - 1)))
        .select("block", "q_part", "c_part", "chunk_id", "embedding")
    )
    schema = _schema(queries, chunks)
    names = schema.fieldNames()

    def score(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if q.empty or c.empty:
            return pd.DataFrame(columns=names)
        return pd.concat(_best_of_group(q["query_id"], _unit(q["embedding"]), c["chunk_id"], _unit(c["embedding"]), k, exclude_self))

    keys = ["block", "q_part", "c_part"]
    # A fixed number, as a group is little data and much work: by their bytes adaptive execution would put many into one task.
    tasks = min(8192, max(cores, 2 * sum(c * q for _, c, q in table)))
    return (
        left.repartition(tasks, *keys).groupBy(*keys)
        .cogroup(right.repartition(tasks, *keys).groupBy(*keys)).applyInPandas(score, schema)
    )


def public_metadata(metadata: Column, prefix: str = fixed.INTERNAL_METADATA_PREFIX) -> Column:
    """Drop service-internal keys from a metadata map."""
    return F.map_filter(metadata, lambda key, _: ~F.startswith(key, F.lit(prefix)))


def session_scope(retrieved: DataFrame, cap: int = fixed.SCOPE_CAP, dedupe_key: str = "chunk_id") -> DataFrame:
    """Chunks in scope of each session after all its turns.

    ``retrieved(session_id, turn, rank, chunk_id, score)``. The best score of a
    chunk survives; equal scores keep the order in which that score was first
    reached, within a turn the order in which the chunks first came into the session. A chunk pushed out by the cap can only return with
    a better score, so the running merge over turns equals this single pass.
    """
    keys = ["session_id", dedupe_key]
    # Two aggregations instead of a window: a chunk retrieved by most turns of a
    # session is combined map-side.
    best = retrieved.groupBy(*keys).agg(
        F.max_by(F.struct("turn", "rank", *[c for c in retrieved.columns if c not in {*keys, "turn", "rank", "score"}]),
                 F.struct(F.col("score"), -F.col("turn"), -F.col("rank"))).alias("_at"),
        F.max("score").alias("score"), F.min(F.struct("turn", "rank")).alias("_seen"),
    )
    order = [F.col("score").desc(), F.col("_at.turn"), F.col("_seen"), F.col(dedupe_key)]
    ranked = first_per_group(best, ["session_id"], order, cap)
    extra = [c for c in retrieved.columns if c not in {*keys, "turn", "rank", "score"}]
    return ranked.select(
        *keys, *[F.col(f"_at.{c}").alias(c) for c in extra], "score",
        F.col("_at.turn").alias("turn"), F.col("rank").alias("scope_rank"),
    )


def mark_cited(chunks: DataFrame, cited: DataFrame, keys: list[str]) -> DataFrame:
    """Flag the chunks in scope that the draft cites."""
    hits = cited.select(*keys).distinct().withColumn("is_cited", F.lit(True))
    return chunks.join(hits, keys, "left").withColumn("is_cited", F.coalesce("is_cited", F.lit(False)))


@F.pandas_udf(T.BinaryType())
def packed(texts: pd.Series) -> pd.Series:
    """Bytes of a text, compressed; null stays null."""
    one = zstandard.ZstdCompressor(level=3)
    return texts.map(lambda x: None if x is None else one.compress(x))


@F.pandas_udf(T.ArrayType(T.BinaryType()))
def unpacked(lists: pd.Series) -> pd.Series:
    """The bytes that :func:`packed` got, of each entry of an array."""
    one = zstandard.ZstdDecompressor()
    return lists.map(lambda some: None if some is None else [None if x is None else one.decompress(x) for x in some])


def in_slices(
    asked: DataFrame, top: DataFrame, chunks: DataFrame, on: list[str], run: str, finish: Callable[[DataFrame], DataFrame], slices: int = 8
) -> DataFrame:
    """``finish`` of every run's retrieved chunks, one slice of the runs after the other.

    ``asked(run, query_id, ...)`` meets ``top(query_id, chunk_id, score, rank)`` and then, on ``on``, ``chunks`` (those columns and
    others); a chunk that is not there has null columns. ``finish`` gets whole runs, and its rows are written. A chunk
    moves to each run that retrieved it, so many times over: let it be small (:func:`packed`). The shuffle files of a slice go before the
    next one starts, and the chunks are dealt out by their keys once, for all slices.
    """
    spark = asked.sparkSession
    dealt = chunks.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *on).sortWithinPartitions(*on)
    dealt = dealt.persist(StorageLevel.DISK_ONLY)
    try:
        done = []
        for number in range(slices):
            some = asked.where(F.pmod(F.xxhash64(run), F.lit(slices)) == number)
            done.append(written_and_freed(finish(some.join(top, "query_id").join(dealt.hint("merge"), on, "left"))))
    finally:
        dealt.unpersist()
    return reduce(DataFrame.unionByName, done)


def context_blocks(
    chunks: DataFrame, keys: list[str], *, with_score: bool = True, word: str = "Provision", unpack: Callable[[Column], Column] | None = None
) -> DataFrame:
    """Numbered context block per run from its ranked chunks (bounded by the retrieval cap).

    ``unpack`` makes texts of an array of ``content``, which then moves as it is until a run's chunks are together.
    """
    score = F.concat(F.lit("\nScore: "), F.format_string("%.4f", "score")) if with_score else F.lit("")
    head = F.concat(
        F.format_string(f"--- {word} %d (chunk_id: %s) ---\nSection: ", F.col("_i"), F.col("chunk_id").cast("string")),
        F.coalesce(F.col("section").cast("string"), F.lit("unknown")), score, F.lit("\n\n"),
    )
    numbered = chunks.withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy("rank")))
    parts = numbered.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(F.col("_i"), head.alias("head"), F.col("content")))).alias("_blocks")
    )
    texts = F.transform("_blocks", lambda b: b["content"])
    blocks = F.zip_with(F.transform("_blocks", lambda b: b["head"]), unpack(texts) if unpack else texts, lambda head, text: F.concat(head, text))
    return parts.select(*keys, F.array_join(blocks, "\n\n").alias("context"), F.size("_blocks").alias("n_chunks"))
