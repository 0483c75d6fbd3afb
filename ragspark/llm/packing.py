"""Cost-balanced packing of documents into sequences of a fixed number of tokens.

The cost of a piece of n tokens is n + n²/context: its linear layers plus its
attention, which looks at the piece alone. Within a group of documents (a run of one
partition's rows, bounded in tokens), whole sequences are cut off long documents
first. The rest goes, longest first, to the sequence of lowest cost that still has
room; a piece that fits nowhere is cut to fill the roomiest ones. A group has as
many sequences as its tokens need, so that only one of them can have padding to
speak of. Nothing is shuffled.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragspark.llm import tokens

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, cost double"
)


def cost(lengths: np.ndarray, context: int) -> np.ndarray:
    return lengths + lengths.astype(float) ** 2 / context


def assign(sizes: list[int], context: int) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of documents of the given sizes.

    Ties go to the earlier document and the lower sequence. The pieces of a
    document partition its tokens; documents of size zero get no piece.
    """
    out = []
    rest = []
    sequence = 0
    for doc, size in enumerate(sizes):
        for start in range(0, size - context + 1, context):
            out.append((doc, start, context, sequence, 0))
            sequence += 1
        if size % context:
            rest.append((doc, size - size % context, size % context))
    if not rest:
        return out
    rest.sort(key=lambda p: (-p[2], p[0]))
    count = -(-sum(p[2] for p in rest) // context)
    room, load = np.full(count, context), np.zeros(count)
    price = cost(np.array([p[2] for p in rest]), context)
    for (doc, start, length), own in zip(rest, price):
        open_ = np.where(room >= length, load, np.inf)
        at = int(np.argmin(open_))
        if np.isfinite(open_[at]):
            parts = [(at, length, own)]
        else:
            parts = []
            left = length
            for at in np.argsort(-room, kind="stable"):
                take = min(left, int(room[at]))
                parts.append((int(at), take, take + take**2 / context))
                left -= take
                if not left:
                    break
        for at, take, own_cost in parts:
            out.append((doc, start, take, sequence + at, context - int(room[at])))
            room[at] -= take
            load[at] += own_cost
            start += take
    return out


def pack(docs: DataFrame, path: str, context: int = 2048, end_id: int = 1, group_tokens: int = 4_000_000) -> DataFrame:
    """One row per piece of every document: where it lies in the document and in its sequence.

    A document is its tokens and ``end_id``; null text counts as empty, so every
    document has a piece. Repeated rows are packed each for itself; extra columns
    are ignored; a null doc_id stays null; an empty table gives no rows. ``sequence_id`` is partition, group and
    sequence number in one long; ids are not consecutive. A group is closed once it holds ``group_tokens``
    tokens, a document of more makes one group.
    """
    end = np.asarray([end_id], "<u4").tobytes()

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        encode = tokens.encoder(path)
        base = TaskContext.get().partitionId() << 40
        names: list = []
        ids: list[bytes] = []
        held = 0

        def flush() -> pd.DataFrame:
            nonlocal base, held
            pieces = assign([len(x) // 4 for x in ids], context)
            rows = [
                (names[d], s, n, zlib.crc32(ids[d][4 * s : 4 * (s + n)]), len(ids[d]) // 4, base + q, o)
                for d, s, n, q, o in pieces
            ]
            out = pd.DataFrame(rows, columns=SCHEMA.replace(" long", "").replace(" double", "").split(", ")[:-1])
            out["doc_id"] = out["doc_id"].astype("Int64")
            out["cost"] = cost(out["length"].to_numpy(), context)
            base = int(max(p[3] for p in pieces)) + base + 1
            names.clear(), ids.clear()
            held = 0
            return out

        for batch in batches:
            for name, text in zip(batch["doc_id"], batch["text"]):
                names.append(None if pd.isna(name) else int(name))
                ids.append(encode(text) + end)
                held += len(ids[-1]) // 4
                if held >= group_tokens:
                    yield flush()
        if names:
            yield flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(packed, SCHEMA)
