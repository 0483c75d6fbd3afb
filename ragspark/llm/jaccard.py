"""N-gram Jaccard self-join with PartEnum signatures, exact for documents of every size.

1. One pass reads every text as its set of hashed five-word shingles.
   The set has to share three quarters of its shingles with any partner, so
   a document more than a quarter of whose shingles occur nowhere else links with
   nothing. Shingle hashes meet in ranges, as sorted compressed runs, to tell.
2. The others are grouped by equal sets. Each distinct set gets PartEnum
   signatures: for its band of sizes and the next one, the hash domain is dealt
   into groups of cells, and in each group every choice of all cells but one
   gives a signature. Sets similar enough differ in so few shingles that some group
   has at most one cell that differs, so they share a signature; of these enough agree
   that each set can leave out those of the fewest shingles.
3. Sets that share signatures are first compared with one anchor each, which merges
   most of a large group of near copies by as many comparisons as it has members.
   Then all pairs between different components that share a signature meet, each in one
   pair of blocks of sets, where sketches rule most out before any pair is emitted, and are
   compared; pairs inside a component can add no link between components. Where many are left, the
   nearest of each set come first and merge components, round by round; at last all that are left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragspark.llm.common import fresh, worker_state
from ragspark.llm.components import components
from ragspark.session import materialise, written

CELLS = 3
BUCKETS = 128
SLICE = 256
# Members of signatures that a task compares, on average.
TASK_ROWS = 500_000
# Pairs that a task lets out at once, for each of its sets; from a task with more, only the nearest of each set come first.
FEW = 1
_MIX = 0x9E3779B97F4A7C15


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= 200_000:
            self.clear()
        out = self[word] = xxhash.xxh64_intdigest(word)
        return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word windows; of the whole sequence if there are fewer words."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    known = worker_state().setdefault("word_hashes", WordHashes())
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = min(size, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for j in range(n):
        out = _mixed(out * np.uint64(_MIX) + h[j : len(h) - n + 1 + j])
    return np.unique(out)


def _hashes(column) -> np.ndarray:
    """A set from its column of signed numbers."""
    return np.asarray(column, np.int64).view(np.uint64)


def _digest(found: np.ndarray) -> tuple[int, int]:
    """128 bits that tell equal sets."""
    raw = xxhash.xxh3_128_digest(found.tobytes())
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)


def _pack(values: np.ndarray, docs: np.ndarray) -> bytes:
    """Sorted values as differences and their documents, compressed."""
    steps = np.diff(values, prepend=np.uint64(0)).astype("<u8")
    planes = steps.view(np.uint8).reshape(-1, 8).T
    used = int(np.flatnonzero(planes.any(axis=1)).max(initial=0)) + 1
    body = bytes([used]) + planes[:used].tobytes() + docs.astype("<u2").view(np.uint8).reshape(-1, 2).T.tobytes()
    return zstandard.ZstdCompressor(level=1).compress(body)


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    used, n = int(raw[0]), (len(raw) - 1) // (int(raw[0]) + 2)
    planes = np.zeros((n, 8), np.uint8)
    planes[:, :used] = raw[1 : 1 + used * n].reshape(used, n).T
    docs = np.ascontiguousarray(raw[1 + used * n :].reshape(2, n).T).view("<u2").ravel()
    return np.cumsum(planes.view("<u8").ravel(), dtype=np.uint64), docs


def _profile(docs: DataFrame, size: int, range_bits: int, value_bits: int) -> DataFrame:
    """Of rows with doc_id and text or set: per row doc_id, n, block, place; per block and range of hashes: range, blob."""
    most = 1_000_000

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        sets: list[np.ndarray] = []
        names: list = []
        held = 0

        def flush() -> Iterator[pd.DataFrame]:
            yield pd.DataFrame({
                "doc_id": pd.array(names, "Int64"), "n": [len(s) for s in sets], "block": block,
                "place": np.arange(len(sets)), "range": pd.array([None] * len(sets), "Int32"), "blob": None,
            })
            values = np.concatenate(sets) >> np.uint64(64 - range_bits - value_bits)
            place = np.repeat(np.arange(len(sets), dtype=np.uint16), [len(s) for s in sets])
            order = np.argsort(values, kind="stable")
            values, place = values[order], place[order]
            del order
            part = (values >> np.uint64(value_bits)).astype(np.int64)
            values &= np.uint64((1 << value_bits) - 1)
            edges = np.flatnonzero(np.diff(part, prepend=-1, append=-1))
            rows = [
                (block, int(part[lo]), _pack(values[lo:hi], place[lo:hi])) for lo, hi in zip(edges[:-1], edges[1:])
            ]
            if rows:
                out = pd.DataFrame(rows, columns=["block", "range", "blob"])
                out["doc_id"] = out["n"] = out["place"] = pd.array([None] * len(out), "Int64")
                yield out[["doc_id", "n", "block", "place", "range", "blob"]]

        for batch in batches:
            known = "found" in batch
            for name, item in zip(batch["doc_id"], batch["found" if known else "text"]):
                found = _hashes(item) if known else shingles(item, size)
                names.append(None if pd.isna(name) else int(name))
                sets.append(found)
                held += len(found)
                if held >= most or len(sets) == 65535:
                    yield from flush()
                    block, held = block + 1, 0
                    sets.clear(), names.clear()
        if sets:
            yield from flush()
        # The worker lives on through the joins that follow; it should not hold memory there.
        worker_state().pop("word_hashes", None)
        pa.default_memory_pool().release_unused()

    return docs.mapInPandas(read, "doc_id long, n long, block long, place long, range int, blob binary")


def _alone(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Of one range of hashes: per block, how many shingles of each document occur in no other document."""
    found = [_unpack(b) for b in rows["blob"]]
    values = np.concatenate([v for v, _ in found])
    owner = np.repeat(np.arange(len(found), dtype=np.int32), [len(v) for v, _ in found])
    places = np.concatenate([d for _, d in found])
    order = np.argsort(values, kind="stable")
    v = values[order]
    new = np.concatenate(([True], v[1:] != v[:-1]))
    single = order[new & np.concatenate((new[1:], [True]))]
    by_owner = single[np.argsort(owner[single], kind="stable")]
    cuts = np.searchsorted(owner[by_owner], np.arange(len(found) + 1))
    out = [(b, places[by_owner[cuts[i] : cuts[i + 1]]]) for i, b in enumerate(rows["block"])]
    return pd.DataFrame(
        [(b, np.bincount(p, minlength=1).astype("<u4").tobytes()) for b, p in out], columns=["block", "counts"]
    )


def _summed(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Of one block: documents and their shingles that occur nowhere else."""
    parts = [np.frombuffer(c, "<u4") for c in rows["counts"]]
    total = np.zeros(max(map(len, parts)), np.int64)
    for part in parts:
        total[: len(part)] += part
    return pd.DataFrame({"block": key[0], "place": np.arange(len(total)), "alone": total})


def bands(n: int, threshold: float) -> list[tuple[int, int]]:
    """(band, its largest size) of the size's own band and the next one.

    A band ends where its largest size is the smallest one divided by the threshold, so
    sets similar enough lie in one band or in two neighbouring ones.
    """
    band, lo = 0, 1
    while True:
        hi = int(lo / threshold + 1e-9)
        if n <= hi:
            break
        band, lo = band + 1, hi + 1
    return [(band, hi), (band + 1, int((hi + 1) / threshold + 1e-9))]


def _differing(sizes: int, threshold: float) -> int:
    """Most elements in which two sets differ that are similar enough and have so many elements together."""
    return int(sizes * (1 - threshold) / (1 + threshold) + 1e-9)


def signatures(found: np.ndarray, threshold: float) -> np.ndarray:
    """PartEnum signatures of a set of hashes.

    With at most k differing elements and more than k/2 groups, some group has at most one
    that differs; it spoils one of the group's cells, and the signature of the others agrees.
    All but k/2 groups agree like that, and there are a few more groups than needed. Signatures of few elements, above all of
    none, bring unrelated sets together. Where a pair agrees on one, both sides see the same elements there. So a
    set leaves out its signatures of the fewest elements as long as they touch fewer of its groups than agree with
    any set that is similar enough: every such pair still agrees on a signature that neither side leaves out.
    """
    out = []
    for band, hi in bands(len(found), threshold):
        needed = _differing(2 * hi, threshold) // 2 + 1
        groups = needed + needed // 16 + 3
        salt = np.uint64((_MIX * (band + 1)) & (2**64 - 1))
        mixed = _mixed(found + salt)
        cell = ((mixed >> np.uint64(20)) % np.uint64(groups * CELLS)).astype(np.int64)
        sums = np.zeros(groups * CELLS, np.uint64)
        np.add.at(sums, cell, mixed)
        sums = sums.reshape(groups, CELLS)
        rest = sums.sum(axis=1, dtype=np.uint64)[:, None] - sums
        label = (np.arange(groups * CELLS, dtype=np.uint64) + np.uint64(1)) * salt
        signs = _mixed(rest.ravel() + label)
        held = np.bincount(cell, minlength=groups * CELLS).reshape(groups, CELLS)
        content = held.sum(axis=1)[:, None] - held
        largest = min(hi, int(len(found) / threshold + 1e-9))
        agreeing = groups - _differing(len(found) + largest, threshold) // 2
        # Fewer than ``agreeing`` groups have a signature of less than this many elements.
        least = np.sort(content.min(axis=1))[agreeing - 1]
        out.append(signs[content.ravel() >= least])
    return np.concatenate(out)


def _sketch(found: np.ndarray) -> bytes:
    """Elements per bucket; two sets share at most the sum of the smaller counts."""
    return np.bincount((found >> np.uint64(7)).astype(np.int64) % BUCKETS, minlength=BUCKETS).astype("<u4").tobytes()


def _fine(found: np.ndarray) -> bytes:
    """As the sketch, with about one bucket of a byte per element; empty, which rules nothing out, if a count does not fit."""
    buckets = 1 << max(0, len(found) - 1).bit_length()
    counts = np.bincount((found >> np.uint64(20)).astype(np.int64) % buckets, minlength=buckets)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else b""


def _most_shared(x: bytes, y: bytes) -> tuple[int, int]:
    """Upper bound of shared elements by two fine sketches, and the sum of both sizes."""
    a, b = (np.frombuffer(s, np.uint8).astype(np.int64) for s in sorted((x, y), key=len))
    # Numbers of buckets are powers of two, so the finer sketch folds into the coarser one.
    return int(np.minimum(a, b.reshape(-1, len(a)).sum(axis=0)).sum()), int(a.sum() + b.sum())


def _may_link(x: bytes, y: bytes, percent: int) -> bool:
    """Whether two fine sketches allow a link."""
    if not (x and y):
        return True
    shared, total = _most_shared(x, y)
    return (100 + percent) * shared >= percent * total


def _sets(docs: DataFrame, size: int) -> DataFrame:
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [shingles(t, size) for t in batch["text"]]
            digests = [_digest(f) for f in found]
            yield pd.DataFrame({
                "doc_id": batch["doc_id"], "n": [len(f) for f in found], "d1": [d[0] for d in digests],
                "d2": [d[1] for d in digests], "sketch": [_sketch(f) for f in found],
                "fine": [_fine(f) for f in found], "found": [f.view(np.int64) for f in found],
            })

    return docs.mapInPandas(read, "doc_id long, n long, d1 long, d2 long, sketch binary, fine binary, found array<long>")


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float, sieved: bool = False) -> DataFrame:
    """Pairs (a, b) whose sets are similar enough, exactly; fine sketches spare most dissimilar pairs the move of whole sets.

    ``sieved`` pairs have met by their fine sketches already.
    """
    percent = round(threshold * 100)

    @F.pandas_udf("boolean")
    def fits(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([_may_link(a, b, percent) for a, b in zip(x, y)], dtype=bool)

    def joined(rows: DataFrame, column: str) -> DataFrame:
        # Without the bitmap all sets would be shuffled for however few pairs.
        side = lambda name: _maybe(sets.select(F.col("cls").alias(name), F.col(column).alias(f"s{name}")), rows.select(name), name)
        return rows.join(side("a"), "a").join(side("b"), "b")

    both = joined(pairs if sieved else materialise(joined(pairs, "fine").where(fits("sa", "sb")).select("a", "b")), "found")
    # 100 * shared >= percent * (a + b - shared), with the intersection named once.
    shared, total = F.size(F.array_intersect("sa", "sb")), F.size("sa").cast("long") + F.size("sb")
    return both.where((100 + percent) * shared.cast("long") >= percent * total).select("a", "b")


def _possible(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs that their sketches don't rule out."""
    percent = round(threshold * 100)

    @F.pandas_udf("boolean")
    def fits(x: pd.Series, y: pd.Series) -> pd.Series:
        a = np.frombuffer(b"".join(x), "<u4").reshape(-1, BUCKETS).astype(np.int64)
        b = np.frombuffer(b"".join(y), "<u4").reshape(-1, BUCKETS).astype(np.int64)
        shared = np.minimum(a, b).sum(axis=1)
        return pd.Series(100 * shared >= percent * (a.sum(axis=1) + b.sum(axis=1) - shared))

    side = lambda name: sets.select(F.col("cls").alias(name), F.col("sketch").alias(f"k{name}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").where(fits("ka", "kb")).select("a", "b")


def _links(sets: DataFrame, threshold: float, rounds: int = 3) -> DataFrame:
    """Links (a, b) between distinct sets that connect all sets that similar pairs connect."""
    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for cls, n, found in zip(batch["cls"], batch["n"], batch["found"]):
                sigs = signatures(_hashes(found), threshold)
                yield pd.DataFrame({"sig": sigs.view(np.int64), "cls": cls})

    signed = sets.select("cls", "n", "found").mapInPandas(sign, "sig long, cls long")
    by_sig = Window.partitionBy("sig")
    # Most signatures of a group of sets are shared by the same members; one of them is enough.
    # Should two groups fall under one name, they are only compared more.
    named = signed.select("cls", F.count("*").over(by_sig).alias("c"), F.bit_xor(F.xxhash64("cls")).over(by_sig).alias("sig"))
    shared = named.where("c > 1").select("sig", "cls").distinct()
    members = materialise(shared.join(sets.select("cls", "n"), "cls").select("sig", "cls", "n"))
    label = None
    for k in range(rounds):
        near = _labelled(members, label)
        order = F.struct(F.xxhash64(F.lit(k), "cls").alias("o"), F.col("cls"), F.col("comp"))
        anchor = near.groupBy("sig").agg(F.min(order).alias("anchor"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
        asked = near.join(anchor.where("lo <> hi"), "sig").where(F.col("comp") != F.col("anchor.comp"))
        votes = asked.groupBy(F.col("cls").alias("a"), F.col("anchor.cls").alias("b")).count()
        best = votes.groupBy("a").agg(F.max(F.struct("count", "b")).alias("m")).select("a", F.col("m.b").alias("b"))
        found = materialise(_verified(materialise(_possible(best, sets, threshold)), sets, threshold))
        if found.isEmpty():
            break
        label = _merged(label, found)
    few: int | None = FEW
    while True:
        met = materialise(_meeting(materialise(_labelled(members, label)), sets, threshold, few))
        if met.where("cut").isEmpty():
            break
        first = materialise(_nearest(met))
        found = materialise(_verified(first, sets, threshold, sieved=True))
        # Where few of the nearest link, few of the others do: then all come at once.
        if 20 * found.count() < first.count():
            few = None
        if not found.isEmpty():
            label = _merged(label, found)
    rest = _verified(met.select("a", "b"), sets, threshold, sieved=True)
    if label is None:
        return rest
    tree = label.where("cls <> comp").select(F.col("comp").alias("a"), F.col("cls").alias("b"))
    return tree.unionByName(_contracted(rest, label))


def _blocks(counted: DataFrame) -> int:
    """Blocks of sets, so that a signature has about ``SLICE`` members in a block and two blocks share few enough rows for a task."""
    tried = [8 << i for i in range(14)]
    rows = [F.sum(F.col("all") * F.least("all", F.lit(b))) for b in tried]
    largest, *rows = counted.agg(F.max("all"), *rows).first()
    # A member goes to one task for each block that its signature has members in, at most.
    return next((b for b, n in zip(tried, rows) if b * SLICE >= (largest or 0) and 2 * (n or 0) <= TASK_ROWS * b * b), tried[-1])


def _nearest(met: DataFrame) -> DataFrame:
    """Of pairs (a, b, apart), the nearest one of each set."""
    ends = met.select("a", "b", "apart", F.explode(F.array("a", "b")).alias("of"))
    best = ends.groupBy("of").agg(F.min(F.struct("apart", "a", "b")).alias("m"))
    return best.select("m.a", "m.b").distinct()


def _meeting(near: DataFrame, sets: DataFrame, threshold: float, few: int | None = None) -> DataFrame:
    """Pairs (a, b) of ``near(sig, cls, n, comp)`` in different components that share a signature and whose sketches allow a link.

    ``apart`` is how far their sketches are apart, by their sizes. With ``few``, a task that has more than so many pairs for each set lets
    out only the nearest pair of each of its sets, and says so in ``cut``.

    Of each signature, the members outside its largest component ask all members. Sets are dealt into blocks, and a task
    holds, of every signature, the members in one pair of blocks. So all signatures that two sets share meet in one task, which lets
    the pair out once, if the sketches don't rule it out. A task gets the sketches of a set once, however many signatures it has there.
    """
    percent = round(threshold * 100)
    counted = near.groupBy("sig", "comp").agg(F.count("*").alias("c")).groupBy("sig").agg(
        F.max(F.struct("c", "comp")).alias("major"), F.count("*").alias("comps"), F.sum("c").alias("all")
    ).where("comps > 1").select("sig", F.col("major.comp").alias("major"), "all")
    blocks = _blocks(counted)
    block = F.pmod(F.xxhash64(F.lit("block"), "cls"), F.lit(blocks)).cast("int")
    mixed = near.join(counted.drop("all"), "sig").select(
        "sig", "cls", "n", "comp", (F.col("comp") == F.col("major")).alias("main"), block.alias("block")
    )
    held = mixed.groupBy("sig", "block").agg(F.count("*").alias("all"), F.count_if(~F.col("main")).alias("asking")).groupBy("sig").agg(
        F.collect_list(F.struct("block", "all", "asking")).alias("held")
    )
    # Who asks goes to every block that has someone else, the others to the blocks of those who ask.
    useful = lambda h: F.when(F.col("main"), h["asking"] > 0).otherwise((h["block"] != F.col("block")) | (h["all"] > 1))
    task = lambda h: F.least("block", h["block"]) * F.lit(blocks).cast("long") + F.greatest("block", h["block"])
    dealt = materialise(mixed.join(held, "sig").withColumn("tasks", F.transform(F.filter("held", useful), task)).drop("held"))

    @F.pandas_udf("binary")
    def short(sketches: pd.Series) -> pd.Series:
        # Larger counts become 255, which only brings sketches nearer to each other.
        return sketches.map(lambda s: np.minimum(np.frombuffer(s, "<u4"), 255).astype(np.uint8).tobytes())

    finer = "fine" in sets.columns
    placed = dealt.select(F.explode("tasks").alias("task"), "sig", "cls", "comp", "main")
    known = dealt.select(F.explode("tasks").alias("task"), "cls", "n", "block").distinct().join(
        sets.select("cls", short("sketch").alias("short"), *["fine"] * finer), "cls"
    )
    # New names, as both sides come from one table.
    known = known.toDF(*known.columns)

    def meet(rows: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        known = known.sort_values("cls")
        cls, n, block = (known[c].to_numpy() for c in ("cls", "n", "block"))
        # Askers come first in a signature; who is in the largest component does not ask.
        rows = rows.sort_values(["sig", "main"])
        sig, comp, at = rows["sig"].to_numpy(), rows["comp"].to_numpy(), np.searchsorted(cls, rows["cls"].to_numpy())
        one_block = bool((block == block[:1]).all())
        asking, step = np.flatnonzero(~rows["main"].to_numpy()), 0
        codes, waiting = [np.empty(0, np.int64)], 0
        while asking.size:
            step += 1
            asking = asking[asking + step < len(sig)]
            asking = asking[sig[asking] == sig[asking + step]]
            x, y = at[asking], at[asking + step]
            fit = (comp[asking] != comp[asking + step]) & (100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y]))
            if not one_block:
                fit &= block[x] != block[y]
            codes.append(np.minimum(x[fit], y[fit]) * len(cls) + np.maximum(x[fit], y[fit]))
            waiting += len(codes[-1])
            if waiting > TASK_ROWS:
                codes, waiting = [np.unique(np.concatenate(codes))], 0
        codes = np.unique(np.concatenate(codes))
        marks = np.frombuffer(b"".join(known["short"]), np.uint8).reshape(-1, BUCKETS).astype(np.int16)
        fine = known["fine"].to_list() if finer else None
        out, gaps = [np.empty((0, 2), np.int64)], [np.empty(0)]
        for start in range(0, len(codes), 16384):
            x, y = np.divmod(codes[start : start + 16384], len(cls))
            apart = np.abs(marks[x] - marks[y]).sum(axis=1, dtype=np.int64)
            close = (100 + percent) * apart <= (100 - percent) * (n[x] + n[y])
            if fine is not None:
                close[close] = [_may_link(fine[i], fine[j], percent) for i, j in zip(x[close].tolist(), y[close].tolist())]
            out.append(np.stack([x[close], y[close]], axis=1))
            gaps.append(apart[close] / (n[x[close]] + n[y[close]]))
        pairs, gap = np.concatenate(out), np.concatenate(gaps)
        cut = few is not None and len(pairs) > few * len(cls)
        if cut:
            order = np.argsort(gap, kind="stable")
            firsts = [order[np.unique(pairs[order, side], return_index=True)[1]] for side in (0, 1)]
            kept = np.unique(np.concatenate(firsts))
            pairs, gap = pairs[kept], gap[kept]
        return pd.DataFrame({"a": cls[pairs[:, 0]], "b": cls[pairs[:, 1]], "apart": gap, "cut": cut})

    return placed.groupBy("task").cogroup(known.groupBy("task")).applyInPandas(meet, "a long, b long, apart double, cut boolean")


def _contracted(links: DataFrame, label: DataFrame) -> DataFrame:
    """One link between any two components that ``links`` connect; many links of two groups are one."""
    to = lambda name: label.select(F.col("cls").alias(name), F.col("comp").alias(f"_{name}"))
    moved = links.join(to("a"), "a", "left").join(to("b"), "b", "left").select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"))
    return moved.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _merged(label: DataFrame | None, links: DataFrame) -> DataFrame:
    """cls and comp, its smallest set, of all sets with a link: ``label`` after more ``links``, of which only those between its components count."""
    up = components(links if label is None else _contracted(links, label))
    if label is None:
        return up.select(F.col("id").alias("cls"), F.col("component_id").alias("comp"))
    new = up.select(F.col("id").alias("cls"), F.col("id").alias("comp")).join(label, "cls", "left_anti")
    moved = label.unionByName(new).join(up.withColumnRenamed("id", "comp"), "comp", "left")
    return materialise(moved.select("cls", F.coalesce("component_id", "comp").alias("comp")))


def _labelled(members: DataFrame, label: DataFrame | None) -> DataFrame:
    if label is None:
        return members.withColumn("comp", F.col("cls"))
    return members.join(label.withColumnRenamed("comp", "_comp"), "cls", "left").select("sig", "cls", "n", F.coalesce("_comp", "cls").alias("comp"))


def _shared(rows: DataFrame, size: int, threshold: float, items: Column) -> DataFrame:
    """doc_id and n of every row, and whether it is ``able`` to share enough shingles with another row.

    ``items`` bounds the shingles of a row. Exact: what occurs in no other row cannot be shared.
    """
    total = int(rows.agg(F.sum(items)).first()[0] or 0) + 1
    range_bits = max(4, (total // 1_000_000).bit_length())
    value_bits = max(12, total.bit_length() + 5 - range_bits)
    enough = 100 * (F.col("n") - F.col("alone")) >= round(threshold * 100) * F.col("n")
    with written(_profile(rows, size, range_bits, value_bits)) as profile:
        alone = profile.where(F.col("range").isNotNull()).select("block", "range", "blob").groupBy("range").applyInPandas(
            _alone, "block long, counts binary"
        ).groupBy("block").applyInPandas(_summed, "block long, place long, alone long")
        own = profile.where(F.col("range").isNull()).select("doc_id", "n", "block", "place").join(alone, ["block", "place"], "left")
        return materialise(own.select("doc_id", "n", F.coalesce((F.col("n") > 0) & enough, F.lit(False)).alias("able")))


def _maybe(rows: DataFrame, ids: DataFrame, name: str, bits: int = 24) -> DataFrame:
    """Rows whose ``name`` is listed, and a few others. A bitmap of fixed size keeps most others out of the shuffle of a join that follows."""
    place = F.pmod(F.xxhash64(name), F.lit(1 << bits)) + 1  # bitmaps count from one
    bucket, at = F.bitmap_bucket_number(place), F.bitmap_bit_position(place)
    maps = ids.groupBy(bucket.alias("_bucket")).agg(F.bitmap_construct_agg(at).alias("_map"))
    byte = F.conv(F.hex(F.substring("_map", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    # At most 2 ** (bits - 15) + 1 rows of 4 kB, whatever the input.
    listed = rows.join(F.broadcast(maps), bucket == F.col("_bucket")).where(F.getbit(byte, (at % 8).cast("int")) == 1)
    return listed.select(*rows.columns)


def _only(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose doc_id is listed; ``ids`` lists each once."""
    # A left semi join would be moved below the bitmap, and all texts shuffled for it.
    return _maybe(rows, ids, "doc_id").join(ids, "doc_id")


def near_duplicates(docs: DataFrame, size: int = 5, threshold: float = 0.75) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs`` (doc_id, text; extra columns are ignored).

    Words are runs of anything but the six ASCII blanks, A-Z in lower case. A text of
    fewer than ``size`` words is one shingle; without words, or null, it has none and links with
    nothing. Rows of one doc_id with different texts are one node. A null doc_id links
    with nothing and has a null component. Every link between different texts counts.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    own = _shared(rows, size, threshold, F.octet_length("text") / 4)
    able = materialise(own.where(F.col("able") & F.col("doc_id").isNotNull()).select("doc_id").distinct())
    key = ["n", "d1", "d2"]
    with written(_sets(_only(rows, able), size).where("n > 0")) as found:
        one = found.groupBy(*key).agg(F.min(F.struct("doc_id", "sketch", "fine", "found")).alias("m"))
        one = one.select(F.col("m.doc_id").alias("cls"), *key, "m.sketch", "m.fine", "m.found")
        with written(one) as sets:
            # A join, so that a large group of copies can be split.
            same = found.select("doc_id", *key).join(sets.select(*key, "cls"), key).where("doc_id <> cls")
            same = materialise(same.select(F.col("cls").alias("a"), F.col("doc_id").alias("b")))
            # Exact copies kept each other above; among distinct sets the same test is sharper.
            apart = _shared(sets.select(F.col("cls").alias("doc_id"), "found"), size, threshold, F.size("found"))
            apart = apart.where("able").select(F.col("doc_id").alias("cls"))
            close = materialise(sets.join(apart, "cls", "left_semi").select("cls", "n", "sketch", "fine", "found"))
    links = _links(close, threshold).unionByName(same)
    label = components(links).withColumnRenamed("id", "doc_id")
    return own.join(label, "doc_id", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")
    )


def keep_first(docs: DataFrame, size: int = 5, threshold: float = 0.75) -> DataFrame:
    """One document of each group, the one with the smallest doc_id; columns unchanged.

    Rows that repeat a doc_id stay together; rows without an id stay.
    """
    label = near_duplicates(docs, size, threshold)
    # Only what goes is listed, so a plan may send the short list to the documents.
    name = fresh(docs, "_gone")
    gone = label.where(F.col("component_id") != F.col("doc_id")).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, docs["doc_id"] == F.col(name), "left_anti")
