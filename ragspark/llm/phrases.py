"""Phrase collocations by sampled mining with a checked border.

Texts become chunks of word numbers once. A sample of the documents proposes phrases: those that
occur in it often enough, found level by level, a phrase being looked for only if both phrases one word shorter
were found. One pass over all documents then counts the proposed phrases and their negative border, that is every
phrase whose two shorter phrases were proposed, proposed itself or not. Where a phrase of the
border proves frequent, longer phrases may have been missed; it joins the proposed ones, and another
pass counts what that newly admits, until no such phrase is left.

Those passes count hashes: a sum that phrases share is never too small, so none is missed. The last pass
counts the phrases whose hashes were frequent by their text, which is exact, whatever the sample was. Proposed
phrases reach the tasks as a bitmap of hashes of fixed size; a bit that two phrases share only makes tasks count more.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from contextlib import ExitStack
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ragspark.session import materialise, written

#: ASCII capitals to small letters, characters that end a piece to a full stop.
PLAIN = bytes.maketrans(bytes(range(65, 91)) + b".,;:!?\n\x0b\x0c\r", bytes(range(97, 123)) + b"." * 10)
EDGE = re.compile(rb"[. \t]")
#: Tokens counted together, and bytes of a text split at once.
CHUNK, SEGMENT = 1 << 18, 1 << 20
#: Tokens of the last chunk that a phrase may begin with.
LOOK_BACK = 15
#: Leading bits of a hash that sums are kept by: few to shuffle, many against the number of phrases.
SUMMED = 40
#: Hashes a task holds before it counts them, and rows of a batch it hands on.
HELD, PORTION = 1 << 21, 1 << 15
#: Chunks of a row group: those that Spark holds decoded in a task, and in the task that writes them.
GROUPED = 8
#: Splits that a task of the last pass reads, where there are more than cores.
GATHERED = 8


def _tokens(text: bytes) -> Iterator[list[bytes]]:
    """Words of a text in order, with a full stop at each end of a piece; long texts in several lists."""
    plain = text.translate(PLAIN)
    at = 0
    while at < len(plain):
        cut = EDGE.search(plain, at + SEGMENT) if len(plain) - at > SEGMENT else None
        end = cut.start() if cut else len(plain)
        yield plain[at:end].replace(b".", b" . ").split()
        at = end
    yield [b"."]


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _test(bits: np.ndarray | None, h: np.ndarray) -> np.ndarray:
    """Whether the bit of each hash is set; always where there is no bitmap yet."""
    if bits is None:
        return np.ones(len(h), bool)
    place = h >> np.uint64(64 - (len(bits) * 8).bit_length() + 1)
    return (bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _keys(ids: np.ndarray, ends: np.ndarray, size: int, words: int) -> np.ndarray:
    """A number for the phrase of ``size`` words that ends at each place, equal just for equal phrases."""
    key = ids[ends - size + 1]
    for back in range(size - 2, -1, -1):
        if back < size - 2:
            key = np.unique(key, return_inverse=True)[1]
        key = key * words + ids[ends - back]
    return key


def tokenise(docs: DataFrame) -> DataFrame:
    """Chunks of the texts of ``docs`` (lang, text, sample): lang, sample, skip, ids (16-bit numbers, 32-bit ones if there are more words), words (joined by blanks).

    Number 0 ends a piece. The first ``skip`` tokens stood at the end of another chunk: phrases may begin, but not end there.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[bytes]] = {}
        over: dict[tuple, int] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for key in list(held):
                tokens = held.pop(key)
                # Its numbers come from a counter: with its own length it would wait for the collector of cycles, which bytes never wake.
                number: defaultdict[bytes, int] = defaultdict(count().__next__)
                number[b"."]
                ids = np.fromiter(map(number.__getitem__, tokens), np.int32, len(tokens))
                yield pa.RecordBatch.from_pydict({
                    "lang": [key[0]], "sample": [key[1]], "skip": pa.array([over.pop(key, 0)], pa.int32()), "ids": [(ids if len(number) > 65535 else ids.astype(np.uint16)).tobytes()],
                    "words": [b" ".join(number)],
                })
                if tokens[-1] != b".":
                    held[key] = tokens[-LOOK_BACK:]
                    over[key] = len(held[key])

        size = 0
        for batch in batches:
            columns = batch.column("lang").to_pylist(), batch.column("sample").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()
            for lang, sample, value in zip(*columns):
                for tokens in _tokens(value):
                    held.setdefault((lang, sample), []).extend(tokens)
                    size += len(tokens)
                    if size >= CHUNK:
                        yield from flush()
                        size = 0
        yield from flush()

    return docs.select("lang", "sample", "text").mapInArrow(run, "lang string, sample boolean, skip int, ids binary, words binary")


class _Chunk:
    """One chunk: the phrases at its places, level by level."""

    def __init__(self, row: dict):
        self.names, self.skip = row["words"].split(b" "), row["skip"]
        self.ids = np.frombuffer(row["ids"], np.int32 if len(self.names) > 65535 else np.uint16).astype(np.int64)
        seed = xxhash.xxh3_64_intdigest(row["lang"])
        self.h1 = np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in self.names), np.uint64, len(self.names))

    def levels(self, high: int, now, before=None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(words, end places, hashes, admitted by ``now``, known) of the phrases both whose shorter phrases ``now`` admits.

        ``known``: ``before`` admitted both already.
        """
        ids, h1 = self.ids, self.h1
        real = ids > 0
        ends = np.flatnonzero(real)
        h = h1[ids]
        ok = _test(now, h1)[ids] & real
        was = _test(before, h1)[ids] & real if before is not None else np.zeros(len(ids), bool)
        yield 1, ends, h[ends], ok[ends], np.full(len(ends), before is not None)
        for k in range(2, high + 1):
            ends = np.flatnonzero(ok[:-1] & ok[1:]) + 1
            if not len(ends):
                return
            known = was[ends - 1] & was[ends]
            hk = _mix(h[ends - 1], h1[ids[ends]])
            hit = _test(now, hk)
            yield k, ends, hk, hit, known
            ok, was, h = np.zeros(len(ids), bool), np.zeros(len(ids), bool), np.zeros(len(ids), np.uint64)
            ok[ends], h[ends] = hit, hk
            if before is not None:
                was[ends] = known & _test(before, hk)

    def phrases(self, ends: np.ndarray, k: int) -> tuple[pa.Array, np.ndarray]:
        """Distinct phrases of ``k`` words that end at the places, and their counts."""
        names = pa.array(self.names, pa.binary())
        _, first, times = np.unique(_keys(self.ids, ends, k, len(self.names)), return_index=True, return_counts=True)
        parts = [names.take(pa.array(self.ids[ends[first] - back])) for back in range(k - 1, -1, -1)]
        return pc.binary_join_element_wise(*parts, b" ") if k > 1 else parts[0], times


def sums(chunks: DataFrame, low: int, high: int, least: int, top: int, now=None, before=None) -> DataFrame:
    """Hashes (first ``SUMMED`` bits) of phrases of ``low`` to ``high`` words with a sum of ``least`` or more: h, last (has ``top`` words).

    Phrases count if ``now`` admits both their shorter phrases and ``before`` did not.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Filled, sorted and read out in place, so that a task holds the hashes once.
        held, n = np.empty(HELD, np.uint64), 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal n
            part, n = held[:n], 0
            part.sort()
            new = np.ones(len(part), bool)
            np.not_equal(part[1:], part[:-1], out=new[1:])
            first = np.flatnonzero(new)
            for at in range(0, len(first), PORTION):
                some = first[at : at + PORTION + 1]
                f = np.diff(some if len(some) > PORTION else np.append(some, len(part)))
                yield pa.RecordBatch.from_pydict({"h": part[some[: len(f)]].view(np.int64), "f": f.astype(np.int64)})

        for batch in batches:
            for row in batch.to_pylist():
                chunk = _Chunk(row)
                for k, ends, h, _, known in chunk.levels(high, now, before):
                    if k >= low:
                        more = h[(ends >= chunk.skip) & ~known] >> np.uint64(64 - SUMMED) << np.uint64(1) | np.uint64(k == top)
                        while len(more):
                            part, more = more[: HELD - n], more[HELD - n :]
                            held[n : n + len(part)] = part
                            n += len(part)
                            if n == HELD:
                                yield from flush()
        yield from flush()

    counted = chunks.mapInArrow(run, "h long, f long").groupBy("h").agg(F.sum("f").alias("f"))
    return counted.where(F.col("f") >= least).select(F.shiftright("h", 1).alias("h"), (F.col("h") % 2 == 1).alias("last"))


def counts(chunks: DataFrame, longest: int, known: np.ndarray) -> DataFrame:
    """Exact counts by text of the phrases that the bitmap ``known`` admits: lang, k, phrase, f; k = 0: all words of a language."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                chunk = _Chunk(row)
                for k, ends, _, hit, _ in chunk.levels(longest, known):
                    new = ends >= chunk.skip
                    found = [(0, pa.array([b""], pa.binary()), np.array([new.sum()]))] if k == 1 else []
                    if (new & hit).any():
                        found.append((k, *chunk.phrases(ends[new & hit], k)))
                    for size, phrase, times in found:
                        yield pa.RecordBatch.from_pydict({
                            "lang": pa.repeat(row["lang"], len(phrase)), "k": np.full(len(phrase), size, np.int32),
                            "phrase": phrase.cast(pa.string()), "f": times.astype(np.int64),
                        })

    # Tasks of several splits: more copies of a phrase merge before they are shuffled.
    tasks = max(chunks.sparkSession.sparkContext.defaultParallelism, chunks.rdd.getNumPartitions() // GATHERED)
    counted = chunks.coalesce(tasks).mapInArrow(run, "lang string, k int, phrase string, f long")
    return counted.groupBy("lang", "k", "phrase").agg(F.sum("f").alias("f"))


def bitmap(hashes: DataFrame, bits: int) -> np.ndarray:
    """The 2^bits bits of the hashes ``h``; merged by Spark, so that the driver gets its fixed size only."""
    place = F.shiftright("h", SUMMED - bits) + 1
    rows = hashes.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("b")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("m")
    )
    out = np.zeros(2**bits // 8, np.uint8)
    for r in rows.collect():
        part = np.frombuffer(bytes(r.m), np.uint8)
        start = (r.b - 1) * len(part)
        out[start : start + len(part)] = part[: len(out) - start]
    return out


def propose(sample: DataFrame, least: int, longest: int, bits: int) -> np.ndarray:
    """Bitmap of the phrases of fewer than ``longest`` words that the sample holds ``least`` times, level by level."""
    found = None
    for k in range(1, longest):
        new = bitmap(sums(sample, k, k, least, longest, found), bits)
        found = new if found is None else found | new
    return found


def frequent(docs: DataFrame, least: int, longest: int, fraction: float, bits: int, stack: ExitStack) -> DataFrame:
    """lang, k, phrase, f of all phrases of 1 to ``longest`` words that a language has ``least`` times or more; k = 0: its words."""
    share = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < int(fraction * (1 << 20))
    chunked = tokenise(docs.select("lang", "text", share.alias("sample")))
    # Readers decode a row group at once, however large the file: its rows are bounded, as each is a whole chunk.
    with written(chunked, **{"parquet.block.row.count.limit": GROUPED}) as chunks:
        # Not lowered: what this misses costs a pass, as phrases near the limit do in any case; lower limits widen the border.
        now = propose(chunks.where("sample"), max(2, round(least * fraction)), longest, bits)
        before, known = None, np.zeros_like(now)
        while True:
            with written(sums(chunks, 1 if before is None else 2, longest, least, longest, now, before)) as found:
                shorter, longer = bitmap(found.where(~F.col("last")), bits), bitmap(found.where("last"), bits)
            known |= shorter | longer
            if not (shorter & ~now).any():
                break
            before, now = now, now | shorter
        exact = counts(chunks, longest, known)
        return stack.enter_context(written(exact.where((F.col("f") >= least) | (F.col("k") == 0))))


def collocations(
    docs: DataFrame, least: int = 30, longest: int = 4, top: int = 2000, cover: int = 80, fraction: float = 0.1, bits: int = 26
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of each language in ``docs`` (doc_id, text, lang).

    Texts are split at ``.,;:!?`` and line ends into pieces, pieces at blanks into words; ASCII capitals become small
    letters. A phrase is a run of 2 to ``longest`` words within a piece with f = a of at least ``least``. The cut of lowest
    floor(2000000 a / (l + r)), of equal ones the first, gives l and r. Phrases inside a longer one with
    at least ``cover`` per cent of their count are dropped. Order: score and a falling, phrase rising by bytes.

    Null text counts as empty, null lang as ``und``; repeated rows count each time; extra columns are ignored.
    An empty table gives no rows. ``longest`` is 16 at most. ``fraction`` and ``bits`` (a bitmap of 2^bits bits in each task) change the time, never the result.
    """
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    with ExitStack() as stack:
        known = frequent(rows, least, longest, fraction, bits, stack)
        phrases = known.where(F.col("k") > 0).select("lang", "phrase", "f")
        long = known.where(F.col("k") > 1).select("lang", "k", "phrase", F.col("f").alias("a")).withColumn("w", F.split("phrase", " "))
        part = lambda start, size: F.array_join(F.slice("w", start, size), " ")
        cut = long.select("*", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut")).select(
            "lang", "k", "phrase", "a", "cut", part(F.lit(1), F.col("cut")).alias("first"), part(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("rest")
        )
        side = lambda name, f: phrases.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
        sized = cut.join(side("first", "l"), ["lang", "first"]).join(side("rest", "r"), ["lang", "rest"])
        score = F.expr("CAST(2000000 AS DECIMAL(18, 0)) * CAST(a AS DECIMAL(19, 0)) DIV (CAST(l AS DECIMAL(19, 0)) + CAST(r AS DECIMAL(19, 0)))")
        best = sized.groupBy("lang", "phrase", "k", "a").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("m"))
        # Every run of words inside a longer phrase, with the largest count of such a phrase.
        inner = long.where(F.col("k") > 2).select("lang", "w", "k", "a", F.explode(F.sequence(F.lit(2), F.col("k") - 1)).alias("size")).select(
            "lang", "w", "a", "size", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("size") + 1)).alias("at")
        )
        covered = inner.select("lang", part(F.col("at"), F.col("size")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("more"))
        exact = lambda c: F.col(c).cast("decimal(19,0)")
        left = best.join(covered, ["lang", "phrase"], "left").where(
            F.col("more").isNull() | (exact("more") * 100 < exact("a") * F.lit(cover))
        ).select("lang", "phrase", "a", "m.l", "m.r", F.col("m.score").cast("long").alias("score"))
        order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
        ranked = left.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        total = known.where(F.col("k") == 0).select("lang", F.col("f").alias("n"))
        return materialise(ranked.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"))
