"""SentencePiece merges with seeded dropout.

The merges of a public model run over an agenda of neighbouring pairs, best score
first. Each candidate of each occurrence of a word is skipped at the dropout rate by its own
draw, a keyed hash of seed, document, place of the occurrence and number of the draw. So
segmentations vary from occurrence to occurrence, yet every run, partitioning and retry gives
the same ids. Pieces of any segmentation spell the text, so decoding is lossless.
"""

from __future__ import annotations

import heapq
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragspark.llm.common import worker_state

SPACE = "▁"
#: Symbol of a space mark that stands in the text; every other symbol is one character or a piece.
_LITERAL = SPACE + "\0"
#: A word with the blanks before it: no piece goes on after a blank that follows something else.
_UNITS = re.compile(" *[^ ]+| +")
_NEVER = float("inf")
#: Candidates up to the next skip that one draw can tell; a draw past them is followed by another one.
_FAR = 256
#: Longest units that merge together, and how many do at once.
_WIDE, _TOGETHER = 32, 4096
#: Characters of the texts whose words are held at once, but for one text.
_CHARS = 1_000_000
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def thresholds(rate: float) -> np.ndarray:
    """Chance, in units of 2**-53, that at most 0, 1, ... candidates merge before the next skip."""
    stay, out = 1.0, []
    for _ in range(_FAR):
        stay *= 1.0 - rate
        out.append(int((1.0 - stay) * 2**53))
    return np.array(out, np.uint64)


def keys_of(seed: int, docs: list) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(f"{seed}/{d}") for d in docs], np.uint64)


def gaps(keys: np.ndarray, places: np.ndarray, turn: int, table: np.ndarray) -> np.ndarray:
    """How many candidates merge before the next skip, by draw number ``turn`` of the occurrences at ``places``."""
    x = keys + (places.astype(np.uint64) + np.uint64(turn << 40)) * _STEP
    x = (x ^ x >> np.uint64(30)) * _MIX[0]
    x = (x ^ x >> np.uint64(27)) * _MIX[1]
    return np.searchsorted(table, (x ^ x >> np.uint64(31)) >> np.uint64(11), "right")


class Merger:
    """A model file's pieces, and encoding of one unit."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        # Units bring their own blank: in the model, which is a protocol buffer, a later
        # add_dummy_prefix of the normaliser takes the place of the first.
        with open(path, "rb") as file:
            self.plain = model = SentencePieceProcessor(model_proto=file.read() + b"\x1a\x02\x18\x00")
        size = model.get_piece_size()
        plain = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        #: Piece -> (cost, id): the lowest cost merges first.
        self.merges = {model.id_to_piece(i): (-model.get_score(i), i) for i in plain}
        self.costs = {piece: cost for piece, (cost, _) in self.merges.items()}
        self.pieces = [model.id_to_piece(i) for i in range(size)]
        self.bytes = {int(model.id_to_piece(i)[3:5], 16): i for i in range(size) if model.is_byte(i)}
        self.byte_ids = frozenset(self.bytes.values())
        self.spelled = [b""] * size
        for piece, (_, i) in self.merges.items():
            self.spelled[i] = piece.replace(SPACE, " ").encode()
        for value, i in self.bytes.items():
            self.spelled[i] = bytes([value])
        # Pairs of pieces that make a piece, as sorted numbers; the last one is never reached.
        self._size = size
        pairs = sorted(
            (self.merges[w[:j]][1] * size + self.merges[w[j:]][1], i)
            for w, (_, i) in self.merges.items() for j in range(1, len(w)) if w[:j] in self.merges and w[j:] in self.merges
        )
        self._pairs = np.array([k for k, _ in pairs] + [np.iinfo(np.int64).max], np.int64)
        self._made = np.array([i for _, i in pairs] + [size], np.int64)
        self._cost_of = np.full(size + 1, _NEVER)
        for cost, i in self.merges.values():
            self._cost_of[i] = cost
        #: Code point -> its piece, or -2 - code point, which never merges; -1 if it is a part of a piece only.
        self._piece_of = -2 - np.arange(0x110000)
        self._piece_of[[ord(c) for c in set("".join(self.merges))]] = -1
        for piece, (_, i) in self.merges.items():
            if len(piece) == 1:
                self._piece_of[ord(piece)] = i
        # Blanks become the model's space mark, a literal mark is spelled in bytes.
        self._piece_of[ord(" ")], self._piece_of[ord(SPACE)] = self._piece_of[ord(SPACE)], -2 - ord(SPACE)
        self._is_byte = np.zeros(size, bool)
        self._is_byte[list(self.byte_ids)] = True
        self.units = Units(self)

    def unit(self, word: str, skips: Iterator[int]) -> tuple[bytes, int]:
        """Ids of one unit, and how many candidates merged after the last skip.

        ``skips`` tells how many merge before each skip. Blanks become the model's space
        mark, a literal mark in the text is spelled in bytes.
        """
        symbols = [_LITERAL if c == SPACE else c for c in word] if SPACE in word else list(word)
        if " " in word:
            symbols = [SPACE if c == " " else c for c in symbols]
        symbols, done = (self._merge_short if len(symbols) <= 64 else self._merge_long)(symbols, skips)
        out: list[int] = []
        for s in symbols:
            known = self.merges.get(s)
            if known is not None:
                out.append(known[1])
            else:
                out += [self.bytes[b] for b in (SPACE if s == _LITERAL else s).encode()]
        return struct.pack(f"<{len(out)}I", *out), done

    def unskipped(self, words: list[str]) -> Iterator[tuple[bytes, int]]:
        """As ``unit`` without skips, for many units."""
        return zip(*self.all_unskipped(words))

    def skipping(self, words: list[str], skips: list[list[int]]) -> list[tuple[bytes, int]]:
        """As ``unit`` for many units, each with its list of skips."""
        return list(zip(*self.all_skipping(words, skips)))

    def all_unskipped(self, words: list[str]) -> tuple[list[bytes], list[int]]:
        """The two columns of ``unskipped``, by the model itself where each merge takes one symbol away."""
        found = self.plain.encode(words, num_threads=1)
        sizes = np.fromiter(map(len, found), np.int64, len(words))
        flat = np.fromiter(chain.from_iterable(found), np.int64, int(sizes.sum()))
        ends = np.cumsum(sizes)
        spelled = np.concatenate([[0], np.cumsum(self._is_byte[flat])])
        odd = (spelled[ends] > spelled[ends - sizes]) | np.fromiter((SPACE in w for w in words), bool, len(words))
        raw = flat.astype("<u4").tobytes()
        ids = [raw[lo:hi] for lo, hi in zip((4 * (ends - sizes)).tolist(), (4 * ends).tolist())]
        done = (np.fromiter(map(len, words), np.int64, len(words)) - sizes).tolist()
        apart = np.flatnonzero(odd).tolist()
        for i, x, d in zip(apart, *self.all_skipping([words[i] for i in apart], [[]] * len(apart))):
            ids[i], done[i] = x, d
        return ids, done

    def all_skipping(self, words: list[str], skips: list[list[int]]) -> tuple[list[bytes], list[int]]:
        """The two columns of ``skipping``, merged together."""
        out, after = [b""] * len(words), [0] * len(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        pieces = self._piece_of[np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")]
        starts = np.cumsum(sizes) - sizes
        apart = (sizes > _WIDE) | np.logical_or.reduceat(pieces == -1, starts) if len(words) else np.empty(0, bool)
        for i in np.flatnonzero(apart).tolist():
            out[i], after[i] = self.unit(words[i], iter(skips[i]))
        order = np.flatnonzero(~apart)
        order = order[np.argsort(sizes[order], kind="stable")]
        for at in range(0, len(order), _TOGETHER):
            some = order[at : at + _TOGETHER]
            column = np.arange(int(sizes[some[-1]]) + 1)
            inside = column < sizes[some][:, None]
            symbols = np.where(inside, pieces[np.minimum(starts[some][:, None] + column, len(pieces) - 1)], -1)
            own = [skips[i] for i in some.tolist()]
            counts = np.fromiter(map(len, own), np.int64, len(own))
            gaps_of = np.full((len(own), int(counts.max()) + 1), -1)
            gaps_of[np.arange(gaps_of.shape[1]) < counts[:, None]] = np.fromiter(chain.from_iterable(own), np.int64, int(counts.sum()))
            ids, done = self._merge_together(symbols, gaps_of)
            ends = np.cumsum((ids != -1).sum(axis=1))
            odd = (ids < -1).any(axis=1)
            ids = ids[ids != -1]
            raw, start = ids.astype("<u4").tobytes(), 0
            for i, end, d, apart in zip(some.tolist(), ends.tolist(), done.tolist(), odd.tolist()):
                out[i], after[i] = self._spelled_out(ids[start:end].tolist()) if apart else raw[4 * start : 4 * end], d
                start = end
        return out, after

    def _spelled_out(self, ids: list[int]) -> bytes:
        """Ids with the bytes of characters that have no piece."""
        out: list[int] = []
        for i in ids:
            out += [i] if i >= 0 else [self.bytes[b] for b in chr(-2 - i).encode()]
        return struct.pack(f"<{len(out)}I", *out)

    def _joined(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The piece that two neighbours make, or one that costs too much where they make none or one is missing (-1)."""
        key = np.where((a < 0) | (b < 0), -1, a * self._size + b)
        at = np.searchsorted(self._pairs, key)
        return np.where(self._pairs[at] == key, self._made[at], self._size)

    def _merge_together(self, symbols: np.ndarray, gaps_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The merges of ``_merge_short`` on rows of pieces: rows with -1 where a symbol went, and merges after the last skip.

        Rows are padded by -1, and end with it. A symbol stays where its first character was, so the leftmost of equal costs is the same.
        """
        rows, width = symbols.shape
        made = np.full(symbols.shape, self._size)
        made[:, :-1] = self._joined(symbols[:, :-1], symbols[:, 1:])
        costs = self._cost_of[made]
        after, before = (np.tile(np.arange(width) + k, (rows, 1)).ravel() for k in (1, -1))
        flat, made, cost = symbols.ravel(), made.ravel(), costs.ravel()
        gap_of, most = gaps_of.ravel(), gaps_of.shape[1]
        row, done, turn = np.arange(rows), np.zeros(rows, np.int64), np.zeros(rows, np.int64)
        while row.size:
            at = row * width + costs[row].argmin(axis=1)
            going = cost[at] != _NEVER
            row, at = row[going], at[going]
            skip = done[row] == gap_of[row * most + turn[row]]
            cost[at[skip]] = _NEVER
            turn[row[skip]] += 1
            done[row] += 1
            done[row[skip]] = 0
            at = at[~skip]
            base = row[~skip] * width
            gone, merged = base + after[at], made[at]
            flat[at], flat[gone], cost[gone] = merged, -1, _NEVER
            end = after[gone]
            after[at], before[base + end] = end, at - base
            made[at] = self._joined(merged, flat[base + end])
            cost[at] = self._cost_of[made[at]]
            some = before[at] >= 0
            left = base[some] + before[at[some]]
            made[left] = self._joined(flat[left], merged[some])
            cost[left] = self._cost_of[made[left]]
        return symbols, done

    def _merge_short(self, symbols: list[str], skips: Iterator[int]) -> tuple[list[str], int]:
        """Merge by looking through all costs each time, which is faster for few symbols than an agenda."""
        cost = self.costs.get
        costs = [cost(a + b, _NEVER) for a, b in zip(symbols, symbols[1:])]
        done, gap = 0, next(skips, -1)
        while costs and (least := min(costs)) != _NEVER:
            i = costs.index(least)
            if done == gap:
                done, gap = 0, next(skips, -1)
                costs[i] = _NEVER
                continue
            done += 1
            del costs[i]
            merged = symbols[i] = symbols[i] + symbols.pop(i + 1)
            if i:
                costs[i - 1] = cost(symbols[i - 1] + merged, _NEVER)
            if i < len(costs):
                costs[i] = cost(merged + symbols[i + 1], _NEVER)
        return symbols, done

    def _merge_long(self, symbols: list[str | None], skips: Iterator[int]) -> tuple[list[str], int]:
        """The same merges in the same order by an agenda."""
        merges, size = self.merges, len(symbols)
        agenda = []
        for i in range(size - 1):
            known = merges.get(symbols[i] + symbols[i + 1])
            if known is not None:
                agenda.append((known[0], i, known[1], i + 1))
        heapq.heapify(agenda)
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        spelled = self.pieces
        done, gap = 0, next(skips, -1)
        while agenda:
            _, left, piece, right = heapq.heappop(agenda)
            a, b = symbols[left], symbols[right]
            if a is None or b is None or after[left] != right or a + b != spelled[piece]:
                continue
            if done == gap:
                done, gap = 0, next(skips, -1)
                continue
            done += 1
            merged = symbols[left] = spelled[piece]
            symbols[right] = None
            after[left] = end = after[right]
            if end < size:
                before[end] = left
                known = merges.get(merged + symbols[end])
                if known is not None:
                    heapq.heappush(agenda, (known[0], left, known[1], end))
            start = before[left]
            if start >= 0:
                known = merges.get(symbols[start] + merged)
                if known is not None:
                    heapq.heappush(agenda, (known[0], start, known[1], left))
        return [s for s in symbols if s is not None], done

    def encode(self, text: str, seed: int, doc: object, rate: float) -> bytes:
        """Ids of a whole text (little-endian 32 bits); the model's leading blank is added."""
        return self.encode_all([text], seed, [doc], rate)[0]

    def encode_all(self, texts: list[str | None], seed: int, docs: list, rate: float) -> list[bytes]:
        """Ids of each text, drawn by seed, document and place in the text."""
        split = [_UNITS.findall(" " + t) if t else [] for t in texts]
        sizes = np.array([len(x) for x in split], np.int64)
        ends = np.cumsum(sizes)
        words = [w for x in split for w in x]
        keys = np.repeat(keys_of(seed, docs), sizes)
        places = np.arange(len(words)) - np.repeat(ends - sizes, sizes)
        parts = self.units.ids(words, keys, places, thresholds(rate))
        return [b"".join(parts[end - n : end]) for n, end in zip(sizes.tolist(), ends.tolist())]

    def decode(self, ids: bytes) -> str:
        """The text of the ids of any segmentation."""
        raw = b"".join(map(self.spelled.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return raw.decode()[1:] if raw else ""


class Units(dict):
    """Unit -> number of the node of its ids without skips, of bounded size; a full one keeps what it has.

    A node is a unit and the places of its skips, from which its ids follow, whatever the
    draws; ``skipped`` leads from a node and one more skip to the next node. So draws are never
    shared between occurrences, only the merging of equal ones is.
    """

    def __init__(self, model: Merger, most: int = 400_000, longest: int = 64):
        super().__init__()
        self._model, self._most, self._longest = model, most, longest
        self._skipped: dict[int, int] = {}
        # Node 0 stands for units that are too long to keep.
        self._made: list[str | int] = [""]
        self._ids: list[bytes] = [b""]
        self._after = np.zeros(1024, np.int64)

    def _add(self, made: list, ids: list[bytes], after: list[int]) -> range:
        """Numbers of new nodes."""
        first = len(self._ids)
        self._made += made
        self._ids += ids
        if len(self._ids) > len(self._after):
            self._after = np.concatenate([self._after, np.zeros(len(self._ids), np.int64)])
        self._after[first : len(self._ids)] = after
        return range(first, len(self._ids))

    def _skip(self, nodes: np.ndarray, gap: np.ndarray) -> list[int]:
        """Nodes after one more skip; those not known yet are merged together."""
        keys = (nodes * _FAR + gap).tolist()
        known = self._skipped
        new = [k for k in dict.fromkeys(keys) if k not in known]
        for at in range(0, len(new), 4 * _TOGETHER):
            some, origin = new[at : at + 4 * _TOGETHER], self._made
            words, skips = [], []
            for made in some:
                path = []
                while made.__class__ is int:
                    node, gap = divmod(made, _FAR)
                    path.append(gap)
                    made = origin[node]
                path.reverse()
                words.append(made)
                skips.append(path)
            known.update(zip(some, self._add(some, *self._model.all_skipping(words, skips))))
        return list(map(known.__getitem__, keys))

    def ids(self, words: list[str], keys: np.ndarray, places: np.ndarray, table: np.ndarray) -> list[bytes]:
        """Ids of every occurrence of a unit by its own draws."""
        new = [w for w in dict.fromkeys(words) if w not in self and len(w) <= self._longest]
        self.update(zip(new, self._add(new, *self._model.all_unskipped(new))))
        nodes = np.fromiter(map(self.get, words, repeat(0)), np.int64, len(words))
        long = np.flatnonzero(nodes == 0).tolist()
        live, turn = np.arange(len(words)), 0
        while live.size:
            gap = gaps(keys[live], places[live], turn, table)
            hit = gap < self._after[nodes[live]]
            live, gap, turn = live[hit], gap[hit], turn + 1
            nodes[live] = self._skip(nodes[live], gap)
        out = list(map(self._ids.__getitem__, nodes.tolist()))
        for i in long:
            out[i] = self._model.unit(words[i], one_by_one(keys[i : i + 1], places[i : i + 1], table))[0]
        self._trim()
        return out

    def _trim(self) -> None:
        for known in (self, self._skipped):
            while known:
                key, node = known.popitem()
                if node < self._most:
                    known[key] = node
                    break
        del self._made[self._most :], self._ids[self._most :]


def one_by_one(key: np.ndarray, place: np.ndarray, table: np.ndarray) -> Iterator[int]:
    """The draws of one occurrence: how many candidates merge before each skip."""
    kept = 0
    for first in range(0, 2**23, 64):
        for gap in gaps(key, place + (np.arange(first, first + 64) << 40), 0, table).tolist():
            kept += gap
            if gap < _FAR:
                yield kept
                kept = 0


def merger(path: str) -> Merger:
    """One per worker and file."""
    kept = worker_state().setdefault("mergers", {})
    if path not in kept:
        kept.clear()
        kept[path] = Merger(path)
    return kept[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode(docs: DataFrame, path: str, seed: int = 1, rate: float = 0.1) -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32 bits) of every whole text.

    Every occurrence of a word has draws of its own, by seed, doc_id and place; rate 0
    gives the model's own segmentation. Null text counts as empty and has no ids.
    Repeated rows get equal ids; a null doc_id counts as an id of its own; extra columns are ignored.
    """
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = merger(path)
        for batch in batches:
            texts, docs, ids = batch["text"].tolist(), batch["doc_id"].tolist(), []
            # Words of a call are held together.
            cuts = np.cumsum([len(t or "") for t in texts]) // _CHARS
            edges = [0, *(np.flatnonzero(np.diff(cuts)) + 1).tolist(), len(texts)]
            for lo, hi in zip(edges, edges[1:]):
                ids += m.encode_all(texts[lo:hi], seed, docs[lo:hi], rate)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "ids": ids})

    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(read, "doc_id string, ids binary").select(
        F.col("doc_id").cast("long").alias("doc_id"), "ids"
    )


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32, text of encoded documents, from their ids alone."""
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = merger(path)
        for batch in batches:
            yield pd.DataFrame({
                "doc_id": batch["doc_id"], "n_tokens": [len(x) // 4 for x in batch["ids"]],
                "ids_crc32": [zlib.crc32(x) for x in batch["ids"]], "text": [m.decode(x) for x in batch["ids"]],
            })

    rows = encoded.select(F.col("doc_id").cast("string").alias("doc_id"), "ids").mapInPandas(
        read, "doc_id string, n_tokens long, ids_crc32 long, text string"
    )
    return rows.withColumn("doc_id", F.col("doc_id").cast("long"))
