"""Per-text helpers of the chunker: splitting a block that exceeds the caps."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

_TOKEN = re.compile(r"\w+|[^\w\s]")


def count_words(text: str) -> int:
    """Python twin of the default token counter."""
    return len(_TOKEN.findall(text))


def _windows(text: str, limit: int, count: Callable[[str], int]) -> list[str]:
    """Cut a run that has no better boundary into pieces of at most ``limit`` tokens."""
    marks = [m.span() for m in _TOKEN.finditer(text)]
    pieces = [
        text[marks[i][0]: marks[min(i + limit, len(marks)) - 1][1]] for i in range(0, len(marks), limit)
    ]
    # A sub-word counter may still find a piece too long: halve it.
    out: list[str] = []
    for piece in pieces:
        while count(piece) > limit and len(piece) > 1:
            size = len(piece)
            while size > 1 and count(piece[:size]) > limit:
                size //= 2
            out.append(piece[:size].strip())
            piece = piece[size:]
        out.append(piece.strip())
    return [p for p in out if p]


def _joined_size(body: str, size: int, glue: str, part: str, part_size: int, count: Callable[[str], int]) -> int:
    """Tokens of two texts joined by white space; the default counter simply adds up."""
    return size + part_size if count is count_words else count(body + glue + part)


def _join_while_fits(
    parts: Iterable[str], glue: str, limit: int, count: Callable[[str], int],
    split: Callable[[str], list[str]],
) -> list[str]:
    """Greedy runs of parts; a part that does not fit alone is split and stands alone."""
    runs: list[str] = []
    run, size = "", 0
    for part in filter(None, (p.strip() for p in parts)):
        part_size = count(part)
        if part_size > limit:
            runs += [run, *split(part)]
            run, size = "", 0
        elif run and (together := _joined_size(run, size, glue, part, part_size, count)) <= limit:
            run, size = run + glue + part, together
        else:
            runs.append(run)
            run, size = part, part_size
    return [r for r in [*runs, run] if r]


def split_block(text: str, max_tokens: int, max_chars: int, count: Callable[[str], int] = count_words) -> list[str]:
    """Pieces of a block within both caps: paragraphs, then sentences, then windows."""
    def sentences(paragraph: str) -> list[str]:
        parts = re.split(r"(?<=[.!?])\s+", paragraph)
        return _join_while_fits(parts, " ", max_tokens, count, lambda s: _windows(s, max_tokens, count))

    text = text.strip()
    if count(text) <= max_tokens:
        pieces = [text] if text else []
    else:
        pieces = _join_while_fits(re.split(r"\n\s*\n", text), "\n\n", max_tokens, count, sentences)
    return [p[i:i + max_chars] for p in pieces for i in range(0, len(p), max_chars)]


class Packer:
    """Greedy packing of one parent's blocks, fed one by one; holds the open chunk only."""

    def __init__(self, header: str, max_tokens: int, max_chars: int, count: Callable[[str], int] = count_words):
        header = header.strip()
        self._prefix = f"{header}\n\n" if header else ""
        self._count = count
        self._tokens, self._chars = max_tokens - count(self._prefix), max_chars - len(self._prefix)
        if self._tokens <= 0 or self._chars <= 0:
            raise ValueError(f"header leaves no room under {max_tokens} tokens and {max_chars} characters")
        self._body, self._size, self._labels = "", 0, []

    def push(self, label, text: str | None) -> list[tuple[str, list]]:
        """Chunks that are complete now that this block has come."""
        block = (text or "").strip()
        if not block:
            return []
        size = self._count(block)
        if self._body and len(self._body) + 2 + len(block) <= self._chars:
            together = _joined_size(self._body, self._size, "\n\n", block, size, self._count)
            if together <= self._tokens:
                self._body, self._size = f"{self._body}\n\n{block}", together
                self._labels += [] if label in self._labels else [label]
                return []
        done = self.finish()
        if len(block) <= self._chars and size <= self._tokens:
            self._body, self._size, self._labels = block, size, [label]
        else:
            done += [(self._prefix + piece, [label]) for piece in split_block(block, self._tokens, self._chars, self._count)]
        return done

    def finish(self) -> list[tuple[str, list]]:
        """The open chunk, if there is one."""
        done = [(self._prefix + self._body, self._labels)] if self._body else []
        self._body, self._size, self._labels = "", 0, []
        return done


def pack_blocks(
    blocks: Iterable[tuple[str, str]], header: str, max_tokens: int, max_chars: int, count: Callable[[str], int] = count_words,
) -> list[tuple[str, list[str]]]:
    """(text, labels) chunks of the blocks of one parent."""
    packer = Packer(header, max_tokens, max_chars, count)
    chunks = [chunk for label, text in blocks for chunk in packer.push(label, text)]
    return chunks + packer.finish()
