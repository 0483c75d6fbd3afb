"""Token ids of whole texts from a public tokenizer file."""

from __future__ import annotations

import json
import struct
import unicodedata
from collections.abc import Callable

from ragspark.llm.common import worker_state

class WordCache(dict):
    """Word -> bytes of its ids (little-endian 32 bits), of bounded size.

    Frequent words come early, so a full cache keeps what it has. Plain words are
    kept apart from the punctuation after them, which such tokenizers separate anyway. Where the
    tokenizer folds case, words of ASCII letters are kept in lower case; no other word is,
    as added tokens are found before case is folded.
    """

    def __init__(self, encode: Callable[[str], list[int]], folds: bool, most: int = 400_000):
        super().__init__()
        self._encode, self._folds, self._most = encode, folds, most
        self[""] = b""

    def __missing__(self, word: str) -> bytes:
        core = word.rstrip(".,!?;:")
        low = core.lower() if self._folds and core.isascii() and core.isalpha() else core
        if core != word and core.isalpha():
            out = self[low] + self[word[len(core):]]
        elif low != word and core == word:
            out = self[low]
        else:
            ids = self._encode(word)
            out = struct.pack(f"<{len(ids)}I", *ids)
        if len(self) < self._most and len(word) <= 64:
            self[word] = out
        return out


def default_path() -> str:
    """The tokenizer file that the queries use; every operator takes another one as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encoder(path: str) -> Callable[[str | None], bytes]:
    """Function from a text to its ids as little-endian 32-bit integers; null counts as empty.

    For tokenizers that drop white space, so that the ids of a text are those of
    its words one after the other (tests compare with whole texts). The file is
    read once per worker.
    """
    caches = worker_state().setdefault("words", {})
    if path not in caches:
        caches[path] = WordCache(*_word_encoder(path))
    cache = caches[path]
    return lambda text: b"".join(map(cache.__getitem__, text.replace("\n", " ").split(" "))) if text else b""


def vocabulary(path: str) -> int:
    """Number of ids of a tokenizer file, added tokens included."""
    from tokenizers import Tokenizer

    return max(Tokenizer.from_file(path).get_vocab(with_added_tokens=True).values()) + 1


def _word_encoder(path: str) -> tuple[Callable[[str], list[int]], bool]:
    """Ids of one word, and whether case is folded. A Latin word of letters is one unit of the merges, so it skips normalising and splitting."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as file:
        parts = json.load(file)
    kinds = lambda part: {part["type"], *(x["type"] for k in ("pretokenizers", "normalizers") for x in part.get(k, []))}
    folds = bool(parts["normalizer"]) and "Lowercase" in kinds(parts["normalizer"])
    direct = (
        parts["model"]["type"] == "BPE" and folds and parts["pre_tokenizer"] and "ByteLevel" in kinds(parts["pre_tokenizer"])
    )
    model, shown = tokenizer.model, _byte_letters()

    def encode(word: str) -> list[int]:
        if direct and word.isalpha():
            low = word.lower()
            if word.isascii():
                return [t.id for t in model.tokenize(low)]
            if max(word) < "\u0250" and len(low) == len(word) and unicodedata.is_normalized("NFC", word):
                return [t.id for t in model.tokenize(low.encode().decode("latin-1").translate(shown))]
        return tokenizer.encode(word, add_special_tokens=False).ids

    return encode, folds


def _byte_letters() -> dict[int, int]:
    """The public byte-level alphabet: printable bytes stand for themselves, the others follow from U+0100 on."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or (0xA1 <= b <= 0xFF and b != 0xAD)]
    rest = [b for b in range(256) if b not in plain]
    return {b: 0x100 + i for i, b in enumerate(rest)}
