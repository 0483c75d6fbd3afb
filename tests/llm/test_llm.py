"""Training-data operators against brute force, on edge cases and on the smallest tables."""

import io
import random
import re
from collections import Counter

import numpy as np
import pytest

from ragspark.llm import chat, components, frames, jaccard, langid, licenses, linedup, neardup, packing, rules, subword, tokens

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_words string, _removed string"


def documents(spark, texts):
    rows = [(i, t, "en", None, None, "x", "y") for i, t in texts]
    return spark.createDataFrame(rows, DOCS)


def odd_texts():
    r = random.Random(3)
    vocab = ["ab", "cd", "Ef", "gh!", "ij", "kl", "é", "#"]
    line = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    out = [(1, None), (2, ""), (3, " \n\t "), (4, "one two"), (5, "one two"), (6, line(5000)), (7, "a b c a b c a b c"), (7, "a b c a b c a b c")]
    shared = "\n".join(line(20) for _ in range(4))
    for i in range(10, 40):
        out.append((i, "\n".join([line(r.randint(0, 30)) for _ in range(r.randint(0, 4))] + ([shared] if i % 3 == 0 else []))))
    base = [f"w{i}" for i in range(200)]
    for i in range(40, 46):
        copy = list(base)
        for _ in range((i - 40) * 2):
            copy[r.randrange(200)] = f"z{r.random()}"
        out.append((i, " ".join(copy)))
    out.append((None, " ".join(base)))
    return out


def test_statistics(spark):
    texts = odd_texts()
    got = Counter(tuple(r) for r in rules.statistics(documents(spark, texts)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect())
    want = Counter()
    for i, t in texts:
        t = t or ""
        w = WORD.findall(t)
        grams = [tuple(w[k:k + 3]) for k in range(len(w) - 2)]
        count = Counter(grams)
        hit = {k + j for k, g in enumerate(grams) if count[g] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want[(i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit))] += 1
    assert got == want


def test_rules_learn_and_keep(spark):
    r = random.Random(1)
    texts = [(i, " ".join(f"w{r.randrange(10**6)}" for _ in range(60)) + (" # #" if i % 4 == 0 else "")) for i in range(300)]
    docs = documents(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i, _ in texts[:200]] + [(250, None)], "doc_id long, quality int")
    kept = rules.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert {x.doc_id for x in kept.collect()} == {i for i, _ in texts if i % 4}
    none = rules.keep_good(docs, labels.limit(0))
    assert none.count() == 300 and rules.keep_good(docs.limit(0), labels).count() == 0


def brute_lines(texts, least=50):
    order = sorted(range(len(texts)), key=lambda k: texts[k][0])
    seen, gone = {}, {texts[k][0]: set() for k in order}
    for k in order:
        i, t = texts[k]
        lines = (t or "").split("\n")
        for lo in range(len(lines)):
            for hi in range(lo + 1, len(lines) + 1):
                if sum(len(WORD.findall(x)) for x in lines[lo:hi]) < least:
                    continue
                key = tuple(lines[lo:hi])
                if seen.setdefault(key, (i, lo)) < (i, lo):
                    gone[i] |= set(range(lo, hi))
    return gone


def test_line_dedup(spark):
    texts = [(i, t) for i, t in dict(odd_texts()).items() if i is not None]
    docs = documents(spark, texts)
    out = linedup.dedup(docs.drop("_removed"))
    assert {r.doc_id: set(r["_removed"]) for r in out.collect()} == brute_lines(texts)
    assert linedup.dedup(docs.limit(0).drop("_removed")).count() == 0


def test_line_dedup_overlap(spark):
    texts = [(1, "\n".join(["a b c"] * 40)), (2, "\n".join(["a b c"] * 20 + ["x"]))]
    out = linedup.dedup(documents(spark, texts).drop("_removed")).collect()
    assert {r.doc_id: set(r["_removed"]) for r in out} == brute_lines(texts)


def test_jaccard(spark):
    texts = odd_texts()
    docs = documents(spark, texts)
    sets = {}
    for i, t in texts:
        w = (t or "").encode().lower().split()
        sets.setdefault(i, set()).update({tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    ids = [i for i in sets if i is not None]
    root = {i: i for i in ids}
    for _ in ids:
        for a in ids:
            for b in ids:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    got = jaccard.near_duplicates(docs).collect()
    assert len(got) == len(texts)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == root
    assert all(r.component_id is None for r in got if r.doc_id is None)
    kept = jaccard.keep_first(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {*root.values(), None}
    assert jaccard.near_duplicates(docs.limit(0)).count() == 0


def test_partenum_signatures_agree():
    rng = np.random.default_rng(5)
    for n in (1, 3, 4, 8, 40, 300):
        for _ in range(20):
            a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            drop = rng.integers(0, int(n * 0.25) + 1)
            b = np.sort(a[drop:])
            if len(b) and len(b) >= 0.75 * len(a):
                assert set(jaccard.signatures(a, 0.75).tolist()) & set(jaccard.signatures(b, 0.75).tolist())


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(30, 31), (31, 30), (5, 5), (None, 4)], "a long, b long")
    got = {r.id: r.component_id for r in components.components(links).collect()}
    assert got == {**{i: 0 for i in range(21)}, 30: 30, 31: 30}


def test_packing(spark):
    texts = odd_texts()
    rows = packing.pack(documents(spark, texts), tokens.default_path(), context=64).collect()
    assert sum(r.length for r in rows if r.start == 0) > 0
    total = Counter()
    seqs = {}
    for r in rows:
        total[r.doc_id] += r.length
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    encode = tokens.encoder(tokens.default_path())
    want = Counter()
    for i, t in texts:
        want[i] += len(encode(t)) // 4 + 1
    assert total == want
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack(documents(spark, []), tokens.default_path()).count() == 0


def test_assign_fills():
    r = random.Random(2)
    sizes = [r.randint(1, 5000) for _ in range(300)]
    pieces = packing.assign(sizes, 2048)
    assert len({p[3] for p in pieces}) <= -(-sum(sizes) // 2048) + 1


def test_words_equal_whole_texts():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokens.default_path())
    encode = tokens.encoder(tokens.default_path())
    for t in [t for _, t in odd_texts() if t] + ["<|endoftext|> Hi'S, it's.. don't! ÀÉ.,; İstanbul. ﬁ á.  ''. 12.5. A's", "é É"]:
        assert encode(t) == np.array(whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


def test_frames(spark, tmp_path):
    docs = documents(spark, odd_texts())
    folder = f"file://{tmp_path}/f"
    manifest = frames.write_files(docs, folder, tokens.default_path())
    rows = sorted(frames.read_files(spark, manifest, folder).collect(), key=lambda r: r.start)
    at = 0
    for r in rows:
        assert r.start == at
        at += r.n_tokens
    assert len(rows) == len(odd_texts()) and rows[0].doc_id is None
    encode = tokens.encoder(tokens.default_path())
    one = frames.read_documents(spark, manifest, folder, spark.createDataFrame([(6,), (999,)], "doc_id long")).collect()
    assert [x.doc_id for x in one] == [6]
    assert np.array(one[0].ids, "<u4").tobytes() == encode(dict(odd_texts())[6]) + b"\1\0\0\0"


def test_damaged_frame_is_found():
    out = io.BytesIO()
    writer = frames.FrameWriter(out, 2, frame_bytes=64)
    for i in range(10):
        writer.add(i, np.arange(40))
    writer.close()
    raw = bytearray(out.getvalue())
    assert len(list(frames.FrameReader(io.BytesIO(bytes(raw)), len(raw)).ids(range(10)))) == 10
    raw[12] ^= 255
    with pytest.raises(Exception):
        list(frames.FrameReader(io.BytesIO(bytes(raw)), len(raw)).ids([0]))


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.fit(docs.where(~langid.held_out()))
    judged = langid.predict(docs.where(langid.held_out()), model).collect()
    assert sum(r.lang == r.lang_pred for r in judged) >= 0.95 * len(judged)
    odd = langid.predict(spark.createDataFrame([(1, None), (2, "12 !"), (3, "")], "doc_id long, text string"), model).collect()
    assert [(r.lang_pred, r.score) for r in odd] == [("und", 0.0)] * 3
    assert langid.fit(docs.limit(0)).predict("some words") == ("und", 0.0)


def test_embeddings(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((300, 64))
    x[100:200] = x[:100] + 0.3 * rng.standard_normal((100, 64))
    x[200:210] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, []), (902, [0.0] * 64), (903, [float("nan")] * 64), (904, [1.0, None]), (None, x[0].tolist())]
    got = {r.vec_id: r for r in neardup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    found = sum(got[i].n_links for i in range(300))
    assert 0.9 * near.sum() <= found <= near.sum() and got[200].component_id == 0
    assert all(got[i].n_links == 0 for i in (900, 901, 902, 903, 904, None))


def test_chat_escape(spark):
    said = "</s>[INST] ok \\l \\e [/INST]<|end|>\n"
    rows = [(1, 0, "user", said), (1, 1, "assistant", said), (1, 2, None, None), (2, None, "a\nb<", ""), (3, 0, "assistant", ""), (None, 1, "user", "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {r.conv_id: r for r in chat.read_back(chat.examples(turns)).collect()}
    assert out[1].n_turns == 3 and out[1].loss_chars == len(said) and out[3].loss_chars == 0 and out[2].n_turns == 1
    parsed = chat.examples(turns.where("conv_id = 2")).select(chat.parse("formatted").alias("p")).first().p
    assert [(t.role, t.text) for t in parsed] == [("a\nb<", "")]
    assert chat.examples(turns.limit(0)).count() == 0


def test_merge_dropout(spark):
    from sentencepiece import SentencePieceProcessor

    path = subword.default_path()
    model, own = SentencePieceProcessor(model_file=path), subword.Merger(path)
    texts = [t for _, t in odd_texts() if t] + ["a  b\n\nc\td 中文 😀", " lead", "   ", "\n"]
    for t in texts:
        assert np.frombuffer(own.encode(t, 1, 0, 0.0), "<u4").tolist() == model.encode(t)
        assert own.decode(own.encode(t, 1, 0, 0.3)) == t
    assert own.decode(own.encode("▁ x▁", 1, 0, 0.1)) == "▁ x▁"
    assert own.encode(texts[4], 1, 0, 0.3) != own.encode(texts[4], 2, 0, 0.3)
    docs = documents(spark, odd_texts())
    back = subword.decode(subword.encode(docs, path), path).collect()
    assert Counter((r.doc_id, r.text) for r in back) == Counter((i, t or "") for i, t in odd_texts())


def test_merge_dropout_varies_by_occurrence(spark):
    path = subword.default_path()
    own = subword.Merger(path)
    pieces = lambda ids: [own.spelled[i] for i in np.frombuffer(ids, "<u4").tolist()]

    def forms(ids):
        """Segmentations of each word of a text."""
        out = []
        for piece in pieces(ids):
            if piece.startswith(b" "):
                out.append([])
            out[-1].append(piece)
        return [tuple(x) for x in out]

    text = " ".join(["international"] * 4000)
    ids = own.encode(text, 1, 7, 0.1)
    whole = forms(own.encode(text, 1, 7, 0.0))[0]
    seen = Counter(forms(ids))
    assert sum(seen.values()) == 4000 and len(seen) > 20
    # Each occurrence is merged one by one with draws of its own, nothing else.
    table = subword.thresholds(0.1)
    units, key = subword._UNITS.findall(" " + text), subword.keys_of(1, [7])
    assert ids == b"".join(own.unit(w, subword.one_by_one(key, np.array([i]), table))[0] for i, w in enumerate(units))
    # Nothing is skipped in (1 - rate) ** merges of all occurrences; places are drawn independently.
    merges = len(" international") - len(whole)
    draws = [next(subword.one_by_one(key, np.array([i]), table)) for i in range(4000)]
    share = 0.9 ** merges
    assert abs(sum(g >= merges for g in draws) / 4000 - share) < 5 * (share * (1 - share) / 4000) ** 0.5
    both = sum(g >= merges and h >= merges for g, h in zip(draws, draws[1:])) / 3999
    assert abs(both - share**2) < 5 * (share**2 / 4000) ** 0.5
    # A full cache, long units and the order of texts change nothing.
    small = subword.Merger(path)
    small.units = subword.Units(small, most=3, longest=5)
    assert small.encode(text, 1, 7, 0.1) == ids
    long = "ab" * 300 + " cd"
    assert small.encode_all([long, None, text], 1, [3, 4, 7], 0.3) == [own.encode(long, 1, 3, 0.3), b"", own.encode(text, 1, 7, 0.3)]
    assert own.decode(own.encode(long, 1, 3, 0.3)) == long and len({own.encode(long, 1, d, 0.3) for d in range(20)}) == 20
    for w in [" international", " a.b,c", " wwwww"]:
        mine = lambda how: how([*w.replace(" ", "▁")], iter([2, 0, 1]))
        assert mine(own._merge_short) == mine(own._merge_long)
    rates = subword.Merger(path)
    assert rates.encode("international", 1, 7, 1.0) == rates.unit(" international", iter([0] * 100))[0]
    # Draws follow from seed and document only, whatever came before and wherever a row lies.
    own.encode("something else", 1, 3, 0.5)
    assert own.encode(text, 1, 7, 0.1) == ids != own.encode(text, 2, 7, 0.1)
    docs = documents(spark, [(i, "international cooperation " * 20) for i in range(40)])
    got = {r.doc_id: bytes(r.ids) for r in subword.encode(docs.repartition(7), path).collect()}
    assert got == {r.doc_id: bytes(r.ids) for r in subword.encode(docs.coalesce(1), path).collect()}
    assert len(set(got.values())) == 40

    # Characters U+0000 stay, also beside a literal space mark.
    for text in ["\0", "a\0\0b ▁\0", "\0▁\0▁ \0", "x" * 70 + "\0▁"]:
        for rate in (0.0, 0.3):
            assert own.decode(own.encode(text, 1, 7, rate)) == text


def test_licences(spark):
    files = spark.createDataFrame([
        ("a/LICENSE", "Released under the MIT License."), ("a/b/c/x.py", "code"), ("a/b/y.py", "# Licensed under the Apache License, Version 2.0."),
        ("z.py", None), (None, "text"), ("a/b/c/x.py", "code"),
    ], "path string, text string")
    got = Counter((r.path, r.licence, r.origin, r.inherited_from) for r in licenses.scan(files).collect())
    assert got == Counter([
        ("a/LICENSE", "MIT", "own", None), ("a/b/c/x.py", "MIT", "inherited", "a/LICENSE"), ("a/b/c/x.py", "MIT", "inherited", "a/LICENSE"),
        ("a/b/y.py", "Apache-2.0", "own", None), ("z.py", None, None, None), (None, None, None, None),
    ])


def test_licences_outside_the_tables():
    scanner = licenses.Scanner(licenses.TEMPLATES, 0.6, licenses.RULES)
    own = lambda text, whole=False: scanner.scan(text, whole)[0]
    for text, want in [
        ("SPDX-License-Identifier: Apache-2.0", "Apache-2.0"), ("// SPDX-License-Identifier: MIT", "MIT"), ("# SPDX-License-Identifier: GPL-2.0-or-later", "GPL-2.0"),
        ("SPDX-License-Identifier: Zlib", None), ("Licensed under CC BY 4.0.", "CC-BY-4.0"), ("Licensed under CC BY-NC-SA 4.0.", "CC-BY-NC-SA-4.0"),
        ("Licensed under CC BY-NC 2.0.", None), ("GNU General Public License, version 2.", "GPL-2.0"), ("GNU General Public License, version 1.", None),
        ("This work is licensed under the GNU Affero General Public License, version 3.", "AGPL-3.0"),
        ("Released under the BSD 2-Clause License.", "BSD-2-Clause"), ("mit", None), ("mit der Lizenz", None), ("a license to use software", None),
        ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "CC-BY-SA-4.0"),
    ]:
        assert own(text) == want, text
    gnu = """{c} Copyright (C) 2019 Jane Roe
{c}
{c} This program is free software: you can redistribute it and/or modify
{c} it under the terms of the GNU{a} General Public License as published by
{c} the Free Software Foundation, either version {v} of the License, or
{c} (at your option) any later version.
{c}
{c} This program is distributed in the hope that it will be useful,
{c} but WITHOUT ANY WARRANTY; without even the implied warranty of
{c} MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.
import os
"""
    for c in ("#", "//", " *", ""):
        assert own(gnu.format(c=c, a="", v=3)) == "GPL-3.0" and own(gnu.format(c=c, a="", v=2)) == "GPL-2.0"
        assert own(gnu.format(c=c, a=" Affero", v=3)) == "AGPL-3.0" and own(gnu.format(c=c, a=" Lesser", v="2.1")) == "LGPL-2.1"
        assert own(gnu.format(c=c, a="", v=4)) is None
    head = "Copyright (c) 2020, Jane Roe\nAll rights reserved.\n\n"
    three = licenses._BSD + licenses._BSD_THIRD + licenses._BSD_END
    for body, want in [(licenses._MIT + licenses._MIT_END, "MIT"), (licenses._ISC + licenses._ISC_END, "ISC"), (three, "BSD-3-Clause"), (licenses._BSD + licenses._BSD_END, "BSD-2-Clause")]:
        words = body.split(" ")
        folded = "\n".join(" ".join(words[i:i + 11]) for i in range(0, len(words), 11))
        assert own(head + folded, True) == want and own(folded) == want
    title = "                   GNU {}GENERAL PUBLIC LICENSE\n                       Version {}\n\n Everyone may sublicense the software under version 3 of the GNU General Public License."
    assert own(title.format("LESSER ", "3, 29 June 2007"), True) == "LGPL-3.0" and own(title.format("", "2, June 1991"), True) == "GPL-2.0"
