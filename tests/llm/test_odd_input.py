"""Inputs that gave wrong answers or failed: added tokens in capitals, wide ids, columns of our names, many wanted ids."""

import io
import json
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from ragspark.llm import frames, jaccard, linedup, packing, tokens

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _gone string, _removed string"


def added_tokens():
    with open(tokens.default_path(), encoding="utf-8") as file:
        return [t["content"] for t in json.load(file)["added_tokens"]]


def odd():
    out = ["plain Words, HERE. A-B c9D Éa ÉA STRASSE straße", "", None]
    for t in added_tokens():
        for form in (t, t.upper(), t.title(), f"a{t}b", f"A{t.upper()}B.", f"{t.upper()}.", f"x {t.swapcase()}, y", t + "Abc;", t.upper() + "Abc;"):
            out.append(form)
    return out


def library(text):
    return Tokenizer.from_file(tokens.default_path()).encode(text or "", add_special_tokens=False).ids


def test_added_tokens_in_any_case():
    encode = tokens.encoder(tokens.default_path())
    assert added_tokens()
    for text in odd():
        assert np.frombuffer(encode(text), "<u4").tolist() == library(text), text


def test_files_and_packing_against_the_library(spark, tmp_path):
    """Every id of every document: starts, counts and checksums of op4, pieces of op1."""
    texts = odd()
    docs = spark.createDataFrame([(i * 3, t, "en", None, 1, "x", "y") for i, t in enumerate(texts)], DOCS).repartition(3)
    ids = {i * 3: [*library(t), 1] for i, t in enumerate(texts)}
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    start, want = 0, []
    for i, x in sorted(ids.items()):
        want.append((i, start, len(x), crc(x)))
        start += len(x)
    folder = str(tmp_path / "frames")
    manifest = frames.write_files(docs, folder, tokens.default_path())
    got = frames.read_files(spark, manifest, folder).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, got)) == want
    pieces = {}
    for r in packing.pack(docs, tokens.default_path(), context=16).collect():
        assert r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == crc(ids[r.doc_id][r.start:r.start + r.length])
        pieces.setdefault(r.doc_id, []).append((r.start, r.start + r.length))
    assert {i: [e for p in sorted(x) for e in p] for i, x in pieces.items()} == {
        i: [e for p in sorted(pieces[i]) for e in p] for i in ids}
    for i, x in pieces.items():
        x.sort()
        assert x[0][0] == 0 and x[-1][1] == len(ids[i]) and all(a[1] == b[0] for a, b in zip(x, x[1:]))


def test_wanted_documents_come_by_file(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(frames, "SLICE", 3)
    docs = spark.createDataFrame([(i, f"text {i}", "en", None, 1, "", "") for i in range(0, 80, 2)] + [(None, "n", "en", None, 1, "", ""), (4, "again", "en", None, 1, "", "")], DOCS)
    folder = str(tmp_path / "frames")
    manifest = frames.write_files(docs, folder, tokens.default_path())
    wanted = spark.createDataFrame([(i,) for i in range(-5, 60)] + [(None,), (8,)], "doc_id long")
    got = frames.read_documents(spark, manifest, folder, wanted).collect()
    assert sorted((r.doc_id, tuple(r.ids)) for r in got) == sorted(
        [(i, (*library(f"text {i}"), 1)) for i in range(0, 60, 2)] + [(4, (*library("again"), 1))])
    none = frames.write_files(docs.limit(0), str(tmp_path / "none"), tokens.default_path())
    assert none.count() == 0 and frames.read_documents(spark, none, str(tmp_path / "none"), wanted).count() == 0


def test_an_id_that_does_not_fit_is_an_error():
    writer = frames.FrameWriter(io.BytesIO(), 2)
    writer.add(1, np.array([65535], "<u4"))
    with pytest.raises(ValueError, match="65536"):
        writer.add(2, np.array([65536], "<u4"))


def test_columns_of_our_names(spark):
    lines = "\n".join("a b c d e f g h i j" for _ in range(8))
    docs = spark.createDataFrame([(1, lines, "en", None, 1, "x", "y"), (2, lines + "\nmore words", "en", None, 1, "x", "y")], DOCS)
    kept = jaccard.keep_first(docs)
    assert kept.columns == docs.columns and [(r.doc_id, r["_gone"]) for r in kept.collect()][0] == (1, "x")
    out = linedup.dedup(docs)
    assert out.columns == [*docs.columns, "_removed_"] and {r["_removed"] for r in out.collect()} == {"y"}


def test_line_stage_keeps_a_column_of_its_name(spark):
    import corpus_pipeline

    lines = "\n".join(f"a b c d e f g h i {i}" for i in range(8))
    docs = spark.createDataFrame([(1, lines, "en", None, len(lines), "x", "y"), (2, lines + "\nmore", "en", None, 9, "x", "y")], DOCS)
    out = corpus_pipeline.lines(spark, docs, "")
    assert out.columns == docs.columns and sorted((r.doc_id, r.text, r.n_chars, r["_removed"]) for r in out.collect()) == [(1, lines, len(lines), "y"), (2, "more", 4, "y")]
