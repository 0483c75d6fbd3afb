"""Language ID with bit-sliced Bloom filters over character n-grams.

One table of bit positions holds, at each position, a mask with one bit per
language. The masks at an n-gram's positions, combined by AND, name all languages
that contain it at once. Per language, the n-grams of a text whose bit is set are counted,
the count is corrected for the filter's false positives, and the highest share
decides. Prediction reads the text only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragspark.llm.common import worker_state

UNKNOWN = "und"
SIZES = (2, 3, 4)
#: N-grams that a worker holds at once while it counts.
PORTION = 1_000_000
PROBES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def _letters() -> np.ndarray:
    """Per code point: is it a letter? Built once per worker from the Unicode tables."""
    state = worker_state()
    if "letters" not in state:
        state["letters"] = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return state["letters"]


def grams(text: str) -> tuple[np.ndarray, int]:
    """Hashes of all n-grams of the lower-cased letters, one blank between words; number of letters."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    known = _letters()[codes]
    count = int(known.sum())
    if not count:
        return np.empty(0, np.uint64), 0
    line = np.concatenate(([0], np.where(known, codes, 0), [0])).astype(np.uint64)
    line = line[np.concatenate(([True], (line[1:] != 0) | (line[:-1] != 0)))]
    out = []
    for n in SIZES:
        if len(line) >= n:
            h = np.full(len(line) - n + 1, n, np.uint64)
            inner = np.ones(len(h), bool)
            for j in range(n):
                part = line[j : len(line) - n + 1 + j]
                h = (h ^ part) * np.uint64(0x9FB21C651E98DF25)
                h ^= h >> np.uint64(29)
                if 0 < j < n - 1:
                    inner &= part != 0
            out.append(h[inner])
    return np.concatenate(out), count


@dataclass(frozen=True)
class Model:
    """``table``: masks by bit position; ``wrong``: false-positive rate per language; ``fallback``: most frequent language."""

    languages: tuple[str, ...]
    table: np.ndarray
    wrong: np.ndarray
    fallback: str

    def places(self, hashes: np.ndarray) -> list[np.ndarray]:
        shift = np.uint64(64 - int(len(self.table)).bit_length() + 1)
        return [(hashes * np.uint64(p)) >> shift for p in PROBES]

    def predict(self, text: str | None) -> tuple[str, float]:
        hashes, letters = grams(text) if text else (None, 0)
        if not letters or not self.languages:
            return UNKNOWN, 0.0
        first, *rest = self.places(hashes)
        masks = self.table[first]
        for place in rest:
            masks &= self.table[place]
        n = len(masks)
        # A language beyond the 64th has its bit in the next word of the mask.
        hits = np.array([
            np.count_nonzero(masks[:, i // 64] & np.uint64(1 << i % 64)) for i in range(len(self.languages))
        ])
        share = np.maximum(0.0, hits - n * self.wrong) / (1 - self.wrong) / max(n, 1)
        best = int(np.argmax(share))
        if share[best] <= 0:
            return self.fallback, 0.0
        return self.languages[best], float(min(1.0, share[best]))


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Occurrences of each n-gram per language, summed over texts of about ``PORTION`` n-grams."""
    def summed(lang: str, found: list[np.ndarray]) -> pd.DataFrame:
        values, counts = np.unique(np.concatenate(found), return_counts=True)
        return pd.DataFrame({"lang": lang, "gram": values.view(np.int64), "n": counts})

    # A worker that has packed keeps the words it met; counting needs none of them.
    worker_state().pop("words", None)
    for batch in batches:
        for lang, texts in batch.groupby("lang")["text"]:
            found, held = [], 0
            for text in texts:
                found.append(grams(text)[0])
                held += len(found[-1])
                if held >= PORTION:
                    yield summed(lang, found)
                    found, held = [], 0
            if found:
                yield summed(lang, found)


def fit(rows: DataFrame, max_rows: int = 20000, max_grams: int = 32768, least_share: float = 0.25) -> Model:
    """Model from ``rows`` (doc_id, text, lang), of which about ``max_rows`` are read.

    The bound is a parameter: rows enter by a hash of doc_id. A language's
    filter holds its ``max_grams`` most frequent n-grams among those whose
    share in it is at least ``least_share`` of their highest share in any language.
    Rows with null text or lang teach nothing; without any, all texts get ``und``.
    """
    usable = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    total = usable.count()
    part = int(min(1.0, max_rows / max(total, 1)) * 2**31)
    sample = usable.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(2**31)) < part)
    counted = sample.select("lang", "text").mapInPandas(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    by_lang, by_gram = Window.partitionBy("lang"), Window.partitionBy("gram")
    shares = counted.withColumn("share", F.col("n") / F.sum("n").over(by_lang)).withColumn("all", F.sum("n").over(by_lang))
    own = shares.withColumn("top", F.max("share").over(by_gram)).where(F.col("share") >= least_share * F.col("top"))
    ranked = own.withColumn("rank", F.row_number().over(by_lang.orderBy(F.desc("n"), "gram"))).where(F.col("rank") <= max_grams)
    found = ranked.select("lang", "gram", "all").toPandas()
    languages = tuple(sorted(found["lang"].unique()))
    if not languages:
        return Model((), np.zeros((2, 1), np.uint64), np.zeros(0), UNKNOWN)
    # Five positions for each gram and probe keep every filter below one fifth full.
    fullest = int(found.groupby("lang").size().max())
    table = np.zeros((1 << max(10, (fullest * len(PROBES) * 5).bit_length()), (len(languages) + 63) // 64), np.uint64)
    model = Model(languages, table, np.zeros(len(languages)), "")
    for i, lang in enumerate(languages):
        hashes = found.loc[found["lang"] == lang, "gram"].to_numpy(np.int64).view(np.uint64)
        for place in model.places(hashes):
            table[place, i // 64] |= np.uint64(1 << i % 64)
    filled = np.array([np.count_nonzero(table[:, i // 64] & np.uint64(1 << i % 64)) for i in range(len(languages))])
    totals = found.groupby("lang")["all"].first()
    return Model(languages, table, (filled / len(table)) ** len(PROBES), str(totals.sort_index().idxmax()))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (0 to 1) at the end.

    Null texts and texts without a letter are ``und`` with score 0; a text with
    letters none of whose n-grams is known gets the most frequent language with score
    0; equal shares go to the first language. Rows are judged one by one, so repeated ones alike. Columns of the same
    names in ``docs`` are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def judge(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shared.value.predict(t) for t in texts], columns=["lang_pred", "score"])

    kept = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    judged = docs.select(*kept, judge("text").alias("_judged"))
    return judged.select(*kept, "_judged.lang_pred", "_judged.score")


def held_out() -> Column:
    """Rows that no model may learn from: crc32 of the id's text modulo 4 is 2."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def keep_known(docs: DataFrame, model: Model, least: float = 0.3) -> DataFrame:
    """Documents with a letter whose best language explains at least ``least`` of their n-grams; columns unchanged."""
    safe = [f"_doc{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*safe).withColumn("text", F.col(f"_doc{docs.columns.index('text')}"))
    judged = predict(rows, model).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least))
    return judged.select(*safe).toDF(*docs.columns)
