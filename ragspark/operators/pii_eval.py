"""Quality of redaction against labelled spans."""

from __future__ import annotations

import bisect
import heapq
from collections.abc import Sequence

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragspark.functions.numbers import ratio
from ragspark.functions.pii import DETECTORS, Detector, masked
from ragspark.session import materialise, spread


MEETING = "hit array<boolean>, true_positive array<boolean>, negative array<int>"


class _Painted:
    """Stretches of a text, each with the smallest number of the spans over it; built by one sweep over sorted ends."""

    def __init__(self, spans: list[tuple[int, int, int]]):
        self._starts, self._ends, self._numbers = [], [], []
        waiting, open_, at = sorted(spans), [], 0
        edges = sorted({e for s in spans for e in s[:2]})
        for lo, hi in zip(edges, edges[1:]):
            while at < len(waiting) and waiting[at][0] <= lo:
                heapq.heappush(open_, (waiting[at][2], waiting[at][1]))
                at += 1
            while open_ and open_[0][1] <= lo:
                heapq.heappop(open_)
            if open_:
                self._starts.append(lo)
                self._ends.append(hi)
                self._numbers.append(open_[0][0])

    def least(self, spans: list[tuple[int, int]]) -> int | None:
        """Smallest number of a span that one of these overlaps."""
        best = None
        for start, end in spans:
            i = bisect.bisect_right(self._ends, start)
            while i < len(self._starts) and self._starts[i] < end:
                if best is None or self._numbers[i] < best:
                    best = self._numbers[i]
                i += 1
        return best


def _meet(text: str | None, gold: list, masks: list) -> tuple[list, list, list]:
    """Which gold strings a mask overlaps, which masks overlap a true one, and the first negative a mask overlaps."""
    found: dict[str, list[tuple[int, int]]] = {s: [] for s in (*(g["text"] for g in gold), *masks) if s}
    if text and found:
        # All strings of a case are looked for in one pass over its text, however many there are.
        machine = ahocorasick.Automaton()
        for s in found:
            machine.add_word(s, s)
        machine.make_automaton()
        for last, s in machine.iter(text):
            found[s].append((last + 1 - len(s), last + 1))
    of = lambda s: found.get(s, []) if s else []
    masked_ = _Painted([(*span, 0) for m in set(masks) for span in of(m)])
    true = _Painted([(*span, 0) for g in gold if g["is_pii"] for span in of(g["text"])])
    negative = _Painted([(*span, i) for i, g in enumerate(gold) if g["is_pii"] is False for span in of(g["text"])])
    return (
        [masked_.least(of(g["text"])) is not None for g in gold], [true.least(of(m)) is not None for m in masks], [negative.least(of(m)) for m in masks],
    )


def outcomes(cases: DataFrame, detectors: Sequence[Detector] = DETECTORS) -> DataFrame:
    """Per case the outcome of every mask and every true entity.

    ``cases(case_id, text, entities array<struct<text,type,is_pii>>)``. A case is
    its own session, so masks, spans and labels live in one row: no shuffle. One automaton finds every span of every string of a
    case, overlapping ones included, and a sweep over the sorted spans tells which overlap, so the time
    follows the text and the spans found, not the strings times the spans. A null text or string has no spans.
    """
    @F.pandas_udf(MEETING)
    def meet(texts: pd.Series, gold: pd.Series, masks: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_meet(t, list(g), [m["value"] for m in ms]) for t, g, ms in zip(texts, gold, masks)], columns=["hit", "true_positive", "negative"])

    found = spread(cases).withColumn("_masks", masked(F.col("text"), detectors)["entities"]).withColumn(
        "_gold", F.coalesce("entities", F.array().cast("array<struct<text:string,type:string,is_pii:boolean>>"))
    )
    met = found.select("case_id", "_gold", "_masks", F.explode_outer(F.array(meet("text", "_gold", "_masks"))).alias("_met"))
    numbered = F.transform("_gold", lambda g, i: F.struct(
        g["text"].alias("text"), g["type"].alias("type"), F.get(F.col("_met.hit"), i).alias("detected"), g["is_pii"].alias("is_pii")))

    def mask(m, i):
        true = F.get(F.col("_met.true_positive"), i)
        cause = F.coalesce(F.get("_gold", F.get(F.col("_met.negative"), i))["type"], F.lit("spurious"))
        return F.struct(m["value"].alias("value"), m["entity_type"].alias("type"), true.alias("true_positive"), F.when(~true, cause).alias("category"))

    return met.select(
        "case_id",
        F.transform(F.filter(numbered, lambda g: g["is_pii"]), lambda g: F.struct(g["text"].alias("text"), g["type"].alias("type"), g["detected"].alias("detected"))).alias("gold"),
        F.transform("_masks", mask).alias("masks"),
    )


def report(cases: DataFrame, detectors: Sequence[Detector] = DETECTORS) -> DataFrame:
    """Long report ``(section, label, hits, total, value)``.

    Sections: recall per type and overall, precision, over-mask rate and false
    positives per category. Only counters leave the tasks.
    """
    result = materialise(outcomes(cases, detectors))
    gold = result.select(F.explode("gold").alias("g")).select("g.*")
    masks = result.select(F.explode("masks").alias("m")).select("m.*")
    recall = (
        gold.rollup("type")
        .agg(F.count_if(F.col("detected")).alias("hits"), F.count("*").alias("total"), F.grouping("type").alias("_all"))
        .select(F.lit("recall").alias("section"), F.when(F.col("_all") == 1, "overall").otherwise(F.col("type")).alias("label"),
                "hits", "total", ratio(F.col("hits"), F.col("total")).alias("value"))
    )
    counted = masks.agg(
        F.count_if("true_positive").alias("tp"), F.count_if(~F.col("true_positive")).alias("fp"), F.count("*").alias("n")
    )
    rates = counted.select(F.explode(F.array(
        F.struct(F.lit("masks").alias("section"), F.lit("precision").alias("label"), F.col("tp").alias("hits"), F.col("n").alias("total")),
        F.struct(F.lit("masks").alias("section"), F.lit("over_mask_rate").alias("label"), F.col("fp").alias("hits"), F.col("n").alias("total")),
    )).alias("r")).select("r.*").withColumn("value", ratio(F.col("hits"), F.col("total")))
    causes = (
        masks.where(~F.col("true_positive")).groupBy(F.col("category").alias("label")).agg(F.count("*").alias("hits"))
        .select(F.lit("false_positives").alias("section"), "label", "hits", F.col("hits").alias("total"), F.lit(1.0).alias("value"))
    )
    return recall.unionByName(rates).unionByName(causes)
