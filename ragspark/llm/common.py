"""Helpers shared by the training-data operators."""

from __future__ import annotations

import sys
import types

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space between words: the six ASCII blanks.
BLANKS = r"[\x20\x09-\x0D]+"


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that the frame does not have yet, whatever extra columns it carries."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def bind(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once, however many later expressions use them.

    The generator keeps the optimiser from copying a costly expression into each
    of its uses; the outer form keeps it from testing the expression beforehand.
    """
    for name, column in columns.items():
        df = df.select("*", F.explode_outer(F.array(column)).alias(name))
    return df


def words(text: Column) -> Column:
    """Whole text as an array of its words; null counts as empty."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS), "")


def worker_state() -> dict:
    """Objects a Python worker keeps between tasks, such as a loaded tokenizer.

    Shipped code is unpickled anew for each task, so its own globals do not last.
    """
    return sys.modules.setdefault("_ragspark_worker", types.ModuleType("_ragspark_worker")).__dict__
