"""Reversible, session-scoped pseudonymisation as table jobs."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ragspark import fixed
from ragspark.functions.pii import DETECTORS, Detector, assemble, masked
from ragspark.operators.ranking import row_numbers
from ragspark.session import materialise, spread

TURNS_PER_BUCKET = 1024


@dataclass
class Redaction:
    """``texts`` with ``clean_text`` and ``detections`` per row, and the ``vault`` table."""

    texts: DataFrame
    vault: DataFrame


def redact(
    texts: DataFrame,
    detectors: Sequence[Detector] = DETECTORS,
    *,
    turns_per_bucket: int = TURNS_PER_BUCKET,
) -> Redaction:
    """Redact ``texts(session_id, turn, pass_no, text)``; (session_id, turn, pass_no) is unique.

    ``turn`` is an integer and, with ``pass_no``, gives the order in which a session
    saw its texts. Masking runs once, without a shuffle, and is written down; the
    branches below read only the columns they need from that table.

    Token numbers follow first sight within (session, first type). They are
    computed per turn bucket, so one session may hold most of the data. Texts
    without entities never take part in a shuffle.
    """
    marked = materialise(
        spread(texts).withColumn("_m", masked(F.col("text"), detectors)).drop("text").select("*", "_m.*").drop("_m")
        .withColumn("n_entities", F.size("entities"))
    )
    row = ["session_id", "turn", "pass_no"]
    seen = marked.where("n_entities > 0").select(*row, F.explode("entities").alias("e")).select(*row, "e.*")
    vault = materialise(number_tokens(seen, turns_per_bucket))

    tokens = (
        seen.select(*row, "slot", "key")
        .join(vault.select("session_id", "key", "token"), ["session_id", "key"])
        .groupBy(*row).agg(F.map_from_entries(F.collect_list(F.struct("slot", "token"))).alias("_tokens"))
    )
    fill = F.transform("slots", lambda s: F.element_at("_tokens", s))
    kept = [c for c in texts.columns if c != "text"]
    with_entities = (
        marked.where("n_entities > 0").join(tokens, row)
        .select(*kept, assemble(F.col("pieces"), fill).alias("clean_text"), F.col("counts").alias("detections"))
    )
    without = marked.where("n_entities = 0").select(
        *kept, F.element_at("pieces", 1).alias("clean_text"), F.col("counts").alias("detections")
    )
    return Redaction(with_entities.unionByName(without), vault)


def number_tokens(seen: DataFrame, turns_per_bucket: int = TURNS_PER_BUCKET) -> DataFrame:
    """Vault of ``seen(session_id, turn, pass_no, slot, entity_type, value, key)``.

    The key is type-free: a value keeps the type and casing under which the
    session saw it first.
    """
    when = F.struct("turn", "pass_no", "slot")
    first = seen.groupBy("session_id", "key").agg(
        F.min_by(F.struct("entity_type", "value"), when).alias("_f"), F.min(when).alias("_at")
    ).select("session_id", "key", "_f.*", "_at.*")
    numbered = row_numbers(
        first, ["session_id", "entity_type"], F.floor(F.col("turn") / turns_per_bucket),
        [F.col("turn"), F.col("pass_no"), F.col("slot")], "n",
    )
    token = F.concat(F.lit("["), F.col("entity_type"), F.lit("_"), F.col("n").cast("string"), F.lit("]"))
    return numbered.select("session_id", "key", "entity_type", "n", token.alias("token"), "value")


def rehydrate(texts: DataFrame, vault: DataFrame, keys: list[str], column: str = "clean_text") -> DataFrame:
    """Replace vault tokens by their values; tokens the vault does not know stay.

    ``keys`` identify a row and include ``session_id``. The text is cut at its
    tokens, so a value that itself looks like a token is not replaced again.
    """
    pattern = F.lit(fixed.TOKEN_PATTERN)
    found = F.regexp_extract_all(F.col(column), pattern, F.lit(0))
    asked = texts.select(*keys, F.explode(F.array_distinct(found)).alias("token"))
    once = vault.groupBy("session_id", "token").agg(
        F.min("value").alias("value"), F.max("value").alias("_other")
    ).where(F.col("value") == F.col("_other")).drop("_other")
    values = (
        # Should a token have been issued twice, it stays as it is: either value might be wrong.
        asked.join(once, ["session_id", "token"])
        .groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("token", "value"))).alias("_values"))
    )
    has_tokens = F.col(column).rlike(fixed.TOKEN_PATTERN)
    fill = F.transform(found, lambda t: F.coalesce(F.try_element_at(F.col("_values"), t), t))
    pieces = F.split(F.col(column), fixed.TOKEN_PATTERN, -1)
    restored = (
        texts.where(has_tokens).join(values, keys, "left")
        .withColumn("_values", F.coalesce("_values", F.create_map().cast("map<string,string>")))
        .withColumn("rehydrated", assemble(pieces, fill)).drop("_values")
    )
    return restored.unionByName(texts.where(~has_tokens | F.col(column).isNull()).withColumn("rehydrated", F.col(column)))


def detection_totals(texts: DataFrame, keys: list[str], detections: str = "detections") -> DataFrame:
    """Counts per entity type over all passes of a key."""
    return (
        texts.select(*keys, F.explode(detections).alias("d"))
        .groupBy(*keys, F.col("d.entity_type").alias("entity_type")).agg(F.sum("d.count").alias("count"))
    )


def merge_detections(*lists: Column) -> Column:
    """Sum detection arrays of one row per type, sorted by type."""
    every = F.concat(*lists)
    types = F.array_sort(F.array_distinct(F.transform(every, lambda d: d["entity_type"])))
    return F.transform(
        types,
        lambda t: F.struct(
            t.alias("entity_type"),
            F.aggregate(
                F.filter(every, lambda d: d["entity_type"] == t), F.lit(0).cast("long"), lambda n, d: n + d["count"]
            ).alias("count"),
        ),
    )
