"""Ratios, F1, prices and hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ragspark import fixed


def ratio(num: Column, den: Column) -> Column:
    """num / den, 0.0 for an empty or missing denominator."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def f1(precision: Column, recall: Column) -> Column:
    return ratio(precision * recall * 2, precision + recall)


def share(flag: Column) -> Column:
    """Aggregate: share of rows where the flag holds, 0.0 over no rows."""
    return F.coalesce(F.avg(F.when(flag, 1.0).otherwise(0.0)), F.lit(0.0))


def model_id(name: Column) -> Column:
    """Resolve a preset name to a model id; other names stay."""
    presets = F.create_map(*[F.lit(x) for kv in fixed.MODEL_PRESETS.items() for x in kv])
    return F.coalesce(F.try_element_at(presets, name), name)


def call_cost(model: Column, input_tokens: Column, output_tokens: Column, prices=None) -> Column:
    """Cost of one call. The price table is a literal map: it is a handful of models."""
    prices = prices or fixed.TOKEN_PRICES
    def table(i):
        return F.create_map(*[F.lit(x) for m, p in prices.items() for x in (m, float(p[i]))])
    def price(i):
        return F.coalesce(F.try_element_at(table(i), model), F.lit(0.0))
    return (
        F.coalesce(input_tokens, F.lit(0)) / 1000 * price(0)
        + F.coalesce(output_tokens, F.lit(0)) / 1000 * price(1)
    )


def usage(source: Column) -> Column:
    """Token usage with zero defaults from a struct that has the service's field names."""
    def field(name):
        return F.coalesce(source[name].cast("long"), F.lit(0).cast("long"))
    return F.struct(
        field("inputTokens").alias("input_tokens"),
        field("outputTokens").alias("output_tokens"),
        field("totalTokens").alias("total_tokens"),
    )


def keyed_hash(text: Column, key: bytes) -> Column:
    """HMAC-SHA256 in hex, composed from ``sha2`` so that it stays in generated code."""
    import hashlib

    block = hashlib.sha256(key).digest() if len(key) > 64 else key
    block = block.ljust(64, b"\0")
    inner = F.lit(bytearray(b ^ 0x36 for b in block))
    outer = F.lit(bytearray(b ^ 0x5C for b in block))
    digest = F.sha2(F.concat(inner, F.encode(text, "UTF-8")), 256)
    return F.sha2(F.concat(outer, F.unhex(digest)), 256)
