"""Queries on the driver tables."""

from ragspark.queries import corpus, curation, evaluation, redaction, references, retrieval, runs  # noqa: F401
from ragspark.queries.registry import ORACLES, QUERIES  # noqa: F401
