"""Retrieval, redaction and evaluation jobs expressed as Spark DataFrames."""
