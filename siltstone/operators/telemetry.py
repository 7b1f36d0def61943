"""Counts and sizes of a log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_kind(entries: DataFrame) -> DataFrame:
    """(kind, entries, key_bytes, value_bytes, first_seq, last_seq)."""
    return entries.groupBy("kind").agg(
        F.count("*").alias("entries"),
        F.sum(F.octet_length("key")).alias("key_bytes"),
        F.coalesce(F.sum(F.octet_length("value")), F.lit(0)).alias("value_bytes"),
        F.min("seq").alias("first_seq"),
        F.max("seq").alias("last_seq"),
    )
