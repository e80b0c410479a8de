"""Unique keys over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.typed import column


def unique_violations(df: DataFrame, key: str) -> DataFrame:
    """``key, n`` of the keys that more than one row has. Null is a key like any other."""
    parts = key.split(".")
    c = column(parts[0])
    for p in parts[1:]:
        c = c.getField(p)
    return df.groupBy(c.alias("key")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def clustered(df: DataFrame, key: str, partitions: int | None = None) -> DataFrame:
    """``df`` laid out by a key, so that the statistics of files and row groups let scans skip most of them."""
    c = column(key)
    out = df.repartitionByRange(partitions, c) if partitions else df.repartitionByRange(c)
    return out.sortWithinPartitions(c)
