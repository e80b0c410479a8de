"""Distinct values of a path."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.typed import column, compile_filter


def distinct(df: DataFrame, key: str, filter: Mapping | None = None, seq: Sequence[str] = ()) -> DataFrame:
    """One column ``value``: the different values of a path through documents.

    An array at its end gives its elements; arrays on the way give nothing; an empty array gives nothing.
    With ``seq``, values stand in the order in which they first occur.
    """
    if filter:
        df = df.filter(compile_filter(df, filter))
    c, t = None, df.schema
    for name in key.split("."):
        found = next((f for f in t.fields if f.name == name), None) if isinstance(t, T.StructType) else None
        if found is None:
            return df.select(F.lit(None).cast("string").alias("value")).filter("false")
        c, t = column(name) if c is None else c.getField(name), found.dataType
    order = F.struct(*[column(s) for s in seq]) if seq else F.lit(0)
    values = F.explode(c) if isinstance(t, T.ArrayType) else c
    rows = df.select(values.alias("value"), order.alias("at"))
    if not seq:
        return rows.select("value").distinct()
    return rows.groupBy("value").agg(F.min("at").alias("at")).orderBy("at").select("value")
