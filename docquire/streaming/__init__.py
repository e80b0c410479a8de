"""Filters and projections on streaming DataFrames.

Compiled filters are ordinary columns, so they run on streams as they do on tables; sorts, skips and limits don't.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from ..operators.find import Projection
from ..plans.typed import column, compile_filter


def watch(stream: DataFrame, filter: Mapping | None = None, projection: Mapping | Sequence | None = None) -> DataFrame:
    """The rows of a stream that pass a filter, in the fields of a projection."""
    rows = stream.filter(compile_filter(stream, filter)) if filter else stream
    return rows.select(*[column(n) for n in Projection.of(projection).fields(stream.columns)])
