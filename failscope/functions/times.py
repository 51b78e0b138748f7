"""Time literals of a column's own type, so that filters reach the scan uncast."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def moment(df: DataFrame, column: str, value: datetime) -> Column:
    if isinstance(df.schema[column].dataType, T.TimestampNTZType):
        return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")
    return F.lit(value)


def as_instant(ts: Column) -> Column:
    """A timestamp without a zone read as UTC (the pinned session zone)."""
    return ts.cast("timestamp")
