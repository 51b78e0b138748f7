"""Execution, schema and temporal features: pure expressions over one event."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _flag(condition: Column) -> Column:
    return condition.cast("int")


def _one_for_zero(value: Column) -> Column:
    return F.when(value == 0, F.lit(1.0)).otherwise(value.cast("double"))


def execution_columns(df: DataFrame) -> list[Column]:
    runtime, retries, rows = df["runtime"], df["retry_count"], df["rows_processed"]
    rows_d, retries_d = rows.cast("double"), retries.cast("double")
    safe_runtime = _one_for_zero(runtime)
    return [
        runtime.cast("double").alias("feat_runtime"),
        retries_d.alias("feat_retry_count"),
        rows_d.alias("feat_rows_processed"),
        F.log1p(rows_d).alias("feat_log_rows_processed"),
        F.log1p(runtime.cast("double")).alias("feat_log_runtime"),
        (rows_d / safe_runtime).alias("feat_rows_per_second"),
        _flag(rows == 0).alias("feat_zero_rows"),
        _flag(runtime < 30).alias("feat_short_runtime"),
        _flag(runtime > 1800).alias("feat_long_runtime"),
        _flag(retries > 2).alias("feat_high_retries"),
        (retries_d / (safe_runtime / F.lit(100.0))).alias("feat_retry_rate"),
        (rows_d / _one_for_zero(retries)).alias("feat_rows_per_retry"),
    ]


def schema_columns(df: DataFrame) -> list[Column]:
    schema, upstream = df["schema_change"], df["upstream_failed"]
    return [
        _flag(schema).alias("feat_schema_change"),
        _flag(upstream).alias("feat_upstream_failed"),
        _flag(schema & upstream).alias("feat_schema_and_upstream"),
        _flag(schema & ~upstream).alias("feat_schema_no_upstream"),
        _flag(~schema & upstream).alias("feat_upstream_no_schema"),
    ]


def temporal_columns(df: DataFrame, ts: str = "timestamp") -> list[Column]:
    hour, day = F.hour(df[ts]), F.weekday(df[ts])
    hour_angle = F.lit(2 * math.pi) * hour / F.lit(24.0)
    day_angle = F.lit(2 * math.pi) * day / F.lit(7.0)
    return [
        hour.alias("feat_hour"),
        day.alias("feat_day_of_week"),
        _flag(day >= 5).alias("feat_is_weekend"),
        _flag((hour >= 9) & (hour < 18)).alias("feat_is_business_hours"),
        F.sin(hour_angle).alias("feat_hour_sin"),
        F.cos(hour_angle).alias("feat_hour_cos"),
        F.sin(day_angle).alias("feat_dow_sin"),
        F.cos(day_angle).alias("feat_dow_cos"),
        F.dayofmonth(df[ts]).alias("feat_day_of_month"),
        _flag((hour < 6) | (hour >= 22)).alias("feat_is_night"),
        F.month(df[ts]).alias("feat_month"),
    ]


EXECUTION = [
    "feat_runtime", "feat_retry_count", "feat_rows_processed", "feat_log_rows_processed",
    "feat_log_runtime", "feat_rows_per_second", "feat_zero_rows", "feat_short_runtime",
    "feat_long_runtime", "feat_high_retries", "feat_retry_rate", "feat_rows_per_retry",
]
SCHEMA = [
    "feat_schema_change", "feat_upstream_failed", "feat_schema_and_upstream",
    "feat_schema_no_upstream", "feat_upstream_no_schema",
]
TEMPORAL = [
    "feat_hour", "feat_day_of_week", "feat_is_weekend", "feat_is_business_hours",
    "feat_hour_sin", "feat_hour_cos", "feat_dow_sin", "feat_dow_cos", "feat_day_of_month",
    "feat_is_night", "feat_month",
]
LAG = ["feat_lag_seconds", "feat_is_burst"]


def utc_timestamp(text: Column) -> Column:
    """ISO-8601 text to a UTC timestamp; unreadable text gives null."""
    return F.try_to_timestamp(text)
