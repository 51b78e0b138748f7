"""Seconds since the previous failure of the same pipeline, and the burst flag."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from failscope import constants as K


def _micros(ts: Column) -> Column:
    """Microseconds since 1970; works for timestamps with and without a time zone."""
    origin = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", origin, ts.cast("timestamp_ntz"))


def lag_table(
    events: DataFrame, ts: str = "timestamp", key: str = "pipeline_name", id: str = "event_id",
    earlier: DataFrame | None = None,
) -> DataFrame:
    """One row per distinct (key, time): the first event's id and the raw lag.

    A plain window over ``key`` would put a whole pipeline into one task. Here the
    events collapse to distinct times first (map-side), and the previous time is
    found in two windows of bounded size: over the microseconds of one minute, and
    over the minutes of one pipeline. Both bounds come from the calendar, not from
    the data. Events that share a time come after the first one with lag 0, so
    they need no row here. ``earlier`` (key, time) holds times already seen.
    """
    seen = events.select(
        F.col(key).alias("k"), _micros(F.col(ts)).alias("us"), F.col(id).alias("id"),
        F.lit(False).alias("known"))
    if earlier is not None:
        seen = seen.unionByName(earlier.select(
            F.col(key).alias("k"), _micros(F.col(ts)).alias("us"),
            F.lit(None).cast(events.schema[id].dataType).alias("id"), F.lit(True).alias("known")))
    times = (
        seen.groupBy("k", "us").agg(F.min("id").alias("id"), F.max("known").alias("known"))
        .withColumn("minute", F.floor(F.col("us") / F.lit(60_000_000)))
    )
    inner = Window.partitionBy("k", "minute").orderBy("us")
    times = times.withColumn("before", F.lag("us").over(inner))
    minutes = times.groupBy("k", "minute").agg(F.max("us").alias("last"))
    minutes = minutes.select(
        "k", "minute",
        F.lag("last").over(Window.partitionBy("k").orderBy("minute")).alias("before_minute"))
    lagged = times.join(minutes, ["k", "minute"]).withColumn(
        "before", F.coalesce("before", "before_minute"))
    return lagged.where(~F.col("known")).select(
        F.col("id").alias(id),
        ((F.col("us") - F.col("before")).cast("double") / F.lit(1e6)).alias("raw_lag"),
        F.lit(True).alias("first_at_time"))


def lag_columns() -> list[Column]:
    """Both features, from the columns of ``lag_table`` joined by event id."""
    raw = F.when(F.col("first_at_time"), F.col("raw_lag")).otherwise(F.lit(0.0))
    return [
        F.coalesce(raw, F.lit(0.0)).alias("feat_lag_seconds"),
        F.coalesce((raw < K.BURST_SECONDS).cast("int"), F.lit(0)).alias("feat_is_burst"),
    ]


def with_lag(
    events: DataFrame, ts: str = "timestamp", key: str = "pipeline_name", id: str = "event_id",
    earlier: DataFrame | None = None,
) -> DataFrame:
    """Add both features; events join their lag by the unique event id, so no key is hot."""
    joined = events.join(lag_table(events, ts, key, id, earlier), id, "left")
    return joined.select(*[events[c] if c != id else F.col(id) for c in events.columns],
                         *lag_columns())
