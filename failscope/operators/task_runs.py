"""Task runs to failure events: clamps, text heuristics, failed siblings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from failscope import constants as K
from failscope.functions.text import contains_any
from failscope.functions.times import moment


def _seconds(start: Column, end: Column) -> Column:
    return F.timestamp_diff("SECOND", start, end)


def failed_sibling(runs: DataFrame) -> DataFrame:
    """Add ``sibling_failed``: another task of the same run has failed.

    A run's failed tasks are reduced to their smallest and largest id: one of the
    two differs from a given task exactly when some other task failed. No pairs of
    tasks are formed, whatever the size of a run.
    """
    failed = F.when(F.col("state") == "failed", F.col("task_id"))
    per_run = runs.groupBy("run_id").agg(
        F.min(failed).alias("first_failed"), F.max(failed).alias("last_failed"))
    joined = runs.join(per_run.where("first_failed IS NOT NULL"), "run_id", "left")
    other = (F.col("first_failed") != F.col("task_id")) | (F.col("last_failed") != F.col("task_id"))
    return joined.withColumn("sibling_failed", F.coalesce(other, F.lit(False))).drop(
        "first_failed", "last_failed")


def schema_change_hint(log: Column, short: bool = False) -> Column:
    return contains_any(F.lower(log), K.SCHEMA_CHANGE_HINTS_SHORT if short else K.SCHEMA_CHANGE_HINTS)


def upstream_hint(log: Column, short: bool = False) -> Column:
    return contains_any(F.lower(log), K.UPSTREAM_HINTS_SHORT if short else K.UPSTREAM_HINTS)


def task_run_events(runs: DataFrame, as_of, extra: list[str] | None = None) -> DataFrame:
    """One failure event per task run; ``as_of`` stands in for a missing end time."""
    log = F.coalesce(F.when(F.col("exception") != "", F.col("exception")),
                     F.lit(K.NO_EXCEPTION_TEXT))
    seconds = _seconds(F.col("start_date"), F.coalesce(F.col("end_date"), moment(runs, "end_date", as_of)))
    return failed_sibling(runs).select(
        *(extra or []),
        F.coalesce("dag_id", F.lit("unknown_dag")).alias("pipeline_name"),
        F.coalesce("task_id", F.lit("unknown_task")).alias("task_name"),
        F.greatest(F.coalesce(seconds, F.lit(0)), F.lit(0)).cast("int").alias("runtime"),
        F.least(F.greatest(F.coalesce(F.col("try_number") - 1, F.lit(0)), F.lit(0)), F.lit(10))
        .alias("retry_count"),
        F.lit(0).alias("rows_processed"),
        schema_change_hint(log).alias("schema_change"),
        (upstream_hint(log) | F.col("sibling_failed")).alias("upstream_failed"),
        F.substring(log, 1, K.ERROR_LOG_LIMIT).alias("error_log"),
    )
