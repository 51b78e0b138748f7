"""Queries: log signals, event features, lag, feature quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from failscope.functions import event_features as E
from failscope.functions.log_signals import SIGNALS, signals, with_signals
from failscope.operators.lag import with_lag
from failscope.plans import oracle_text as O
from failscope.plans.derived import failure_events, timed_events, with_tables
from failscope.plans.registry import query


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round doubles so that both engines print the same digits."""
    return df.select(*[
        (F.round(F.col(f"`{n}`"), digits) + F.lit(0.0)).alias(n) if t == "double"
        else F.col(f"`{n}`")
        for n, t in df.dtypes])


@query("failure_events", with_tables("failure_events", select="SELECT * FROM failure_events"))
def q_failure_events(spark: SparkSession, folder: str) -> DataFrame:
    return failure_events(spark, folder)


@query("log_signals", with_tables(
    "failure_events", select=O.log_signal_select("event_id", "failure_events")))
def q_log_signals(spark: SparkSession, folder: str) -> DataFrame:
    events = failure_events(spark, folder, heavy=True)
    return _rounded(signals(events, "event_id"))


@query("execution_features", with_tables(
    "failure_events", select=f"SELECT event_id,{O.execution_select()} FROM failure_events"))
def q_execution(spark: SparkSession, folder: str) -> DataFrame:
    events = failure_events(spark, folder)
    return _rounded(events.select("event_id", *E.execution_columns(events)))


@query("schema_features", with_tables(
    "failure_events", select=f"SELECT event_id,{O.schema_select()} FROM failure_events"))
def q_schema(spark: SparkSession, folder: str) -> DataFrame:
    events = failure_events(spark, folder)
    return events.select("event_id", *E.schema_columns(events))


@query("temporal_features", with_tables(
    "failure_events",
    select=f"SELECT event_id,{O.temporal_select('event_timestamp')} FROM failure_events"))
def q_temporal(spark: SparkSession, folder: str) -> DataFrame:
    events = failure_events(spark, folder)
    return _rounded(events.select("event_id", *E.temporal_columns(events, "event_timestamp")))


@query("lag_burst", with_tables("failure_events", select=O.lag_select()))
def q_lag(spark: SparkSession, folder: str) -> DataFrame:
    events = timed_events(spark, folder).select("event_id", "pipeline_name", "timestamp")
    return _rounded(with_lag(events).select("event_id", *E.LAG))


def event_matrix(spark: SparkSession, folder: str) -> DataFrame:
    """The 53 feature columns that need no fitted vocabulary, in fixed order."""
    events = with_signals(with_lag(timed_events(spark, folder, heavy=True)))
    return events.select(
        "event_id",
        *E.execution_columns(events), *E.schema_columns(events), *E.temporal_columns(events),
        *E.LAG, *SIGNALS)


MATRIX = E.EXECUTION + E.SCHEMA + E.TEMPORAL + E.LAG + SIGNALS

MATRIX_CTE = f"""matrix AS (
SELECT l.event_id, {", ".join(f"x.{c}" for c in E.EXECUTION + E.SCHEMA + E.TEMPORAL)},
  g.feat_lag_seconds, g.feat_is_burst, {", ".join(f"l.{c}" for c in SIGNALS)}
FROM ({O.log_signal_select("event_id", "failure_events")}) l
JOIN (SELECT event_id,{O.execution_select()},{O.schema_select()},{O.temporal_select('event_timestamp')}
      FROM failure_events) x ON l.event_id = x.event_id
JOIN ({O.lag_select()}) g ON l.event_id = g.event_id)"""


@query("feature_matrix", with_tables("failure_events", MATRIX_CTE, select="SELECT * FROM matrix"))
def q_matrix(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(event_matrix(spark, folder))
