"""Queries: streaming jobs over the events table; each must equal its batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from failscope.functions.times import as_instant
from failscope.operators import validation as V
from failscope.plans import derived as D
from failscope.plans import oracle_text as O
from failscope.plans.contracts import CHECKED
from failscope.plans.features import _rounded
from failscope.plans.registry import query
from failscope.session import new_path
from failscope.streaming import jobs as S


def _event_stream(spark: SparkSession, folder: str) -> DataFrame:
    schema = D.table(spark, folder, "events").schema
    return S.read_stream(spark, folder, schema, "events.parquet")


def _timed(df: DataFrame, ts: str) -> DataFrame:
    """Event time as an instant, which watermarks need."""
    return df.withColumn(ts, as_instant(F.col(ts)))


@query("stream_valid", D.with_tables("raw_events", CHECKED, select=f"""
SELECT event_id, {O.strip('pipeline_name')} AS pipeline_name, root_cause, event_timestamp
FROM checked WHERE len(errors) = 0"""))
def q_valid(spark: SparkSession, folder: str) -> DataFrame:
    events = D._over(spark, D.RAW_EVENTS, failure_events=D.failure_events_from(
        _event_stream(spark, folder)))
    base = new_path(spark, "stream-validate")
    S.validate_stream(
        events, V.event_rules("event_timestamp"), f"{base}/valid", f"{base}/invalid",
        f"{base}/checkpoint").awaitTermination()
    return S.read_sink(spark, f"{base}/valid", events.schema).select(
        "event_id", "pipeline_name", "root_cause", "event_timestamp")


@query("stream_invalid", D.with_tables("raw_events", CHECKED, select="""
SELECT event_id, array_to_string(errors, '; ') AS errors FROM checked WHERE len(errors) > 0"""))
def q_invalid(spark: SparkSession, folder: str) -> DataFrame:
    events = D._over(spark, D.RAW_EVENTS, failure_events=D.failure_events_from(
        _event_stream(spark, folder)))
    base = new_path(spark, "stream-validate")
    S.validate_stream(
        events, V.event_rules("event_timestamp"), f"{base}/valid", f"{base}/invalid",
        f"{base}/checkpoint").awaitTermination()
    schema = T.StructType(events.schema.fields + [
        T.StructField("errors", T.ArrayType(T.StringType()))])
    return S.read_sink(spark, f"{base}/invalid", schema).select(
        "event_id", F.array_join("errors", "; ").alias("errors"))


@query("stream_lag", D.with_tables("failure_events", select=O.lag_select()))
def q_lag(spark: SparkSession, folder: str) -> DataFrame:
    events = _timed(D.failure_events_from(_event_stream(spark, folder)), "event_timestamp")
    events = events.select(
        "event_id", "pipeline_name", F.col("event_timestamp").alias("timestamp"))
    base = new_path(spark, "stream-lag")
    S.lag_stream(events, f"{base}/out", f"{base}/state", f"{base}/checkpoint").awaitTermination()
    schema = T.StructType([
        T.StructField("event_id", T.LongType()), T.StructField("feat_lag_seconds", T.DoubleType()),
        T.StructField("feat_is_burst", T.IntegerType())])
    return _rounded(S.read_sink(spark, f"{base}/out", schema).drop("batch"))


def _prediction_stream(spark: SparkSession, folder: str) -> DataFrame:
    events = D.failure_events_from(_event_stream(spark, folder))
    return _timed(D._over(spark, D.PREDICTIONS, failure_events=events), "created_at")


@query("stream_trend", D.with_tables("predictions", select="""
SELECT strftime(created_at, '%Y-%m-%d') AS date, predicted_root_cause AS root_cause,
  count(*) AS count FROM predictions GROUP BY 1, 2"""))
def q_trend(spark: SparkSession, folder: str) -> DataFrame:
    base = new_path(spark, "stream-trend")
    S.trend_stream(
        _prediction_stream(spark, folder), f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return S.read_trend(spark, f"{base}/out")


@query("stream_once", D.with_tables("predictions", select="""
SELECT failure_id, pipeline_name, predicted_root_cause, confidence FROM predictions"""))
def q_once(spark: SparkSession, folder: str) -> DataFrame:
    """Every prediction arrives twice in the stream; one of each is kept."""
    stream = _prediction_stream(spark, folder)
    twice = stream.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    base = new_path(spark, "stream-once")
    S.once_per_failure(twice, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out").select(
        "failure_id", "pipeline_name", "predicted_root_cause", "confidence")
