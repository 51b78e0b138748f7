"""Queries: monitoring roll-ups, feeds and dataset profile."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from failscope import constants as K
from failscope.functions.log_signals import SIGNALS, signals
from failscope.functions.text import stripped
from failscope.operators import rollups as R
from failscope.plans import oracle_text as O
from failscope.plans.derived import (
    contributions, failure_events, latest, pod_logs, predictions, with_tables,
)
from failscope.plans.features import _rounded
from failscope.plans.registry import query
from failscope.sources.tables import matching

DAYS = 7
_EXACT = f"created_at >= (SELECT max(created_at) FROM predictions) - INTERVAL {DAYS} DAY"
_CALENDAR = (
    "strftime(created_at, '%Y-%m-%d') >= "
    f"strftime((SELECT max(created_at) FROM predictions) - INTERVAL {DAYS} DAY, '%Y-%m-%d')")


def _recent(spark: SparkSession, folder: str, calendar: bool = False) -> DataFrame:
    preds = predictions(spark, folder)
    keep = R.within_calendar_days if calendar else R.within_days
    return keep(preds, latest(preds, "created_at"), DAYS)


@query("cause_signal_profile", with_tables("failure_events", select=f"""
SELECT e.root_cause, count(*) AS count,
  {", ".join(f"round(avg(CAST(s.{n} AS DOUBLE)), 6) AS avg_{n}" for n in SIGNALS)}
FROM ({O.log_signal_select("event_id", "failure_events")}) s
JOIN failure_events e ON e.event_id = s.event_id GROUP BY e.root_cause"""))
def q_profile(spark: SparkSession, folder: str) -> DataFrame:
    rows = signals(failure_events(spark, folder, heavy=True), "root_cause")
    return _rounded(R.cause_signal_profile(rows, "root_cause", SIGNALS))


@query("time_window_filter", with_tables("predictions", select=f"""
SELECT failure_id, created_at FROM predictions WHERE {_EXACT}"""))
def q_window(spark: SparkSession, folder: str) -> DataFrame:
    return _recent(spark, folder).select("failure_id", "created_at")


@query("calendar_window_filter", with_tables("predictions", select=f"""
SELECT failure_id, created_at FROM predictions WHERE {_CALENDAR}"""))
def q_calendar(spark: SparkSession, folder: str) -> DataFrame:
    return _recent(spark, folder, True).select("failure_id", "created_at")


@query("root_cause_distribution", with_tables("predictions", select=f"""
SELECT predicted_root_cause AS root_cause, count(*) AS count FROM predictions
WHERE {_EXACT} GROUP BY 1"""))
def q_distribution(spark: SparkSession, folder: str) -> DataFrame:
    return R.root_cause_distribution(_recent(spark, folder))


@query("prediction_stats", with_tables("predictions", select=f"""
SELECT CAST(sum(n) AS BIGINT) AS total_predictions, round(sum(s) / sum(n), 4) AS avg_confidence,
  arg_min(cause, (-n, cause)) AS most_common_root_cause, {DAYS} AS period_days
FROM (SELECT predicted_root_cause AS cause, count(*) AS n, sum(confidence) AS s
      FROM predictions WHERE {_EXACT} GROUP BY 1) g"""))
def q_stats(spark: SparkSession, folder: str) -> DataFrame:
    return R.prediction_stats(_recent(spark, folder), DAYS)


TREND_SQL = f"""
SELECT strftime(created_at, '%Y-%m-%d') AS date, predicted_root_cause AS root_cause,
  count(*) AS count FROM predictions WHERE {_CALENDAR} GROUP BY 1, 2"""


@query("failure_trend", with_tables("predictions", select=TREND_SQL))
def q_trend(spark: SparkSession, folder: str) -> DataFrame:
    return R.failure_trend(_recent(spark, folder, True))


_CELLS = ", ".join(
    f"""count(*) FILTER (predicted_root_cause = '{c}') AS "{c}\"""" for c in K.ROOT_CAUSES)


@query("pipeline_heatmap", with_tables("predictions", select=f"""
SELECT pipeline_name, {_CELLS} FROM predictions WHERE {_CALENDAR} GROUP BY pipeline_name"""))
def q_heatmap(spark: SparkSession, folder: str) -> DataFrame:
    return R.pipeline_heatmap(_recent(spark, folder, True))


@query("confidence_box", with_tables("predictions", select="""
SELECT root_cause, n, round(p[1], 6) AS low, round(p[2], 6) AS q1, round(p[3], 6) AS median,
  round(p[4], 6) AS q3, round(p[5], 6) AS high
FROM (SELECT predicted_root_cause AS root_cause, count(*) AS n,
        quantile_cont(confidence, [0, 0.25, 0.5, 0.75, 1]) AS p
      FROM predictions GROUP BY 1) s"""))
def q_box(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(R.confidence_spread(predictions(spark, folder)))


@query("confidence_kpis", with_tables("predictions", select=f"""
SELECT count(*) AS shown, round(avg(confidence), 6) AS avg_confidence,
  min(confidence) AS min_confidence, count(*) FILTER (confidence >= 0.8) AS high_confidence,
  round(CAST(count(*) FILTER (confidence >= 0.8) AS DOUBLE) / count(*), 6) AS high_share
FROM predictions WHERE {_EXACT}"""))
def q_kpis(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(R.confidence_kpis(_recent(spark, folder)))


def _describe_sql(c: str) -> str:
    return f"""
SELECT '{c}' AS "column", count({c}) AS n, round(avg({c}), 4) AS mean,
  round(stddev_samp({c}), 4) AS std, CAST(min({c}) AS DOUBLE) AS low,
  CAST(max({c}) AS DOUBLE) AS high,
  round(quantile_cont(CAST({c} AS DOUBLE), 0.25), 4) AS q1,
  round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 4) AS median,
  round(quantile_cont(CAST({c} AS DOUBLE), 0.75), 4) AS q3 FROM measured"""


@query("dataset_profile", with_tables("failure_events", """
measured AS (SELECT runtime, rows_processed, CAST(rows_processed AS DOUBLE) / (runtime + 1) AS pace,
  CAST(runtime AS BIGINT) * 3000000000 AS nanos FROM failure_events)""",
    select=" UNION ALL ".join(map(_describe_sql, ("runtime", "rows_processed", "pace", "nanos")))))
def q_describe(spark: SparkSession, folder: str) -> DataFrame:
    events = failure_events(spark, folder).select(
        "runtime", "rows_processed",
        (F.col("rows_processed").cast("double") / (F.col("runtime") + 1)).alias("pace"),
        (F.col("runtime").cast("bigint") * 3_000_000_000).alias("nanos"))
    return _rounded(R.describe(events, events.columns), 4)


@query("flag_rates", with_tables("failure_events", select="""
SELECT round(avg(CAST(schema_change AS INTEGER)), 6) AS schema_change_rate,
  round(avg(CAST(upstream_failed AS INTEGER)), 6) AS upstream_failed_rate FROM failure_events"""))
def q_flags(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(R.flag_rates(failure_events(spark, folder)))


@query("label_distribution", with_tables("failure_events", select="""
SELECT root_cause, count(*) AS count FROM failure_events GROUP BY root_cause"""))
def q_labels(spark: SparkSession, folder: str) -> DataFrame:
    return R.value_counts(failure_events(spark, folder), "root_cause")


@query("feature_groups", with_tables("contributions", select="""
SELECT count(*) FILTER (feature LIKE 'feat\\_%' ESCAPE '\\') AS execution,
  count(*) FILTER (feature NOT LIKE 'feat\\_%' ESCAPE '\\' AND feature NOT LIKE 'tfidf\\_%' ESCAPE '\\') AS log_signals,
  count(*) FILTER (feature LIKE 'tfidf\\_%' ESCAPE '\\') AS tfidf, count(*) AS total
FROM (SELECT DISTINCT feature FROM contributions) d"""))
def q_groups(spark: SparkSession, folder: str) -> DataFrame:
    return R.feature_groups(contributions(spark, folder))


@query("log_volume", with_tables("pod_logs", select=f"""
SELECT date_key, count(DISTINCT pod_name) AS pods, count(*) AS messages
FROM pod_logs WHERE {O.strip('content')} <> '' GROUP BY date_key"""))
def q_volume(spark: SparkSession, folder: str) -> DataFrame:
    return R.log_volume(pod_logs(spark, folder).where(stripped(F.col("content")) != ""))


@query("recent_failures", with_tables("failure_events", select="""
SELECT event_id, pipeline_name, event_timestamp FROM failure_events
WHERE pipeline_name = 'analytics_pipeline' ORDER BY event_timestamp DESC, event_id LIMIT 50"""))
def q_recent_failures(spark: SparkSession, folder: str) -> DataFrame:
    rows = matching(failure_events(spark, folder), pipeline_name="analytics_pipeline")
    return R.newest(rows, 50, "event_timestamp", "event_id").select(
        "event_id", "pipeline_name", "event_timestamp")


@query("recent_predictions", with_tables("predictions", select="""
SELECT failure_id, pipeline_name, predicted_root_cause, confidence, model_version, created_at
FROM predictions WHERE predicted_root_cause = 'API Failure'
ORDER BY created_at DESC, failure_id LIMIT 50"""))
def q_recent_predictions(spark: SparkSession, folder: str) -> DataFrame:
    rows = matching(
        predictions(spark, folder), pipeline_name=None, predicted_root_cause="API Failure")
    return R.newest(rows.drop("actual_root_cause"), 50, "created_at", "failure_id")


@query("min_confidence_feed", with_tables("predictions", select="""
SELECT * FROM (SELECT failure_id, pipeline_name, confidence FROM predictions
  ORDER BY created_at DESC, failure_id LIMIT 100) f WHERE confidence >= 0.8"""))
def q_min_confidence(spark: SparkSession, folder: str) -> DataFrame:
    feed = R.newest(predictions(spark, folder), 100, "created_at", "failure_id")
    return R.confident(feed, 0.8).select("failure_id", "pipeline_name", "confidence")


@query("prediction_feed", with_tables("predictions", select="""
SELECT failure_id, pipeline_name AS pipeline, predicted_root_cause AS root_cause,
  format('{:.1f}%', confidence * 100.0::DOUBLE) AS confidence, model_version AS model,
  strftime(created_at, '%Y-%m-%d %H:%M') AS timestamp FROM predictions"""))
def q_feed(spark: SparkSession, folder: str) -> DataFrame:
    preds = predictions(spark, folder)
    feed = R.prediction_feed(preds)
    return preds.select("failure_id", *[
        c.alias(n) for c, n in zip(_feed_columns(), feed.columns)])


def _feed_columns():
    from failscope.functions.numbers import percent_text

    return [F.col("pipeline_name"), F.col("predicted_root_cause"), percent_text(F.col("confidence")),
            F.col("model_version"), F.date_format("created_at", "yyyy-MM-dd HH:mm")]


@query("failure_prediction_join", with_tables("predictions", select="""
SELECT f.event_id, f.pipeline_name, f.root_cause, p.predicted_root_cause, p.confidence,
  p.model_version FROM failure_events f
LEFT JOIN (SELECT * FROM predictions WHERE model_version = 'v1') p ON p.failure_id = f.event_id"""))
def q_join(spark: SparkSession, folder: str) -> DataFrame:
    stored = matching(predictions(spark, folder), model_version="v1")
    failures = failure_events(spark, folder).select("event_id", "pipeline_name", "root_cause")
    return R.failures_with_predictions(failures, stored)
