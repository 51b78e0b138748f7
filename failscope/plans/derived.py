"""Failure tables derived from the given tables.

Each text is portable: the Spark side runs it over a view, the checking side
uses the same text as a common table expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from failscope.session import spread

PIPELINES = [
    "atlas_tiles", "barge_manifest", "beacon_reads", "cellar_stock", "cinema_listing",
    "coral_survey", "dairy_yield", "dock_schedule", "ferry_tickets", "forest_census",
    "glacier_melt", "harbour_tides", "hive_counts", "kiln_firing", "lagoon_sonar",
    "lantern_sales", "library_loans", "market_stalls", "meadow_pollen", "mill_output",
    "museum_entry", "orchard_picking", "parcel_rounds", "quarry_loads", "quay_cranes",
    "reef_imaging", "river_gauges", "saddle_orders", "timber_grading", "tram_delays",
]
TASKS = [
    "weigh", "sort", "grade", "count_in", "count_out", "measure", "stamp", "unpack", "label",
    "compare", "tally", "inspect", "dispatch", "archive", "settle",
]
#: Log texts by kind; {pod}, {n} and {q} (a quote) are filled in for each event.
LOGS = {
    "resource": [
        "MemoryError: no room for {n}.25 GiB, the OOM killer ended the worker",
        "ResourceError: cgroup limit of {pod} reached, CPU throttled for {n} s",
        "Killed: {pod} went over its memory limit of {n}Mi and was evicted",
        "DiskFullError: volume of {pod} at 100% capacity, could not write /scratch/{n}.csv",
    ],
    "api": [
        "HTTPError: 503 Service Unavailable from {pod} after {n} tries",
        "ConnectionError: max retries exceeded for {pod}:9200",
        "TimeoutError: call to {pod} timed out after {n}s",
        "HTTPError: 429 Too Many Requests, {pod} asks to wait, rate limit exceeded",
    ],
    "dependency": [
        "DependencyError: upstream {pod} not responding, network delay of {n} ms",
        "ConnectionTimeout: packet loss towards {pod}, service unreachable",
        "UpstreamFailure: {pod} ended with status=FAILED, nothing to read",
        "DependencyError: sensor gave up on {pod}, timed out after {n} seconds",
    ],
    "schema": [
        "KeyError: column {q}berth{q} not found, expected schema does not match",
        "SchemaValidationError: expected {n} columns but received 7, missing: [berth, tide]",
        "ValidationError: field mapping of {pod} changed",
        "SchemaError: column dtype mismatch on {pod}, int64 read as text",
    ],
    "quality": [
        "DataQualityError: {n}% of rows failed null checks on {q}weight_kg{q}",
        "ValueError: {n} rows hold a negative {q}weight_kg{q}",
        "DataQualityError: {n} duplicate keys in berths",
        "DataQualityError: stale partition, invalid format in range check",
    ],
    "missing": [
        "FileNotFoundError: s3://quay/{pod}/{n}.parquet does not exist",
        "EmptyDataError: 0 rows, partition not ready",
        "FileNotFoundError: /var/quay/{pod}.csv missing",
        "SourceUnavailable: 0 bytes read, no partition found",
    ],
}


def _pick(texts: list[str], separator: str, number: str) -> str:
    """SQL: the text of a 1-based number."""
    return f"split_part('{separator.join(texts)}', '{separator}', {number})"


FAILURE_EVENTS = f"""
WITH b AS (
  SELECT event_id, user_id, event_type, value, ts,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k,
         CAST(event_id % 4 + 1 AS INT) AS t
  FROM events)
SELECT event_id,
  {_pick(PIPELINES, ',', f'CAST(user_id % {len(PIPELINES)} + 1 AS INT)')} AS pipeline_name,
  {_pick(TASKS, ',', f'CAST(event_id % {len(TASKS)} + 1 AS INT)')} AS task_name,
  CAST(floor(value * 20) AS INT) AS runtime,
  CAST(event_id % 11 AS INT) AS retry_count,
  CASE WHEN k < 30 THEN 0 ELSE k * 1000 END AS rows_processed,
  (event_type = 'signup' OR k % 17 = 0) AS schema_change,
  (event_type = 'view' OR k % 13 = 0) AS upstream_failed,
  replace(replace(replace(CASE
    WHEN event_type = 'error' THEN {_pick(LOGS['resource'], '|', 't')}
    WHEN event_type = 'click' THEN {_pick(LOGS['api'], '|', 't')}
    WHEN event_type = 'view' THEN {_pick(LOGS['dependency'], '|', 't')}
    WHEN event_type = 'signup' THEN {_pick(LOGS['schema'], '|', 't')}
    WHEN k % 2 = 0 THEN {_pick(LOGS['quality'], '|', 't')}
    ELSE {_pick(LOGS['missing'], '|', 't')}
  END, '{{pod}}', concat('pod-', CAST(user_id AS VARCHAR(20)))), '{{n}}', CAST(k AS VARCHAR(20))), '{{q}}', chr(39)) AS error_log,
  CASE WHEN event_type = 'error' THEN 'Resource Exhaustion' WHEN event_type = 'click' THEN 'API Failure'
       WHEN event_type = 'view' THEN 'Dependency Failure' WHEN event_type = 'signup' THEN 'Schema Change'
       WHEN k % 2 = 0 THEN 'Data Quality Issue' ELSE 'Missing Data' END AS root_cause,
  ts AS event_timestamp
FROM b
"""

# Rows that break one rule each, for the validation queries.
RAW_EVENTS = """
SELECT event_id,
  CASE WHEN event_id % 20 = 3 THEN '   ' WHEN event_id % 20 = 8 THEN concat('  ', pipeline_name, ' ') ELSE pipeline_name END AS pipeline_name,
  CASE WHEN event_id % 20 = 9 THEN NULL ELSE task_name END AS task_name,
  CASE WHEN event_id % 20 = 1 THEN -1 ELSE runtime END AS runtime,
  CASE WHEN event_id % 20 IN (1, 2) THEN 11 ELSE retry_count END AS retry_count,
  rows_processed,
  CASE WHEN event_id % 20 = 7 THEN NULL ELSE schema_change END AS schema_change,
  upstream_failed,
  CASE WHEN event_id % 20 = 5 THEN '' ELSE error_log END AS error_log,
  CASE WHEN event_id % 20 = 4 THEN 'Unknown' ELSE root_cause END AS root_cause,
  CASE WHEN event_id % 20 = 6 THEN NULL ELSE event_timestamp END AS event_timestamp
FROM failure_events
"""

PREDICTIONS = """
SELECT event_id AS failure_id, pipeline_name, root_cause AS actual_root_cause,
  CASE WHEN event_id % 10 = 9 THEN 'Resource Exhaustion' WHEN event_id % 17 = 3 THEN 'API Failure' ELSE root_cause END AS predicted_root_cause,
  CAST(5000 + (event_id * 37) % 5000 AS DOUBLE) / 10000 AS confidence,
  CASE WHEN event_id % 2 = 0 THEN 'v1' ELSE 'v2' END AS model_version,
  event_timestamp AS created_at
FROM failure_events
"""

CONTRIBUTIONS = """
SELECT p.failure_id, p.predicted_root_cause, f.feature,
  CAST((p.failure_id * 31 + f.i * 57) % 401 - 200 AS DOUBLE) / 100 AS shap_value,
  CAST((p.failure_id + f.i) % 50 AS DOUBLE) AS feature_value
FROM predictions p CROSS JOIN (VALUES (1,'feat_runtime'),(2,'feat_retry_count'),(3,'feat_zero_rows'),(4,'feat_schema_change'),(5,'feat_upstream_failed'),(6,'feat_rows_per_second'),(7,'http_status_code'),(8,'memory_value_mb'),(9,'keyword_score_api'),(10,'tfidf_killed'),(11,'tfidf_not found'),(12,'feat_month'),(13,'timeout_seconds'),(14,'has_s3_path')) AS f(i, feature)
"""

TASK_RUNS = """
SELECT event_id, pipeline_name AS dag_id, concat(pipeline_name, '_', CAST(CAST(event_timestamp AS DATE) AS VARCHAR(10))) AS run_id,
  task_name AS task_id, CAST(event_id % 14 AS INT) AS try_number, event_timestamp AS start_date,
  CASE WHEN event_id % 9 = 0 THEN NULL ELSE event_timestamp + INTERVAL '1' SECOND * runtime END AS end_date,
  CASE WHEN root_cause IN ('Resource Exhaustion', 'API Failure') THEN 'failed' ELSE 'success' END AS state,
  CASE WHEN event_id % 25 = 0 THEN NULL ELSE error_log END AS exception
FROM failure_events
"""

POD_LOGS = """
SELECT split_part('20231207,20231221,20240115,20240124,20240207,20240215', ',', CAST(event_id % 6 + 1 AS INT)) AS date_key,
  split_part('productpage-x,ratings-y,Malware-z,web-ap-q,details-x,reviews-y,ip-10-1-100-109,ledger-x', ',', CAST(floor(event_id / 6) % 8 + 1 AS INT)) AS pod_name,
  event_id AS line_id,
  CASE WHEN event_id % 5 = 0 THEN '   ' WHEN event_id % 3 = 0 THEN error_log ELSE concat('INFO request processed rows=', CAST(rows_processed AS VARCHAR(20))) END AS content
FROM failure_events
"""

EDGES = """
SELECT DISTINCT concat('n', CAST(u AS VARCHAR(20))) AS upstream, concat('n', CAST(v AS VARCHAR(20))) AS downstream
FROM (SELECT o_custkey AS u, o_custkey + 1 + o_orderkey % 5 AS v FROM orders) e
WHERE floor(u / 20) = floor(v / 20)
"""

_CTES = {
    "failure_events": FAILURE_EVENTS,
    "raw_events": RAW_EVENTS,
    "predictions": PREDICTIONS,
    "contributions": CONTRIBUTIONS,
    "task_runs": TASK_RUNS,
    "pod_logs": POD_LOGS,
    "edges": EDGES,
}
_NEEDS = {
    "failure_events": [],
    "raw_events": ["failure_events"],
    "predictions": ["failure_events"],
    "contributions": ["failure_events", "predictions"],
    "task_runs": ["failure_events"],
    "pod_logs": ["failure_events"],
    "edges": [],
}


def with_tables(tables: str, *ctes: str, select: str) -> str:
    """SQL text: the named derived tables, further CTEs, then the final select."""
    names: list[str] = []
    for table in tables.split():
        for need in [*_NEEDS[table], table]:
            if need not in names:
                names.append(need)
    parts = [f"{name} AS ({_CTES[name].strip()})" for name in names]
    parts += [c.strip() for c in ctes]
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + select.strip()


def table(spark: SparkSession, folder: str, name: str, heavy: bool = False) -> DataFrame:
    """A given table; ``heavy`` spreads a small one over all cores."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return spread(df) if heavy else df


def _over(spark: SparkSession, text: str, **views: DataFrame) -> DataFrame:
    for name, df in views.items():
        df.createOrReplaceTempView(f"failscope_{name}")
        text = text.replace(f"FROM {name}", f"FROM failscope_{name}")
    return spark.sql(text)


def failure_events_from(events: DataFrame) -> DataFrame:
    return _over(events.sparkSession, FAILURE_EVENTS, events=events)


def failure_events(spark: SparkSession, folder: str, heavy: bool = False) -> DataFrame:
    return failure_events_from(table(spark, folder, "events", heavy))


def timed_events(spark: SparkSession, folder: str, heavy: bool = False) -> DataFrame:
    """Failure events with the event time under the contract's name."""
    return failure_events(spark, folder, heavy).withColumnRenamed("event_timestamp", "timestamp")


def raw_events(spark: SparkSession, folder: str) -> DataFrame:
    return _over(spark, RAW_EVENTS, failure_events=failure_events(spark, folder))


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    return _over(spark, PREDICTIONS, failure_events=failure_events(spark, folder))


CONTRIBUTION_FEATURES = [
    "feat_runtime", "feat_retry_count", "feat_zero_rows", "feat_schema_change",
    "feat_upstream_failed", "feat_rows_per_second", "http_status_code", "memory_value_mb",
    "keyword_score_api", "tfidf_killed", "tfidf_not found", "feat_month", "timeout_seconds",
    "has_s3_path",
]


def contributions(spark: SparkSession, folder: str) -> DataFrame:
    """One row per prediction and feature; each row expands in place, without a join."""
    feature = F.posexplode(F.array(*[F.lit(f) for f in CONTRIBUTION_FEATURES]))
    rows = predictions(spark, folder).select(
        "failure_id", "predicted_root_cause", feature.alias("pos", "feature"))
    i = F.col("pos") + 1
    return rows.select(
        "failure_id", "predicted_root_cause", "feature",
        (((F.col("failure_id") * 31 + i * 57) % 401 - 200).cast("double") / 100)
        .alias("shap_value"),
        ((F.col("failure_id") + i) % 50).cast("double").alias("feature_value"))


def task_runs(spark: SparkSession, folder: str) -> DataFrame:
    return _over(spark, TASK_RUNS, failure_events=failure_events(spark, folder))


def pod_logs(spark: SparkSession, folder: str) -> DataFrame:
    return _over(spark, POD_LOGS, failure_events=failure_events(spark, folder))


def edges(spark: SparkSession, folder: str) -> DataFrame:
    return _over(spark, EDGES, orders=table(spark, folder, "orders"))


def latest(df: DataFrame, ts: str):
    """The newest event time: one value, used as the reference time of a window."""
    return df.agg(F.max(ts)).first()[0]
