"""Queries: contract checks, projections, filters, files and idempotent appends."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from failscope import constants as K
from failscope.functions import text as X
from failscope.functions.event_features import utc_timestamp
from failscope.operators import task_runs as TR
from failscope.operators import validation as V
from failscope.plans import oracle_text as O
from failscope.plans.derived import (
    failure_events, latest, pod_logs, predictions, raw_events, task_runs,
    with_tables,
)
from failscope.plans.features import (
    MATRIX, MATRIX_CTE, _rounded, event_matrix,
)
from failscope.plans.registry import query
from failscope.session import new_path
from failscope.sources import files, tables

T = O.text


def _sql_first(*checks: tuple[str, str]) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {T(m)}" for c, m in checks) + " END"


def _sql_name(c: str) -> str:
    return _sql_first(
        (f"{c} IS NULL", V.NOT_TEXT), (f"length({c}) < 1", V.TOO_SHORT),
        (f"length({c}) > 200", V.TOO_LONG), (f"{O.strip(c)} = ''", V.BLANK))


def _sql_count(c: str, top: bool = False) -> str:
    more = [(f"{c} > 10", V.ABOVE_10)] if top else []
    return _sql_first((f"{c} IS NULL", V.NOT_INT), (f"{c} < 0", V.BELOW), *more)


_SHARED = [
    _sql_name("pipeline_name"), _sql_name("task_name"), _sql_count("runtime"),
    _sql_count("retry_count", True), _sql_count("rows_processed"),
    _sql_first(("schema_change IS NULL", V.NOT_BOOL)),
    _sql_first(("upstream_failed IS NULL", V.NOT_BOOL)),
]
_CAUSES = ", ".join(T(c) for c in K.ROOT_CAUSES)
_EVENT_RULES = _SHARED + [
    _sql_first((f"root_cause IS NULL OR root_cause NOT IN ({_CAUSES})", V.NOT_CAUSE)),
    _sql_first(("event_timestamp IS NULL", V.NOT_TIME)),
]
_REQUEST_RULES = _SHARED + [
    _sql_first(("error_log IS NULL", V.NOT_TEXT), ("length(error_log) < 1", V.TOO_SHORT))]


def _checked_cte(rules: list[str]) -> str:
    return (f"checked AS (SELECT *, list_filter([{', '.join(rules)}], lambda m: m IS NOT NULL) "
            "AS errors FROM raw_events)")


CHECKED = _checked_cte(_EVENT_RULES)
_ERROR_COLUMNS = """
SELECT event_id, CAST(len(errors) AS INTEGER) AS n_errors,
  array_to_string(errors, '; ') AS errors FROM checked"""


def _error_columns(df: DataFrame) -> DataFrame:
    return df.select(
        "event_id", F.size("errors").alias("n_errors"),
        F.array_join("errors", "; ").alias("errors"))


def checked_events(spark: SparkSession, folder: str) -> DataFrame:
    return V.check(raw_events(spark, folder), V.event_rules("event_timestamp"))


@query("validate_events", with_tables("raw_events", CHECKED, select=_ERROR_COLUMNS))
def q_validate_events(spark: SparkSession, folder: str) -> DataFrame:
    return _error_columns(checked_events(spark, folder))


@query("validate_requests", with_tables(
    "raw_events", _checked_cte(_REQUEST_RULES), select=_ERROR_COLUMNS))
def q_validate_requests(spark: SparkSession, folder: str) -> DataFrame:
    return _error_columns(V.check(raw_events(spark, folder), V.request_rules()))


@query("validate_responses", with_tables("contributions", """
checked AS (SELECT failure_id, feature, list_filter([
  CASE WHEN shap_value IS NULL THEN 'Input should be a valid number'
       WHEN shap_value < 0 THEN 'Input should be greater than or equal to 0'
       WHEN shap_value > 1 THEN 'Input should be less than or equal to 1' END],
  lambda m: m IS NOT NULL) AS errors FROM contributions)""", select="""
SELECT failure_id, feature, CAST(len(errors) AS INTEGER) AS n_errors,
  array_to_string(errors, '; ') AS errors FROM checked"""))
def q_validate_responses(spark: SparkSession, folder: str) -> DataFrame:
    from failscope.plans.derived import contributions

    rows = contributions(spark, folder).select(
        "failure_id", "feature", F.col("shap_value").alias("confidence"),
        F.col("predicted_root_cause"), F.lit("p").alias("pipeline_name"),
        F.lit("v1").alias("model_version"))
    return V.check(rows, V.response_rules()).select(
        "failure_id", "feature", F.size("errors").alias("n_errors"),
        F.array_join("errors", "; ").alias("errors"))


@query("validation_report", with_tables("raw_events", CHECKED, select="""
SELECT count(*) FILTER (len(errors) = 0) AS valid_rows,
       count(*) FILTER (len(errors) > 0) AS invalid_rows FROM checked"""))
def q_validation_report(spark: SparkSession, folder: str) -> DataFrame:
    return V.counts(checked_events(spark, folder))


@query("validation_messages", with_tables("raw_events", CHECKED, select="""
SELECT event_id, concat('Row ', event_id, ': ', len(errors), ' error(s) — ', errors[1]) AS message
FROM checked WHERE len(errors) > 0 ORDER BY event_id LIMIT 10"""))
def q_validation_messages(spark: SparkSession, folder: str) -> DataFrame:
    return V.messages(checked_events(spark, folder))


@query("quarantine_valid", with_tables("raw_events", CHECKED, select=f"""
SELECT event_id, {O.strip('pipeline_name')} AS pipeline_name, {O.strip('task_name')} AS task_name,
  runtime, retry_count, rows_processed, schema_change, upstream_failed,
  coalesce(error_log, '') AS error_log, root_cause, event_timestamp
FROM checked WHERE len(errors) = 0"""))
def q_quarantine_valid(spark: SparkSession, folder: str) -> DataFrame:
    return V.split_valid(checked_events(spark, folder))[0]


@query("quarantine_invalid", with_tables("raw_events", CHECKED, select="""
SELECT event_id, pipeline_name, task_name, error_log, root_cause,
  array_to_string(errors, '; ') AS errors FROM checked WHERE len(errors) > 0"""))
def q_quarantine_invalid(spark: SparkSession, folder: str) -> DataFrame:
    bad = V.split_valid(checked_events(spark, folder))[1]
    return bad.select("event_id", "pipeline_name", "task_name", "error_log", "root_cause",
                      F.array_join("errors", "; ").alias("errors"))


@query("name_normalise", with_tables("raw_events", select=f"""
SELECT event_id, {O.strip('pipeline_name')} AS pipeline_name,
  coalesce({O.strip('task_name')}, '') AS task_name,
  {O.strip('pipeline_name')} = '' AS is_blank FROM raw_events"""))
def q_name_normalise(spark: SparkSession, folder: str) -> DataFrame:
    name = X.stripped(F.col("pipeline_name"))
    return raw_events(spark, folder).select(
        "event_id", name.alias("pipeline_name"), X.clean_text(F.col("task_name")).alias("task_name"),
        (name == "").alias("is_blank"))


@query("null_safe_text", f"""
SELECT doc_id, coalesce({O.strip('text')}, '') AS clean,
  CAST(length(coalesce({O.strip('text')}, '')) AS INTEGER) AS n FROM documents""")
def q_null_safe_text(spark: SparkSession, folder: str) -> DataFrame:
    clean = X.clean_text(F.col("text"))
    return spark.read.parquet(f"{folder}/documents.parquet").select(
        "doc_id", clean.alias("clean"), F.length(clean).alias("n"))


@query("default_timestamp", with_tables("raw_events", select="""
SELECT event_id, coalesce(event_timestamp, (SELECT max(event_timestamp) FROM raw_events))
  AS event_timestamp FROM raw_events"""))
def q_default_timestamp(spark: SparkSession, folder: str) -> DataFrame:
    rows = raw_events(spark, folder).select("event_id", "event_timestamp")
    return V.with_default_time(rows, latest(rows, "event_timestamp"), "event_timestamp")


@query("boolean_from_text", with_tables("raw_events", select="""
SELECT event_id, coalesce(lower(CAST(schema_change AS VARCHAR)) = 'true', false) AS schema_change,
  coalesce(lower(upper(CAST(upstream_failed AS VARCHAR))) = 'true', false) AS upstream_failed
FROM raw_events"""))
def q_boolean(spark: SparkSession, folder: str) -> DataFrame:
    return raw_events(spark, folder).select(
        "event_id", X.text_is_true(F.col("schema_change")).alias("schema_change"),
        X.text_is_true(F.upper(F.col("upstream_failed").cast("string"))).alias("upstream_failed"))


_HINT_LOG = "coalesce(nullif(exception, ''), 'Unknown error — no exception captured')"
_SIBLING = """EXISTS (SELECT 1 FROM task_runs o WHERE o.run_id = r.run_id
    AND o.state = 'failed' AND o.task_id <> r.task_id)"""


@query("task_run_events", with_tables("task_runs", select=f"""
SELECT event_id, coalesce(dag_id, 'unknown_dag') AS pipeline_name,
  coalesce(task_id, 'unknown_task') AS task_name,
  CAST(greatest(coalesce(trunc(CAST(epoch_us(coalesce(end_date, (SELECT max(start_date) FROM task_runs)))
    - epoch_us(start_date) AS DOUBLE) / 1000000), 0), 0) AS INTEGER) AS runtime,
  CAST(least(greatest(coalesce(try_number - 1, 0), 0), 10) AS INTEGER) AS retry_count,
  0 AS rows_processed,
  {O.any_word(f"lower({_HINT_LOG})", K.SCHEMA_CHANGE_HINTS)} AS schema_change,
  ({O.any_word(f"lower({_HINT_LOG})", K.UPSTREAM_HINTS)} OR {_SIBLING}) AS upstream_failed,
  substr({_HINT_LOG}, 1, 5000) AS error_log
FROM task_runs r"""))
def q_task_run_events(spark: SparkSession, folder: str) -> DataFrame:
    runs = task_runs(spark, folder)
    return TR.task_run_events(runs, latest(runs, "start_date"), ["event_id"])


@query("sibling_failure", with_tables("task_runs", select=f"""
SELECT event_id, run_id, task_id, {_SIBLING} AS sibling_failed FROM task_runs r"""))
def q_sibling(spark: SparkSession, folder: str) -> DataFrame:
    runs = task_runs(spark, folder).select("event_id", "run_id", "task_id", "state")
    return TR.failed_sibling(runs).select("event_id", "run_id", "task_id", "sibling_failed")


@query("text_heuristics", with_tables("failure_events", select=f"""
SELECT event_id,
  {O.any_word("lower(error_log)", K.SCHEMA_CHANGE_HINTS)} AS schema_change,
  {O.any_word("lower(error_log)", K.UPSTREAM_HINTS)} AS upstream_failed,
  {O.any_word("lower(error_log)", K.SCHEMA_CHANGE_HINTS_SHORT)} AS schema_change_short,
  {O.any_word("lower(error_log)", K.UPSTREAM_HINTS_SHORT)} AS upstream_failed_short
FROM failure_events"""))
def q_heuristics(spark: SparkSession, folder: str) -> DataFrame:
    log = F.col("error_log")
    return failure_events(spark, folder).select(
        "event_id",
        TR.schema_change_hint(log).alias("schema_change"),
        TR.upstream_hint(log).alias("upstream_failed"),
        TR.schema_change_hint(log, True).alias("schema_change_short"),
        TR.upstream_hint(log, True).alias("upstream_failed_short"))


@query("equality_filter", with_tables("predictions", select="""
SELECT failure_id, pipeline_name, predicted_root_cause, confidence FROM predictions
WHERE pipeline_name = 'user_etl_pipeline' AND predicted_root_cause = 'Resource Exhaustion'"""))
def q_equality(spark: SparkSession, folder: str) -> DataFrame:
    rows = tables.matching(
        predictions(spark, folder), pipeline_name="user_etl_pipeline",
        predicted_root_cause="Resource Exhaustion")
    return rows.select("failure_id", "pipeline_name", "predicted_root_cause", "confidence")


@query("prediction_by_id", with_tables("predictions", select="""
SELECT * FROM predictions WHERE failure_id = (SELECT max(event_id) FROM events)"""))
def q_by_id(spark: SparkSession, folder: str) -> DataFrame:
    last = spark.read.parquet(f"{folder}/events.parquet").agg(F.max("event_id")).first()[0]
    return tables.by_id(predictions(spark, folder), last, "failure_id")


@query("error_lines", with_tables("pod_logs", select=f"""
SELECT date_key, pod_name, line_id, {O.strip('content')} AS content FROM pod_logs
WHERE {O.any_word('lower(content)', K.ERROR_LINE_WORDS)}"""))
def q_error_lines(spark: SparkSession, folder: str) -> DataFrame:
    return pod_logs(spark, folder).where(X.is_error_line(F.col("content"))).select(
        "date_key", "pod_name", "line_id", X.stripped(F.col("content")).alias("content"))


@query("column_alignment", with_tables("failure_events", select="""
SELECT error_log, runtime, pipeline_name, event_id FROM failure_events"""))
def q_alignment(spark: SparkSession, folder: str) -> DataFrame:
    events = failure_events(spark, folder)
    doubled = events.select("*", F.lit(-1).alias("runtime"), F.lit("x").alias("pipeline_name"))
    return V.align_columns(doubled, ["error_log", "runtime", "pipeline_name", "event_id"])


@query("scenario_dates", with_tables("pod_logs", select="""
SELECT DISTINCT k AS date_key, coalesce(try_strptime(k, '%Y%m%d'), TIMESTAMP '2024-01-01') AS day
FROM (SELECT date_key AS k FROM pod_logs UNION ALL SELECT pod_name FROM pod_logs) s"""))
def q_scenario_dates(spark: SparkSession, folder: str) -> DataFrame:
    logs = pod_logs(spark, folder)
    keys = logs.select(F.col("date_key")).union(logs.select("pod_name")).distinct()
    return keys.select(
        "date_key", X.scenario_date(F.col("date_key")).cast("timestamp_ntz").alias("day"))


@query("display_names", with_tables("failure_events", select="""
SELECT event_id, replace(replace(pipeline_name, '_pipeline', ''), '_', ' ') AS display_name
FROM failure_events"""))
def q_display(spark: SparkSession, folder: str) -> DataFrame:
    return failure_events(spark, folder).select(
        "event_id", X.display_name(F.col("pipeline_name")).alias("display_name"))


@query("iso_timestamps", with_tables("failure_events", select="""
SELECT event_id, event_timestamp AS utc_time FROM failure_events"""))
def q_iso(spark: SparkSession, folder: str) -> DataFrame:
    text = F.concat(F.date_format("event_timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))
    return failure_events(spark, folder).select(
        "event_id", utc_timestamp(text).cast("timestamp_ntz").alias("utc_time"))


@query("event_csv_round_trip", with_tables("failure_events", select="""
SELECT pipeline_name, task_name, runtime, retry_count, rows_processed, schema_change,
  upstream_failed, error_log, root_cause, event_timestamp AS timestamp FROM failure_events"""))
def q_csv(spark: SparkSession, folder: str) -> DataFrame:
    path = new_path(spark, "events-csv")
    events = failure_events(spark, folder).drop("event_id").withColumnRenamed(
        "event_timestamp", "timestamp")
    files.write_events(events.withColumn("timestamp", F.col("timestamp").cast("timestamp")), path)
    back = files.read_events(spark, path)
    return back.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


@query("pod_log_files", with_tables("pod_logs", select=f"""
SELECT date_key, pod_name, CAST(line_id AS INTEGER) AS line_id, {O.strip('content')} AS content
FROM pod_logs WHERE {O.strip('content')} <> ''"""))
def q_pod_files(spark: SparkSession, folder: str) -> DataFrame:
    path = new_path(spark, "pods")
    none = F.lit(None).cast("string")
    lines = pod_logs(spark, folder).select(
        F.col("line_id").alias("LineId"), none.alias("Time"), F.col("content").alias("Content"),
        none.alias("EventId"), none.alias("EventTemplate"), none.alias("ParameterList"),
        "date_key", F.concat("pod_name", F.lit("_messages_structured.csv")).alias("file"))
    lines.write.partitionBy("date_key", "file").options(
        header="true", escape='"', ignoreLeadingWhiteSpace="false",
        ignoreTrailingWhiteSpace="false").csv(path)
    return files.read_pod_logs(spark, path).select("date_key", "pod_name", "line_id", "content")


@query("idempotent_append", with_tables("predictions", select="""
SELECT failure_id, pipeline_name, predicted_root_cause, confidence, model_version FROM predictions
"""))
def q_append(spark: SparkSession, folder: str) -> DataFrame:
    """Store version v1, then append everything twice: each failure is kept once."""
    rows = predictions(spark, folder).select(
        "failure_id", "pipeline_name", "predicted_root_cause", "confidence", "model_version")
    path = new_path(spark, "predictions")
    tables.append_once(
        rows.where("model_version = 'v1'"), path, ["failure_id"], ["model_version"], rows.schema)
    again = rows.union(rows.withColumns({
        "model_version": F.lit("v9"), "confidence": F.lit(0.0)}))
    tables.append_once(again, path, ["failure_id"], ["model_version"], rows.schema)
    return spark.read.schema(rows.schema).parquet(path)


@query("new_dependencies", """
WITH pairs AS (SELECT l_suppkey AS u, l_partkey AS d, l_linenumber AS n, l_returnflag AS f FROM lineitem),
stored AS (SELECT DISTINCT u, d FROM pairs WHERE f = 'R')
SELECT u AS upstream, d AS downstream, min(n) AS line FROM pairs p
WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.u = p.u AND s.d = p.d) GROUP BY u, d""")
def q_new_dependencies(spark: SparkSession, folder: str) -> DataFrame:
    pairs = spark.read.parquet(f"{folder}/lineitem.parquet").select(
        F.col("l_suppkey").alias("upstream"), F.col("l_partkey").alias("downstream"),
        F.col("l_linenumber").alias("line"), "l_returnflag")
    stored = pairs.where("l_returnflag = 'R'").select("upstream", "downstream")
    return tables.not_yet_stored(
        pairs.drop("l_returnflag"), stored, ["upstream", "downstream"], ["line"])


@query("active_dependencies", """
SELECT concat('n', CAST(o_custkey AS VARCHAR)) AS upstream, concat('n', CAST(o_orderkey AS VARCHAR)) AS downstream,
  o_orderpriority AS dependency_type FROM orders WHERE o_orderstatus = 'F'""")
def q_active(spark: SparkSession, folder: str) -> DataFrame:
    node = lambda c: F.concat(F.lit("n"), F.col(c).cast("string"))
    stored = spark.read.parquet(f"{folder}/orders.parquet").select(
        node("o_custkey").alias("upstream_pipeline"),
        node("o_orderkey").alias("downstream_pipeline"),
        F.col("o_orderpriority").alias("dependency_type"),
        (F.col("o_orderstatus") == "F").alias("is_active"))
    return tables.read_dependencies(stored)


@query("unknown_labels", with_tables("raw_events", select=f"""
SELECT root_cause, count(*) AS n_rows FROM raw_events
WHERE root_cause NOT IN ({_CAUSES}) GROUP BY root_cause"""))
def q_unknown_labels(spark: SparkSession, folder: str) -> DataFrame:
    allowed = spark.createDataFrame([(c,) for c in K.ROOT_CAUSES], "root_cause string")
    seen = raw_events(spark, folder).groupBy("root_cause").agg(F.count("*").alias("n_rows"))
    return seen.join(allowed, "root_cause", "left_anti")


_QUALITY = ", ".join(
    f"""{{'feature': '{c}', 'n_rows': count(*),
    'n_missing': count(*) FILTER ("{c}" IS NULL OR isnan(CAST("{c}" AS DOUBLE))),
    'n_infinite': count(*) FILTER (isinf(CAST("{c}" AS DOUBLE))),
    'variance': coalesce(var_samp(CAST("{c}" AS DOUBLE)), 0.0)}}""" for c in MATRIX)
_QUALITY_CTE = (
    f"quality AS (SELECT unnest(s, recursive := true) FROM "
    f"(SELECT unnest([{_QUALITY}]) AS s FROM matrix) q)")


@query("feature_quality", with_tables("failure_events", MATRIX_CTE, _QUALITY_CTE, select="""
SELECT feature, n_rows, n_missing, n_infinite, round(sqrt(variance), 4) AS std_dev,
  variance = 0 AS is_constant FROM quality"""))
def q_quality(spark: SparkSession, folder: str) -> DataFrame:
    quality = V.feature_quality(_rounded(event_matrix(spark, folder)), MATRIX)
    std_dev = F.sqrt("variance").alias("std_dev")
    return _rounded(quality.select(
        "feature", "n_rows", "n_missing", "n_infinite", std_dev, "is_constant"), 4)


@query("low_variance", with_tables("failure_events", MATRIX_CTE, _QUALITY_CTE, select=f"""
SELECT feature, round(variance, 6) AS variance FROM quality WHERE variance < {K.LOW_VARIANCE}"""))
def q_low_variance(spark: SparkSession, folder: str) -> DataFrame:
    quality = V.feature_quality(_rounded(event_matrix(spark, folder)), MATRIX)
    return _rounded(V.low_variance(quality))


