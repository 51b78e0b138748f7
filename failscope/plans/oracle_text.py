"""SQL fragments used by the checking side."""

from __future__ import annotations

from failscope import constants as K
from failscope.functions.text import LINE_BREAK, WS

WORD_SQL = r"[\p{L}\p{N}_]"


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def strip(expr: str) -> str:
    return f"regexp_replace({expr}, '^{WS}+|{WS}+$', '', 'g')"


def any_word(expr: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({expr}, {text(w)})" for w in words) + ")"


def flag(condition: str) -> str:
    return f"CAST(coalesce({condition}, false) AS INTEGER)"


def hits(words: str, vocabulary: list[str]) -> str:
    inside = ", ".join(text(w) for w in vocabulary)
    return f"CAST(len(list_intersect({words}, [{inside}])) AS INTEGER)"


def count_matches(expr: str, pattern: str) -> str:
    return f"CAST(len(regexp_extract_all({expr}, {text(pattern)})) AS INTEGER)"


def log_signal_select(key: str, source: str, extra: str = "") -> str:
    """Select of ``key``, 23 signals (and ``extra``) from ``source`` with column error_log."""
    unit = "upper(regexp_extract(t, {}, 2))".format(text(K.P_MEMORY))
    factor = "CASE " + " ".join(
        f"WHEN {unit} = '{u}' THEN CAST({mb!r} AS DOUBLE)" for u, mb in K.MEMORY_UNIT_MB.items()
    ) + " ELSE 1.0 END"
    etype = f"regexp_extract(t, {text(K.P_ERROR_TYPE)}, 1)"
    phrases = " + ".join(flag(f"contains(l, {text(p)})") for p in K.MISSING_DATA_PHRASES)
    return f"""
SELECT {key},
  {flag(f"{etype} <> ''")} AS has_error_type,
  CASE WHEN {etype} <> '' THEN CAST(CAST(concat('0x', substr(md5({etype}), 1, 8)) AS BIGINT) % 1000 AS INTEGER) ELSE 0 END AS error_type_hash,
  {flag("code >= 400")} AS has_http_error,
  code AS http_status_code,
  {flag("code >= 400 AND code < 500")} AS is_client_error,
  {flag("code >= 500")} AS is_server_error,
  {flag(f"regexp_matches(t, {text(K.P_PATH)})")} AS has_file_path,
  {flag(f"len(list_filter(regexp_extract_all(t, {text(K.P_PATH)}), lambda x: contains(x, 's3://'))) > 0")} AS has_s3_path,
  {flag(f"regexp_matches(t, {text(K.P_MEMORY)})")} AS has_memory_ref,
  round(CASE WHEN regexp_matches(t, {text(K.P_MEMORY)}) THEN CAST(regexp_extract(t, {text(K.P_MEMORY)}, 1) AS DOUBLE) * {factor} ELSE 0.0 END, 6) AS memory_value_mb,
  {flag(f"regexp_matches(t, {text(K.P_TIMEOUT)})")} AS has_timeout,
  coalesce(TRY_CAST(nullif(regexp_extract(t, {text(K.P_TIMEOUT)}, 1), '') AS BIGINT), 0) AS timeout_seconds,
  {count_matches("t", K.P_QUOTED)} AS column_count,
  {count_matches("t", K.P_COUNTED)} AS numeric_count_in_log,
  CAST(length(t) AS INTEGER) AS log_length,
  CASE WHEN t = '' THEN 0 ELSE CAST(len(regexp_split_to_array(t, '{WS}+')) AS INTEGER) END AS word_count,
  CASE WHEN t = '' THEN 0 ELSE {count_matches("t", LINE_BREAK)} + 1 END AS log_line_count,
  {hits("ws", K.SCHEMA_WORDS)} AS keyword_score_schema,
  {hits("ws", K.RESOURCE_WORDS)} AS keyword_score_resource,
  {hits("ws", K.API_WORDS)} AS keyword_score_api,
  {hits("ws", K.DATA_QUALITY_WORDS)} AS keyword_score_data_quality,
  {hits("ws", K.DEPENDENCY_WORDS)} AS keyword_score_dependency,
  CAST({phrases} AS INTEGER) AS keyword_score_missing_data{extra}
FROM (
  SELECT *, lower(t) AS l, regexp_split_to_array(lower(t), '{WS}+') AS ws,
    coalesce(TRY_CAST(nullif(regexp_extract(t, {text(K.P_HTTP_STATUS)}, 1), '') AS INTEGER), 0) AS code
  FROM (SELECT *, coalesce({strip("error_log")}, '') AS t FROM {source}) s1) s2
"""


def execution_select() -> str:
    rt = "CASE WHEN runtime = 0 THEN 1.0 ELSE CAST(runtime AS DOUBLE) END"
    rc = "CASE WHEN retry_count = 0 THEN 1.0 ELSE CAST(retry_count AS DOUBLE) END"
    return f"""
  CAST(runtime AS DOUBLE) AS feat_runtime,
  CAST(retry_count AS DOUBLE) AS feat_retry_count,
  CAST(rows_processed AS DOUBLE) AS feat_rows_processed,
  round(ln(1.0::DOUBLE + rows_processed), 6) AS feat_log_rows_processed,
  round(ln(1.0::DOUBLE + runtime), 6) AS feat_log_runtime,
  round(CAST(rows_processed AS DOUBLE) / ({rt}), 6) AS feat_rows_per_second,
  {flag("rows_processed = 0")} AS feat_zero_rows,
  {flag("runtime < 30")} AS feat_short_runtime,
  {flag("runtime > 1800")} AS feat_long_runtime,
  {flag("retry_count > 2")} AS feat_high_retries,
  round(CAST(retry_count AS DOUBLE) / (({rt}) / 100.0::DOUBLE), 6) AS feat_retry_rate,
  round(CAST(rows_processed AS DOUBLE) / ({rc}), 6) AS feat_rows_per_retry"""


def schema_select() -> str:
    return f"""
  {flag("schema_change")} AS feat_schema_change,
  {flag("upstream_failed")} AS feat_upstream_failed,
  {flag("schema_change AND upstream_failed")} AS feat_schema_and_upstream,
  {flag("schema_change AND NOT upstream_failed")} AS feat_schema_no_upstream,
  {flag("NOT schema_change AND upstream_failed")} AS feat_upstream_no_schema"""


def temporal_select(ts: str) -> str:
    hour, dow = f"hour({ts})", f"(isodow({ts}) - 1)"
    return f"""
  CAST({hour} AS INTEGER) AS feat_hour,
  CAST({dow} AS INTEGER) AS feat_day_of_week,
  {flag(f"{dow} >= 5")} AS feat_is_weekend,
  {flag(f"{hour} >= 9 AND {hour} < 18")} AS feat_is_business_hours,
  round(sin(2 * pi() * {hour} / 24), 6) + 0.0 AS feat_hour_sin,
  round(cos(2 * pi() * {hour} / 24), 6) + 0.0 AS feat_hour_cos,
  round(sin(2 * pi() * {dow} / 7), 6) + 0.0 AS feat_dow_sin,
  round(cos(2 * pi() * {dow} / 7), 6) + 0.0 AS feat_dow_cos,
  CAST(day({ts}) AS INTEGER) AS feat_day_of_month,
  {flag(f"{hour} < 6 OR {hour} >= 22")} AS feat_is_night,
  CAST(month({ts}) AS INTEGER) AS feat_month"""


def lag_select(ts: str = "event_timestamp") -> str:
    """Select event_id, lag and burst from failure_events."""
    raw = (f"CAST(epoch_us({ts}) - lag(epoch_us({ts})) OVER "
           f"(PARTITION BY pipeline_name ORDER BY {ts}, event_id) AS DOUBLE) / 1000000")
    return f"""
SELECT event_id, round(coalesce(raw, 0.0), 6) AS feat_lag_seconds,
  {flag("raw < 300")} AS feat_is_burst
FROM (SELECT event_id, {raw} AS raw FROM failure_events) s"""


TOKENS_SQL = f"regexp_extract_all(txt, '{WORD_SQL}{{2,}}')"


def placeholder_sql(expr: str) -> str:
    out = f"lower({expr})"
    for pattern, name in K.PLACEHOLDERS:
        out = f"regexp_replace({out}, {text(pattern)}, ' {name} ', 'g')"
    return strip(f"regexp_replace({out}, '{WS}+', ' ', 'g')")
