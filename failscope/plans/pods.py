"""Queries: scenario pod logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from failscope import constants as K
from failscope.operators import pod_logs as P
from failscope.plans import oracle_text as O
from failscope.plans.derived import pod_logs, with_tables
from failscope.plans.registry import query
from failscope.sources.files import scenarios

SCENARIOS = "scen AS (SELECT * FROM (VALUES " + ", ".join(
    f"({O.text(s[0])}, {O.text(s[1])}, {O.text(s[2])})" for s in K.SCENARIOS
) + ") v(date_key, root_cause, pattern))"
FIRST = f"""first AS (
SELECT date_key, pod_name, line_id, content, line_rank FROM (
  SELECT date_key, pod_name, line_id, {O.strip('content')} AS content,
    row_number() OVER (PARTITION BY date_key, pod_name ORDER BY line_id) AS line_rank
  FROM pod_logs WHERE {O.strip('content')} <> '') s WHERE line_rank <= 300),
flagged AS (SELECT f.*, s.root_cause, regexp_matches(f.pod_name, concat('(?i)', s.pattern)) AS is_faulty_pod
FROM first f JOIN scen s ON s.date_key = f.date_key)"""
ERRORS = f"""errs AS (SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY date_key, pod_name ORDER BY line_id) AS error_rank
  FROM flagged WHERE {O.any_word('lower(content)', K.ERROR_LINE_WORDS)}) s WHERE error_rank <= 50)"""
POOL = """cand AS (
SELECT date_key, pod_name, line_id, content, 1 AS source FROM errs WHERE is_faulty_pod
UNION ALL SELECT date_key, pod_name, line_id, content, 2 FROM errs
UNION ALL SELECT date_key, pod_name, line_id, content, 3 FROM flagged WHERE is_faulty_pod AND line_rank <= 20
UNION ALL SELECT f.date_key, f.pod_name, f.line_id, f.content, 4 FROM flagged f JOIN (
  SELECT date_key, pod_name, sum(n) OVER (PARTITION BY date_key ORDER BY pod_name) - n AS before
  FROM (SELECT date_key, pod_name, count(*) AS n FROM flagged WHERE line_rank <= 10 GROUP BY 1, 2) c) b
  ON b.date_key = f.date_key AND b.pod_name = f.pod_name AND b.before < 30 WHERE f.line_rank <= 10),
pool AS (SELECT * FROM cand c WHERE source = (SELECT min(source) FROM cand d WHERE d.date_key = c.date_key))"""


@query("faulty_pods", with_tables("pod_logs", SCENARIOS, select="""
SELECT l.date_key, l.pod_name, l.line_id, s.root_cause,
  regexp_matches(l.pod_name, concat('(?i)', s.pattern)) AS is_faulty_pod
FROM pod_logs l JOIN scen s ON s.date_key = l.date_key"""))
def q_faulty(spark: SparkSession, folder: str) -> DataFrame:
    return P.with_faulty_flag(pod_logs(spark, folder), scenarios(spark)).select(
        "date_key", "pod_name", "line_id", "root_cause", "is_faulty_pod")


@query("first_pod_lines", with_tables("pod_logs", SCENARIOS, FIRST, select="""
SELECT date_key, pod_name, line_id, content, CAST(line_rank AS INTEGER) AS line_rank FROM first"""))
def q_first(spark: SparkSession, folder: str) -> DataFrame:
    return P.first_lines(pod_logs(spark, folder))


@query("first_error_lines", with_tables("pod_logs", SCENARIOS, FIRST, ERRORS, select="""
SELECT date_key, pod_name, line_id, content, CAST(error_rank AS INTEGER) AS error_rank FROM errs"""))
def q_first_errors(spark: SparkSession, folder: str) -> DataFrame:
    lines = P.first_lines(pod_logs(spark, folder)).drop("line_rank")
    return P.first_error_lines(lines)


@query("error_pool", with_tables("pod_logs", SCENARIOS, FIRST, ERRORS, POOL, select="""
SELECT date_key, pod_name, line_id, content, source FROM pool"""))
def q_pool(spark: SparkSession, folder: str) -> DataFrame:
    return P.error_pool(pod_logs(spark, folder), scenarios(spark))
