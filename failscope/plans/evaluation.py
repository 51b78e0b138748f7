"""Queries: classification metrics, class weights, holdout, shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from failscope import constants as K
from failscope.operators import metrics as M
from failscope.operators import split as S
from failscope.plans.derived import failure_events, predictions, with_tables
from failscope.plans.features import _rounded
from failscope.plans.registry import query

_GRID = f"""classes AS (SELECT unnest([{', '.join(repr(c) for c in K.ROOT_CAUSES)}]) AS c)"""
MATRIX = """cm AS (
SELECT a.c AS actual, b.c AS predicted, count(p.failure_id) AS n FROM classes a JOIN classes b ON true
LEFT JOIN predictions p ON p.actual_root_cause = a.c AND p.predicted_root_cause = b.c GROUP BY 1, 2)"""
REPORT = """report AS (
SELECT root_cause, CASE WHEN claimed > 0 THEN hits / claimed ELSE 0.0::DOUBLE END AS precision,
  CASE WHEN support > 0 THEN hits / support ELSE 0.0::DOUBLE END AS recall,
  CASE WHEN support + claimed > 0 THEN 2 * hits / (support + claimed) ELSE 0.0::DOUBLE END AS f1,
  CAST(support AS BIGINT) AS support, CAST(hits AS BIGINT) AS hits
FROM (SELECT c AS root_cause,
  CAST((SELECT sum(n) FROM cm WHERE actual = c) AS DOUBLE) AS support,
  CAST((SELECT sum(n) FROM cm WHERE predicted = c) AS DOUBLE) AS claimed,
  CAST((SELECT sum(n) FROM cm WHERE actual = c AND predicted = c) AS DOUBLE) AS hits
  FROM classes) s)"""
OVERALL = """overall AS (
SELECT CAST(sum(hits) AS DOUBLE) / sum(support) AS accuracy, avg(f1) AS macro_f1,
  sum(f1 * support) / sum(support) AS weighted_f1, CAST(sum(support) AS BIGINT) AS n_rows
FROM report)"""


def _sql(select: str) -> str:
    return with_tables("predictions", _GRID, MATRIX, REPORT, OVERALL, select=select)


def _report(spark: SparkSession, folder: str) -> DataFrame:
    return M.class_report(M.confusion_matrix(predictions(spark, folder)))


@query("confusion_matrix", _sql("SELECT * FROM cm"))
def q_matrix(spark: SparkSession, folder: str) -> DataFrame:
    return M.confusion_matrix(predictions(spark, folder))


@query("class_report", _sql("""
SELECT root_cause, round(precision, 6) AS precision, round(recall, 6) AS recall,
  round(f1, 6) AS f1, support, hits FROM report"""))
def q_report(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(_report(spark, folder))


@query("overall_metrics", _sql("""
SELECT round(accuracy, 6) AS accuracy, round(macro_f1, 6) AS macro_f1,
  round(weighted_f1, 6) AS weighted_f1, n_rows FROM overall"""))
def q_overall(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(M.overall_metrics(_report(spark, folder)))


@query("confidence_by_class", _sql("""
SELECT actual_root_cause AS root_cause, count(*) AS n, round(avg(confidence), 6) AS avg_confidence
FROM predictions GROUP BY 1
UNION ALL SELECT NULL, count(*), round(avg(confidence), 6) FROM predictions"""))
def q_confidence(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(M.confidence_by_class(predictions(spark, folder)))


@query("common_error", _sql("""
SELECT * FROM cm WHERE actual <> predicted AND n > 0 ORDER BY n DESC, actual, predicted LIMIT 1"""))
def q_error(spark: SparkSession, folder: str) -> DataFrame:
    return M.most_common_error(M.confusion_matrix(predictions(spark, folder)))


@query("go_no_go", _sql(f"""
SELECT round(macro_f1, 6) AS macro_f1, macro_f1 >= {K.MIN_MACRO_F1} AS go FROM overall"""))
def q_gate(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(M.go_no_go(M.overall_metrics(_report(spark, folder))))


@query("evaluation_summary", _sql("""
SELECT root_cause, round(precision, 6) AS precision, round(recall, 6) AS recall,
  round(f1, 6) AS f1, round(coalesce((SELECT avg(confidence) FROM predictions
    WHERE actual_root_cause = root_cause), 0.0), 6) AS avg_confidence, support FROM report"""))
def q_summary(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(M.summary_table(predictions(spark, folder)))


@query("class_weights", with_tables("failure_events", select="""
SELECT event_id, root_cause, round(CAST((SELECT count(*) FROM failure_events) AS DOUBLE)
  / ((SELECT count(DISTINCT root_cause) FROM failure_events) * n), 6) AS class_weight
FROM (SELECT event_id, root_cause, count(*) OVER (PARTITION BY root_cause) AS n
      FROM failure_events) s"""))
def q_weights(spark: SparkSession, folder: str) -> DataFrame:
    rows = failure_events(spark, folder).select("event_id", "root_cause")
    return _rounded(S.balanced_weights(rows).select("event_id", "root_cause", "class_weight"))


@query("label_count", with_tables("failure_events", select="""
SELECT count(DISTINCT root_cause) AS n_classes FROM failure_events"""))
def q_label_count(spark: SparkSession, folder: str) -> DataFrame:
    return M.label_count(failure_events(spark, folder))


@query("label_encoding", with_tables("failure_events", select="""
SELECT event_id, root_cause, CAST(dense_rank() OVER (ORDER BY root_cause) - 1 AS INTEGER)
  AS label_index FROM failure_events"""))
def q_labels(spark: SparkSession, folder: str) -> DataFrame:
    rows = failure_events(spark, folder).select("event_id", "root_cause")
    coded = M.encode_labels(rows)
    return M.decode_labels(coded.drop("root_cause"), M.label_index(rows)).select(
        "event_id", "root_cause", "label_index")


@query("stratified_split", with_tables("failure_events", select=f"""
SELECT event_id, root_cause,
  row_number() OVER (PARTITION BY root_cause ORDER BY md5(concat(event_id, ':42')), event_id)
    <= round({K.TEST_FRACTION} * count(*) OVER (PARTITION BY root_cause)) AS is_test
FROM failure_events"""))
def q_split(spark: SparkSession, folder: str) -> DataFrame:
    return S.stratified_split(failure_events(spark, folder).select("event_id", "root_cause"))


@query("seeded_shuffle", """
SELECT event_id, md5(concat(event_id, ':42')) AS shuffle_key FROM events""")
def q_shuffle(spark: SparkSession, folder: str) -> DataFrame:
    rows = failure_events(spark, folder).select("event_id")
    return S.seeded_shuffle(rows).select(
        "event_id", S.seeded_key(F.col("event_id"), 42).alias("shuffle_key"))
