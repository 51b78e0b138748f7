"""Queries: ranked contributions and evidence sentences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from failscope import constants as K
from failscope.operators import evidence as E
from failscope.plans import oracle_text as O
from failscope.plans.derived import contributions, with_tables
from failscope.plans.features import _rounded
from failscope.plans.registry import query

RANKED = """ranked AS (SELECT * FROM (
SELECT *, CASE WHEN shap_value > 0 THEN 'for' ELSE 'against' END AS direction,
  row_number() OVER (PARTITION BY failure_id, shap_value > 0
    ORDER BY abs(shap_value) DESC, encode(feature)) AS rank
FROM contributions WHERE shap_value <> 0) s WHERE rank <= CASE direction WHEN 'for' THEN 10 ELSE 5 END)"""

_KNOWN = "CASE feature " + " ".join(
    "WHEN {} THEN {}".format(
        O.text(f), "replace(replace({}, '{{value:.0f}}', format('{{:.0f}}', feature_value)), "
        "'{{value:.1f}}', format('{{:.1f}}', feature_value))".format(O.text(t)))
    for f, t in K.FEATURE_TEXT.items()) + " END"


def _wording(term: str) -> str:
    return f"""coalesce({_KNOWN},
  CASE WHEN starts_with(feature, 'tfidf_') THEN concat('{term} ''', replace(replace(feature, 'tfidf_', ''), '_', ' '), '''') END,
  concat(feature, ' = ', CAST(feature_value AS VARCHAR)))"""


@query("top_contributions", with_tables("contributions", RANKED, select="""
SELECT failure_id, direction, CAST(rank AS INTEGER) AS rank, feature, shap_value FROM ranked"""))
def q_top(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(E.top_contributions(E.ranked(contributions(spark, folder))))


@query("evidence", with_tables("contributions", RANKED, f"""
said AS (SELECT failure_id, rank, concat({_wording('error log contains the term')},
  CASE WHEN abs(shap_value) > 1.0 THEN ' (very high impact)' WHEN abs(shap_value) > 0.5 THEN ' (high impact)'
    WHEN abs(shap_value) > 0.2 THEN ' (moderate impact)' ELSE ' (contributing factor)' END) AS line
  FROM ranked WHERE direction = 'for' AND rank <= 5)""", select=f"""
SELECT p.failure_id, coalesce(string_agg(s.line, ' | ' ORDER BY s.rank), {O.text(K.NO_EVIDENCE_TEXT)}) AS evidence
FROM predictions p LEFT JOIN said s ON s.failure_id = p.failure_id GROUP BY p.failure_id"""))
def q_evidence(spark: SparkSession, folder: str) -> DataFrame:
    rows = E.with_evidence(E.ranked(contributions(spark, folder)))
    return rows.select("failure_id", F.array_join("evidence", " | ").alias("evidence"))


@query("counter_evidence", with_tables("contributions", RANKED, f"""
said AS (SELECT failure_id, rank, concat('Against: ', {_wording('error log contains')}) AS line
  FROM ranked WHERE direction = 'against' AND rank <= 3)""", select="""
SELECT p.failure_id, coalesce(string_agg(s.line, ' | ' ORDER BY s.rank), '') AS counter_evidence
FROM predictions p LEFT JOIN said s ON s.failure_id = p.failure_id GROUP BY p.failure_id"""))
def q_counter(spark: SparkSession, folder: str) -> DataFrame:
    rows = E.with_evidence(E.ranked(contributions(spark, folder)))
    return rows.select("failure_id", F.array_join("counter_evidence", " | ").alias("counter_evidence"))
