"""Queries: features with vocabulary, training, scoring, attributions, evidence.

Results depend on fitted trees, so most have no equivalent SQL; tests check their
invariants instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from failscope import constants as K
from failscope.operators import attribution as A
from failscope.operators import evidence as E
from failscope.operators import metrics as M
from failscope.operators.feature_engineer import FeatureEngineer, FeatureModel
from failscope.operators.model import RootCauseModel, split_train_evaluate
from failscope.operators.split import stratified_split
from failscope.plans import derived as D
from failscope.plans.features import MATRIX, MATRIX_CTE, _rounded
from failscope.plans.registry import query
from failscope.plans.streams import _event_stream, _timed
from failscope.plans.texts import GRAMS, TOKENS, VOCAB, WEIGHTS, docs_cte
from failscope.session import materialize, new_path
from failscope.sources import artifacts
from failscope.sources.files import read_feature_store, write_feature_store
from failscope.streaming import jobs as S

TREES = K.TREE_PARAMS["n_estimators"]
_FITTED: dict[tuple[str, str], tuple] = {}


def _fitted(spark: SparkSession, folder: str):
    """Features, feature model, tree model and scored holdout; fitted once per session.

    The vocabulary is fitted on the training part only.
    """
    key = (spark.sparkContext.applicationId, folder)
    if key not in _FITTED:
        events = D.timed_events(spark, folder, heavy=True)
        parts = stratified_split(events)
        engineer = FeatureEngineer().fit(parts.where("NOT is_test").drop("is_test"))
        features = materialize(engineer.transform(events), "features")
        model, scored = split_train_evaluate(
            features, engineer.feature_names, n_trees=TREES)
        _FITTED[key] = (features, engineer, model, materialize(
            scored.drop("features"), "scored"))
    return _FITTED[key]


@query("combined_features", D.with_tables(
    "failure_events", MATRIX_CTE, docs_cte("failure_events", "event_id", "error_log"), TOKENS,
    GRAMS, VOCAB, WEIGHTS, select=f"""
SELECT m.event_id, {", ".join(f"m.{c}" for c in MATRIX)}, coalesce(w.n, 0) AS tfidf_terms,
  round(coalesce(w.s, 0.0), 6) AS tfidf_sum FROM matrix m
LEFT JOIN (SELECT id, count(*) AS n, sum(weight) AS s FROM weights GROUP BY id) w ON w.id = m.event_id"""))
def q_combined(spark: SparkSession, folder: str) -> DataFrame:
    events = D.timed_events(spark, folder, heavy=True)
    model = FeatureEngineer().fit(events)
    path = new_path(spark, "feature-model")
    model.save(path)
    model = FeatureModel.load(spark, path)
    features = model.transform(events)
    weights = [F.col(f"`{n}`") for n in model.vocabulary.names]
    terms = sum((F.when(w > 0, 1).otherwise(0) for w in weights), F.lit(0)).cast("bigint")
    total = sum(weights, F.lit(0.0))
    return _rounded(features.select(
        "event_id", *MATRIX, terms.alias("tfidf_terms"), total.alias("tfidf_sum")))


@query("feature_store", D.with_tables("failure_events", MATRIX_CTE, select=f"""
SELECT m.event_id, f.root_cause, {", ".join(f"m.{c}" for c in MATRIX[:12])}
FROM matrix m JOIN failure_events f ON f.event_id = m.event_id"""))
def q_store(spark: SparkSession, folder: str) -> DataFrame:
    """Features written to the feature store by event date, then read back."""
    features, engineer, _, _ = _fitted(spark, folder)
    path = new_path(spark, "feature-store")
    write_feature_store(
        features.withColumn("event_date", F.to_date("timestamp")), path, engineer.feature_names,
        partition_by="event_date")
    stored, names = read_feature_store(spark, path)
    return _rounded(stored.select("event_id", "root_cause", *names[:12]))


@query("train_score")
def q_train(spark: SparkSession, folder: str) -> DataFrame:
    """Scored holdout: actual and predicted cause with confidence and class probabilities."""
    scored = _fitted(spark, folder)[3]
    return scored.select(
        "event_id", "actual_root_cause", "predicted_root_cause", "confidence",
        *[F.round(F.element_at("probabilities", c), 6).alias(f"p_{c.lower().replace(' ', '_')}")
          for c in K.ROOT_CAUSES])


_HELD = f"""held AS (SELECT event_id, root_cause FROM (
SELECT event_id, root_cause, row_number() OVER (PARTITION BY root_cause
    ORDER BY md5(concat(event_id, ':42')), event_id)
  <= round({K.TEST_FRACTION} * count(*) OVER (PARTITION BY root_cause)) AS is_test
FROM failure_events) s WHERE is_test)"""


@query("holdout_contract", D.with_tables("failure_events", _HELD, select="""
SELECT event_id, root_cause AS actual_root_cause, true AS sums_to_one, true AS confidence_is_best,
  true AS best_class_is_predicted, 6 AS n_classes FROM held"""))
def q_contract(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold for every scored holdout event, whatever trees were fitted."""
    p = F.map_values("probabilities")
    total = F.aggregate(p, F.lit(0.0), lambda a, x: a + x)
    return _fitted(spark, folder)[3].select(
        "event_id", "actual_root_cause", (F.abs(total - 1) < 1e-9).alias("sums_to_one"),
        (F.round(F.array_max(p), 4) == F.col("confidence")).alias("confidence_is_best"),
        (F.element_at("probabilities", F.col("predicted_root_cause")) == F.array_max(p))
        .alias("best_class_is_predicted"), F.size(p).alias("n_classes"))


@query("attribution_additivity", D.with_tables("failure_events", _HELD, f"""
classes AS (SELECT unnest([{', '.join(repr(c) for c in K.ROOT_CAUSES)}]) AS c)""", select="""
SELECT event_id, c AS root_cause, true AS adds_up FROM held JOIN classes ON true"""))
def q_additivity(spark: SparkSession, folder: str) -> DataFrame:
    """Base value and contributions give the class probability, for every class."""
    features, _, model, scored = _fitted(spark, folder)
    held = features.join(scored.select("event_id"), "event_id", "left_semi")
    explained = A.attributions(model, held, all_classes=True)
    truth = scored.select("event_id", "probabilities")
    total = F.aggregate("contributions", F.col("base_value"), lambda a, x: a + x)
    return explained.join(truth, "event_id").select(
        "event_id", "root_cause",
        (F.abs(total - F.element_at("probabilities", F.col("root_cause"))) < 1e-9)
        .alias("adds_up"))


@query("holdout_metrics")
def q_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return M.overall_metrics(M.class_report(M.confusion_matrix(_fitted(spark, folder)[3])))


@query("feature_importance")
def q_importance(spark: SparkSession, folder: str) -> DataFrame:
    model: RootCauseModel = _fitted(spark, folder)[2]
    return model.importances().limit(15)


@query("saved_model_info")
def q_info(spark: SparkSession, folder: str) -> DataFrame:
    """Gate, save, load and describe a model."""
    features, _, model, scored = _fitted(spark, folder)
    path = new_path(spark, "models")
    artifacts.save_model(
        model, path, artifacts.evaluation(scored), features.count(), "2024-01-31T00:00:00+00:00")
    artifacts.load_model(spark, path)
    return artifacts.model_info(spark, path)


def _explained(spark: SparkSession, folder: str) -> tuple[DataFrame, RootCauseModel, DataFrame]:
    features, _, model, _ = _fitted(spark, folder)
    return A.attributions(model, features), model, features


@query("attributions")
def q_attributions(spark: SparkSession, folder: str) -> DataFrame:
    """Contributions of every feature to the predicted class, for every event."""
    explained, model, _ = _explained(spark, folder)
    return A.long_contributions(explained, model.names)


@query("attributions_all_classes")
def q_all_classes(spark: SparkSession, folder: str) -> DataFrame:
    features, _, model, _ = _fitted(spark, folder)
    explained = A.attributions(model, features, all_classes=True)
    return explained.select(
        "event_id", "root_cause", "base_value",
        F.aggregate("contributions", F.lit(0.0), lambda a, x: a + x).alias("total"))


@query("explained_predictions")
def q_explained(spark: SparkSession, folder: str) -> DataFrame:
    """Prediction with evidence and counter-evidence for every event."""
    explained, model, held = _explained(spark, folder)
    ranked = E.rank_lists(A.contribution_items(explained, held, model.names))
    told = E.with_evidence(ranked)
    return told.select(
        F.col("event_id").alias("failure_id"), F.col("root_cause").alias("predicted_root_cause"),
        "evidence", "counter_evidence")


@query("stream_score_parity", D.with_tables("failure_events", select="""
SELECT event_id AS failure_id, true AS same_class, true AS same_confidence FROM failure_events"""))
def q_parity(spark: SparkSession, folder: str) -> DataFrame:
    """Streamed predictions equal batch predictions, event by event."""
    features, _, model, _ = _fitted(spark, folder)
    batch = model.score(features).select(
        F.col("event_id").alias("failure_id"), F.col("predicted_root_cause").alias("cause"),
        F.col("confidence").alias("sure"))
    return q_stream_scored(spark, folder).join(batch, "failure_id").select(
        "failure_id", (F.col("cause") == F.col("predicted_root_cause")).alias("same_class"),
        (F.col("sure") == F.col("confidence")).alias("same_confidence"))


@query("stream_scored")
def q_stream_scored(spark: SparkSession, folder: str) -> DataFrame:
    """Events stream through features and scoring; predictions are read from the sink."""
    _, engineer, model, _ = _fitted(spark, folder)
    events = _timed(D.failure_events_from(_event_stream(spark, folder)), "event_timestamp")
    events = events.withColumnRenamed("event_timestamp", "timestamp")
    base = new_path(spark, "stream-score")
    S.score_stream(
        events, engineer, model, f"{base}/failures", f"{base}/predictions", f"{base}/state",
        f"{base}/checkpoint").awaitTermination()
    schema = spark.read.parquet(f"{base}/predictions").drop("batch").schema
    return S.read_sink(spark, f"{base}/predictions", schema).drop("batch")
