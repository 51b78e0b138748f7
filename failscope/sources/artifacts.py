"""Save and load a model with its metadata."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, RandomForestClassificationModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from failscope import constants as K
from failscope.operators import metrics as M
from failscope.operators.model import BOOSTED, FOREST, RootCauseModel
from failscope.schemas import METADATA


def evaluation(scored: DataFrame) -> dict:
    """All metrics of a scored holdout, read from the 6 x 6 table and per-class means."""
    matrix = M.confusion_matrix(scored)
    report = M.class_report(matrix)
    overall = M.overall_metrics(report).first()
    cells = {(r["actual"], r["predicted"]): r["n"] for r in matrix.collect()}
    confidence = {r["root_cause"]: r["avg_confidence"]
                  for r in M.confidence_by_class(scored).collect()}
    average = confidence.pop(None, 0.0)
    return {
        "accuracy": overall["accuracy"], "macro_f1": overall["macro_f1"],
        "weighted_f1": overall["weighted_f1"], "avg_confidence": average or 0.0,
        "per_class_confidence": confidence,
        "per_class_f1": {r["root_cause"]: r["f1"] for r in report.collect()},
        "confusion_matrix": [[cells[a, p] for p in K.ROOT_CAUSES] for a in K.ROOT_CAUSES],
    }


def save_model(
    model: RootCauseModel, folder: str, metrics: dict, training_samples: int, created_at: str,
    threshold: float = K.MIN_MACRO_F1,
) -> dict[str, str]:
    """Save trees and metadata under a version. Refuses, before writing, a model whose
    macro F1 is below the threshold."""
    if metrics["macro_f1"] < threshold:
        raise ValueError(
            f"macro F1 {metrics['macro_f1']:.4f} is below {threshold:.2f}: not saved")
    spark = SparkSession.getActiveSession()
    name = f"root_cause_model_{model.version}"
    trees = [model.trees] if model.kind == FOREST else model.trees
    for i, part in enumerate(trees):
        part.write().overwrite().save(f"{folder}/{name}/{i}")
    params = {k: str(v) for k, v in K.TREE_PARAMS.items()} | {
        "kind": model.kind, "parts": str(len(trees)),
        "trees": str(sum(t.getNumTrees for t in trees))}
    row = (
        model.version, name, created_at, training_samples, len(model.names), len(model.classes),
        model.classes, model.names, params,
        tuple(metrics[k] for k in (
            "accuracy", "macro_f1", "weighted_f1", "avg_confidence", "per_class_confidence",
            "per_class_f1")),
        metrics["confusion_matrix"])
    meta = spark.createDataFrame([row], METADATA).coalesce(1)
    for place in (f"{folder}/{name}/metadata_row", f"{folder}/model_metadata"):
        meta.write.mode("overwrite").json(place)
    return {"model": f"{folder}/{name}", "metadata": f"{folder}/model_metadata"}


def read_metadata(spark: SparkSession, folder: str, version: str | None = None) -> DataFrame:
    place = "model_metadata" if version is None else f"root_cause_model_{version}/metadata_row"
    try:
        return spark.read.schema(METADATA).json(f"{folder}/{place}")
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error):
            raise FileNotFoundError(f"no model metadata at {folder}/{place}") from error
        raise


def load_model(spark: SparkSession, folder: str, version: str | None = None) -> RootCauseModel:
    """The model of a version; without one, the version saved last."""
    meta = read_metadata(spark, folder, version).first()
    params = meta["hyperparameters"]
    kind = params["kind"]
    reader = RandomForestClassificationModel if kind == FOREST else GBTClassificationModel
    parts = [reader.load(f"{folder}/{meta['model_filename']}/{i}")
             for i in range(int(params["parts"]))]
    return RootCauseModel(
        parts[0] if kind != BOOSTED else parts, list(meta["class_names"]),
        list(meta["feature_names"]), kind, meta["model_version"])


def model_info(spark: SparkSession, folder: str) -> DataFrame:
    return read_metadata(spark, folder).select(
        "model_version", F.col("class_names").alias("classes"), "n_classes")
