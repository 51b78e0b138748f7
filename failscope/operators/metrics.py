"""Classification metrics from (actual, predicted, confidence) rows.

The rows are read once, into a 6 x 6 table; all else is arithmetic on that table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from failscope import constants as K
from failscope.session import materialize

_ACTUAL, _PREDICTED = "actual_root_cause", "predicted_root_cause"


def confusion_matrix(preds: DataFrame, classes: list[str] | None = None) -> DataFrame:
    """Counts for every pair of classes: (actual, predicted, n)."""
    classes = classes or K.ROOT_CAUSES
    grid = preds.sparkSession.createDataFrame(
        [(a, p) for a in classes for p in classes], "actual string, predicted string")
    counted = preds.groupBy(
        F.col(_ACTUAL).alias("actual"), F.col(_PREDICTED).alias("predicted")
    ).agg(F.count("*").alias("n"))
    return grid.join(counted, ["actual", "predicted"], "left").na.fill(0, ["n"])


def _ratio(a, b):
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def class_report(matrix: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class; an empty denominator gives 0."""
    hit = F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)
    by_actual = matrix.groupBy(F.col("actual").alias("root_cause")).agg(
        F.sum("n").alias("support"), F.sum(hit).alias("hits"))
    by_predicted = matrix.groupBy(F.col("predicted").alias("root_cause")).agg(
        F.sum("n").alias("claimed"))
    both = by_actual.join(by_predicted, "root_cause")
    precision = _ratio(F.col("hits"), F.col("claimed"))
    recall = _ratio(F.col("hits"), F.col("support"))
    f1 = _ratio(2 * F.col("hits"), F.col("claimed") + F.col("support"))
    return both.select(
        "root_cause", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"),
        "support", "hits")


def overall_metrics(report: DataFrame) -> DataFrame:
    n = F.sum("support")
    return report.agg(
        _ratio(F.sum("hits"), n).alias("accuracy"),
        F.avg("f1").alias("macro_f1"),
        _ratio(F.sum(F.col("f1") * F.col("support")), n).alias("weighted_f1"),
        n.alias("n_rows"))


def confidence_by_class(preds: DataFrame) -> DataFrame:
    """Mean confidence per actual class and, in the row without a class, overall."""
    per = preds.groupBy(F.col(_ACTUAL).alias("root_cause")).agg(
        F.count("*").alias("n"), F.sum("confidence").alias("s"))
    total = per.agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    return per.unionByName(total.withColumn("root_cause", F.lit(None).cast("string"))).select(
        "root_cause", "n", (F.col("s") / F.col("n")).alias("avg_confidence"))


def most_common_error(matrix: DataFrame) -> DataFrame:
    """The largest off-diagonal cell, ties in row order; no row when there is no error."""
    return (
        matrix.where("actual <> predicted AND n > 0")
        .orderBy(F.desc("n"), "actual", "predicted").limit(1))


def go_no_go(overall: DataFrame, threshold: float = K.MIN_MACRO_F1) -> DataFrame:
    return overall.select("macro_f1", (F.col("macro_f1") >= threshold).alias("go"))


def require_go(overall: DataFrame, threshold: float = K.MIN_MACRO_F1) -> None:
    """Raise unless macro F1 reaches the threshold; call before saving a model."""
    row = go_no_go(overall, threshold).first()
    if not row["go"]:
        raise ValueError(f"macro F1 {row['macro_f1']:.4f} is below {threshold:.2f}: not saved")


def summary_table(preds: DataFrame) -> DataFrame:
    """Per class: precision, recall, F1, mean confidence and support."""
    report = class_report(confusion_matrix(preds))
    conf = confidence_by_class(preds).where("root_cause IS NOT NULL").select(
        "root_cause", "avg_confidence")
    return report.join(conf, "root_cause", "left").select(
        "root_cause", "precision", "recall", "f1",
        F.coalesce("avg_confidence", F.lit(0.0)).alias("avg_confidence"), "support")


def label_count(df: DataFrame, label: str = "root_cause") -> DataFrame:
    return df.agg(F.count_distinct(label).alias("n_classes"))


def label_index(df: DataFrame, label: str = "root_cause") -> DataFrame:
    """Alphabetical index per label, found from the data: (label, label_index)."""
    return df.select(label).distinct().select(
        label, (F.row_number().over(Window.orderBy(label)) - 1).alias("label_index"))


def encode_labels(df: DataFrame, label: str = "root_cause") -> DataFrame:
    """Add ``label_index``. The written index has its true size, so it is broadcast."""
    return df.join(materialize(label_index(df, label), "labels"), label, "left")


def decode_labels(df: DataFrame, index: DataFrame, label: str = "root_cause") -> DataFrame:
    """Back from ``label_index`` to the label."""
    return df.join(index.select("label_index", label), "label_index", "left")
