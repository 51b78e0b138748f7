"""Train, score and evaluate the root-cause classifier with MLlib trees."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import (
    GBTClassificationModel, GBTClassifier, RandomForestClassificationModel,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from failscope import constants as K
from failscope.operators import forest
from failscope.operators.split import balanced_weights, class_weights, stratified_split

FOREST, BOOSTED = "forest", "boosted"
ROWS_PER_PARTITION = 100_000
#: Megabytes of node statistics a pass sums up. A row meets all nodes of a pass, so for many rows
#: they are to stay in a core's cache; few rows take fewer passes instead.
PASS_MB, PASS_MB_MANY_ROWS, MANY_ROWS = 256, 2, 200_000
#: A forest on more rows grows level by level over packed rows, see ``operators.forest``.
LEVEL_ROWS = 1_000_000


def assemble(df: DataFrame, names: list[str]) -> DataFrame:
    """Add the feature vector; column names with spaces or dots are renamed on the way."""
    plain = [f"_f{i}" for i in range(len(names))]
    rows = df.withColumns({p: F.col(f"`{n}`").cast("double") for p, n in zip(plain, names)})
    return VectorAssembler(inputCols=plain, outputCol="features").transform(rows).drop(*plain)


def _index(label: Column, classes: list[str]) -> Column:
    return (F.array_position(F.array(*[F.lit(c) for c in classes]), label) - 1).cast("double")


@dataclass
class RootCauseModel:
    """Fitted trees with the class order and the feature order they were fitted on."""

    trees: RandomForestClassificationModel | list[GBTClassificationModel]
    classes: list[str]
    names: list[str]
    kind: str = FOREST
    version: str = "v1"

    def score(self, features: DataFrame) -> DataFrame:
        """Add class, confidence (4 decimals), probabilities and class index."""
        rows = assemble(features, self.names)
        if self.kind == FOREST:
            rows = self.trees.transform(rows).withColumn(
                "_p", vector_to_array("probability")).drop("probability", "rawPrediction", "prediction")
        else:
            for i, model in enumerate(self.trees):
                model = model.copy()
                model.setProbabilityCol(f"_p{i}").setRawPredictionCol("").setPredictionCol("")
                rows = model.transform(rows).withColumn(f"_p{i}", vector_to_array(f"_p{i}")[1])
            each = [F.col(f"_p{i}") for i in range(len(self.classes))]
            total = reduce(lambda a, b: a + b, each)
            rows = rows.withColumn("_p", F.array(*[p / total for p in each])).drop(
                *[f"_p{i}" for i in range(len(self.classes))])
        best = F.array_max("_p")
        names = F.array(*[F.lit(c) for c in self.classes])
        rows = rows.withColumn("_at", F.array_position("_p", best).cast("int") - 1)
        return rows.withColumns({
            "predicted_root_cause": F.get(names, F.col("_at")),
            "confidence": F.round(best, 4),
            "probabilities": F.map_from_arrays(names, F.col("_p")),
            "class_index": F.col("_at"),
            "model_version": F.lit(self.version),
        }).drop("_p", "_at")

    def importances(self) -> DataFrame:
        """Gain share of every feature (sums to 1), largest first."""
        spark = _active()
        if self.kind == FOREST:
            shares = self.trees.featureImportances.toArray()
        else:
            shares = sum(m.featureImportances.toArray() for m in self.trees) / len(self.trees)
        rows = [(n, float(s)) for n, s in zip(self.names, shares)]
        return spark.createDataFrame(rows, "feature string, importance double").orderBy(
            F.desc("importance"), "feature")

    def info(self) -> DataFrame:
        return _active().createDataFrame(
            [(self.version, self.classes, len(self.classes))],
            "model_version string, classes array<string>, n_classes int")


def _active():
    from pyspark.sql import SparkSession

    return SparkSession.getActiveSession()


def train(
    features: DataFrame, names: list[str], label: str = "root_cause", id: str = "event_id",
    kind: str = FOREST, n_trees: int = K.TREE_PARAMS["n_estimators"],
    seed: int = K.TREE_PARAMS["seed"], version: str = "v1", partitions: int | None = None,
) -> RootCauseModel:
    """Fit on all given rows, weighted so that every class counts the same.

    Rows are placed by id hash and sorted, and trees draw their samples per partition,
    so a seed gives the same trees each time. The number of partitions and the size of a
    pass follow the number of rows, not the cluster. A forest on more than ``LEVEL_ROWS`` grows
    all its trees together (``operators.forest``), by the same rules with other draws.
    """
    counts = features.groupBy(label).agg(F.count("*").alias("n")).orderBy(label).collect()
    n, classes = sum(r["n"] for r in counts), [r[0] for r in counts]
    p = K.TREE_PARAMS
    common = dict(
        featuresCol="features", weightCol="class_weight", maxDepth=p["max_depth"],
        minInstancesPerNode=p["min_child_weight"], subsamplingRate=p["subsample"],
        featureSubsetStrategy=str(p["colsample_bytree"]), seed=seed,
        maxMemoryInMB=PASS_MB_MANY_ROWS if n > MANY_ROWS else PASS_MB)
    estimator = RandomForestClassifier(labelCol="_label", numTrees=n_trees, **common)
    if kind == FOREST and n > LEVEL_ROWS:
        weights = {r[label]: r["class_weight"] for r in class_weights(features, label).collect()}
        trees = forest.fit(
            features.withColumn("_label", _index(F.col(label), classes)), names, estimator,
            [weights[c] for c in classes], n, id, partitions)
        return RootCauseModel(trees, classes, names, kind, version)
    rows = balanced_weights(features, label).withColumn("_label", _index(F.col(label), classes))
    rows = assemble(rows, names).select(id, "features", "_label", "class_weight")
    rows = rows.repartition(
        partitions or max(8, math.ceil(n / ROWS_PER_PARTITION)), id).sortWithinPartitions(id)
    if kind == FOREST:
        return RootCauseModel(estimator.fit(rows), classes, names, kind, version)
    fitted = []
    for i in range(len(classes)):  # one binary booster per class
        one = rows.withColumn("_is", (F.col("_label") == i).cast("double"))
        fitted.append(GBTClassifier(
            labelCol="_is", maxIter=n_trees, stepSize=p["learning_rate"], **common).fit(one))
    return RootCauseModel(fitted, classes, names, kind, version)


def split_train_evaluate(
    features: DataFrame, names: list[str], label: str = "root_cause", id: str = "event_id",
    fraction: float = K.TEST_FRACTION, seed: int = 42, **options,
) -> tuple[RootCauseModel, DataFrame]:
    """Fit on the training part; return the model and the scored holdout."""
    parts = stratified_split(features, label, id, fraction, seed)
    model = train(parts.where("NOT is_test").drop("is_test"), names, label, id, seed=seed, **options)
    scored = model.score(parts.where("is_test").drop("is_test"))
    return model, scored.withColumnRenamed(label, "actual_root_cause")
