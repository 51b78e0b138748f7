"""Per-prediction feature attributions of trees (path-dependent Shapley values).

For every prediction: base value + sum of contributions = what the trees give the class. That
is its probability for a forest, and the margin of its booster (before the logistic) for
boosted trees. The scored rows stay partitioned by Spark; a task only evaluates the trees on
its batch.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, RandomForestClassificationModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from failscope.operators.model import FOREST, RootCauseModel, assemble
from failscope.session import new_path

#: Rows that a task explains at once, for their own class and for all classes.
ROWS_AT_ONCE, ROWS_ALL_CLASSES = 10_000, 4_096


def tree_nodes(
    trees_of: RandomForestClassificationModel | GBTClassificationModel,
) -> dict[int, dict[int, dict]]:
    """Nodes per tree. Their number is bounded by trees * 2 ** (depth + 1)."""
    spark = SparkSession.getActiveSession()
    path = new_path(spark, "trees")
    trees_of.write().overwrite().save(path)
    rows = spark.read.parquet(f"{path}/data").collect()
    trees: dict[int, dict[int, dict]] = {}
    for r in rows:
        n = r["nodeData"]
        trees.setdefault(r["treeID"], {})[n["id"]] = {
            "left": n["leftChild"], "right": n["rightChild"], "stats": n["impurityStats"],
            "prediction": n["prediction"],
            "feature": n["split"]["featureIndex"],
            "threshold": (n["split"]["leftCategoriesOrThreshold"] or [0.0])[0]}
    return trees


def _class_weight(node: dict) -> float:
    """Training weight of a classification tree's node."""
    return float(np.sum(node["stats"]))


def _row_weight(node: dict) -> float:
    """Training weight of a regression tree's node, whose statistics are weight, sum, squares."""
    return float(node["stats"][0])


def _paths(tree: dict[int, dict], weight: Callable[[dict], float] = _class_weight
           ) -> Iterator[tuple[dict, dict]]:
    """Each leaf as {feature: (low, high, share)}, and its node.

    A feature's share is the part of the training weight that follows the path at
    its splits; a value in (low, high] follows the path.
    """
    stack = [(0, {})]
    while stack:
        at, path = stack.pop()
        node = tree[at]
        if node["left"] < 0:
            yield path, node
            continue
        f, cut = node["feature"], node["threshold"]
        low, high, share = path.get(f, (-math.inf, math.inf, 1.0))
        for child, lo, hi in ((node["left"], low, min(high, cut)),
                              (node["right"], max(low, cut), high)):
            part = weight(tree[child]) / weight(node)
            stack.append((child, {**path, f: (lo, hi, share * part)}))


def _leaf_table(shares: np.ndarray) -> np.ndarray:
    """Shapley weight of each path feature for every pattern of followed features.

    The leaf is a product game: a known feature contributes 1 or 0 (followed or not),
    an unknown one its share. Subset sums come from a polynomial per left-out feature.
    """
    m = len(shares)
    followed = (np.arange(2 ** m)[:, None] >> np.arange(m)) & 1
    weight = [math.factorial(k) * math.factorial(m - k - 1) / math.factorial(m) for k in range(m)]
    table = np.zeros((2 ** m, m))
    for j in range(m):
        poly = np.zeros((2 ** m, m))
        poly[:, 0] = 1.0
        for i in range(m):
            if i != j:
                grown = poly * shares[i]
                grown[:, 1:] += poly[:, :-1] * followed[:, [i]]
                poly = grown
        table[:, j] = (poly @ np.array(weight)) * (followed[:, j] - shares[j])
    return table


def _leaf(path: dict, value: np.ndarray) -> tuple[tuple | None, np.ndarray]:
    """A leaf's features, low, high, table and value (None without a split); its part of the base."""
    low, high, shares = (np.array([path[f][i] for f in path]) for i in range(3))
    leaf = (np.array(list(path), dtype=int), low, high, _leaf_table(shares), value) if path else None
    return leaf, value * np.prod(shares)


def leaf_tables(forest: RandomForestClassificationModel) -> tuple[list, np.ndarray]:
    """Per leaf: features, low, high, table, class shares; and the base value per class."""
    leaves, base = [], 0.0
    trees = tree_nodes(forest)
    for tree in trees.values():
        for path, node in _paths(tree):
            leaf, part = _leaf(path, np.array(node["stats"], dtype=float) / _class_weight(node) / len(trees))
            leaves += [leaf] if leaf else []
            base = base + part
    return leaves, np.asarray(base)


def boosted_tables(boosters: list[GBTClassificationModel]) -> tuple[list, np.ndarray]:
    """``leaf_tables`` of one booster per class: a leaf's value is its part of its class's margin."""
    leaves, base = [], np.zeros(len(boosters))
    for at, booster in enumerate(boosters):
        steps = booster.treeWeights
        for number, tree in tree_nodes(booster).items():
            for path, node in _paths(tree, _row_weight):
                value = np.zeros(len(boosters))
                value[at] = node["prediction"] * steps[number]
                leaf, part = _leaf(path, value)
                leaves += [leaf] if leaf else []
                base = base + part
    return leaves, base


def _sides(columns: np.ndarray) -> Callable[[int, float, float], np.ndarray]:
    """Which rows have a feature in (low, high], as 0 and 1; each comparison is made once.

    ``columns`` holds a line per feature, so each comparison runs along memory.
    """
    seen: dict[tuple[int, float, bool], np.ndarray] = {}

    def side(f: int, cut: float, above: bool) -> np.ndarray:
        key = (f, cut, above)
        if key not in seen:
            seen[key] = (columns[f] > cut if above else columns[f] <= cut).view(np.uint8)
        return seen[key]

    def inside(f: int, low: float, high: float) -> np.ndarray:
        if low == -math.inf:
            return side(f, high, False)
        return side(f, low, True) if high == math.inf else side(f, low, True) & side(f, high, False)

    return inside


def _weighted(leaves: list, columns: np.ndarray, rows_of: Callable[[np.ndarray], list[slice]]
              ) -> Iterator[tuple[np.ndarray, slice, np.ndarray, np.ndarray]]:
    """Per leaf and slice of the rows it matters to: its features, the slice, their Shapley weights
    (a line per feature) there, its value."""
    inside = _sides(columns)
    for features, low, high, table, value in leaves:
        wanted = rows_of(value)
        if not wanted:
            continue
        path = [inside(*at) for at in zip(features.tolist(), low.tolist(), high.tolist())]
        kind = np.uint8 if len(path) <= 8 else np.intp
        for rows in wanted:
            pattern = np.zeros(rows.stop - rows.start, kind)
            for j, followed in enumerate(path):
                pattern |= followed[rows].astype(kind, copy=False) << kind(j)
            yield features, rows, np.take(table.T, pattern, axis=1, mode="clip"), value


def contributions(leaves: list, x: np.ndarray, cls: np.ndarray) -> np.ndarray:
    """Contribution of every feature to class ``cls`` of every row of ``x``.

    Rows are taken class by class: a leaf that gives a class nothing adds nothing to its rows.
    """
    order = np.argsort(cls, kind="stable")
    known, starts = np.unique(cls[order], return_index=True)
    parts = [slice(a, b) for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(x)])]
    of_class = dict(zip(starts.tolist(), known.tolist()))
    out = np.zeros(x.shape[::-1])
    found = _weighted(leaves, np.ascontiguousarray(x[order].T), lambda value: [
        rows for c, rows in zip(known, parts) if value[c]])
    for features, rows, weights, value in found:
        weights *= value[of_class[rows.start]]
        for f, weight in zip(features, weights):
            out[f, rows] += weight
    back = np.empty(x.shape)
    back[order] = out.T
    return back


def class_contributions(leaves: list, x: np.ndarray, n_classes: int) -> np.ndarray:
    """The same for all classes (row, class, feature): a row follows its leaves once."""
    out = np.zeros((n_classes, *x.shape[::-1]))
    whole = [slice(0, len(x))]
    for features, _, weights, value in _weighted(leaves, np.ascontiguousarray(x.T), lambda value: whole):
        for c in np.flatnonzero(value):
            for f, weight in zip(features, weights):
                out[c, f] += weight * value[c]
    return out.transpose(2, 0, 1)


def attributions(
    model: RootCauseModel, features: DataFrame, id: str = "event_id", all_classes: bool = False
) -> DataFrame:
    """Rows (id, root_cause, base_value, contributions) in feature order.

    For the predicted class, or with ``all_classes`` one row per class.
    """
    n_classes = len(model.classes)
    scored = features.withColumn("class_index", F.lit(0)) if all_classes else model.score(features)
    vector = F.array(*[F.col(f"`{n}`").cast("double") for n in model.names])
    rows = scored.select(F.col(id).alias("id"), "class_index", vector.alias("x"))
    spark = features.sparkSession
    leaves, base = (leaf_tables if model.kind == FOREST else boosted_tables)(model.trees)
    shared = spark.sparkContext.broadcast(leaves)
    id_type = rows.schema["id"].dataType.simpleString()

    def explain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = ROWS_ALL_CLASSES if all_classes else ROWS_AT_ONCE
        for whole in batches:
            for start in range(0, whole.num_rows, step):
                batch = whole.slice(start, step)
                n = batch.num_rows
                ids, cls, x = batch.columns
                x = x.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, -1)
                if all_classes:
                    ids = ids.take(pa.array(np.repeat(np.arange(n), n_classes)))
                    cls = np.tile(np.arange(n_classes, dtype=np.int32), n)
                    found = class_contributions(shared.value, x, n_classes)
                else:
                    cls = cls.to_numpy(zero_copy_only=False)
                    found = contributions(shared.value, x, cls)
                ends = np.arange(len(cls) + 1, dtype=np.int32) * x.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(cls, pa.int32()), pa.array(base[cls]),
                     pa.ListArray.from_arrays(pa.array(ends), pa.array(found.ravel()))],
                    ["id", "class_index", "base_value", "contributions"])

    out = rows.mapInArrow(
        explain,
        f"id {id_type}, class_index int, base_value double, contributions array<double>")
    names = F.array(*[F.lit(c) for c in model.classes])
    return out.select(
        F.col("id").alias(id), F.get(names, F.col("class_index")).alias("root_cause"),
        "base_value", "contributions")


def contribution_items(explained: DataFrame, features: DataFrame, names: list[str],
                       id: str = "event_id") -> DataFrame:
    """Add ``items``: (feature, shap_value, feature_value) per prediction, for ranking."""
    values = features.select(id, F.array(*[
        F.col(f"`{n}`").cast("double") for n in names]).alias("values"))
    listed = F.arrays_zip(
        F.array(*[F.lit(n) for n in names]).alias("feature"),
        F.col("contributions").alias("shap_value"), F.col("values").alias("feature_value"))
    return explained.join(values, id).withColumn("items", listed).drop("values")


def long_contributions(explained: DataFrame, names: list[str], id: str = "event_id") -> DataFrame:
    """One row per prediction and feature, with the absolute value."""
    listed = F.arrays_zip(
        F.array(*[F.lit(n) for n in names]).alias("feature"),
        F.col("contributions").alias("shap_value"))
    rows = explained.select(id, "root_cause", F.explode_outer(listed).alias("c"))
    return rows.select(
        id, "root_cause", "c.feature", "c.shap_value", F.abs("c.shap_value").alias("abs_shap"))
