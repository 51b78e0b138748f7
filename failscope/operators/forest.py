"""A random forest over many rows: all trees grow together, a level in a pass over packed rows.

MLlib keeps each row with its bins as numbers of 4 bytes and its sample counts of all trees, and
scans all rows once for every few nodes whose statistics fit a core's cache. Here a row is one
byte per feature, its sample counts are drawn again in each pass from a seed of its block, and one
matrix product per class counts the sampled rows left of every threshold in all open nodes.

The rules are MLlib's: thresholds from a sample of about 10,000 rows (midpoints, at most ``BINS`` - 1
per feature), Poisson sample counts per tree and row, a share of the features drawn per node, Gini
gain over class-weighted counts, leaves with the same class joined. Counts are whole numbers, so
the trees do not depend on the order in which tasks end. Memory of a task is set by ``BLOCK_ROWS``
and ``COUNT_BYTES``; the driver holds the threshold sample and the nodes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.linalg import DenseVector
from pyspark.serializers import CPickleSerializer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS = 32
SAMPLE_ROWS = 10_000
BLOCK_ROWS = 4_096
ROWS_PER_TASK = 200_000
#: Counts that a task of a pass holds; levels with more open nodes take several passes.
COUNT_BYTES = 1 << 25


@dataclass
class Node:
    """A node in the making: ``counts`` are sampled rows by class."""

    tree: int
    number: int
    depth: int
    counts: np.ndarray | None = None
    feature: int = -1
    place: int = 0
    gain: float = 0.0
    left: int = -1
    right: int = -1


def thresholds(values: np.ndarray, weights: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Midpoints between values: all of them, or up to ``bins`` - 1 at even weight."""
    distinct, at = np.unique(values, return_inverse=True)
    middles = (distinct[:-1] + distinct[1:]) / 2
    if len(middles) < bins:
        return middles
    upto = np.cumsum(np.bincount(at, weights))
    wanted = upto[-1] / bins * np.arange(1, bins)
    after = np.searchsorted(upto, wanted)
    before = np.maximum(after - 1, 0)
    nearer = np.where(np.abs(upto[before] - wanted) <= np.abs(upto[after] - wanted), before, after)
    return middles[np.unique(np.minimum(nearer, len(middles) - 1))]


def gini(weights: np.ndarray) -> np.ndarray:
    """Impurity of class weights along the first axis; 0 for none."""
    total = weights.sum(axis=0)
    return np.where(total > 0, 1 - np.square(weights / np.where(total > 0, total, 1)).sum(axis=0), 0.0)


def best_split(left: np.ndarray, counts: np.ndarray, weights: np.ndarray, feature: np.ndarray,
               order: np.ndarray, least: int) -> tuple[int, float]:
    """Threshold of the greatest gain and its gain, or (-1, 0).

    ``left`` are sampled rows (class x threshold) left of each threshold, ``feature`` is each
    threshold's feature; ``order`` holds the features allowed here, the first of equals wins.
    """
    right = counts[:, None] - left
    ours, other = left * weights[:, None], right * weights[:, None]
    share = ours.sum(axis=0) / (counts * weights).sum()
    gain = gini(counts * weights) - share * gini(ours) - (1 - share) * gini(other)
    rank = np.full(int(feature.max(initial=-1)) + 1, len(order))
    allowed = order[order < len(rank)]
    rank[allowed] = np.flatnonzero(order < len(rank))
    fit = (left.sum(axis=0) >= least) & (right.sum(axis=0) >= least) & (gain > 0)
    fit &= rank[feature] < len(order)
    at = np.flatnonzero(fit)
    if not len(at):
        return -1, 0.0
    chosen = at[np.lexsort((at, rank[feature[at]], -gain[at]))[0]]
    return int(chosen), float(gain[chosen])


def _poisson_table(rate: float) -> np.ndarray:
    """Sample count of each 16-bit number, so that even numbers give Poisson counts."""
    upto, chance, table = 0.0, math.exp(-rate), np.zeros(1 << 16, np.uint8)
    for k in range(256):
        upto += chance
        table[min(round(upto * (1 << 16)), 1 << 16):] = min(k + 1, 255)
        chance *= rate / (k + 1)
    return table


def _values(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A feature's values; nulls and NaN are errors, as in MLlib's assembler."""
    values = column.to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.to_numpy()
    if np.isnan(values).any():
        raise ValueError("a feature is null or NaN")
    return values


def _packed(rows: DataFrame, cuts: list[np.ndarray], partitions: int) -> DataFrame:
    """Blocks (part, block, labels, bins): rows placed by id hash, sorted, then by class in a block."""

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            bins = np.empty((batch.num_rows, len(cuts)), np.uint8)
            for f, cut in enumerate(cuts):
                bins[:, f] = np.searchsorted(cut, _values(batch.column(2 + f)))
            ends = np.arange(batch.num_rows + 1, dtype=np.int32) * len(cuts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.Array.from_buffers(
                    pa.binary(), batch.num_rows, [None, pa.py_buffer(ends), pa.py_buffer(bins)])],
                ["id", "label", "bins"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held, n = TaskContext.get().partitionId(), 0, [], 0

        def block() -> pa.RecordBatch:
            labels = np.concatenate([h.column(0).to_numpy() for h in held]).astype(np.int32)
            joined = b"".join(v for h in held for v in h.column(1).to_pylist())
            bins = np.frombuffer(joined, np.uint8).reshape(len(labels), -1)
            order = np.argsort(labels, kind="stable")
            return pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.array([number], pa.int32()),
                pa.array([labels[order].tobytes()], pa.binary()),
                pa.array([np.ascontiguousarray(bins[order].T).tobytes()], pa.binary())],
                ["part", "block", "labels", "bins"])

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                some = batch.slice(at, BLOCK_ROWS - n)
                held.append(some)
                n, at = n + some.num_rows, at + some.num_rows
                if n == BLOCK_ROWS:
                    yield block()
                    held, n, number = [], 0, number + 1
        if n:
            yield block()

    id_type = rows.schema["id"].dataType.simpleString()
    small = rows.mapInArrow(binned, f"id {id_type}, label int, bins binary")
    placed = small.repartition(partitions, "id").sortWithinPartitions("id", "label", "bins")
    return placed.select("label", "bins").mapInArrow(
        blocks, "part int, block int, labels binary, bins binary")


def _counted(blocks: DataFrame, trees: list[list[Node]], opened: list[Node], cuts: list[np.ndarray],
             n_classes: int, rate: float, seed: int) -> DataFrame:
    """(col, counts): per task and open node, sampled rows by class left of each threshold, and all."""
    shape = [[(n.number, n.feature, n.place, n.left, n.right) for n in tree if n.feature >= 0] for tree in trees]
    open_of: dict[int, list[tuple[int, int]]] = {}
    for col, node in enumerate(opened):
        open_of.setdefault(node.tree, []).append((node.number, col))
    spark = blocks.sparkSession
    shared = spark.sparkContext.broadcast((shape, open_of, [len(c) for c in cuts], len(opened)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape, open_of, sizes, n_open = shared.value
        table, sums = _poisson_table(rate), None
        for batch in batches:
            for at in range(batch.num_rows):
                part, block = batch.column(0)[at].as_py(), batch.column(1)[at].as_py()
                labels = np.frombuffer(batch.column(2)[at].as_buffer(), np.int32)
                bins = np.frombuffer(batch.column(3)[at].as_buffer(), np.uint8).reshape(-1, len(labels))
                draws = np.random.Generator(np.random.SFC64([seed % (1 << 63), part, block]))
                samples = table[draws.integers(0, 1 << 16, (len(shape), len(labels)), np.uint16)]
                sampled = np.zeros((n_open, len(labels)), np.float32)
                for tree, wanted in open_of.items():
                    node = np.zeros(len(labels), np.int16)
                    for number, feature, place, left, right in shape[tree]:
                        here = node == number
                        go = bins[feature] > place
                        np.copyto(node, left, where=here & ~go)
                        np.copyto(node, right, where=here & go)
                    for number, col in wanted:
                        np.multiply(node == number, samples[tree], out=sampled[col], casting="unsafe")
                below = np.ones((sum(sizes) + 1, len(labels)), np.float32)
                line = 0
                for feature, size in enumerate(sizes):
                    for place in range(size):
                        below[line] = bins[feature] <= place
                        line += 1
                if sums is None:
                    sums = np.zeros((n_classes, n_open, len(below)))
                ends = np.searchsorted(labels, np.arange(n_classes + 1))
                for c in range(n_classes):
                    if ends[c] < ends[c + 1]:
                        rows = slice(ends[c], ends[c + 1])
                        sums[c] += sampled[:, rows] @ below[:, rows].T
        if sums is not None:
            whole = sums.astype(np.int64)
            for col in range(n_open):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([col], pa.int32()),
                     pa.array([np.ascontiguousarray(whole[:, col]).tobytes()], pa.binary())], ["col", "counts"])

    return blocks.mapInArrow(run, "col int, counts binary")


def _splits(counted: DataFrame, opened: list[Node], cuts: list[np.ndarray], weights: np.ndarray,
            features_per_node: int, least: int, seed: int) -> DataFrame:
    """(col, place, gain, left, counts): the best threshold of each open node, -1 for none."""
    feature = np.repeat(np.arange(len(cuts)), [len(c) for c in cuts])
    nodes = [(n.tree, n.number) for n in opened]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for at in range(batch.num_rows):
                col = batch.column(0)[at].as_py()
                some = np.frombuffer(batch.column(1)[at].as_buffer(), np.int64).reshape(len(weights), -1)
                sums[col] = sums[col] + some if col in sums else some.copy()
        for col, counts in sums.items():
            draws = np.random.Generator(np.random.PCG64([seed % (1 << 63), *nodes[col]]))
            order = draws.permutation(len(cuts))[:features_per_node]
            total, left = counts[:, -1], counts[:, :-1]
            place, gain = best_split(left, total, weights, feature, order, least)
            side = left[:, place] if place >= 0 else np.zeros(len(weights), np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([col], pa.int32()), pa.array([place], pa.int32()), pa.array([gain]),
                 pa.array([side.tolist()], pa.list_(pa.int64())),
                 pa.array([total.tolist()], pa.list_(pa.int64()))],
                ["col", "place", "gain", "left", "counts"])

    return counted.repartition("col").mapInArrow(
        run, "col int, place int, gain double, left array<long>, counts array<long>")


def _model(spark, estimator: RandomForestClassifier, trees: list[list[Node]], cuts: list[np.ndarray],
           weights: np.ndarray) -> RandomForestClassificationModel:
    """MLlib's model of the grown trees, with the estimator's settings."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    ml = jvm.org.apache.spark.ml
    leaf_node, inner_node, split_at = ml.tree.LeafNode, ml.tree.InternalNode, ml.tree.ContinuousSplit
    calculator = jvm.org.apache.spark.mllib.tree.impurity.GiniCalculator
    loads, cut_out = ml.python.MLSerDe.loads, jvm.java.util.Arrays.copyOfRange
    classes = len(weights)

    def built(tree: list[Node], at: int, held):
        node = tree[at]
        stats = node.counts * weights
        impurity, cls = float(gini(stats)), float(stats.argmax())
        measured = calculator(cut_out(held, at * classes, (at + 1) * classes), int(node.counts.sum()))
        if node.feature >= 0:
            left, left_class = built(tree, node.left, held)
            right, right_class = built(tree, node.right, held)
            if left_class is None or left_class != right_class:
                split = split_at(node.feature, float(cuts[node.feature][node.place]))
                return inner_node(cls, impurity, node.gain, left, right, split, measured), None
        return leaf_node(cls, impurity, measured), cls

    models = gateway.new_array(ml.classification.DecisionTreeClassificationModel, len(trees))
    for i, tree in enumerate(trees):
        stats = DenseVector(np.concatenate([n.counts * weights for n in tree]))
        held = loads(bytearray(CPickleSerializer().dumps(stats))).values()
        models[i] = ml.classification.DecisionTreeClassificationModel(
            built(tree, 0, held)[0], len(cuts), classes)
    java = estimator._to_java()
    model = ml.classification.RandomForestClassificationModel(java.uid(), models, len(cuts), classes)
    return estimator._copyValues(RandomForestClassificationModel(java.copyValues(model, ml.param.ParamMap())))


def fit(rows: DataFrame, names: list[str], estimator: RandomForestClassifier, weights: list[float], n: int,
        id: str, partitions: int | None = None) -> RandomForestClassificationModel:
    """The forest of ``estimator`` over ``n`` rows with a class index, ``_label``; ``weights`` by class."""
    spark = rows.sparkSession
    n_trees, seed, rate = estimator.getNumTrees(), estimator.getSeed(), estimator.getSubsamplingRate()
    depth, least = estimator.getMaxDepth(), estimator.getMinInstancesPerNode()
    weights = np.array(weights, float)
    rows = rows.select(F.col(id).alias("id"), F.col("_label").cast("int").alias("label"), *[
        F.col(f"`{name}`").cast("double").alias(f"_f{i}") for i, name in enumerate(names)])

    drawn = F.pmod(F.xxhash64(*rows.columns, F.lit(seed)), F.lit(1 << 32)) < int(min(1.0, SAMPLE_ROWS / n) * (1 << 32))
    sample = rows.where(drawn).drop("id").toArrow()
    by_row = weights[sample.column("label").to_numpy()]
    cuts = [thresholds(_values(sample.column(f"_f{i}")), by_row) for i in range(len(names))]

    partitions = partitions or max(8, math.ceil(n / ROWS_PER_TASK))
    blocks = _packed(rows, cuts, partitions).persist(StorageLevel.DISK_ONLY)
    share = math.ceil(float(estimator.getFeatureSubsetStrategy()) * len(cuts))
    room = max(1, COUNT_BYTES // (8 * len(weights) * (sum(map(len, cuts)) + 1)))
    trees = [[Node(t, 0, 0)] for t in range(n_trees)]
    wanted = [tree[0] for tree in trees]
    try:
        while wanted:
            opened, wanted = wanted[:room], wanted[room:]
            counted = _counted(blocks, trees, opened, cuts, len(weights), rate, seed)
            found = _splits(counted, opened, cuts, weights, share, least, seed).collect()
            for r in sorted(found, key=lambda r: r.col):
                node = opened[r.col]
                node.counts = np.array(r.counts)
                if r.place < 0:
                    continue
                tree, first = trees[node.tree], r.place
                node.feature = 0
                while first >= len(cuts[node.feature]):
                    first, node.feature = first - len(cuts[node.feature]), node.feature + 1
                node.place, node.gain, node.left, node.right = first, r.gain, len(tree), len(tree) + 1
                for counts in (np.array(r.left), node.counts - np.array(r.left)):
                    tree.append(Node(node.tree, len(tree), node.depth + 1, counts))
                    if node.depth + 1 < depth and gini(counts * weights) > 1e-15:
                        wanted.append(tree[-1])
    finally:
        blocks.unpersist()
    return _model(spark, estimator, trees, cuts, weights)
