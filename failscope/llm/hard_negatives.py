"""Hard negatives of anchors: integer inner products by Strassen's recursion over tiles.

A component is floor(scale * x). Candidate rows and anchor rows are packed into blocks; a tile is
an anchor block against a candidate block, a stated query set against all rows. A tile's scores
come from Strassen's seven products: both sides are padded with zeros to even halves on each
level, all additions are of whole 64-bit numbers, and only the halves of the last level are
multiplied directly. 64-bit sums wrap, so they are exact as long as the scores themselves fit;
where a bound says that one might not, the same recursion runs on whole numbers of any size and
scores are cut to the range of a long.

Two passes over the tiles follow. The first keeps a heap of the best rows of the anchor's label,
its positives. The second keeps, for each positive, a heap of the best rows of another label
inside the window that the positive's score gives. Heaps hold a fixed number of entries and
merge: tiles of one task merge in the task, those of different tasks by a ranked window that
also cuts before its shuffle. So no label, however frequent, is a key of any shuffle.

Memory of a task is set by the block sizes and ``HELD``, whatever the tables' sizes; no block
goes through the driver.

Defined results: rows with a null id, label or vector, or with a null or non-finite component
(or one that scaling makes so) take no part. Vectors of different lengths share the components
that both have; an empty vector scores 0 with all. Rows that share an anchor's vec_id are its
own and are none of its positives or negatives. Repeated rows count as rows each: a repeated
anchor gives its results again. Ties go to the smaller vec_id. Empty tables give no rows. Only
vec_id, label and the vector are read, whatever else the table holds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from failscope.llm.common import counted, dealt, saved, tiles

#: A side of a product that is not halved any further.
LEAF = 32
#: Anchors whose heaps a task holds before it hands them on.
HELD = 65_536
HIGH = np.iinfo(np.int64).max
#: Stands for "no entry"; real scores are greater.
NONE = -HIGH
_KINDS = [np.dtype(k) for k in ("int8", "int16", "int32", "int64", "float64")]


def multiply(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """Whole-number product of ``a`` (m x k) and the transpose of ``b`` (n x k)."""
    (m, k), n = a.shape, len(b)
    if min(m, k, n) <= leaf:
        if a.dtype == object:
            return a.dot(b.T) if k else np.full((m, n), 0, object)
        return np.einsum("ik,jk->ij", np.ascontiguousarray(a), np.ascontiguousarray(b))
    if m % 2 or k % 2 or n % 2:
        padded_a = np.pad(a, ((0, m % 2), (0, k % 2)))
        padded_b = np.pad(b, ((0, n % 2), (0, k % 2)))
        return multiply(padded_a, padded_b, leaf)[:m, :n]
    up, left, front = m // 2, k // 2, n // 2
    a11, a12, a21, a22 = a[:up, :left], a[:up, left:], a[up:, :left], a[up:, left:]
    # quarters of the transpose of b, each held as rows
    b11, b21, b12, b22 = b[:front, :left], b[:front, left:], b[front:, :left], b[front:, left:]
    diagonal = multiply(a11 + a22, b11 + b22, leaf)
    lower = multiply(a21 + a22, b11, leaf)
    right = multiply(a11, b12 - b22, leaf)
    under = multiply(a22, b21 - b11, leaf)
    upper = multiply(a11 + a12, b22, leaf)
    out = np.empty((m, n), diagonal.dtype)
    out[:up, front:] = right + upper
    out[up:, :front] = lower + under
    out[up:, front:] = diagonal - lower + right + multiply(a21 - a11, b11 + b12, leaf)
    out[:up, :front] = diagonal + under - upper + multiply(a12 - a22, b21 + b22, leaf)
    return out


def _whole(x: np.ndarray, kind) -> np.ndarray:
    if kind is object:
        return np.array([[int(v) for v in row] for row in x.tolist()], object).reshape(x.shape)
    return x.astype(np.int64)


def scores(anchors: np.ndarray, rows: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """Scores (anchors x rows) as longs; see the module's text for those beyond a long."""
    terms = min(anchors.shape[1], rows.shape[1])
    anchors, rows = anchors[:, :terms], rows[:, :terms]
    largest = [float(np.abs(x.astype(float)).max(initial=0)) for x in (anchors, rows)]
    fits = max(largest) < 2.0**62 and largest[0] * largest[1] * terms < 2.0**62
    kind = np.int64 if fits else object
    out = multiply(_whole(anchors, kind), _whole(rows, kind), leaf)
    if kind is object:
        out = np.array([[min(max(v, NONE + 1), HIGH) for v in row] for row in out.tolist()],
                       np.int64).reshape(len(anchors), len(rows))
    return out


def best(values: np.ndarray, allowed: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best allowed entries of each row, as (scores, ids); ``ids`` ascend, so ties are right."""
    left = np.where(allowed, values, NONE)
    lines = np.arange(len(left))
    top, owner = np.full((len(left), k), NONE), np.zeros((len(left), k), np.int64)
    for place in range(k if left.size else 0):
        at = left.argmax(axis=1)
        top[:, place], owner[:, place] = left[lines, at], ids[at]
        left[lines, at] = NONE
    return top, owner


def merged(one: tuple, other: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Two heaps of the same anchors as one of the same size."""
    top, owner = (np.concatenate(pair, axis=-1) for pair in zip(one, other))
    order = np.lexsort((owner, -top), axis=-1)[..., : one[0].shape[-1]]
    return np.take_along_axis(top, order, -1), np.take_along_axis(owner, order, -1)


def _matrix(columns: list[pa.Array], scale: int) -> np.ndarray:
    """Rows x components of floor(scale * x), in the smallest type; shorter rows end in 0."""
    lengths = np.concatenate([c.value_lengths().to_numpy(zero_copy_only=False) for c in columns])
    flat = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in columns])
    out = np.zeros((len(lengths), int(lengths.max(initial=0))))
    out[np.arange(out.shape[1]) < lengths[:, None]] = np.floor(flat * scale)
    for kind in _KINDS[:-1]:
        limit = float(np.iinfo(kind).max)
        if np.abs(out).max(initial=0) <= min(limit, 2.0**62):
            return out.astype(kind)
    return out


def _packed(rows: DataFrame, columns: list[str], scale: int, size: int, prefix: str) -> DataFrame:
    """Blocks of up to ``size`` rows of one partition, by vec_id: each column's longs, and the vectors."""
    names = [prefix + c for c in (*columns, "kind", "terms", "weights")]

    def block(held: pa.Table) -> pa.RecordBatch:
        held = held.combine_chunks()
        numbers = [held.column(i).to_numpy() for i in range(len(columns))]
        order = np.argsort(numbers[0], kind="stable")
        matrix = _matrix(held.column(len(columns)).chunks, scale)[order]
        return pa.RecordBatch.from_arrays([
            *[pa.array([c.astype(np.int64)[order].tobytes()], pa.binary()) for c in numbers],
            pa.array([_KINDS.index(matrix.dtype)], pa.int32()), pa.array([matrix.shape[1]], pa.int32()),
            pa.array([matrix.tobytes()], pa.binary())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, size - n)
                held.append(part)
                n, at = n + part.num_rows, at + part.num_rows
                if n == size:
                    yield block(pa.Table.from_batches(held))
                    held, n = [], 0
        if n:
            yield block(pa.Table.from_batches(held))

    kinds = ["binary"] * len(columns) + ["int", "int", "binary"]
    return rows.select(*columns, "embedding").mapInArrow(
        run, ", ".join(f"{n} {k}" for n, k in zip(names, kinds)))


class _Block:
    """A packed block again: its columns as arrays by name, and its matrix."""

    def __init__(self, batch: pa.RecordBatch, at: int, prefix: str, columns: list[str]) -> None:
        take = lambda name: batch.column(batch.schema.get_field_index(prefix + name))[at]
        self.numbers = {c: np.frombuffer(take(c).as_buffer(), np.int64) for c in columns}
        kind = _KINDS[take("kind").as_py()]
        self.matrix = np.frombuffer(take("weights").as_buffer(), kind).reshape(
            len(self.numbers[columns[0]]), take("terms").as_py())

    def __getitem__(self, name: str) -> np.ndarray:
        return self.numbers[name]


def _tiles(asked: DataFrame, n_asked: int, blocks: DataFrame, columns: list[str], k: int,
           heap: Callable[[_Block, _Block, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(row, place, vec_id, score): heaps of every anchor block over all candidate blocks.

    ``heap`` gives the (scores, ids) of a tile, shaped anchors x places x ``k``.
    """

    def rows_of(held: dict) -> Iterator[pa.RecordBatch]:
        for numbers, (top, owner) in held.values():
            line, place, at = np.nonzero(top > NONE)
            yield pa.RecordBatch.from_arrays([
                pa.array(numbers[line]), pa.array(place, pa.int32()),
                pa.array(owner[line, place, at]), pa.array(top[line, place, at])],
                names=["row", "place", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, tuple] = {}
        anchors_held = 0
        for batch in batches:
            for at in range(batch.num_rows):
                asking = _Block(batch, at, "a_", columns)
                rows = _Block(batch, at, "c_", ["vec_id", "label"])
                found = heap(asking, rows, scores(asking.matrix, rows.matrix))
                key = asking["row"].tobytes()
                if key in held:
                    held[key] = (held[key][0], merged(held[key][1], found))
                    continue
                held[key] = (asking["row"].copy(), found)
                anchors_held += len(asking["row"])
                if anchors_held >= HELD:
                    yield from rows_of(held)
                    held, anchors_held = {}, 0
        yield from rows_of(held)

    found = tiles(blocks, asked, n_asked).mapInArrow(run, "row long, place int, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("row", "place").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _positive_heap(k: int):
    def heap(asking: _Block, rows: _Block, values: np.ndarray):
        allowed = (asking["label"][:, None] == rows["label"]) & (asking["vec_id"][:, None] != rows["vec_id"])
        top, owner = best(values, allowed, rows["vec_id"], k)
        return top[:, None, :], owner[:, None, :]

    return heap


def _window_heap(places: int, k: int, low: int, high: int):
    def heap(asking: _Block, rows: _Block, values: np.ndarray):
        shape = (len(values), places, k)
        top, owner = np.full(shape, NONE), np.zeros(shape, np.int64)
        other = (asking["label"][:, None] != rows["label"]) & (asking["vec_id"][:, None] != rows["vec_id"])
        for place in range(places):
            edges = [(at, -(-low * p // 100), high * p // 100) for at, p in
                     enumerate(asking[f"p{place}"].tolist()) if p > NONE]
            edges = [(at, max(a, NONE + 1), min(b, HIGH)) for at, a, b in edges if a <= b]
            if not edges:
                continue
            lines, least, most = (np.array(c, np.int64) for c in zip(*edges))
            mine = values[lines]
            inside = other[lines] & (mine >= least[:, None]) & (mine <= most[:, None])
            top[lines, place], owner[lines, place] = best(mine, inside, rows["vec_id"], k)
        return top, owner

    return heap


def hard_negatives(vectors: DataFrame, positives: int = 5, negatives: int = 3, low: int = 50,
                   high: int = 95, scale: int = 256, every: int = 50, block_rows: int = 4_096,
                   block_anchors: int = 512) -> DataFrame:
    """anchor_id, positive_id, positive_rank, positive_score, rank, negative_id, negative_score.

    Anchors are the rows whose vec_id is divisible by ``every``. An anchor's positives are its
    best ``positives`` other rows of its label; for each come the best ``negatives`` rows of another
    label with low * positive_score <= 100 * negative_score <= high * positive_score.
    """
    usable = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
        F.col("embedding").cast("array<double>").alias("embedding")).where(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()
        & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * scale) < float("inf"))))
    usable, n = counted(usable.withColumn("row", F.monotonically_increasing_id()), "vectors")
    anchors, n_anchors = counted(usable.where(F.pmod("vec_id", F.lit(every)) == 0), "anchors")
    anchors = anchors.coalesce(-(-n_anchors // block_anchors) or 1)
    blocks = saved(_packed(
        dealt(usable, -(-n // block_rows) or 1), ["vec_id", "label"], scale, block_rows, "c_"), "candidate-blocks")

    columns = ["vec_id", "row", "label"]
    asked, n_asked = counted(_packed(anchors, columns, scale, block_anchors, "a_"), "anchor-blocks")
    found = saved(_tiles(asked, n_asked, blocks, columns, positives, _positive_heap(positives)).select(
        "row", (F.col("rank") - 1).alias("place"), F.col("vec_id").alias("positive_id"),
        F.col("score").alias("positive_score")), "positives")

    places = [f"p{i}" for i in range(positives)]
    wide = found.groupBy("row").agg(*[
        F.max(F.when(F.col("place") == i, F.col("positive_score"))).alias(p) for i, p in enumerate(places)])
    paired = saved(anchors.join(wide, "row").select(
        *columns, *[F.coalesce(p, F.lit(NONE)).alias(p) for p in places], "embedding"), "anchors-with-positives")
    paired = paired.coalesce(-(-n_anchors // block_anchors) or 1)
    columns = [*columns, *places]
    asked, n_asked = counted(_packed(paired, columns, scale, block_anchors, "a_"), "anchor-blocks")
    mined = _tiles(asked, n_asked, blocks, columns, negatives, _window_heap(positives, negatives, low, high))
    mined = mined.select("row", "place", "rank", F.col("vec_id").alias("negative_id"),
                         F.col("score").alias("negative_score"))
    return mined.join(found, ["row", "place"]).join(
        anchors.select("row", F.col("vec_id").alias("anchor_id")), "row").select(
        "anchor_id", "positive_id", (F.col("place") + 1).alias("positive_rank"), "positive_score",
        "rank", "negative_id", "negative_score")
