"""Exact top-k inner products of integer vectors by term-at-a-time accumulation.

A component is floor(scale * x). Candidate rows are packed into blocks: for every term
(dimension) the postings of a block are the rows where the component is not 0, with their
weights. Query rows are packed into blocks as well and meet every candidate block, a stated
query set against all rows. There, a dense array of scores (queries x rows) is filled term by
term: a query's weight times the postings is scattered into its row. The highest scores are
picked by partition selection, ties by the smaller vec_id, and the blocks' winners are merged,
those of one task in the task.

The block size bounds the memory of a task whatever the tables' sizes, and the driver gets none
of the blocks. Scores are exact: they
are summed in float32 or float64 while no sum can leave the exact range, else in whole numbers
of any size, and are cut to the range of a long.

Null vectors, and vectors that hold a null or non-finite component, take no part, nor do rows
without an id. Vectors of different lengths share the terms that both have. Rows that share
the query's vec_id are its own. Empty tables give no rows. Only id and vector are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from failscope.llm.common import counted, dealt, tiles

_PACK = "ids binary, terms int, weights binary"


def _scaled(vectors: list, scale: int) -> np.ndarray:
    """Rows x terms of floor(scale * x) as whole numbers in float64; shorter rows end in 0."""
    out = np.zeros((len(vectors), max((len(v) for v in vectors), default=0)))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return np.floor(out * scale)


def _packed(rows: DataFrame, scale: int, size: int) -> DataFrame:
    """Blocks of up to ``size`` vectors of one partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors = [], []

        def block() -> pa.RecordBatch:
            weights = _scaled(vectors, scale)
            return pa.RecordBatch.from_arrays([
                pa.array([np.asarray(ids, np.int64).tobytes()], pa.binary()),
                pa.array([weights.shape[1]], pa.int32()),
                pa.array([weights.tobytes()], pa.binary())], names=["ids", "terms", "weights"])

        for batch in batches:
            for at in range(batch.num_rows):
                ids.append(batch.column(0)[at].as_py())
                vectors.append(batch.column(1)[at].values.to_numpy(zero_copy_only=False).astype(float))
                if len(ids) == size:
                    yield block()
                    ids, vectors = [], []
        if ids:
            yield block()

    return rows.mapInArrow(run, _PACK)


def _unpack(ids, terms, weights) -> tuple[np.ndarray, np.ndarray]:
    numbers = np.frombuffer(ids.as_buffer(), np.int64)
    return numbers, np.frombuffer(weights.as_buffer(), np.float64).reshape(len(numbers), terms.as_py())


def accumulate(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Scores (queries x rows), term by term over postings."""
    terms = min(queries.shape[1], rows.shape[1])
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * max(terms, 1)
    kind = np.float32 if most < 2**24 else np.float64 if most < 2**53 else object
    if kind is object:
        whole = np.vectorize(int, otypes=[object])
        queries, rows = whole(queries), whole(rows)
    scores = np.zeros((len(queries), len(rows)), kind)
    for term in range(terms):
        asking = np.flatnonzero(queries[:, term])
        posting = np.flatnonzero(rows[:, term])
        if not len(asking) or not len(posting):
            continue
        weights = rows[posting, term].astype(kind)
        whole_row = 4 * len(posting) >= 3 * len(rows)
        if whole_row:  # nearly every row holds the term: add the column as it is
            weights = rows[:, term].astype(kind)
        for q, weight in zip(asking.tolist(), queries[asking, term].tolist()):
            if whole_row:
                scores[q] += kind(weight) * weights if kind is not object else weight * weights
            else:
                scores[q, posting] += kind(weight) * weights if kind is not object else weight * weights
    return scores


def select(scores: np.ndarray, ids: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the k best of one query, ties by the smaller id, without its own."""
    keep = np.flatnonzero(ids != own)
    if len(keep) > k:
        values = scores[keep]
        if values.dtype == object:
            edge = sorted(values, reverse=True)[k - 1]
        else:
            edge = values[np.argpartition(-values, k - 1)[k - 1]]
        keep = keep[np.flatnonzero(values >= edge)]
    if scores.dtype == object:
        order = np.array(sorted(range(len(keep)), key=lambda i: (-scores[keep[i]], ids[keep[i]])), int)
    else:
        order = np.lexsort((ids[keep], -scores[keep]))
    best = keep[order[:k]]
    return ids[best], scores[best]


def _winners(scores: np.ndarray, ids: np.ndarray, owners: np.ndarray, k: int) -> tuple:
    """``select`` for each query as arrays (queries x k): is there an entry, its score as a long, its id."""
    low, high = -(1 << 63), (1 << 63) - 1
    there = np.zeros((len(owners), k), bool)
    top, found = np.zeros((len(owners), k), np.int64), np.zeros((len(owners), k), np.int64)
    for q, own in enumerate(owners.tolist()):
        best, values = select(scores[q], ids, own, k)
        there[q, : len(best)], found[q, : len(best)] = True, best
        top[q, : len(best)] = [min(max(int(v), low), high) for v in values]
    return there, top, found


def merged(one: tuple, other: tuple) -> tuple:
    """Winners of the same queries among two sets of rows as those among both."""
    there, top, found = (np.concatenate(pair, axis=1) for pair in zip(one, other))
    order = np.lexsort((found, ~top, ~there), axis=1)[:, : one[0].shape[1]]
    return tuple(np.take_along_axis(x, order, 1) for x in (there, top, found))


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}
        for batch in batches:
            for at in range(batch.num_rows):
                asking = batch.column(0)[at].as_py()
                owners, queries = _unpack(*[batch.column(i)[at] for i in range(1, 4)])
                ids, rows = _unpack(*[batch.column(i)[at] for i in range(4, 7)])
                best = _winners(accumulate(queries, rows), ids, owners, k)
                if asking in held:
                    held[asking] = owners.copy(), merged(held[asking][1], best)
                else:
                    held[asking] = owners.copy(), best
        for owners, (there, top, found) in held.values():
            lines = np.repeat(owners, there.sum(axis=1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(lines), pa.array(found[there]), pa.array(top[there])],
                names=["query_id", "vec_id", "score"])

    return run


def exact_top_k(vectors: DataFrame, k: int = 20, scale: int = 64, every: int = 20,
                block_rows: int = 4_096, block_queries: int = 512) -> DataFrame:
    """The k best rows of each query: query_id, rank (from 1), vec_id, score.

    Queries are the rows whose vec_id is divisible by ``every``; ``embedding`` is the vector.
    """
    usable = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("embedding").cast("array<double>").alias("embedding")).where(
        F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall(
            "embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    usable, n = counted(usable, "vectors")
    asking = usable.where(F.pmod("vec_id", F.lit(every)) == 0)
    blocks = counted(_packed(dealt(usable, -(-n // block_rows) or 1), scale, block_rows), "vector-blocks")[0]
    asked, n_asked = counted(
        _packed(asking.coalesce(-(-n // (every * block_queries)) or 1), scale, block_queries)
        .toDF("q_ids", "q_terms", "q_weights").withColumn("asking", F.monotonically_increasing_id()), "query-blocks")
    met = tiles(blocks, asked, n_asked)
    found = met.select("asking", "q_ids", "q_terms", "q_weights", "ids", "terms", "weights").mapInArrow(
        _search(k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")

