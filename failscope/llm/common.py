"""What the operators share: written tables, checked broadcasts, tables of the given folder."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from failscope.session import new_path, ship, write_observed

#: Rows of a broadcast side at most; its rows are a few dozen bytes each.
BROADCAST_ROWS = 300_000
#: Rows that a task writes, where a bound of them is known.
TASK_ROWS = 100_000
#: Asking blocks that a task keeps while candidate blocks pass by them.
BLOCKS_KEPT = 16


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def saved(df: DataFrame, name: str, most: int | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back (cuts the lineage).

    ``most``: where it is known how many rows there are at most, a task is not started and a file
    not written for each of the partitions of a few rows.
    """
    return counted(df, name, most)[0]


def counted(df: DataFrame, name: str, most: int | None = None) -> tuple[DataFrame, int]:
    """``saved`` and the number of rows, counted by the same job."""
    path = new_path(df.sparkSession, name)
    if most is not None:
        df = df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, most // TASK_ROWS + 1))
    rows = write_observed(df, path)["rows"]
    return df.sparkSession.read.schema(df.schema).parquet(path), rows


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` as a broadcast side if its counted rows are few, else as it is."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def dealt(df: DataFrame, parts: int) -> DataFrame:
    """``df`` in ``parts`` partitions; rows move only if there are fewer."""
    return df.coalesce(parts) if df.rdd.getNumPartitions() >= parts else df.repartition(parts)


def tiles(blocks: DataFrame, asked: DataFrame, n_asked: int) -> DataFrame:
    """Each row of ``blocks`` beside each row of ``asked`` (blocks that ask, counted).

    A task reads a part of both tables, the asking one up to ``BLOCKS_KEPT`` rows, and forms its
    pairs itself: no pair is shuffled, and neither side goes through the driver, however small
    the written blocks look to the planner.
    """
    parts = -(-n_asked // BLOCKS_KEPT) or 1
    return blocks.crossJoin(asked.repartition(parts).hint("shuffle_replicate_nl"))


def sampled(docs: DataFrame, rows: int) -> DataFrame:
    """Up to ``rows`` of ``docs``, chosen by a hash of doc_id: ids are picked before texts move."""
    ids = docs.select("doc_id").orderBy(F.xxhash64("doc_id", F.lit("sample")), "doc_id").limit(rows)
    ids = saved(ids.distinct().withColumnRenamed("doc_id", "sampled_id"), "sample-ids")
    chosen = docs.join(F.broadcast(ids), F.col("doc_id").eqNullSafe(F.col("sampled_id")), "left_semi")
    return chosen.limit(rows)


def tokenizer_path(name: str, folder: str | None = None) -> str:
    """Place of a public tokenizer's file: ``folder``, or the installed package's.

    Called inside tasks, so that every executor reads its own copy.
    """
    if folder is not None:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
