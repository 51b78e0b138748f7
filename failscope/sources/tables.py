"""Failure, prediction and dependency tables: reads and appends that can be repeated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from failscope import constants as K
from failscope.schemas import EDGE


def read_table(
    spark: SparkSession, path: str | None = None, schema: T.StructType | None = None,
    jdbc: dict[str, str] | None = None,
) -> DataFrame:
    """A stored table from parquet, or from a database when ``jdbc`` options are given.

    Give ``partitionColumn``, bounds and ``numPartitions`` among the options to read
    a large table in parallel. Filters on the result are pushed to either source.
    """
    if jdbc is not None:
        return spark.read.format("jdbc").options(**jdbc).load()
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def read_dependencies(table: DataFrame, active_only: bool = True) -> DataFrame:
    """Edges (upstream, downstream, dependency_type) of a stored dependency table."""
    rows = table.where("is_active") if active_only else table
    return rows.select(
        F.col("upstream_pipeline").alias("upstream"),
        F.col("downstream_pipeline").alias("downstream"), "dependency_type")


def registry_edges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(K.DEPENDENCY_REGISTRY, EDGE)


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the first in ``order``; a plain aggregate, so hot keys pre-combine."""
    row = F.struct(*[F.col(c) for c in df.columns])
    least = F.min_by(row, F.struct(*[F.col(c) for c in order])).alias("row")
    return df.groupBy(*keys).agg(least).select("row.*")


def not_yet_stored(
    new: DataFrame, stored: DataFrame, keys: list[str], order: list[str]
) -> DataFrame:
    """Rows of ``new`` to append: first per key, and only keys that are not stored."""
    return first_per_key(new, keys, order).join(stored.select(*keys), keys, "left_anti")


def append_once(
    new: DataFrame, path: str, keys: list[str], order: list[str], schema: T.StructType
) -> None:
    """Append to a parquet table so that running it again adds nothing."""
    spark = new.sparkSession
    try:
        stored = spark.read.parquet(path)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        stored = spark.createDataFrame([], schema)
    not_yet_stored(new, stored, keys, order).write.mode("append").parquet(path)


def append_failures(df: DataFrame, path: str) -> None:
    """One row per scored event; written before its prediction."""
    df.write.mode("append").parquet(path)


def with_new_id(df: DataFrame, id: str = "id") -> DataFrame:
    """Add a random uuid where the caller has no id of its own."""
    return df.withColumn(id, F.uuid())


def by_id(df: DataFrame, value, id: str = "id") -> DataFrame:
    return df.where(F.col(id) == F.lit(value))


def matching(df: DataFrame, **equal: str | None) -> DataFrame:
    """Rows equal to every given value; a value of None does not filter."""
    condition: Column = F.lit(True)
    for column, value in equal.items():
        if value is not None:
            condition = condition & (F.col(column) == F.lit(value))
    return df.where(condition)
