"""Seeded shuffle and stratified holdout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from failscope import constants as K
from failscope.session import materialize


def seeded_key(id: Column, seed: int) -> Column:
    """Order key that depends only on the id and the seed."""
    return F.md5(F.concat_ws(":", id.cast("string"), F.lit(str(seed))))


def seeded_shuffle(df: DataFrame, id: str = "event_id", seed: int = 42) -> DataFrame:
    return df.orderBy(seeded_key(F.col(id), seed), id)


def stratified_split(
    df: DataFrame, label: str = "root_cause", id: str = "event_id",
    fraction: float = K.TEST_FRACTION, seed: int = 42,
) -> DataFrame:
    """Add ``is_test``: in each class the rows with the smallest seeded keys.

    The number of test rows per class is exact. Rows are counted per class and key
    prefix; the prefix where the wanted count is reached splits a class, and only
    the rows of that one prefix (1/65,536 of a class) are ranked.
    """
    keyed = df.withColumns({"_key": seeded_key(F.col(id), seed)}).withColumn(
        "_part", F.substring("_key", 1, 4))
    hist = keyed.groupBy(label, "_part").agg(F.count("*").alias("n"))
    w = Window.partitionBy(label)
    hist = hist.select(
        label, "_part", "n", F.sum("n").over(w.orderBy("_part")).alias("upto"),
        F.round(F.sum("n").over(w) * F.lit(fraction)).cast("bigint").alias("wanted"))
    cut = materialize(
        hist.where("wanted > upto - n AND wanted <= upto").select(
            label, F.col("_part").alias("_cut"), (F.expr("wanted - upto + n")).alias("_need")),
        "split-cut")
    rows = keyed.join(cut, label, "left")
    rest = rows.where("_cut IS NULL OR _part <> _cut").withColumn(
        "is_test", F.coalesce(F.col("_part") < F.col("_cut"), F.lit(False)))
    rank = F.row_number().over(Window.partitionBy(label).orderBy("_key", id))
    edge = rows.where("_part = _cut").withColumn("is_test", rank <= F.col("_need"))
    return rest.unionByName(edge).select(*df.columns, "is_test")


def class_weights(df: DataFrame, label: str = "root_cause") -> DataFrame:
    """(label, class_weight): n / (classes * rows of the class), written."""
    per = df.groupBy(label).agg(F.count("*").alias("n"))
    one = Window.partitionBy(F.lit(1))
    return materialize(
        per.select(label, (F.sum("n").over(one) / (F.count("*").over(one) * F.col("n")))
                   .alias("class_weight")), "class-weights")


def balanced_weights(df: DataFrame, label: str = "root_cause") -> DataFrame:
    """Add ``class_weight`` = n / (classes * rows of the class); counts join back."""
    return df.join(class_weights(df, label), label, "left")
