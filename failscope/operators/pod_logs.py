"""Scenario pod logs: faulty pods, error lines, error pool."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from failscope.functions.text import is_error_line, stripped
from failscope.session import materialize

POD = ["date_key", "pod_name"]


def with_faulty_flag(lines: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Join the scenario by date and test the pod name against its pattern.

    All pods of a known scenario are kept; ``is_faulty_pod`` marks the matches. The
    scenario table is a few rows with a known size, so the join is a broadcast.
    """
    truth = scenarios.select("date_key", "faulty_pod_pattern", "root_cause")
    match = F.expr("pod_name rlike concat('(?i)', faulty_pod_pattern)")
    return lines.join(truth, "date_key").withColumn("is_faulty_pod", match)


def first_lines(lines: DataFrame, n: int = 300) -> DataFrame:
    """The first ``n`` non-blank lines of every pod, in file order.

    ``rank <= n`` on a row number is cut to ``n`` rows per pod before the shuffle.
    """
    content = stripped(F.col("content"))
    rank = F.row_number().over(Window.partitionBy(*POD).orderBy("line_id"))
    return (
        lines.withColumn("content", content).where("content <> ''")
        .withColumn("line_rank", rank).where(F.col("line_rank") <= n))


def first_error_lines(lines: DataFrame, n: int = 50) -> DataFrame:
    """The first ``n`` error lines of every pod."""
    rank = F.row_number().over(Window.partitionBy(*POD).orderBy("line_id"))
    return (
        lines.where(is_error_line(F.col("content")))
        .withColumn("error_rank", rank).where(F.col("error_rank") <= n))


def error_pool(lines: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Lines that describe each scenario, from the best source that has any.

    1. error lines of faulty pods, 2. error lines of all pods, 3. the first 20 lines of
    faulty pods, 4. the first 10 lines of pods in name order until there are 30.
    One pass marks each line with the sources it belongs to; the best source of a
    scenario is a small aggregate that is joined back.
    """
    first = with_faulty_flag(first_lines(lines), scenarios)
    is_error = is_error_line(F.col("content"))
    rank = F.row_number().over(Window.partitionBy(*POD, "is_error").orderBy("line_id"))
    marked = first.withColumn("is_error", is_error).withColumn("error_rank", rank)
    error = F.col("is_error") & (F.col("error_rank") <= 50)
    faulty = F.col("is_faulty_pod")
    marked = materialize(marked.select(
        *POD, "line_id", "content", "line_rank",
        (faulty & error).alias("s1"), error.alias("s2"),
        (faulty & (F.col("line_rank") <= 20)).alias("s3"),
        (F.col("line_rank") <= 10).alias("s4")), "marked-lines")
    best = materialize(marked.groupBy("date_key").agg(F.min(
        F.when(F.col("s1"), 1).when(F.col("s2"), 2).when(F.col("s3"), 3).otherwise(4)
    ).alias("source")), "best-source")
    # A pod has at least one line, so the first 30 pods always reach 30 lines.
    by_name = Window.partitionBy("date_key").orderBy("pod_name")
    needed = materialize(
        marked.where("s4").groupBy(*POD).agg(F.count("*").alias("n"))
        .withColumn("pod_rank", F.row_number().over(by_name)).where("pod_rank <= 30")
        .withColumn("before", F.sum("n").over(by_name) - F.col("n")).where("before < 30")
        .select(*POD, F.lit(True).alias("needed")), "needed-pods")
    chosen = (
        ((F.col("source") == 1) & F.col("s1")) | ((F.col("source") == 2) & F.col("s2"))
        | ((F.col("source") == 3) & F.col("s3"))
        | ((F.col("source") == 4) & F.col("s4") & F.col("needed")))
    return (
        marked.join(best, "date_key").join(needed, POD, "left").where(chosen)
        .select(*POD, "line_id", "content", "source"))
