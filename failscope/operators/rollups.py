"""Monitoring roll-ups over stored predictions and failures.

Every time window takes ``as_of``, so a result can be repeated. All group keys
here have few values; partial aggregation keeps hot ones small before the shuffle.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from failscope.session import materialize

from failscope import constants as K
from failscope.functions.numbers import percent_text
from failscope.functions.times import moment


def within_days(df: DataFrame, as_of, days: int, ts: str = "created_at") -> DataFrame:
    """Rows of the last ``days`` days to the microsecond."""
    return df.where(F.col(ts) >= moment(df, ts, as_of - timedelta(days=days)))


def within_calendar_days(df: DataFrame, as_of, days: int, ts: str = "created_at") -> DataFrame:
    """Rows since the start of the day ``days`` days ago: the whole cutoff day counts."""
    start = (as_of - timedelta(days=days)).replace(hour=0, minute=0, second=0, microsecond=0)
    return df.where(F.col(ts) >= moment(df, ts, start))


def root_cause_distribution(preds: DataFrame, cause: str = "predicted_root_cause") -> DataFrame:
    return (
        preds.groupBy(F.col(cause).alias("root_cause")).agg(F.count("*").alias("count"))
        .orderBy(F.desc("count"), "root_cause"))


def prediction_stats(preds: DataFrame, days: int) -> DataFrame:
    """Total, mean confidence, most common cause (ties: first by name) in one scan."""
    per = preds.groupBy("predicted_root_cause").agg(
        F.count("*").alias("n"), F.count("confidence").alias("m"),
        F.sum("confidence").alias("s"))
    mean = F.sum("s") / F.nullif(F.sum("m"), F.lit(0))
    return per.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_predictions"),
        F.coalesce(F.round(mean, 4), F.lit(0.0)).alias("avg_confidence"),
        F.min_by("predicted_root_cause", F.struct(-F.col("n"), "predicted_root_cause"))
        .alias("most_common_root_cause"),
        F.lit(days).alias("period_days"))


def failure_trend(preds: DataFrame, ts: str = "created_at") -> DataFrame:
    """Failures per calendar day and cause."""
    return preds.groupBy(
        F.date_format(ts, "yyyy-MM-dd").alias("date"),
        F.col("predicted_root_cause").alias("root_cause"),
    ).agg(F.count("*").alias("count"))


def pipeline_heatmap(preds: DataFrame) -> DataFrame:
    """Failures per pipeline with one column per cause, zeros filled in."""
    return (
        preds.groupBy("pipeline_name").pivot("predicted_root_cause", K.ROOT_CAUSES)
        .agg(F.count(F.lit(1))).na.fill(0, K.ROOT_CAUSES))


def confidence_spread(preds: DataFrame) -> DataFrame:
    """Five-number summary per cause.

    Rows collapse to (cause, confidence, count) first. Stored confidences have four
    decimals, so a cause holds at most 10,001 of them however many rows it has.
    """
    counted = preds.groupBy("predicted_root_cause", "confidence").agg(F.count("*").alias("n"))
    points = F.percentile(
        "confidence", F.array(*[F.lit(p) for p in (0.0, 0.25, 0.5, 0.75, 1.0)]), F.col("n"))
    box = counted.groupBy(F.col("predicted_root_cause").alias("root_cause")).agg(
        F.sum("n").alias("n"), points.alias("p"))
    names = ["low", "q1", "median", "q3", "high"]
    return box.select("root_cause", "n", *[F.col("p")[i].alias(x) for i, x in enumerate(names)])


def confidence_kpis(preds: DataFrame, high: float = 0.8) -> DataFrame:
    n, above = F.count("*"), F.count_if(F.col("confidence") >= high)
    return preds.agg(
        n.alias("shown"), F.avg("confidence").alias("avg_confidence"),
        F.min("confidence").alias("min_confidence"), above.alias("high_confidence"),
        (above / F.nullif(n, F.lit(0))).alias("high_share"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("count"))


def _counted_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, v, n, seen): uses of each value, and of all values up to it in its column.

    All columns are turned into pairs in one scan and counted before the shuffle. The counted
    values are range-sorted, so a column spans many partitions; what lies before a partition
    is one small row per column and partition.
    """
    kinds = dict(df.dtypes)
    for c in columns:
        if kinds[c] not in ("tinyint", "smallint", "int", "bigint", "float", "double"):
            raise TypeError(f"{c} is {kinds[c]}: percentiles need whole numbers or doubles")
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v"))
                      for c in columns])
    counts = df.select(F.inline(pairs)).where("v IS NOT NULL").groupBy("column", "v").agg(
        F.count(F.lit(1)).alias("n"))
    ordered = materialize(counts.orderBy("column", "v").withColumn(
        "part", F.shiftright(F.monotonically_increasing_id(), 33)), "values")
    parts = ordered.groupBy("column", "part").agg(F.sum("n").alias("n"))
    upto = Window.partitionBy("column").orderBy("part")
    parts = materialize(parts.select(
        "column", "part", (F.sum("n").over(upto) - F.col("n")).alias("before")), "value-parts")
    inside = Window.partitionBy("column", "part").orderBy("v")
    return ordered.join(parts, ["column", "part"]).select(
        "column", "v", "n", (F.col("before") + F.sum("n").over(inside)).alias("seen"))


def _quantiles(values: DataFrame, probs: list[float]) -> DataFrame:
    """(column, prob, value) from counted values: exact, interpolated between neighbours."""
    totals = values.groupBy("column").agg(F.sum("n").alias("total"))
    wanted = totals.select("column", "total", F.explode(F.array(*[
        F.lit(float(p)) for p in probs])).alias("prob"))
    wanted = wanted.withColumn("at", F.col("prob") * (F.col("total") - 1)).select(
        "column", "prob", "at", F.explode(F.array_distinct(F.array(
            F.floor("at"), F.ceil("at")))).alias("rank"))
    found = values.join(wanted, "column").where("rank >= seen - n AND rank < seen")
    return found.groupBy("column", "prob").agg((
        F.min("v") + (F.max("v") - F.min("v")) * (F.first("at") - F.min("rank"))).alias("value"))


def percentiles(df: DataFrame, column: str, probs: list[float]) -> DataFrame:
    """Exact interpolated percentiles of a column of whole numbers or doubles: (prob, value)."""
    return _quantiles(_counted_values(df, [column]), probs).select("prob", "value")


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, mean, deviation, range and quartiles of numeric columns, one row each."""
    values = materialize(_counted_values(df, columns), "counted-values")
    n, v = F.col("n"), F.col("v")
    means = values.groupBy("column").agg((F.sum(v * n) / F.sum("n")).alias("mean"))
    basic = values.join(means, "column").groupBy("column", "mean").agg(
        F.sum("n").alias("n"), F.sum(n * (v - F.col("mean")) ** 2).alias("squares"),
        F.min("v").alias("low"), F.max("v").alias("high"))
    at = lambda p: F.max(F.when(F.col("prob") == p, F.col("value")))
    quartiles = _quantiles(values, [0.25, 0.5, 0.75]).groupBy("column").agg(
        at(0.25).alias("q1"), at(0.5).alias("median"), at(0.75).alias("q3"))
    deviation = F.sqrt(F.col("squares") / F.nullif(F.col("n") - 1, F.lit(0)))
    return basic.join(quartiles, "column").select(
        "column", "n", "mean", deviation.alias("std"), "low", "high", "q1", "median", "q3")


def flag_rates(df: DataFrame) -> DataFrame:
    return df.agg(
        F.avg(F.col("schema_change").cast("int")).alias("schema_change_rate"),
        F.avg(F.col("upstream_failed").cast("int")).alias("upstream_failed_rate"))


def feature_groups(names: DataFrame, column: str = "feature") -> DataFrame:
    """Number of distinct feature names per group, told apart by prefix."""
    c = F.col(column)
    feat, tfidf = c.startswith("feat_"), c.startswith("tfidf_")
    return names.select(column).distinct().agg(
        F.count_if(feat).alias("execution"), F.count_if(~feat & ~tfidf).alias("log_signals"),
        F.count_if(tfidf).alias("tfidf"), F.count("*").alias("total"))


def log_volume(pod_lines: DataFrame) -> DataFrame:
    return pod_lines.groupBy("date_key").agg(
        F.count_distinct("pod_name").alias("pods"), F.count("*").alias("messages"))


def newest(df: DataFrame, limit: int, ts: str, id: str) -> DataFrame:
    """The newest rows, ties by id; planned as a per-partition top-k."""
    return df.orderBy(F.desc(ts), id).limit(limit)


def confident(feed: DataFrame, threshold: float) -> DataFrame:
    """Confidence filter on an already limited feed; the limit comes first."""
    return feed.where(F.col("confidence") >= threshold)


def prediction_feed(preds: DataFrame) -> DataFrame:
    return preds.select(
        F.col("pipeline_name").alias("pipeline"),
        F.col("predicted_root_cause").alias("root_cause"),
        percent_text(F.col("confidence")).alias("confidence"),
        F.col("model_version").alias("model"),
        F.date_format("created_at", "yyyy-MM-dd HH:mm").alias("timestamp"))


def failures_with_predictions(failures: DataFrame, preds: DataFrame) -> DataFrame:
    """Each failure with its prediction, if it has one."""
    p = preds.select(
        F.col("failure_id").alias("event_id"), "predicted_root_cause", "confidence",
        "model_version")
    return failures.join(p, "event_id", "left")


def cause_signal_profile(signals: DataFrame, cause: str, names: list[str]) -> DataFrame:
    """Rows per cause and the mean of each signal: which signals tell the causes apart."""
    means: list[Column] = [F.avg(n).alias(f"avg_{n}") for n in names]
    return signals.groupBy(F.col(cause).alias("root_cause")).agg(
        F.count("*").alias("count"), *means)
