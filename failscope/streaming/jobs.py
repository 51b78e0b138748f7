"""Structured Streaming jobs: the batch operators applied to arriving events.

Each job returns a started query that processes what is there and stops. Sinks are
written per micro-batch under its id with overwrite, so a batch that is run again
after a failure replaces its own output: every event lands once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from failscope.operators import validation as V
from failscope.operators.lag import with_lag


def read_stream(
    spark: SparkSession, folder: str, schema: T.StructType, pattern: str = "*.parquet",
    files_per_batch: int | None = None,
) -> DataFrame:
    """Parquet files below ``folder`` as a stream, oldest first."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def _start(writer, checkpoint: str) -> StreamingQuery:
    return (
        writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def _write_batch(df: DataFrame, path: str, batch: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def read_sink(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of all micro-batches of a sink."""
    whole = T.StructType(schema.fields + [T.StructField("batch", T.IntegerType())])
    return spark.read.schema(whole).parquet(path)


def _held(write):
    """``write(batch, n)`` with the batch kept while several jobs read it."""
    def run(batch: DataFrame, n: int) -> None:
        batch.persist()
        try:
            write(batch, n)
        finally:
            batch.unpersist()

    return run


def _stored_before(spark: SparkSession, path: str, n: int, schema: T.StructType) -> DataFrame | None:
    """Rows that earlier micro-batches than ``n`` stored in a sink; None for the first."""
    return read_sink(spark, path, schema).where(F.col("batch") < n).drop("batch") if n else None


def _unseen(batch: DataFrame, id: str, sink: str, n: int, stored_id: str | None = None) -> DataFrame:
    """One row per id of the batch, without ids that earlier batches stored in ``sink``."""
    stored_id = stored_id or id
    new = batch.dropDuplicates([id])
    ids = T.StructType([T.StructField(stored_id, batch.schema[id].dataType)])
    before = _stored_before(batch.sparkSession, sink, n, ids)
    if before is None:
        return new
    return new.join(before.select(F.col(stored_id).alias(id)).distinct(), id, "left_anti").select(
        batch.columns)


def validate_stream(
    events: DataFrame, rules: list[Column], valid: str, invalid: str, checkpoint: str
) -> StreamingQuery:
    """Check every event; valid and invalid rows go to their own sinks."""
    def write(batch: DataFrame, n: int) -> None:
        good, bad = V.split_valid(V.check(batch, rules))
        _write_batch(good, valid, n)
        _write_batch(bad, invalid, n)

    return _start(events.writeStream.foreachBatch(_held(write)), checkpoint)


def _lagged_batch(
    batch: DataFrame, n: int, state: str, ts: str, key: str, id: str
) -> DataFrame:
    """The batch with its lag columns; writes the last time of each key as state ``n``.

    A batch reads the state its predecessor wrote. Inside a batch the skew-free batch
    operator runs, so one busy key is spread over tasks like any other. An event that
    is older than the state has no earlier time to refer to and counts as a first event.
    """
    spark = batch.sparkSession
    schema = T.StructType([batch.schema[key], batch.schema[ts]])
    last, earlier = batch.select(key, ts), None
    if n > 0:
        earlier = spark.read.schema(schema).parquet(f"{state}/batch={n - 1}")
        last = last.unionByName(earlier)
    _write_batch(last.groupBy(key).agg(F.max(ts).alias(ts)), state, n)
    return with_lag(batch, ts, key, id, earlier)


def score_stream(
    events: DataFrame, features, model, failures: str, predictions: str, state: str,
    checkpoint: str, ts: str = "timestamp", key: str = "pipeline_name", id: str = "event_id",
) -> StreamingQuery:
    """Store each event once, score it with its lag over all batches, store its prediction.

    An event that is sent again, in this batch or a later one, gets no second prediction.
    """
    def write(batch: DataFrame, n: int) -> None:
        _write_batch(_unseen(batch, id, failures, n), failures, n)
        stored = batch.sparkSession.read.schema(batch.schema).parquet(f"{failures}/batch={n}")
        lagged = _lagged_batch(stored, n, state, ts, key, id)
        scored = model.score(features.with_features(lagged)).select(
            F.col(id).alias("failure_id"), "pipeline_name", "predicted_root_cause",
            "confidence", "model_version")
        _write_batch(scored, predictions, n)

    return _start(events.writeStream.foreachBatch(write), checkpoint)


def lag_stream(
    events: DataFrame, out: str, state: str, checkpoint: str, ts: str = "timestamp",
    key: str = "pipeline_name", id: str = "event_id",
) -> StreamingQuery:
    """Lag and burst of every event against its own and all earlier batches."""
    def write(batch: DataFrame, n: int) -> None:
        _write_batch(_lagged_batch(batch, n, state, ts, key, id).select(
            id, "feat_lag_seconds", "feat_is_burst"), out, n)

    return _start(events.writeStream.foreachBatch(_held(write)), checkpoint)


def once_per_failure(
    predictions: DataFrame, out: str, checkpoint: str, id: str = "failure_id",
) -> StreamingQuery:
    """At most one prediction per failure, whenever it is sent again: the store decides."""
    def write(batch: DataFrame, n: int) -> None:
        _write_batch(_unseen(batch, id, out, n), out, n)

    return _start(predictions.writeStream.foreachBatch(write), checkpoint)


def trend_stream(
    predictions: DataFrame, out: str, checkpoint: str, ts: str = "created_at",
    late: str = "1 day", cause: str = "predicted_root_cause",
) -> StreamingQuery:
    """Failures per event-time day and cause; each batch writes the days it changed.

    Rows later than the watermark are not counted.
    """
    counted = (
        predictions.withWatermark(ts, late)
        .groupBy(F.window(ts, "1 day").alias("w"), F.col(cause).alias("root_cause"))
        .agg(F.count("*").alias("count")))

    def write(batch: DataFrame, n: int) -> None:
        _write_batch(batch.select(
            F.date_format("w.start", "yyyy-MM-dd").alias("date"), "root_cause", "count"), out, n)

    return _start(counted.writeStream.outputMode("update").foreachBatch(write), checkpoint)


TREND = T.StructType([
    T.StructField("date", T.StringType()), T.StructField("root_cause", T.StringType()),
    T.StructField("count", T.LongType())])


def read_trend(spark: SparkSession, path: str) -> DataFrame:
    """The newest count of every day and cause."""
    return read_sink(spark, path, TREND).groupBy("date", "root_cause").agg(
        F.max_by("count", "batch").alias("count"))
