import pytest
from pyspark.sql import functions as F

from failscope.operators import rollups as R
from failscope.operators import validation as V
from failscope.operators.lag import with_lag
from failscope.plans import derived as D
from failscope.streaming import jobs as S
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def arriving(spark, tmp_path_factory):
    """The events in five files, one per stretch of time, arriving one after another."""
    folder = str(tmp_path_factory.mktemp("stream"))
    events = D.timed_events(spark, SMALL).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    cuts = [0, 120, 121, 500, 800, 10_000_000]
    for low, high in zip(cuts, cuts[1:]):
        events.where(f"event_id >= {low} AND event_id < {high}").coalesce(1).write.mode(
            "append").parquet(folder)
    return events, S.read_stream(spark, folder, events.schema, "*.parquet", files_per_batch=1)


def test_lag_equals_batch(spark, arriving, tmp_path):
    events, stream = arriving
    base = str(tmp_path)
    for _ in range(2):  # the second run finds nothing new and adds nothing
        S.lag_stream(stream, f"{base}/out", f"{base}/state", f"{base}/c").awaitTermination()
    cols = ["event_id", "feat_lag_seconds", "feat_is_burst"]
    got = spark.read.parquet(f"{base}/out")
    assert got.select("batch").distinct().count() == 5
    want = with_lag(events).select(cols)
    assert got.count() == events.count()
    assert got.select(cols).exceptAll(want).count() == 0


def test_validation_equals_batch(spark, arriving, tmp_path):
    events, stream = arriving
    bad = F.when(F.col("event_id") % 7 == 0, -1).otherwise(F.col("runtime")).alias("runtime")
    change = lambda df: df.select(*[bad if c == "runtime" else c for c in df.columns])
    base = str(tmp_path)
    S.validate_stream(change(stream), V.event_rules(), f"{base}/ok", f"{base}/bad",
                      f"{base}/c").awaitTermination()
    good, wrong = V.split_valid(V.check(change(events), V.event_rules()))
    assert spark.read.parquet(f"{base}/ok").count() == good.count()
    assert spark.read.parquet(f"{base}/bad").count() == wrong.count() > 0


def test_trend_equals_batch(spark, arriving, tmp_path):
    events, stream = arriving
    preds = lambda df: df.select(
        F.col("root_cause").alias("predicted_root_cause"), F.col("timestamp").alias("created_at"))
    base = str(tmp_path)
    S.trend_stream(preds(stream), f"{base}/out", f"{base}/c").awaitTermination()
    got = S.read_trend(spark, f"{base}/out")
    want = R.failure_trend(preds(events))
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()


def test_one_prediction_per_failure(spark, arriving, tmp_path):
    events, stream = arriving
    twice = stream.select(
        F.col("event_id").alias("failure_id"), F.col("timestamp").alias("created_at"),
        F.explode(F.array(F.lit(1), F.lit(2))).alias("copy"))
    base = str(tmp_path)
    S.once_per_failure(twice, f"{base}/out", f"{base}/c").awaitTermination()
    got = spark.read.parquet(f"{base}/out")
    assert got.count() == got.select("failure_id").distinct().count() == events.count()


def test_once_per_failure_also_in_later_batches(spark, tmp_path):
    schema = "failure_id int, created_at timestamp"
    base = str(tmp_path)
    for k, ids in enumerate([(1, 2), (2, 3), (3, 1, 4)]):
        spark.createDataFrame([(i, None) for i in ids], schema).coalesce(1).write.parquet(f"{base}/in/{k}")
    stream = S.read_stream(spark, f"{base}/in/*", spark.read.parquet(f"{base}/in/0").schema, files_per_batch=1)
    S.once_per_failure(stream, f"{base}/out", f"{base}/c").awaitTermination()
    got = spark.read.parquet(f"{base}/out")
    assert sorted(r.failure_id for r in got.collect()) == [1, 2, 3, 4]
    assert got.select("batch").distinct().count() == 3


def test_scores_equal_batch(spark, arriving, tmp_path):
    from failscope.operators.feature_engineer import FeatureEngineer
    from failscope.operators.model import train

    events, stream = arriving
    engineer, features, names = FeatureEngineer().fit_transform(events)
    model = train(features, names, n_trees=3, partitions=4)
    base = str(tmp_path)
    S.score_stream(stream, engineer, model, f"{base}/f", f"{base}/p", f"{base}/s",
                   f"{base}/c").awaitTermination()
    cols = ["failure_id", "predicted_root_cause", "confidence"]
    want = model.score(features).withColumnRenamed("event_id", "failure_id").select(cols)
    got = spark.read.parquet(f"{base}/p")
    assert got.count() == events.count() == spark.read.parquet(f"{base}/f").count()
    assert got.select(cols).exceptAll(want).count() == 0
