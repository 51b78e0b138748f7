import random
import statistics
from collections import Counter
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from failscope.functions.numbers import percent_text, tenths_text, whole_text
from failscope.operators import metrics as M
from failscope.operators import rollups as R
from failscope.operators import split as S
from failscope.operators.ranking import with_rank


def test_number_texts_equal_python(spark):
    rng = random.Random(3)
    values = [0.5, 1.5, 2.5, 0.25, 0.75, 57.45, 57.55, 0.05, 0.15, 12.25, 12.75, 1e6 + 0.05]
    values += [rng.uniform(0, 1000) for _ in range(500)]
    values += [round(rng.uniform(0, 100), 2) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    rows = df.select("v", whole_text(F.col("v")).alias("w"), tenths_text(F.col("v")).alias("t"),
                     percent_text(F.col("v") / 100).alias("p")).collect()
    for r in rows:
        assert r["w"] == f"{r['v']:.0f}", r["v"]
        assert r["t"] == f"{r['v']:.1f}", r["v"]
        assert r["p"] == f"{r['v'] / 100:.1%}", r["v"]


@pytest.mark.parametrize("kind, n", [("int", 1), ("int", 2), ("bigint", 7), ("int", 400)])
def test_percentiles(spark, kind, n):
    rng = random.Random(n)
    values = [rng.choice([-70_000, 3, 65_536, rng.randint(-10**9, 10**9)]) for _ in range(n)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], f"v {kind}")
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {r["prob"]: r["value"] for r in R.percentiles(df, "v", probs).collect()}
    ordered = sorted(values)
    for p in probs:
        at = p * (n - 1)
        low, high = ordered[int(at)], ordered[min(int(at) + (at > int(at)), n - 1)]
        assert got[p] == pytest.approx(low + (high - low) * (at - int(at))), p


def test_percentiles_of_doubles_and_large_numbers(spark):
    df = spark.createDataFrame([(0.2, 4_000_000_000), (0.9, 5), (1.7, 6)], "d double, b bigint")
    assert R.percentiles(df, "d", [0.5]).first()["value"] == 0.9
    assert R.percentiles(df, "b", [1.0]).first()["value"] == 4e9
    with pytest.raises(TypeError):
        R.percentiles(df.select(df.d.cast("string").alias("d")), "d", [0.5])


def test_describe(spark):
    values = [1, 2, 2, 10]
    df = spark.createDataFrame([(v,) for v in values], "v int")
    r = R.describe(df, ["v"]).first()
    assert (r["n"], r["mean"], r["median"], r["q3"]) == (4, 3.75, 2.0, 4.0)
    assert r["std"] == pytest.approx(statistics.stdev(values))


def _preds(spark):
    rows = [("a", "API Failure", 0.9), ("a", "Schema Change", 0.5), ("b", "API Failure", 0.7),
            ("b", "Schema Change", 0.5)]
    return spark.createDataFrame(
        [(i, *r, datetime(2026, 1, 1 + i)) for i, r in enumerate(rows)],
        "failure_id int, pipeline_name string, predicted_root_cause string, confidence double, "
        "created_at timestamp_ntz")


def test_stats_and_ties(spark):
    row = R.prediction_stats(_preds(spark), 30).first()
    assert tuple(row) == (4, 0.65, "API Failure", 30)
    empty = R.prediction_stats(_preds(spark).where("false"), 30).first()
    assert tuple(empty) == (0, 0.0, None, 30)


def test_windows(spark):
    preds, now = _preds(spark), datetime(2026, 1, 4, 12)
    assert R.within_days(preds, now, 2).count() == 2
    assert R.within_calendar_days(preds, now, 2).count() == 3
    plan = R.within_days(preds, now, 2)._jdf.queryExecution().optimizedPlan().toString()
    assert "cast(created_at" not in plan


def test_heatmap_has_all_causes(spark):
    row = R.pipeline_heatmap(_preds(spark)).where("pipeline_name = 'a'").first()
    assert len(row) == 7 and row["API Failure"] == 1 and row["Missing Data"] == 0


def test_limit_comes_before_the_confidence_filter(spark):
    feed = R.confident(R.newest(_preds(spark), 2, "created_at", "failure_id"), 0.6)
    assert [r["failure_id"] for r in feed.collect()] == [2]


def _scored(spark):
    pairs = [("API Failure", "API Failure")] * 15 + [("API Failure", "Data Quality Issue")] + [
        (c, c) for c in ("Data Quality Issue", "Dependency Failure", "Missing Data")
        for _ in range(20)] + [("Resource Exhaustion",) * 2] * 64 + [("Schema Change",) * 2] * 20
    return spark.createDataFrame(
        [(*p, 0.9) for p in pairs],
        "actual_root_cause string, predicted_root_cause string, confidence double")


def test_published_metrics(spark):
    """The published confusion matrix gives the published scores."""
    matrix = M.confusion_matrix(_scored(spark))
    assert matrix.count() == 36
    overall = M.overall_metrics(M.class_report(matrix)).first()
    assert overall["accuracy"] == pytest.approx(0.99375)
    assert overall["macro_f1"] == pytest.approx(0.990558615263572)
    assert overall["weighted_f1"] == pytest.approx(0.9937254130605823)
    worst = M.most_common_error(matrix).first()
    assert tuple(worst) == ("API Failure", "Data Quality Issue", 1)


def test_gate(spark):
    good = M.overall_metrics(M.class_report(M.confusion_matrix(_scored(spark))))
    M.require_go(good)
    bad = M.overall_metrics(M.class_report(M.confusion_matrix(
        _scored(spark).withColumn("predicted_root_cause", F.lit("Missing Data")))))
    with pytest.raises(ValueError, match="below 0.70"):
        M.require_go(bad)


def test_split_is_exact_and_repeatable_with_a_hot_class(spark):
    rows = [(i, "hot" if i % 3 else ("b" if i % 2 else "c")) for i in range(2000)] + [(9999, "one")]
    df = spark.createDataFrame(rows, "event_id int, root_cause string")
    first = S.stratified_split(df).collect()
    again = S.stratified_split(df.repartition(5)).collect()
    assert sorted(map(tuple, first)) == sorted(map(tuple, again))
    assert len(first) == len(rows)
    total = Counter(r["root_cause"] for r in first)
    held = Counter(r["root_cause"] for r in first if r["is_test"])
    for label, n in total.items():
        assert held[label] == int(0.2 * n + 0.5)
    other = S.stratified_split(df, seed=7).collect()
    assert {r["event_id"] for r in other if r["is_test"]} != {
        r["event_id"] for r in first if r["is_test"]}


def test_weights(spark):
    df = spark.createDataFrame([("a",), ("a",), ("a",), ("b",)], "root_cause string")
    got = {r["root_cause"]: r["class_weight"] for r in S.balanced_weights(df).collect()}
    assert got == {"a": pytest.approx(4 / 6), "b": 2.0}


def test_rank_in_a_hot_group(spark):
    rows = [("hot" if i % 3 else f"g{i % 4}", f"n{i:04d}") for i in range(900)]
    df = spark.createDataFrame(rows, "g string, name string").repartition(6)
    got = sorted((r["g"], r["name"], r["rank"]) for r in with_rank(df, ["g"], ["name"]).collect())
    want, seen = [], Counter()
    for g, name in sorted(rows):
        want.append((g, name, seen[g]))
        seen[g] += 1
    assert got == want
