import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from failscope.functions import event_features as E
from failscope.operators.lag import with_lag


def _events(spark, **columns):
    n = len(next(iter(columns.values())))
    base = {
        "pipeline_name": ["p"] * n, "task_name": ["t"] * n, "runtime": [60] * n,
        "retry_count": [0] * n, "rows_processed": [1] * n, "schema_change": [False] * n,
        "upstream_failed": [False] * n, "error_log": [""] * n,
        "timestamp": [datetime(2026, 1, 5, 12)] * n}
    base.update(columns)
    base["event_id"] = list(range(n))
    return spark.createDataFrame(
        list(zip(*base.values())),
        "pipeline_name string, task_name string, runtime int, retry_count int, "
        "rows_processed int, schema_change boolean, upstream_failed boolean, error_log string, "
        "timestamp timestamp_ntz, event_id int")


def _column(df, columns, name):
    return [r[name] for r in df.select("event_id", *columns).orderBy("event_id").collect()]


@pytest.mark.parametrize("given, name, want", [
    ({"rows_processed": [0, 5000, 0]}, "feat_zero_rows", [1, 0, 1]),
    ({"runtime": [5, 29, 30, 100]}, "feat_short_runtime", [1, 1, 0, 0]),
    ({"runtime": [100, 1800, 1801, 5000]}, "feat_long_runtime", [0, 0, 1, 1]),
    ({"retry_count": [2, 3]}, "feat_high_retries", [0, 1]),
    ({"runtime": [0, 50], "retry_count": [2, 1]}, "feat_retry_rate", [200.0, 2.0]),
])
def test_execution(spark, given, name, want):
    df = _events(spark, **given)
    assert _column(df, E.execution_columns(df), name) == want


def test_schema_flags(spark):
    df = _events(spark, schema_change=[True, True, False, False],
                 upstream_failed=[True, False, True, False])
    cols = E.schema_columns(df)
    assert _column(df, cols, "feat_schema_and_upstream") == [1, 0, 0, 0]
    assert _column(df, cols, "feat_schema_no_upstream") == [0, 1, 0, 0]
    assert _column(df, cols, "feat_upstream_no_schema") == [0, 0, 1, 0]


def test_calendar(spark):
    days = [datetime(2026, 1, 5), datetime(2026, 1, 10), datetime(2026, 1, 11)]
    df = _events(spark, timestamp=days)
    assert _column(df, E.temporal_columns(df), "feat_is_weekend") == [0, 1, 1]
    assert _column(df, E.temporal_columns(df), "feat_day_of_week") == [0, 5, 6]
    hours = [datetime(2026, 1, 5, h) for h in (8, 9, 17, 18)]
    df = _events(spark, timestamp=hours)
    assert _column(df, E.temporal_columns(df), "feat_is_business_hours") == [0, 1, 1, 0]
    df = _events(spark, timestamp=[datetime(2026, 1, 5, h) for h in (2, 23, 12)])
    assert _column(df, E.temporal_columns(df), "feat_is_night") == [1, 1, 0]


def test_zero_runtime_is_finite(spark):
    df = _events(spark, runtime=[0, 0], rows_processed=[0, 100])
    for row in df.select(*E.execution_columns(df)).collect():
        assert all(v is not None and abs(v) < float("inf") for v in row)


def _plain_lag(rows):
    """Lag by sorting each pipeline: the definition, on a small table."""
    out, last = {}, {}
    for ts, id, name in sorted((t, i, n) for i, n, t in rows):
        gap = (ts - last[name]).total_seconds() if name in last else None
        out[id] = (gap or 0.0, int(gap is not None and gap < 300))
        last[name] = ts
    return out


def test_lag_equals_definition_with_a_hot_pipeline_and_ties(spark):
    rng = random.Random(7)
    start = datetime(2026, 1, 5, 23, 58)
    rows = []
    for i in range(600):
        name = "hot" if i % 3 else f"p{i % 5}"
        gap = rng.choice([0, 0, 1, 59_999_999, 60_000_000, 3_600_000_000, 299_999_999])
        rows.append((i, name, start + timedelta(microseconds=gap * rng.randint(0, 3))))
    df = spark.createDataFrame(rows, "event_id int, pipeline_name string, timestamp timestamp_ntz")
    got = {r["event_id"]: (r["feat_lag_seconds"], r["feat_is_burst"])
           for r in with_lag(df).collect()}
    want = _plain_lag(rows)
    assert got.keys() == want.keys()
    for id, (lag, burst) in want.items():
        assert got[id] == (pytest.approx(lag, abs=1e-6), burst), id


def test_first_event_has_no_burst(spark):
    df = _events(spark, timestamp=[datetime(2026, 1, 5), datetime(2026, 1, 5, 0, 4, 59)])
    rows = with_lag(df).orderBy("event_id").select(*E.LAG).collect()
    assert [tuple(r) for r in rows] == [(0.0, 0), (299.0, 1)]


def test_iso_time(spark):
    df = spark.createDataFrame([("2026-01-05T10:00:00+02:00",), ("nonsense",)], "t string")
    rows = df.select(E.utc_timestamp(F.col("t")).cast("string").alias("t")).collect()
    assert [r["t"] for r in rows] == ["2026-01-05 08:00:00", None]
