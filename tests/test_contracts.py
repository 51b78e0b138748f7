from datetime import datetime

import pytest
from pyspark.sql import functions as F

from failscope.functions.text import display_name, is_error_line, scenario_date, text_is_true
from failscope.operators import task_runs as TR
from failscope.operators import validation as V
from failscope.schemas import EVENT, REQUEST, TASK_RUN
from failscope.sources import files, tables

GOOD = {
    "pipeline_name": " user_etl ", "task_name": "extract", "runtime": 45, "retry_count": 3,
    "rows_processed": 0, "schema_change": True, "upstream_failed": False, "error_log": "KeyError",
    "root_cause": "Schema Change", "timestamp": datetime(2026, 1, 5)}


def _frame(spark, schema, *changes):
    rows = [tuple({**GOOD, **c}[n] for n in schema.names) for c in changes]
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("change, message", [
    ({}, None),
    ({"error_log": None}, None),
    ({"error_log": ""}, None),
    ({"pipeline_name": "   "}, V.BLANK),
    ({"pipeline_name": ""}, V.TOO_SHORT),
    ({"task_name": "x" * 201}, V.TOO_LONG),
    ({"task_name": "x" * 200}, None),
    ({"runtime": -1}, V.BELOW),
    ({"retry_count": 11}, V.ABOVE_10),
    ({"retry_count": 10}, None),
    ({"rows_processed": None}, V.NOT_INT),
    ({"schema_change": None}, V.NOT_BOOL),
    ({"root_cause": "Unknown"}, V.NOT_CAUSE),
    ({"timestamp": None}, V.NOT_TIME),
])
def test_event_rules(spark, change, message):
    row = V.check(_frame(spark, EVENT, change), V.event_rules()).first()
    assert list(row["errors"]) == ([message] if message else [])


def test_request_rules(spark):
    rows = V.check(_frame(spark, REQUEST, {}, {"error_log": ""}, {"timestamp": None}),
                   V.request_rules()).collect()
    assert [list(r["errors"]) for r in rows] == [[], [V.TOO_SHORT], []]


def test_split_and_report(spark):
    checked = V.check(_frame(spark, EVENT, {}, {"runtime": -1, "retry_count": 11}), V.event_rules())
    good, bad = V.split_valid(checked)
    assert [r["pipeline_name"] for r in good.collect()] == ["user_etl"]
    assert [r["pipeline_name"] for r in bad.collect()] == [" user_etl "]
    assert tuple(V.counts(checked).first()) == (1, 1)
    line = V.messages(checked.withColumn("event_id", F.lit(7))).first()["message"]
    assert line == f"Row 7: 2 error(s) — {V.BELOW}"


def test_required_columns(spark):
    df = _frame(spark, EVENT, {}).drop("runtime", "error_log")
    with pytest.raises(ValueError, match="error_log.*runtime"):
        V.require_columns(df)


def test_feature_quality(spark):
    df = spark.createDataFrame(
        [(1.0, 1.0, 0.0), (2.0, 1.0, float("inf")), (None, 1.0, 0.0)], "a double, b double, c double")
    got = {r["feature"]: r for r in V.feature_quality(df, ["a", "b", "c"]).collect()}
    assert got["a"]["n_missing"] == 1 and got["a"]["variance"] == 0.5
    assert got["b"]["is_constant"] and got["c"]["n_infinite"] == 1


def test_task_run(spark):
    start = datetime(2026, 1, 5, 10)
    rows = [
        ("d", "r", "t1", 3, start, datetime(2026, 1, 5, 10, 2, 30), "failed", "column missing"),
        ("d", "r", "t2", 0, None, None, "success", None),
        (None, "q", None, 99, start, None, "failed", "x" * 6000),
        ("d", "s", "t1", 1, start, start, "failed", "field missing"),
    ]
    got = TR.task_run_events(
        spark.createDataFrame(rows, TASK_RUN), datetime(2026, 1, 5, 11), ["run_id", "state"])
    by = {(r["run_id"], r["state"]): r for r in got.collect()}
    one = by["r", "failed"]
    assert (one["runtime"], one["retry_count"], one["schema_change"], one["upstream_failed"]) == (
        150, 2, True, False)
    two = by["r", "success"]
    assert (two["runtime"], two["retry_count"], two["upstream_failed"]) == (0, 0, True)
    assert two["error_log"] == "Unknown error — no exception captured"
    three = by["q", "failed"]
    assert (three["pipeline_name"], three["task_name"]) == ("unknown_dag", "unknown_task")
    assert (three["retry_count"], three["runtime"], len(three["error_log"])) == (10, 3600, 5000)
    assert by["s", "failed"]["schema_change"]


def test_small_expressions(spark):
    lines = ["INFO starting service", "ERROR connection timeout occurred", "WARN disk space low",
             "INFO request processed"]
    df = spark.createDataFrame([(x,) for x in lines], "c string")
    assert [r[0] for r in df.where(is_error_line(F.col("c"))).collect()] == lines[1:3]
    df = spark.createDataFrame([("TRUE",), ("yes",), (None,)], "c string")
    assert [r[0] for r in df.select(text_is_true(F.col("c"))).collect()] == [True, False, False]
    df = spark.createDataFrame([("20231207",), ("soon",)], "c string")
    assert [str(r[0]) for r in df.select(scenario_date(F.col("c"))).collect()] == [
        "2023-12-07 00:00:00", "2024-01-01 00:00:00"]
    df = spark.createDataFrame([("user_etl_pipeline",), ("inventory_sync",)], "c string")
    assert [r[0] for r in df.select(display_name(F.col("c"))).collect()] == [
        "user etl", "inventory sync"]


def test_event_csv_keeps_quotes_newlines_and_bad_rows(spark, tmp_path):
    log = 'line "one"\nline two, with comma'
    path = str(tmp_path / "events")
    files.write_events(_frame(spark, EVENT, {"error_log": log}), path)
    back = files.read_events(spark, path).first()
    assert (back["error_log"], back["pipeline_name"]) == (log, " user_etl ")
    assert back["timestamp"] == GOOD["timestamp"]
    bad = tmp_path / "bad.csv"
    bad.write_text(",".join(EVENT.names) + "\np,t,many,1,1,true,false,log,API Failure,2026-01-05\n")
    row = files.read_events(spark, str(bad), corrupt=True).first()
    assert row["runtime"] is None and "many" in row["_corrupt_record"]


def test_pod_log_files(spark, tmp_path):
    day = tmp_path / "20231207" / "logs"
    day.mkdir(parents=True)
    head = "LineId,Time,Content,EventId,EventTemplate,ParameterList\n"
    (day / "productpage-v1_messages_structured.csv").write_bytes(
        (head + '1,t0,"  an error, quoted ",E1,<*>,[]\n2,t1,   ,E1,,\n3,t2,').encode()
        + b"bad \xff byte,E2,,\n")
    (day / "other.csv").write_text(head + "1,t,skip,E,,\n")
    got = files.read_pod_logs(spark, str(tmp_path)).orderBy("line_id").collect()
    assert [(r["date_key"], r["pod_name"], r["line_id"], r["content"]) for r in got] == [
        ("20231207", "productpage-v1", 1, "an error, quoted"),
        ("20231207", "productpage-v1", 3, "bad � byte")]


def test_append_once(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([("a", 2), ("a", 1), ("b", 5)], "id string, n int")
    for _ in range(3):
        tables.append_once(df, path, ["id"], ["n"], df.schema)
    rows = sorted(tuple(r) for r in spark.read.parquet(path).collect())
    assert rows == [("a", 1), ("b", 5)]


def test_align_keeps_the_first_duplicate(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int").select("a", "b", F.lit(9).alias("a"))
    assert V.align_columns(df, ["b", "a"]).first().asDict() == {"b": 2, "a": 1}


def test_feature_store(spark, tmp_path):
    df = spark.createDataFrame([(1.0, 2.0, "x")], "feat_a double, n double, root_cause string")
    files.write_feature_store(df, str(tmp_path / "fs"), ["feat_a", "n"])
    back, names = files.read_feature_store(spark, str(tmp_path / "fs"))
    assert names == ["feat_a", "n"] and back.count() == 1
    assert files.feature_group_counts(["feat_a", "n", "tfidf_x"]) == {
        "execution": 1, "log_signals": 1, "tfidf": 1, "total": 3}
