import pytest

from failscope.operators import evidence as E
from failscope.operators import pod_logs as P
from failscope.sources.files import scenarios


def _lines(spark, rows):
    return spark.createDataFrame(
        rows, "date_key string, pod_name string, line_id int, content string")


def _pool(spark, rows):
    return [(r["pod_name"], r["line_id"], r["source"]) for r in P.error_pool(
        _lines(spark, rows), scenarios(spark)).orderBy("pod_name", "line_id").collect()]


DAY = "20231207"


def test_faulty_flag_ignores_case_and_keeps_all_pods(spark):
    rows = [(DAY, "ProductPage-v1", 1, "x"), (DAY, "ratings", 1, "x"), ("19990101", "p", 1, "x")]
    got = {r["pod_name"]: r["is_faulty_pod"] for r in P.with_faulty_flag(
        _lines(spark, rows), scenarios(spark)).collect()}
    assert got == {"ProductPage-v1": True, "ratings": False}


def test_first_lines(spark):
    rows = [(DAY, "p", i, " " if i % 2 else f" ERROR {i} ") for i in range(900)]
    kept = P.first_lines(_lines(spark, rows)).orderBy("line_id").collect()
    assert len(kept) == 300 and kept[-1]["line_id"] == 598 and kept[0]["content"] == "ERROR 0"
    assert P.first_error_lines(P.first_lines(_lines(spark, rows))).count() == 50


def test_pool_prefers_errors_of_faulty_pods(spark):
    rows = [(DAY, "productpage", i, "ERROR a" if i % 2 else "fine") for i in range(200)]
    rows += [(DAY, "other", 1, "ERROR b")]
    got = _pool(spark, rows)
    assert len(got) == 50 and {(p, s) for p, _, s in got} == {("productpage", 1)}


def test_pool_falls_back_to_all_errors(spark):
    rows = [(DAY, "productpage", i, "fine") for i in range(9)] + [(DAY, "other", 1, "ERROR b")]
    assert _pool(spark, rows) == [("other", 1, 2)]


def test_pool_falls_back_to_lines_of_faulty_pods(spark):
    rows = [(DAY, "productpage", i, "fine") for i in range(25)] + [(DAY, "other", 1, "ok")]
    got = _pool(spark, rows)
    assert len(got) == 20 and {s for _, _, s in got} == {3}


def test_pool_falls_back_to_first_lines_until_thirty(spark):
    rows = [(DAY, f"pod{p:02d}", i, "fine") for p in range(8) for i in range(4 if p == 0 else 20)]
    got = _pool(spark, rows)
    assert {s for _, _, s in got} == {4}
    assert sorted({p for p, _, _ in got}) == ["pod00", "pod01", "pod02", "pod03"]
    assert len(got) == 34


def _contributions(spark, rows):
    return spark.createDataFrame(
        rows, "failure_id int, feature string, shap_value double, feature_value double")


def test_evidence_texts(spark):
    rows = [
        (1, "feat_runtime", 1.2, 2.5), (1, "feat_rows_per_second", 0.6, 57.45),
        (1, "tfidf_not_found", 0.3, 0.4), (1, "feat_month", 0.1, 5.0), (1, "odd", 0.05, 0.00025),
        (1, "sixth", 0.01, 1.0), (1, "feat_schema_change", -0.4, 0.0), (1, "tfidf_killed", -0.2, 0.0),
        (1, "zero", 0.0, 1.0), (2, "feat_month", -0.3, 1e7)]
    got = {r["failure_id"]: r for r in E.with_evidence(E.ranked(_contributions(spark, rows))).collect()}
    assert list(got[1]["evidence"]) == [
        f"task runtime was {2.5:.0f} seconds (very high impact)",
        f"throughput was {57.45:.1f} rows/second before failure (high impact)",
        "error log contains the term 'not found' (moderate impact)",
        "feat_month = 5.0 (contributing factor)", "odd = 0.00025 (contributing factor)"]
    assert list(got[1]["counter_evidence"]) == [
        "Against: upstream schema change was detected", "Against: error log contains 'killed'"]
    assert list(got[2]["evidence"]) == ["No strong evidence found for this prediction"]
    assert list(got[2]["counter_evidence"]) == ["Against: feat_month = 10000000.0"]


@pytest.mark.parametrize("direction, k", [("for", 10), ("against", 5)])
def test_top_k(spark, direction, k):
    sign = 1 if direction == "for" else -1
    rows = [(1, f"f{i:02d}", sign * (i % 7 + 1) / 10, 0.0) for i in range(40)]
    got = E.top_contributions(E.ranked(_contributions(spark, rows))).orderBy("rank").collect()
    want = sorted(rows, key=lambda r: (-abs(r[2]), r[1]))[:k]
    assert [r["feature"] for r in got] == [w[1] for w in want]
    assert {r["direction"] for r in got} == {direction}
