"""Time the headline queries over whole tables and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "log_signals", "cause_signal_profile", "execution_features", "temporal_features", "lag_burst",
    "feature_matrix", "feature_quality", "validate_events", "validation_report",
    "task_run_events", "sibling_failure", "idempotent_append", "root_cause_distribution",
    "prediction_stats", "failure_trend", "pipeline_heatmap", "confidence_box", "dataset_profile",
    "recent_predictions", "failure_prediction_join", "confusion_matrix", "evaluation_summary",
    "class_weights", "stratified_split", "text_normalise", "tfidf_vocabulary", "tfidf_matrix",
    "tfidf_vocabulary_documents", "tfidf_matrix_documents", "error_pool",
    "top_contributions", "evidence", "closure", "depth", "betweenness", "pagerank", "components",
    "cascade_risk", "stream_lag", "stream_trend", "train_score", "attributions",
    "explained_predictions",
]


def main() -> None:
    from failscope import plans
    from tests.session import make_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = make_session()
    queries = plans.load().QUERIES
    names = sys.argv[1:] or HEADLINE
    seconds: dict[str, float] = {}
    queries["root_cause_distribution"](spark, folder).count()  # start the workers once
    for name in names:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3),
        "unit": "sec", "queries": seconds, "sf": folder.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
