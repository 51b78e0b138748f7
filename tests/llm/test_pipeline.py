"""The pipeline, stage by stage, and the registered queries."""

import corpus_pipeline
import pyarrow as pa
import pytest

from failscope.llm import queries as R
from failscope.llm.common import saved
from tests.conftest import SMALL
from tests.llm import cases
from tests.llm.test_duplicates import components, leaks, near_copies
from tests.llm.test_scans import junk, natural
from tests.oracle import compare, connect


@pytest.mark.parametrize("name", sorted(R.QUERIES))
def test_query(spark, name):
    df = R.QUERIES[name](spark, SMALL)
    if name in R.ORACLES:
        assert compare(df, connect(SMALL), R.ORACLES[name]) == []
    else:
        assert df.count() > 0


def test_pipeline_on_planted_cases(spark, tmp_path):
    item = natural(900)
    copies = near_copies(12, 9)
    footer = "a footer line that stands on every page of the site"
    data = [(i, natural(i) + ("\n" + footer if i < 10 else "")) for i in range(120)]
    data += [(200 + i, junk(i)) for i in range(24)]
    data += [(300 + i, t) for i, t in enumerate(copies)] + [(320, copies[0]), (None, natural(950))]
    data += [(400, natural(901) + " " + item), (500, "short one")]
    docs = cases.table(spark, data)
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    folder = str(tmp_path)

    step = [docs]
    for name, stage in corpus_pipeline.STAGES:
        step.append(saved(stage(spark, step[-1], folder), "test-stage"))
    assert all(d.columns == docs.columns for d in step[:-1])
    texts = [{r.doc_id: r.text for r in d.select("doc_id", "text").collect()} for d in step[:-1]]
    raw, good, lines, unique, clean = texts
    assert set(good) == {d for d, _ in data if d is None or not 200 <= d < 224}
    assert footer in lines[0] and all(footer not in lines[i] for i in range(1, 10))
    assert {d: t for d, t in lines.items() if d is None or d >= 10} == {
        d: t for d, t in good.items() if d is None or d >= 10}
    groups = components([(d, t) for d, t in lines.items() if d is not None], 5, 80)
    assert set(unique) == {d for d in lines if d is None or groups[d] == d}
    leaked = {row[0] for row in leaks(list(unique.items()), [(1, item)]) if row[-1]}
    assert leaked == {400} and set(clean) == set(unique) - leaked
    assert {r.doc_id for r in step[-1].collect()} == set(clean)
    assert all(r.round_trip for r in step[-1].collect())


def test_pipeline_of_awkward_and_empty_tables(spark):
    for data in (cases.rows(), []):
        docs = cases.table(spark, data)
        for name, stage in corpus_pipeline.STAGES:
            docs = saved(stage(spark, docs, SMALL), "test-stage")
        assert docs.count() <= len(data)


def test_texts_that_share_an_id_are_decided_on_their_own(spark, tmp_path):
    item, copy = natural(900), natural(1)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    data = [(1, copy), (5, copy), (5, natural(2)), (6, natural(3)), (6, natural(4) + " " + item),
            (None, natural(5)), (None, natural(6) + " " + item)]
    docs = cases.table(spark, data)
    unique = corpus_pipeline.near_duplicate_stage(spark, docs, str(tmp_path))
    assert {(r.doc_id, r.text) for r in unique.collect()} == set(data) - {(5, copy)}
    clean = corpus_pipeline.leak_stage(spark, docs, str(tmp_path))
    assert {(r.doc_id, r.text) for r in clean.collect()} == {row for row in data if item not in row[1]}


def test_stages_hand_over_few_rows_at_once(spark, tmp_path, monkeypatch):
    def sizes(spark, docs, folder):
        def run(batches):
            for batch in batches:
                yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

        return docs.coalesce(1).mapInArrow(run, "n long")

    spark.range(3_500).selectExpr("id AS doc_id", "'a text' AS text").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(corpus_pipeline, "STAGES", [("sizes", sizes)])
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = [r.n for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert sum(got) == 3_500 and max(got) <= 1_000
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_a_stage_called_alone_hands_over_few_rows_at_once(spark, tmp_path, monkeypatch):
    def sizes(docs):
        def run(batches):
            for batch in batches:
                yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

        return docs.coalesce(1).mapInArrow(run, "n long")

    monkeypatch.setattr(corpus_pipeline.pieces, "segmentations", sizes)
    docs = spark.range(3_500).selectExpr("id AS doc_id", "'a text' AS text")
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.unset(batch)
    try:
        got = [r.n for r in corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()]
    finally:
        spark.conf.unset(batch)
    assert sum(got) == 3_500 and max(got) <= 1_000
