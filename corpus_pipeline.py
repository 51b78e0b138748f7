"""The corpus pipeline: five filtering and encoding stages, each one operator of ``failscope.llm``.

Every stage takes (spark, docs, folder) and returns a DataFrame; ``run`` writes each result as
Parquet to the shared folder and reads it back as the next one's documents. All stages but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from failscope.llm import line_dedup, pieces, quality
from failscope.llm.common import saved, table
from failscope.llm.decontaminate import decontaminate
from failscope.llm.near_duplicates import near_duplicates

#: Rows that cross to Python at once. With Spark's 10,000 a whole split of texts is one batch, held
#: by the JVM, as Arrow columns and as strings; a worker then keeps that memory for the next stage.
BATCH_ROWS = "1000"
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"

_Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _few_at_once(stage: _Stage) -> _Stage:
    """``stage`` with ``BATCH_ROWS`` set in the session, by whomever it is called.

    It stays set: Spark reads it when the returned rows are written, after the stage.
    """

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
        spark.conf.set(_BATCH, BATCH_ROWS)
        return stage(spark, docs, folder)

    return run_stage


@_few_at_once
def quality_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the classifier, fitted on these documents, does not reject."""
    return quality.keep_good(docs, quality.fit(docs))


@_few_at_once
def line_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Without lines that are used too often, but for their first use.

    Whole copies of documents of one passage stay: the next stage keeps one of them.
    """
    return line_dedup.dedup_lines(docs)


def _numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with a written number (__row) of each row, by which rows are decided on."""
    return saved(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered-rows")


@_few_at_once
def near_duplicate_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group: five-word shingles, a similarity of 0.8 or more.

    The one with the least doc_id stays. Rows that repeat a doc_id and text count as copies of one
    another, different texts of a doc_id are compared as any others; rows without an id stay.
    """
    rows = _numbered(docs)
    known = rows.where("doc_id IS NOT NULL")
    groups = near_duplicates(known.select(F.col("__row").alias("doc_id"), "text"), words=5, percent=80)
    member = saved(groups.select(F.col("doc_id").alias("__row"), "component_id"), "near-groups")
    first = member.join(known.select("__row", "doc_id"), "__row").groupBy("component_id").agg(
        F.min(F.struct("doc_id", "__row"))["__row"].alias("__row"))
    kept = known.join(saved(first.select("__row"), "near-kept"), "__row", "left_semi").drop("__row")
    return kept.dropDuplicates(["doc_id", "text"]).unionByName(
        rows.where("doc_id IS NULL").drop("__row")).select(*docs.columns)


@_few_at_once
def leak_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Without documents that hold a window of a benchmark item."""
    rows = _numbered(docs)
    found = decontaminate(rows.select(F.col("__row").alias("doc_id"), "text"), table(spark, folder, "benchmark"))
    leaks = saved(found.where("contaminated").select(F.col("doc_id").alias("__row")), "leaks")
    return rows.join(leaks, "__row", "left_anti").drop("__row").select(*docs.columns)


@_few_at_once
def piece_stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The remaining documents as pieces: the ids and scores of the N best segmentations."""
    return pieces.segmentations(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("MinHash near-dedup", near_duplicate_stage),
    ("benchmark decontamination", leak_stage),
    ("SentencePiece encoding and decoding", piece_stage),
]

#: SQL expresses neither the classifier nor the lattice search; tests compare stage by stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, BATCH_ROWS)
    try:
        for name, stage in STAGES:
            docs = saved(stage(spark, docs, sf_dir), "stage-" + name.split()[0].lower())
    finally:
        spark.conf.set(_BATCH, before)
    return docs
