"""Event, pod-log and feature files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from failscope import constants as K
from failscope.functions.text import stripped
from failscope.schemas import EVENT, POD_LINE, SCENARIO

_CSV = {"header": "true", "escape": '"', "multiLine": "true"}


def read_events(
    spark: SparkSession, path: str, schema: T.StructType = EVENT, corrupt: bool = False
) -> DataFrame:
    """Failure events from CSV; the schema is given, so nothing is inferred.

    With ``corrupt`` a row that does not fit keeps its text in ``_corrupt_record``.
    """
    if corrupt:
        schema = T.StructType(schema.fields + [T.StructField("_corrupt_record", T.StringType())])
    return spark.read.schema(schema).options(**_CSV, mode="PERMISSIVE").csv(path)


def write_events(df: DataFrame, path: str, format: str = "csv", mode: str = "errorifexists") -> None:
    writer = df.write.mode(mode)
    if format == "csv":
        writer.options(
            header="true", escape='"', ignoreLeadingWhiteSpace="false",
            ignoreTrailingWhiteSpace="false",
            timestampFormat="yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").csv(path)
    else:
        writer.format(format).save(path)


def read_pod_logs(spark: SparkSession, path: str) -> DataFrame:
    """Lines of all ``<pod>_messages_structured.csv`` files (or folders) below ``path``.

    The pod comes from the file name, the scenario from an eight-digit folder.
    Undecodable bytes are replaced, blank lines dropped, content is stripped.
    """
    raw = (
        spark.read.schema(POD_LINE)
        .options(**_CSV, recursiveFileLookup="true", pathGlobFilter="*.csv")
        .csv(path)
        .select("*", F.col("_metadata.file_path").alias("file"))
    )
    pod = F.regexp_extract("file", r"([^/=]+)_messages_structured\.csv", 1)
    content = stripped(F.col("Content"))
    return raw.where(pod != "").where(content != "").select(
        F.regexp_extract("file", r"[/=](\d{8})/", 1).alias("date_key"),
        pod.alias("pod_name"),
        F.col("LineId").alias("line_id"),
        F.col("Time").alias("time"),
        content.alias("content"),
        F.col("EventId").alias("event_id"),
        F.col("EventTemplate").alias("event_template"),
        F.col("ParameterList").alias("parameter_list"),
    )


def scenarios(spark: SparkSession) -> DataFrame:
    """The scenario ground truth: six rows, so any join with it is planned as a broadcast."""
    return spark.createDataFrame(K.SCENARIOS, SCENARIO)


def write_feature_store(
    features: DataFrame, path: str, names: list[str], label: str = "root_cause",
    partition_by: str | None = None,
) -> None:
    """Features and label as parquet; names and group counts as one JSON row."""
    writer = features.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(f"{path}/features")
    features.sparkSession.createDataFrame(
        [(names, feature_group_counts(names))],
        "feature_names array<string>, feature_groups map<string,int>",
    ).coalesce(1).write.mode("overwrite").json(f"{path}/feature_names")


def feature_group_counts(names: list[str]) -> dict[str, int]:
    feat = sum(n.startswith("feat_") for n in names)
    tfidf = sum(n.startswith("tfidf_") for n in names)
    return {"execution": feat, "log_signals": len(names) - feat - tfidf, "tfidf": tfidf,
            "total": len(names)}


def read_feature_store(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    meta = spark.read.schema("feature_names array<string>, feature_groups map<string,bigint>").json(
        f"{path}/feature_names").first()
    return spark.read.parquet(f"{path}/features"), list(meta["feature_names"])
