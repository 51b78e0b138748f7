"""Numeric signals read from one error log: 23 expressions, no Python worker."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from failscope import constants as K
from failscope.functions.text import clean_text, line_breaks, unicode_aware, words_between_spaces

SIGNALS = [
    "has_error_type", "error_type_hash", "has_http_error", "http_status_code",
    "is_client_error", "is_server_error", "has_file_path", "has_s3_path",
    "has_memory_ref", "memory_value_mb", "has_timeout", "timeout_seconds",
    "column_count", "numeric_count_in_log", "log_length", "word_count", "log_line_count",
    "keyword_score_schema", "keyword_score_resource", "keyword_score_api",
    "keyword_score_data_quality", "keyword_score_dependency", "keyword_score_missing_data",
]


_SCORES = {
    "keyword_score_schema": K.SCHEMA_WORDS,
    "keyword_score_resource": K.RESOURCE_WORDS,
    "keyword_score_api": K.API_WORDS,
    "keyword_score_data_quality": K.DATA_QUALITY_WORDS,
    "keyword_score_dependency": K.DEPENDENCY_WORDS,
}


def _literals(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def _flag(condition: Column) -> Column:
    return condition.cast("int")


def _number(digits: Column, kind: str) -> Column:
    """Text to number; no match is null before the cast, which then has nothing to fail on."""
    return F.nullif(digits, F.lit("")).try_cast(kind)


def _bucket(text: Column) -> Column:
    """Stable bucket 0..999 of a text, the same in every process."""
    head = F.substring(F.md5(text), 1, 8)
    return (F.conv(head, 16, 10).cast("bigint") % 1000).cast("int")


def with_signals(df: DataFrame, error_log: str = "error_log") -> DataFrame:
    """Add the 23 signals of a log column, in fixed order.

    Texts, words and matches that several signals use get columns of their own first,
    so each pattern runs over a log once.
    """
    text, lower, words = F.col("_text"), F.col("_lower"), F.col("_words")
    every = sorted({w for vocabulary in _SCORES.values() for w in vocabulary})
    rows = df.withColumn("_text", clean_text(F.col(error_log)))
    rows = rows.withColumn("_lower", F.lower(text))
    rows = rows.withColumns({
        "_words": words_between_spaces(lower),
        "_type": F.regexp_extract(text, unicode_aware(K.P_ERROR_TYPE), 1),
        "_status": F.coalesce(
            _number(F.regexp_extract(text, unicode_aware(K.P_HTTP_STATUS), 1), "int"), F.lit(0)),
        "_memory": F.regexp_extract(text, unicode_aware(K.P_MEMORY), 0),
        "_timeout": F.regexp_extract(text, unicode_aware(K.P_TIMEOUT), 1),
    })
    rows = rows.withColumn("_hits", F.array_intersect(words, _literals(every)))

    error_type, status = F.col("_type"), F.col("_status")
    memory, timeout = F.col("_memory"), F.col("_timeout")
    empty = text == ""
    path = unicode_aware(K.P_PATH)
    paths = F.array_join(F.regexp_extract_all(text, F.lit(path), F.lit(0)), "\n")
    s3 = F.lit("s3://")
    number = F.regexp_extract(memory, r"^\d+(?:\.\d+)?", 0).try_cast("double")
    unit = F.upper(F.regexp_extract(memory, r"[A-Za-z]+$", 0))
    factor = F.lit(None).cast("double")
    for name, mb in K.MEMORY_UNIT_MB.items():
        factor = F.when(unit == name, F.lit(mb)).otherwise(factor)
    phrases = sum(
        (_flag(F.contains(lower, F.lit(p))) for p in K.MISSING_DATA_PHRASES), F.lit(0))

    values = {
        "has_error_type": _flag(error_type != ""),
        "error_type_hash": F.when(error_type != "", _bucket(error_type)).otherwise(0),
        "has_http_error": _flag(status >= 400),
        "http_status_code": status,
        "is_client_error": _flag((status >= 400) & (status < 500)),
        "is_server_error": _flag(status >= 500),
        "has_file_path": _flag(F.rlike(text, F.lit(path))),
        "has_s3_path": _flag(F.contains(text, s3) & F.contains(paths, s3)),
        "has_memory_ref": _flag(memory != ""),
        "memory_value_mb": F.when(memory != "", F.coalesce(number * factor, F.lit(0.0)))
        .otherwise(F.lit(0.0)),
        "has_timeout": _flag(timeout != ""),
        "timeout_seconds": F.coalesce(_number(timeout, "bigint"), F.lit(0).cast("bigint")),
        "column_count": F.regexp_count(text, F.lit(unicode_aware(K.P_QUOTED))),
        "numeric_count_in_log": F.regexp_count(text, F.lit(unicode_aware(K.P_COUNTED))),
        "log_length": F.length(text),
        "word_count": F.when(empty, 0).otherwise(F.size(words)),
        "log_line_count": F.when(empty, 0).otherwise(line_breaks(text) + 1),
        **{name: F.size(F.array_intersect(_literals(vocabulary), F.col("_hits")))
           for name, vocabulary in _SCORES.items()},
        "keyword_score_missing_data": phrases,
    }
    helpers = ["_text", "_lower", "_words", "_type", "_status", "_memory", "_timeout", "_hits"]
    return rows.withColumns(values).drop(*helpers)


def signals(df: DataFrame, *keep: str, error_log: str = "error_log") -> DataFrame:
    """The kept columns and the 23 signals."""
    return with_signals(df.select(*keep, F.col(error_log).alias("_log")), "_log").drop("_log")
