"""Contract checks: each rule is an expression that yields a message or null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from failscope import constants as K
from failscope.functions.text import stripped
from failscope.functions.times import moment
from failscope.schemas import REQUIRED_COLUMNS

# Message texts.
NOT_TEXT = "Input should be a valid string"
TOO_SHORT = "String should have at least 1 character"
TOO_LONG = "String should have at most 200 characters"
BLANK = "Value error, Field must not be blank or whitespace-only"
NOT_INT = "Input should be a valid integer"
BELOW = "Input should be greater than or equal to 0"
ABOVE_10 = "Input should be less than or equal to 10"
ABOVE_1 = "Input should be less than or equal to 1"
NOT_BOOL = "Input should be a valid boolean"
NOT_CAUSE = (
    "Input should be 'Schema Change', 'Missing Data', 'Dependency Failure', "
    "'API Failure', 'Resource Exhaustion' or 'Data Quality Issue'")
NOT_TIME = "Input should be a valid datetime"
NOT_NUMBER = "Input should be a valid number"


def _first(*checks: tuple[Column, str]) -> Column:
    """Message of the first check that fails, else null."""
    out = F.lit(None).cast("string")
    for failed, message in reversed(checks):
        out = F.when(failed, F.lit(message)).otherwise(out)
    return out


def _name(c: Column) -> Column:
    return _first(
        (c.isNull(), NOT_TEXT), (F.length(c) < 1, TOO_SHORT), (F.length(c) > 200, TOO_LONG),
        (stripped(c) == "", BLANK))


def _count(c: Column, top: int | None = None) -> Column:
    checks = [(c.isNull(), NOT_INT), (c < 0, BELOW)]
    if top is not None:
        checks.append((c > top, ABOVE_10))
    return _first(*checks)


def _shared_rules() -> list[Column]:
    return [
        _name(F.col("pipeline_name")),
        _name(F.col("task_name")),
        _count(F.col("runtime")),
        _count(F.col("retry_count"), 10),
        _count(F.col("rows_processed")),
        _first((F.col("schema_change").isNull(), NOT_BOOL)),
        _first((F.col("upstream_failed").isNull(), NOT_BOOL)),
    ]


def event_rules(ts: str = "timestamp") -> list[Column]:
    """Rules of a labelled event, in field order; a missing log counts as empty."""
    cause = F.col("root_cause")
    return _shared_rules() + [
        _first((cause.isNull() | ~cause.isin(K.ROOT_CAUSES), NOT_CAUSE)),
        _first((F.col(ts).isNull(), NOT_TIME)),
    ]


def request_rules() -> list[Column]:
    """Rules of an unlabelled request: the log must not be empty, the time may be."""
    log = F.col("error_log")
    return _shared_rules() + [_first((log.isNull(), NOT_TEXT), (F.length(log) < 1, TOO_SHORT))]


def response_rules() -> list[Column]:
    conf = F.col("confidence")
    return [
        _first((F.col("pipeline_name").isNull(), NOT_TEXT)),
        _first((F.col("predicted_root_cause").isNull(), NOT_TEXT)),
        _first((conf.isNull(), NOT_NUMBER), (conf < 0, BELOW), (conf > 1, ABOVE_1)),
        _first((F.col("model_version").isNull(), NOT_TEXT)),
    ]


def check(df: DataFrame, rules: list[Column]) -> DataFrame:
    """Add ``errors``: the messages of all failed rules, in field order."""
    return df.withColumn(
        "errors", F.filter(F.array(*rules), lambda m: m.isNotNull()))


def with_contract_defaults(df: DataFrame) -> DataFrame:
    """Strip both names; a missing log becomes empty."""
    return df.withColumns({
        "pipeline_name": stripped(F.col("pipeline_name")),
        "task_name": stripped(F.col("task_name")),
        "error_log": F.coalesce(F.col("error_log"), F.lit("")),
    })


def split_valid(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid rows (normalised, without ``errors``) and invalid rows (as they came)."""
    ok = F.size("errors") == 0
    return with_contract_defaults(checked.where(ok).drop("errors")), checked.where(~ok)


def counts(checked: DataFrame) -> DataFrame:
    ok = F.size("errors") == 0
    return checked.agg(
        F.count_if(ok).alias("valid_rows"), F.count_if(~ok).alias("invalid_rows"))


def messages(checked: DataFrame, id: str = "event_id", limit: int = 10) -> DataFrame:
    """The first ``limit`` invalid rows by id, one line of text each."""
    line = F.format_string(
        "Row %s: %d error(s) — %s", F.col(id).cast("string"), F.size("errors"), F.col("errors")[0])
    return (
        checked.where(F.size("errors") > 0).select(id, line.alias("message"))
        .orderBy(id).limit(limit))


def require_columns(df: DataFrame) -> DataFrame:
    """Fail early, with the names, when a contract column is missing."""
    missing = sorted(set(REQUIRED_COLUMNS) - set(df.columns))
    if missing:
        raise ValueError(f"Missing required columns: {missing}")
    return df


def align_columns(df: DataFrame, ordered: list[str]) -> DataFrame:
    """Columns in the fitted order; of columns that share a name the first is kept."""
    first: dict[str, int] = {}
    for at, name in enumerate(df.columns):
        first.setdefault(name, at)
    unique = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return unique.select(*[F.col(f"c{first[name]}").alias(name) for name in ordered])


def with_default_time(df: DataFrame, as_of, ts: str = "timestamp") -> DataFrame:
    return df.withColumn(ts, F.coalesce(F.col(ts), moment(df, ts, as_of)))


def feature_quality(features: DataFrame, names: list[str]) -> DataFrame:
    """Nulls, infinities and variance per feature, one row each, in one pass.

    Rows turn into (position, value) pairs that are aggregated before the shuffle: the
    aggregate keeps five numbers per feature however many features there are.
    """
    values = F.array(*[F.col(f"`{name}`").cast("double") for name in names])
    value = F.col("value")
    stats = features.select(F.posexplode(values).alias("at", "value")).groupBy("at").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(value.isNull() | F.isnan(value)).alias("n_missing"),
        F.count_if(F.abs(value) == F.lit(float("inf"))).alias("n_infinite"),
        F.coalesce(F.var_samp(value), F.lit(0.0)).alias("variance"))
    listed = F.array(*[F.lit(name) for name in names])
    return stats.select(
        F.get(listed, F.col("at")).alias("feature"), "n_rows", "n_missing", "n_infinite",
        "variance", (F.col("variance") == 0).alias("is_constant"))


def low_variance(quality: DataFrame, threshold: float = K.LOW_VARIANCE) -> DataFrame:
    return quality.where(F.col("variance") < threshold).select("feature", "variance")
