"""Signed feature contributions to ranked evidence sentences.

A prediction has one contribution per feature, about a hundred, so its list is
bounded and one shuffle by prediction is all that is needed; ranking and wording
work on the list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from failscope import constants as K
from failscope.functions.numbers import tenths_text, whole_text

TOP_FOR, TOP_AGAINST = 10, 5
SHOWN_FOR, SHOWN_AGAINST = 5, 3


def _ordered(items: Column, sign: int, k: int) -> Column:
    """The ``k`` largest items of one sign by size, ties by feature name."""
    kept = F.filter(items, lambda c: c["shap_value"] * sign > 0)
    keyed = F.transform(kept, lambda c: F.struct(
        (-F.abs(c["shap_value"])).alias("size"), c["feature"].alias("feature"),
        c["shap_value"].alias("shap_value"), c["feature_value"].alias("feature_value")))
    return F.slice(F.array_sort(keyed), 1, k)


def ranked(contributions: DataFrame, id: str = "failure_id") -> DataFrame:
    """Per prediction: the top features for it and against it."""
    item = F.struct("feature", "shap_value", "feature_value")
    lists = contributions.groupBy(id).agg(F.collect_list(item).alias("items"))
    return rank_lists(lists)


def rank_lists(lists: DataFrame, items: str = "items") -> DataFrame:
    """The same for predictions that already carry their list of contributions."""
    return lists.withColumns({
        "for_it": _ordered(F.col(items), 1, TOP_FOR),
        "against_it": _ordered(F.col(items), -1, TOP_AGAINST)}).drop(items)


def top_contributions(ranked_lists: DataFrame, id: str = "failure_id") -> DataFrame:
    """One row per ranked contribution: 10 for, 5 against."""
    def rows(column: str, direction: str) -> DataFrame:
        listed = ranked_lists.select(id, F.posexplode(column).alias("pos", "c"))
        return listed.select(
            id, F.lit(direction).alias("direction"), (F.col("pos") + 1).alias("rank"),
            "c.feature", "c.shap_value")

    return rows("for_it", "for").unionByName(rows("against_it", "against"))


def _float_text(value: Column) -> Column:
    """A double the way it is usually printed: 5.0, 0.25, without an exponent."""
    plain = F.regexp_replace(value.cast("decimal(38,17)").cast("string"), "0+$", "")
    plain = F.when(plain.endswith("."), F.concat(plain, F.lit("0"))).otherwise(plain)
    size = F.abs(value)
    return F.when((size == 0) | ((size >= 1e-4) & (size < 1e16)), plain).otherwise(
        value.cast("string"))


def _wording(feature: Column, value: Column, term: str) -> Column:
    """Description of a feature with its value; ``term`` words a vocabulary feature."""
    known = F.lit(None).cast("string")
    table = F.create_map(*[F.lit(x) for pair in K.FEATURE_TEXT.items() for x in pair])
    known = F.try_element_at(table, feature)
    known = F.replace(known, F.lit("{value:.0f}"), whole_text(value))
    known = F.when(known.contains("{value:.1f}"), F.replace(
        known, F.lit("{value:.1f}"), tenths_text(value))).otherwise(known)
    word = F.replace(F.replace(feature, F.lit("tfidf_"), F.lit("")), F.lit("_"), F.lit(" "))
    return F.coalesce(
        known,
        F.when(feature.startswith("tfidf_"), F.concat(F.lit(f"{term} '"), word, F.lit("'"))),
        F.concat(feature, F.lit(" = "), _float_text(value)))


def _impact(shap_value: Column) -> Column:
    size = F.abs(shap_value)
    return (
        F.when(size > 1.0, " (very high impact)").when(size > 0.5, " (high impact)")
        .when(size > 0.2, " (moderate impact)").otherwise(" (contributing factor)"))


def with_evidence(ranked_lists: DataFrame) -> DataFrame:
    """Add ``evidence`` (up to 5 sentences) and ``counter_evidence`` (up to 3)."""
    shown = F.transform(F.slice("for_it", 1, SHOWN_FOR), lambda c: F.concat(
        _wording(c["feature"], c["feature_value"], "error log contains the term"),
        _impact(c["shap_value"])))
    against = F.transform(F.slice("against_it", 1, SHOWN_AGAINST), lambda c: F.concat(
        F.lit("Against: "), _wording(c["feature"], c["feature_value"], "error log contains")))
    none = F.array(F.lit(K.NO_EVIDENCE_TEXT))
    return ranked_lists.withColumns({
        "evidence": F.when(F.size("for_it") == 0, none).otherwise(shown),
        "counter_evidence": against})
