"""The feature matrix as a fit / transform pair with a saved state."""

from __future__ import annotations

import json

from pyspark.ml import Estimator, Model
from pyspark.sql import DataFrame, SparkSession

from failscope import constants as K
from failscope.functions import event_features as E
from failscope.functions.log_signals import SIGNALS, with_signals
from failscope.operators.lag import with_lag
from failscope.operators.validation import require_columns
from failscope.operators.vectorize import Vocabulary, fit_vocabulary

FIXED = E.EXECUTION + E.SCHEMA + E.TEMPORAL + E.LAG + SIGNALS


def with_log_features(df: DataFrame, vocabulary: Vocabulary, log: str = "error_log") -> DataFrame:
    """Combined log features: 23 signals and the array of vocabulary weights, ``tfidf``."""
    return vocabulary.add_weights(with_signals(df, log), log)


class FeatureEngineer(Estimator):
    """Learns the log vocabulary; everything else needs no fitting."""

    def __init__(self, max_features: int = K.TFIDF_MAX_FEATURES) -> None:
        super().__init__()
        self.max_features = max_features

    def _fit(self, events: DataFrame) -> "FeatureModel":
        require_columns(events)
        return FeatureModel(fit_vocabulary(events, "error_log", self.max_features))

    def fit_transform(self, events: DataFrame, label: str = "root_cause"):
        """Model, features with the label, and the ordered feature names."""
        if label not in events.columns:
            raise ValueError(f"Label column '{label}' not found")
        model = self.fit(events)
        return model, model.transform(events), model.feature_names


class FeatureModel(Model):
    """Turns events into features; the same code serves training and scoring."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        super().__init__()
        self.vocabulary = vocabulary
        self.feature_names = FIXED + vocabulary.names

    def _transform(self, events: DataFrame) -> DataFrame:
        return self.with_features(with_lag(require_columns(events)))

    def with_features(self, events: DataFrame) -> DataFrame:
        """Features of events that already carry their lag columns: no shuffle.

        Other event columns are kept in front of the features.
        """
        rows = with_log_features(events, self.vocabulary)
        kept = [c for c in events.columns if c not in E.LAG]
        return rows.select(
            *kept, *E.execution_columns(rows), *E.schema_columns(rows),
            *E.temporal_columns(rows), *E.LAG,
            *SIGNALS, *self.vocabulary.columns())

    def save(self, path: str) -> None:
        self.vocabulary.save(f"{path}/vocabulary")
        spark = self.vocabulary.table.sparkSession
        spark.createDataFrame([(json.dumps(self.feature_names),)], "value string").coalesce(
            1).write.mode("overwrite").text(f"{path}/feature_names")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "FeatureModel":
        model = FeatureModel(Vocabulary.load(spark, f"{path}/vocabulary"))
        names = json.loads(spark.read.text(f"{path}/feature_names").first()[0])
        if names != model.feature_names:
            raise ValueError("saved feature names do not match the saved vocabulary")
        return model
