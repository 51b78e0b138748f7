"""TF-IDF: fit a vocabulary, weight documents, save and load."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from failscope import constants as K
from failscope.functions.text import text_tokens, token_pairs, with_grams
from failscope.session import materialize

#: Words collected to tell which pairs can be used often enough; with more, all pairs are counted.
MAX_COMMON = 10_000

VOCABULARY = "term string, df bigint, tf bigint, idf double, idx int"


def term_counts(listed: DataFrame, terms: Column) -> DataFrame:
    """Corpus count and document count of every term in one shuffle.

    Each document contributes its terms once per use and once per distinct term;
    both counts are summed map-side, so no (term, document) pair is shuffled.
    """
    listed = listed.select(terms.alias("g"))
    uses = F.transform("g", lambda t: F.struct(
        t.alias("term"), F.lit(1).alias("tf"), F.lit(0).alias("df")))
    once = F.transform(F.array_distinct("g"), lambda t: F.struct(
        t.alias("term"), F.lit(0).alias("tf"), F.lit(1).alias("df")))
    return (
        # The outer form: a plain inline would also filter on the size of the array,
        # and the optimizer would compute the array a second time for that filter.
        listed.select(F.inline_outer(F.concat(uses, once))).where("term IS NOT NULL")
        .groupBy("term").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf")))


def fit_vocabulary(
    docs: DataFrame, text: str, max_features: int = K.TFIDF_MAX_FEATURES,
    min_df: int = K.TFIDF_MIN_DF, max_df: float = K.TFIDF_MAX_DF,
) -> "Vocabulary":
    """Most used terms that are neither rare nor everywhere; ties by term.

    Single words are counted first. The least use among the best ``max_features`` of them
    is a floor: a pair is used no more often than either of its words, so only pairs of two
    words used that often can be among the best terms, and no other pair is formed. With fewer words
    than wanted there is no floor, and all pairs are counted.
    """
    n = docs.count()
    allowed = (F.col("df") >= min_df) & (F.col("df") <= F.lit(max_df * n))
    best = [F.desc("tf"), F.col("term")]
    found = materialize(docs.select(text_tokens(F.col(text)).alias("_tokens")), "tokens")
    words = materialize(term_counts(found, F.col("_tokens")), "words")
    top = [r["tf"] for r in words.where(allowed).orderBy(*best).limit(max_features).collect()]
    floor = top[-1] if top and len(top) == max_features else 0
    common = [r["term"] for r in words.where(F.col("tf") >= floor).limit(MAX_COMMON + 1).select(
        "term").collect()] if floor else None
    if common is not None and len(common) > MAX_COMMON:
        common = None
    pairs = term_counts(found, token_pairs(F.col("_tokens"), common))
    top = words.unionByName(pairs).where(allowed).orderBy(*best).limit(max_features)
    idf = F.log(F.lit(1.0 + n) / (1 + F.col("df"))) + 1
    order = F.row_number().over(Window.orderBy("term")) - 1
    table = materialize(
        top.select("term", "df", "tf", idf.alias("idf"), order.alias("idx")), "vocabulary")
    return Vocabulary(table)


@dataclass
class Vocabulary:
    """A fitted vocabulary: at most ``max_features`` rows (term, df, tf, idf, idx)."""

    table: DataFrame

    @cached_property
    def size(self) -> int:
        return self.table.count()

    @cached_property
    def terms(self) -> list[tuple[str, float]]:
        """Terms with their weights, in column order (at most ``max_features``)."""
        return [(r["term"], r["idf"]) for r in self.table.orderBy("idx").collect()]

    @property
    def names(self) -> list[str]:
        return [f"tfidf_{term}" for term, _ in self.terms]

    def vectors(self, docs: DataFrame, text: str, out: str) -> DataFrame:
        """Add a sparse vector of L2-normalised weights, without a shuffle.

        Linear in a document's terms, whatever the vocabulary's size.
        """
        counts = CountVectorizerModel.from_vocabulary(
            [t for t, _ in self.terms], inputCol="_grams", outputCol="_counts")
        idf = ElementwiseProduct(
            scalingVec=Vectors.dense([w for _, w in self.terms]), inputCol="_counts",
            outputCol="_weights")
        unit = Normalizer(p=2.0, inputCol="_weights", outputCol=out)
        rows = with_grams(docs, text, "_grams").withColumn(
            "_grams", F.coalesce("_grams", F.array().cast("array<string>")))
        return unit.transform(idf.transform(counts.transform(rows))).drop(
            "_grams", "_counts", "_weights")

    def add_weights(self, docs: DataFrame, text: str, out: str = "tfidf") -> DataFrame:
        """Add an array of L2-normalised weights in column order; all-zero stays all-zero."""
        if not self.terms:
            return docs.withColumn(out, F.array().cast("array<double>"))
        return self.vectors(docs, text, "_unit").withColumn(out, vector_to_array("_unit")).drop("_unit")

    def columns(self, weights: str = "tfidf") -> list[Column]:
        """One ``tfidf_<term>`` column per term, from the array of ``add_weights``."""
        return [F.col(weights)[i].alias(name) for i, name in enumerate(self.names)]

    def long_weights(self, docs: DataFrame, id: str, text: str) -> DataFrame:
        """Non-zero weights as rows (id, term, weight)."""
        if not self.terms:
            return docs.select(id, F.lit("").alias("term"), F.lit(0.0).alias("weight")).limit(0)
        parts = F.unwrap_udt("_unit")
        rows = self.vectors(docs.select(id, text), text, "_unit").select(
            id, F.inline(F.arrays_zip(
                parts["indices"].alias("idx"), parts["values"].alias("weight"))))
        names = self.table.select("idx", "term")
        return rows.toDF(id, "idx", "weight").where("weight <> 0").join(names, "idx").select(
            id, "term", "weight")

    def save(self, path: str) -> None:
        self.table.coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> "Vocabulary":
        return Vocabulary(spark.read.schema(VOCABULARY).parquet(path))

