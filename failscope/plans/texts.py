"""Queries: log normalisation, tokens, vocabulary and TF-IDF weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from failscope import constants as K
from failscope.functions.text import grams, placeholder_text, text_tokens, vector_text
from failscope.operators.vectorize import Vocabulary, fit_vocabulary
from failscope.plans import oracle_text as O
from failscope.plans.derived import failure_events, table, with_tables
from failscope.plans.features import _rounded
from failscope.plans.registry import query
from failscope.session import new_path


def docs_cte(source: str, id: str, text: str) -> str:
    return (f"docs AS (SELECT {id} AS id, lower({O.placeholder_sql(f'coalesce({text}, {O.text(str())})')}) "
            f"AS txt FROM {source})")


TOKENS = f"toks AS (SELECT id, {O.TOKENS_SQL} AS ts FROM docs)"
GRAMS = """grams AS (SELECT id, unnest(list_concat(ts,
  list_transform(range(1, len(ts)), lambda i: concat(ts[i], ' ', ts[i + 1])))) AS term FROM toks)"""
VOCAB = f"""vocab AS (
SELECT *, CAST(row_number() OVER (ORDER BY encode(term)) - 1 AS INTEGER) AS idx FROM (
SELECT term, df, tf, ln((1.0::DOUBLE + n) / (1 + df)) + 1 AS idf
FROM (SELECT term, count(DISTINCT id) AS df, count(*) AS tf, (SELECT count(*) FROM docs) AS n
      FROM grams GROUP BY term) c
WHERE df >= {K.TFIDF_MIN_DF} AND df <= {K.TFIDF_MAX_DF} * n
ORDER BY tf DESC, encode(term) LIMIT {K.TFIDF_MAX_FEATURES}) top)"""
WEIGHTS = """weights AS (
SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS weight
FROM (SELECT g.id, g.term, count(*) * v.idf AS w FROM grams g JOIN vocab v ON v.term = g.term
      GROUP BY g.id, g.term, v.idf) s)"""
_LOGS = docs_cte("failure_events", "event_id", "error_log")
_DOCS = docs_cte("documents", "doc_id", "text")


@query("log_normalise", with_tables("failure_events", select=f"""
SELECT event_id, {O.placeholder_sql('error_log')} AS normal,
  lower({O.placeholder_sql('error_log')}) AS vector FROM failure_events"""))
def q_normalise(spark: SparkSession, folder: str) -> DataFrame:
    return failure_events(spark, folder, heavy=True).select(
        "event_id", placeholder_text(F.col("error_log")).alias("normal"),
        vector_text(F.col("error_log")).alias("vector"))


@query("text_normalise", f"""
SELECT doc_id, lower({O.placeholder_sql('text')}) AS vector FROM documents""")
def q_text_normalise(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents", heavy=True).select(
        "doc_id", vector_text(F.col("text")).alias("vector"))


@query("tokens_ngrams", f"""
WITH {_DOCS}, {TOKENS}, {GRAMS}
SELECT id AS doc_id, count(*) AS n_grams, count(*) FILTER (contains(term, ' ')) AS n_pairs,
  count(DISTINCT term) AS n_distinct, min(encode(term)) = min(encode(term)) AS ok
FROM grams GROUP BY id""")
def q_grams(spark: SparkSession, folder: str) -> DataFrame:
    listed = table(spark, folder, "documents", heavy=True).select(
        "doc_id", text_tokens(F.col("text")).alias("t"))
    # The optimizer takes a filter on the tokens below the spreading, where few tasks would compute
    # them a second time. It does not take it through a generator.
    listed = listed.select("doc_id", F.explode_outer(F.array("t")).alias("t"))
    both = listed.select("doc_id", F.size("t").alias("n"), grams(F.col("t")).alias("g"))
    return both.where("n > 0").select(
        "doc_id", F.size("g").cast("bigint").alias("n_grams"),
        (F.size("g") - F.col("n")).cast("bigint").alias("n_pairs"),
        F.size(F.array_distinct("g")).cast("bigint").alias("n_distinct"), F.lit(True).alias("ok"))


@query("token_list", f"""
WITH {_DOCS}, {TOKENS}
SELECT id AS doc_id, array_to_string(ts, ' ') AS tokens FROM toks""")
def q_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents", heavy=True).select(
        "doc_id", F.array_join(text_tokens(F.col("text")), " ").alias("tokens"))


_VOCAB_SELECT = "SELECT term, concat('tfidf_', term) AS feature, df, tf, round(idf, 9) AS idf, idx FROM vocab"


def _vocab_rows(vocabulary: Vocabulary) -> DataFrame:
    t = vocabulary.table
    return _rounded(t.select(
        "term", F.concat(F.lit("tfidf_"), "term").alias("feature"), "df", "tf", "idf", "idx"), 9)


@query("tfidf_vocabulary", with_tables(
    "failure_events", _LOGS, TOKENS, GRAMS, VOCAB, select=_VOCAB_SELECT))
def q_vocabulary(spark: SparkSession, folder: str) -> DataFrame:
    return _vocab_rows(fit_vocabulary(failure_events(spark, folder, heavy=True), "error_log"))


@query("tfidf_vocabulary_documents", f"WITH {_DOCS}, {TOKENS}, {GRAMS}, {VOCAB} {_VOCAB_SELECT}")
def q_vocabulary_documents(spark: SparkSession, folder: str) -> DataFrame:
    return _vocab_rows(fit_vocabulary(table(spark, folder, "documents", heavy=True), "text"))


@query("tfidf_matrix", with_tables(
    "failure_events", _LOGS, TOKENS, GRAMS, VOCAB, WEIGHTS,
    select="SELECT id AS event_id, term, round(weight, 6) AS weight FROM weights"))
def q_tfidf(spark: SparkSession, folder: str) -> DataFrame:
    """The vocabulary is saved and loaded again before it is used."""
    events = failure_events(spark, folder, heavy=True)
    path = new_path(spark, "saved-vocabulary")
    fit_vocabulary(events, "error_log").save(path)
    vocabulary = Vocabulary.load(spark, path)
    return _rounded(vocabulary.long_weights(events, "event_id", "error_log"))


@query("tfidf_matrix_documents", f"""
WITH {_DOCS}, {TOKENS}, {GRAMS}, {VOCAB}, {WEIGHTS}
SELECT id AS doc_id, term, round(weight, 6) AS weight FROM weights""")
def q_tfidf_documents(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", heavy=True)
    return _rounded(fit_vocabulary(docs, "text").long_weights(docs, "doc_id", "text"))
