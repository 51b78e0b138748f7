import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from failscope.functions.text import text_tokens, token_pairs, tokens, vector_text
from failscope.operators import vectorize as X
from failscope.operators.vectorize import fit_vocabulary
from tests.conftest import SMALL

WORDS = "error schema pod-7 timeout 503 /tmp/a.csv s3://b/c größe not found null 12.5 mb x".split()


def _docs():
    rng = random.Random(5)
    docs = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 12))) for _ in range(120)]
    return docs + ["common common"] * 3 + ["", None]


def _plain_tfidf(docs, limit):
    """Vocabulary and weights by their definition."""
    from tests.test_log_signals import _python_form

    def terms(text):
        t = re.findall(r"(?u)\b\w[\w_]+\b", _python_form(_python_form(text or "")))
        return t + [f"{a} {b}" for a, b in zip(t, t[1:])]

    bags = [Counter(terms(d)) for d in docs]
    n = len(docs)
    df, tf = Counter(), Counter()
    for bag in bags:
        df.update(bag.keys())
        tf.update(bag)
    kept = sorted((t for t in df if 2 <= df[t] <= 0.9 * n), key=lambda t: (-tf[t], t))[:limit]
    vocabulary = sorted(kept)
    idf = {t: math.log((1 + n) / (1 + df[t])) + 1 for t in vocabulary}
    weights = []
    for bag in bags:
        w = {t: bag[t] * idf[t] for t in vocabulary if bag[t]}
        norm = math.sqrt(sum(x * x for x in w.values()))
        weights.append({t: x / norm for t, x in w.items()})
    return vocabulary, weights


def test_tfidf_equals_definition(spark, tmp_path):
    docs = _docs()
    df = spark.createDataFrame(list(enumerate(docs)), "id int, text string")
    vocabulary, weights = _plain_tfidf(docs, 20)
    fitted = X.fit_vocabulary(df, "text", max_features=20)
    assert [t for t, _ in fitted.terms] == vocabulary
    assert fitted.names == [f"tfidf_{t}" for t in vocabulary]
    fitted.save(str(tmp_path / "v"))
    loaded = X.Vocabulary.load(spark, str(tmp_path / "v"))
    got = {}
    for r in loaded.long_weights(df, "id", "text").collect():
        got.setdefault(r["id"], {})[r["term"]] = r["weight"]
    for i, want in enumerate(weights):
        assert got.get(i, {}) == pytest.approx(want), docs[i]


def test_dense_weights_keep_zero_rows(spark):
    docs = _docs()
    df = spark.createDataFrame(list(enumerate(docs)), "id int, text string")
    fitted = X.fit_vocabulary(df, "text", max_features=20)
    rows = fitted.add_weights(df, "text").collect()
    assert all(len(r["tfidf"]) == 20 for r in rows)
    assert sum(rows[-1]["tfidf"]) == 0
    for r in rows:
        size = math.sqrt(sum(x * x for x in r["tfidf"]))
        assert size == pytest.approx(0) or size == pytest.approx(1)


def test_empty_corpus(spark):
    df = spark.createDataFrame([(1, "")], "id int, text string")
    fitted = X.fit_vocabulary(df, "text")
    assert fitted.names == [] and fitted.long_weights(df, "id", "text").count() == 0


def test_large_vocabularies_take_the_same_path(spark):
    docs = [" ".join(f"word{(i * 7 + j) % 3_000}" for j in range(40)) for i in range(600)]
    df = spark.createDataFrame(list(enumerate(docs)), "id int, text string")
    fitted = X.fit_vocabulary(df, "text", max_features=5_000, min_df=1, max_df=1.0)
    assert fitted.size == 5_000
    rows = fitted.add_weights(df.limit(3), "text").collect()
    long = {}
    for r in fitted.long_weights(df.limit(3), "id", "text").collect():
        long.setdefault(r["id"], {})[r["term"]] = r["weight"]
    for r in rows:
        dense = {t: w for (t, _), w in zip(fitted.terms, r["tfidf"]) if w}
        assert dense == pytest.approx(long[r["id"]])


def test_tokens_without_collapsing_are_the_same(spark):
    from tests.test_log_signals import TRICKY
    texts = TRICKY + ["a  b　　cc\tdd S3://X/y.z 12 GB", "", None, "ΣΑΣ ΑΣ", "5 ms500 /a/b.CSV 1234"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string").select(
        text_tokens(F.col("t")).alias("got"), tokens(vector_text(F.col("t"))).alias("want")).collect()
    assert len(rows) == len(texts) and all(r.got == r.want for r in rows)


@pytest.mark.parametrize("size", [1, 3, 6, 12, 500])
def test_vocabulary_from_common_words_is_that_of_all_terms(spark, size):
    rng = random.Random(size)
    words = ["aa", "bb", "cc", "dd", "ee", "ff", "gg"]
    texts = [" ".join(rng.choices(words, weights=[40, 20, 9, 5, 3, 2, 1], k=rng.randint(0, 12)))
             for _ in range(60)] + [None, "aa aa aa"]
    docs = spark.createDataFrame([(t,) for t in texts], "t string")
    tf, df = Counter(), Counter()
    for text in texts:
        found = (text or "").split()
        found += [f"{a} {b}" for a, b in zip(found, found[1:])]
        tf.update(found)
        df.update(set(found))
    want = sorted((-tf[t], t) for t in tf if 2 <= df[t] <= 0.9 * len(texts))[:size]
    got = {r.term: (r.tf, r.df) for r in fit_vocabulary(docs, "t", size).table.collect()}
    assert got == {t: (-n, df[t]) for n, t in want}


def test_only_pairs_of_given_words_are_formed(spark):
    row = spark.createDataFrame([(["aa", "bb", "zz", "aa", "aa"],)], "t array<string>").select(
        token_pairs(F.col("t"), ["aa", "bb"]).alias("p")).first()
    assert row.p == ["aa bb", "aa aa"]


def test_tokens_are_found_once_and_after_spreading(spark):
    from failscope.plans.texts import q_grams
    plan = q_grams(spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Repartition"):] if "Repartition" in plan else ""
    assert plan.count("regexp_extract_all") == 1 and "regexp" not in below
