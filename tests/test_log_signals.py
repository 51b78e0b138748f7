import re
import time

import pytest
from pyspark.sql import functions as F

from failscope import constants as K
from failscope.functions.log_signals import SIGNALS, signals
from failscope.functions.text import (
    LINE_BREAK, SPACES, clean_text, grams, line_breaks, placeholder_text, tokens, unicode_aware,
    vector_text, with_grams, words_between_spaces,
)

CASES = [
    ("TideError: berth 'q4' is closed", {"has_error_type": 1, "memory_value_mb": 0.0}),
    ("the crane run stopped early", {"has_error_type": 0}),
    ("HTTPError: 502 Bad Gateway from https://quay.example/berths",
     {"has_http_error": 1, "http_status_code": 502, "is_server_error": 1, "is_client_error": 0}),
    ("HTTPError: 404 Not Found", {"http_status_code": 404, "is_client_error": 1}),
    ("MemoryError: wanted 2.5 GiB",
     {"has_http_error": 0, "http_status_code": 0, "has_memory_ref": 1,
      "memory_value_mb": 2.5 * 1073.74}),
    ("FileNotFoundError: s3://quay/berths/7.parquet is gone",
     {"has_s3_path": 1, "has_file_path": 1}),
    ("TimeoutError: crane timed out after 45s", {"has_timeout": 1, "timeout_seconds": 45}),
    ("six words make up this line", {"log_length": 27, "word_count": 6}),
    ("", {name: 0 for name in SIGNALS}),
    (None, {name: 0 for name in SIGNALS}),
    ("  \n ", {name: 0 for name in SIGNALS}),
    ("a\r\nb c", {"log_line_count": 3}),
    ("/foo.s3://bar", {"has_s3_path": 0, "has_file_path": 1}),
]


@pytest.fixture(scope="module")
def parsed(spark):
    rows = [(i, log) for i, (log, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "event_id int, error_log string")
    return {r["event_id"]: r for r in signals(df, "event_id").collect()}


@pytest.mark.parametrize("at", range(len(CASES)))
def test_literal_logs(parsed, at):
    got = parsed[at]
    for name, want in CASES[at][1].items():
        assert got[name] == pytest.approx(want), name


def test_all_signals_present(parsed):
    assert list(parsed[0].asDict())[1:] == SIGNALS


TRICKY = [
    "é123 123é 456 7890", "café schön über_x ab c", "x y z", "45% null", "45%x 12 gib",
    "s3://bucket/a b", "/tmp/Ünï.csv failed", "٣٤٥ 345", "http://a/b?c https://é.com/ü x",
    "naïve 12.5 MB free 3s 30seconds 9sec", "Größe 500", "['col'] \"über\" [a]",
    "İstanbul ERROR", "ab12 500. 499, (404)",
]


def _python_form(text):
    out = text.lower()
    for pattern, name in K.PLACEHOLDERS:
        out = re.sub(pattern, f" {name} ", out)
    return re.sub(r"\s+", " ", out).strip()


def test_unicode_patterns_agree_with_python(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TRICKY)], "i int, t string")
    got = df.select(
        "i", placeholder_text(F.col("t")).alias("p"), tokens(F.col("t")).alias("k"),
        F.regexp_count("t", F.lit(unicode_aware(K.P_QUOTED))).alias("q"),
        F.regexp_extract("t", unicode_aware(K.P_HTTP_STATUS), 1).alias("s"),
        F.regexp_extract("t", unicode_aware(K.P_TIMEOUT), 1).alias("o")).collect()
    for r in got:
        t = TRICKY[r["i"]]
        assert r["p"] == _python_form(t), t
        assert r["k"] == re.findall(r"(?u)\b\w[\w_]+\b", t), t
        assert r["q"] == len(re.findall(K.P_QUOTED, t)), t
        if t.isascii() or "٣" not in t:
            found = re.findall(K.P_HTTP_STATUS, t)
            assert r["s"] == (found[0] if found else ""), t
            found = re.findall(K.P_TIMEOUT, t)
            assert r["o"] == (found[0] if found else ""), t


def test_two_passes_equal_lower_of_one(spark):
    df = spark.createDataFrame([(t,) for t in TRICKY], "t string")
    rows = df.select("t", vector_text(F.col("t")).alias("v")).collect()
    for r in rows:
        assert r["v"] == _python_form(_python_form(r["t"])), r["t"]


def test_grams(spark):
    df = spark.createDataFrame([("one two three",), ("one",), ("",), (None,)], "t string")
    got = [r["g"] for r in with_grams(df, "t", "g").collect()]
    assert got == [["one", "two", "three", "one two", "two three"], ["one"], [], []]
    assert df.select(grams(F.array(F.lit("a"), F.lit("b")))).first()[0] == ["a", "b", "a b"]


def test_clean_text(spark):
    df = spark.createDataFrame([(" 　a b\x1f",), (None,), ("\t",)], "t string")
    assert [r[0] for r in df.select(clean_text(F.col("t"))).collect()] == ["a b", "", ""]


COUNTED = [
    "1.5.5 rows", "12.34x 5 row6 rows", "5%7%", "007 s", "9s9s 9sx 9 s", "1.2.3%", "12 columnsx", "3 seconds4 sec 5secs",
    "a1 keys", "1" * 40 + " duplicates", "1 2 3 rows", "1.", ".5 s", "12 34s", "",
]


def test_numbers_are_found_as_from_any_place(spark):
    df = spark.createDataFrame(list(enumerate(COUNTED)), "i int, t string")
    got = df.select(
        "i", F.regexp_count("t", F.lit(unicode_aware(K.P_COUNTED))).alias("n"),
        F.regexp_extract("t", unicode_aware(K.P_TIMEOUT), 1).alias("s")).collect()
    for r in got:
        t = COUNTED[r["i"]]
        assert r["n"] == len(re.findall(K.P_COUNTED, t)), t
        assert r["s"] == (re.findall(K.P_TIMEOUT, t) or [""])[0], t


def test_long_runs_of_digits_are_read_once(spark):
    df = spark.createDataFrame([("1" * 200_000 + "x",)], "t string")
    for pattern in (K.P_COUNTED, K.P_TIMEOUT):
        began = time.time()
        assert df.select(F.regexp_count("t", F.lit(unicode_aware(pattern)))).first()[0] == 0
        assert time.time() - began < 10


def test_words_and_line_breaks(spark):
    texts = ["one two", "a\t\tb c", "a\r\nb\rc\x85d e", "x\x0by\x1cz\n", "größe ü", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", words_between_spaces(F.col("t")).alias("w"), F.split("t", SPACES).alias("v"),
                    line_breaks(F.col("t")).alias("n"), F.regexp_count("t", F.lit(LINE_BREAK)).alias("m")).collect()
    assert all(r["w"] == r["v"] and r["n"] == r["m"] for r in got)
    assert [r["n"] for r in got] == [0, 0, 4, 3, 0, 0]
