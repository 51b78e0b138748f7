"""Text expressions shared by validation, log signals and vectorisation."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from failscope import constants as K

# Every Unicode white-space character, spelled out: a plain \s is ASCII in Java.
WS_INNER = (
    r"\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
WS = f"[{WS_INNER}]"
# The same classes for Java: printable ASCII is told apart by one comparison.
_SPACE = f"[[^!-~]&&[{WS_INNER}]]"
_NOT_SPACE = f"[!-~[^{WS_INNER}]]"
SPACES = f"{_SPACE}+"
WS_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
WORD_INNER = r"0-9A-Za-z_\p{L}\p{N}"
WORD = f"[{WORD_INNER}]"
LINE_BREAK = r"\r\n|[\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"


def unicode_aware(pattern: str) -> str:
    r"""Spell out \w, \d, \s, \S and \b so that they cover all of Unicode on any JDK."""
    boundary = f"(?!{WORD})"
    if "|%|" in pattern:  # the text before the boundary may end in a non-word character
        boundary = f"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"
    if pattern.startswith(r"\b"):
        # All of these go on with a digit: testing that first skips most positions.
        pattern = rf"(?=\d)(?<!{WORD})" + pattern[2:]
    if pattern.startswith(r"(\d+"):
        # No digit may follow the digits of these, so a match begins with a run of digits and takes
        # all of it: nothing is tried again from the middle of a run, or with a part of one.
        pattern = r"(?=\d)(?<!\d)" + pattern.replace(r"\d+", r"\d++")
    return (
        pattern.replace(r"\b", boundary)
        .replace(r"[\w", f"[{WORD_INNER}")
        .replace(r"\w", WORD)
        .replace(r"\d", r"[0-9\p{Nd}]")
        .replace(r"\s", _SPACE)
        .replace(r"\S", _NOT_SPACE)
    )


def line_breaks(text: Column) -> Column:
    """How many there are; a text of printable ASCII, with none, is told by a simpler pattern."""
    return F.when(F.rlike(text, F.lit("[^ -~]")), F.regexp_count(text, F.lit(LINE_BREAK))).otherwise(0)


def words_between_spaces(text: Column) -> Column:
    """Split at runs of white space. ``split`` builds its pattern anew for each row, unless it is one
    character."""
    return F.split(F.regexp_replace(text, SPACES, " "), " ")


def stripped(text: Column) -> Column:
    """Text without leading and trailing white space (null stays null)."""
    return F.btrim(text, F.lit(WS_CHARS))


def clean_text(text: Column) -> Column:
    """Stripped text; null and blank become the empty string."""
    return F.coalesce(stripped(text), F.lit(""))


def contains_any(text: Column, words: list[str]) -> Column:
    """True where ``text`` contains at least one of ``words`` as a substring.

    One alternation: the text is scanned once and its expression appears once.
    """
    return F.rlike(text, F.lit("|".join(re.escape(word) for word in words)))


def is_error_line(content: Column) -> Column:
    return contains_any(F.lower(content), K.ERROR_LINE_WORDS)


def text_is_true(value: Column) -> Column:
    """Text to boolean: only 'true' in any letter case is true."""
    return F.coalesce(F.lower(value.cast("string")) == "true", F.lit(False))


def display_name(pipeline: Column) -> Column:
    return F.replace(F.replace(pipeline, F.lit("_pipeline"), F.lit("")), F.lit("_"), F.lit(" "))


def placeholder_text(text: Column) -> Column:
    """Lower-cased log text with paths, URLs and numbers replaced by placeholders."""
    out = F.lower(text)
    for pattern, name in K.PLACEHOLDERS:
        out = F.regexp_replace(out, unicode_aware(pattern), f" {name} ")
    return stripped(F.regexp_replace(out, SPACES, " "))


def vector_text(text: Column) -> Column:
    """Text as the vocabulary sees it: placeholders are lower-cased as well."""
    return F.lower(placeholder_text(F.coalesce(text, F.lit(""))))


def tokens(text: Column) -> Column:
    """Runs of two or more word characters, in text order."""
    return F.regexp_extract_all(text, F.lit(f"{WORD}{{2,}}"), F.lit(0))


def text_tokens(text: Column) -> Column:
    """``tokens(vector_text(text))``: runs of word characters are the same before white space
    is collapsed and placeholders lower-cased, so neither is done."""
    out = F.lower(F.coalesce(text, F.lit("")))
    for pattern, name in K.PLACEHOLDERS:
        out = F.regexp_replace(out, unicode_aware(pattern), f" {name.lower()} ")
    return tokens(out)


def token_pairs(token_array: Column, among: list[str] | None = None) -> Column:
    """All pairs of neighbours joined by a space; with ``among``, those of two such tokens."""
    n = F.size(token_array)
    if among is not None:
        token_array = F.transform(token_array, lambda t: F.when(t.isin(among), t))
    pairs = F.zip_with(
        F.slice(token_array, F.lit(1), F.greatest(n - 1, F.lit(0))),
        F.slice(token_array, F.lit(2), F.greatest(n - 1, F.lit(0))),
        lambda a, b: F.concat(a, F.lit(" "), b),
    )
    return pairs if among is None else F.filter(pairs, lambda p: p.isNotNull())


def grams(token_array: Column) -> Column:
    """All single tokens, then all pairs of neighbours joined by a space."""
    return F.concat(token_array, token_pairs(token_array))


def with_grams(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add the grams of a text column. The tokens get a column of their own: they are
    used several times, and this way they are found once."""
    found = df.withColumn("_tokens", text_tokens(F.col(text)))
    return found.withColumn(out, grams(F.col("_tokens"))).drop("_tokens")


def scenario_date(date_key: Column) -> Column:
    """Midnight UTC of a yyyyMMdd key; an unreadable key gives the default date."""
    return F.coalesce(
        F.try_to_timestamp(date_key, F.lit("yyyyMMdd")),
        F.to_timestamp(F.lit(K.SCENARIO_DEFAULT_DATE), "yyyyMMdd"),
    )
