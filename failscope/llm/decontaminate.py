"""Benchmark decontamination by a prefix-filtered set join, in DataFrame functions only.

A benchmark item becomes windows of ``window`` consecutive words (a shorter item is one
window). A window occurs in a document only if all its word shingles do, so one shingle of
each window is enough to find it: the rarest over the corpus (the prefix for a containment
of 1). Occurrences of prefix shingles give candidates; the position of the shingle in the
window and the document's length bound where the window may lie, and the words there are
compared exactly.

Documents are read once into a table of normalised words. A first pass over it counts the
items' shingles, a second finds the windows. The windows are the small side: broadcast if
their counted rows are few; else positions and shingles alone are shuffled and the words are
joined to the candidates.

Nulls and texts without words have no words and no hits. Items without words have no
windows. Items without an id, and repeated items, add nothing to the item list. Repeated
documents each get a row. Only the id and text columns are read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from failscope.llm.common import BROADCAST_ROWS, counted, saved

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BREAKS = "".join(
    chr(c) for c in range(128) if not (chr(c).isdigit() or chr(c).isalpha()))


def normalised(text: Column) -> Column:
    """ASCII-lower-cased words, joined by one space; words are what lies between breaks."""
    plain = F.translate(text, _BREAKS + _UPPER, " " * len(_BREAKS) + _UPPER.lower())
    return F.coalesce(F.trim(F.regexp_replace(plain, " +", " ")), F.lit(""))


def _split(norm: Column) -> Column:
    return F.split(norm, " ")


def _key(words: Column, at: Column, length: int) -> Column:
    """Hash of ``length`` words from position ``at`` (from 0)."""
    return F.xxhash64(F.lit(length), *[F.get(words, at + i) for i in range(length)])


def benchmark_windows(items: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """Distinct windows (win_id, n_win, win_words), and (win_id, item_id) of the items."""
    words = items.select("item_id", normalised(F.col("text")).alias("norm")).where("norm != ''")
    words = words.select("item_id", _split(F.col("norm")).alias("w"))
    wins = words.select("item_id", F.explode(F.when(
        F.size("w") <= window, F.array("w")).otherwise(F.transform(
            F.sequence(F.lit(1), F.size("w") - window + 1),
            lambda i: F.slice("w", i, window)))).alias("win_words"))
    distinct = saved(wins.select("win_words").distinct().select(
        F.monotonically_increasing_id().alias("win_id"),
        F.size("win_words").alias("n_win"), "win_words"), "windows")
    owners = wins.join(distinct, "win_words").where("item_id IS NOT NULL")
    return distinct, saved(owners.select("win_id", "item_id").distinct(), "window-items")


def _positions(words: DataFrame, lengths: list[int], *keep: str) -> DataFrame:
    """A row (…, pos, key) for each shingle of each document."""
    at = words.select("row_id", "n_words", "words", F.posexplode("words").alias("pos", "w"))
    keys = [F.when(F.col("pos") + n <= F.col("n_words"), _key(F.col("words"), F.col("pos"), n))
            for n in lengths]
    if len(keys) == 1:
        return at.select("row_id", "n_words", "pos", *keep, keys[0].alias("key")).where(
            "key IS NOT NULL")
    return at.select("row_id", "n_words", "pos", *keep, F.explode(
        F.array(*keys)).alias("key")).where("key IS NOT NULL")


def _prefixes(windows: DataFrame, words: DataFrame, lengths: list[int], shingle: int,
              limit: int) -> tuple[DataFrame, int]:
    """The rarest shingle of each window: (key, off, win_id, n_win, win_words)."""
    offs = windows.select("*", F.explode(F.sequence(
        F.lit(0), F.greatest(F.col("n_win") - shingle, F.lit(0)))).alias("off"))
    pick = F.least(F.col("n_win"), F.lit(shingle))
    key = reduce(lambda rest, n: F.when(
        pick == n, _key(F.col("win_words"), F.col("off"), n)).otherwise(rest), lengths,
        F.lit(None).cast("long"))
    parts = saved(offs.select("win_id", "off", key.alias("key")), "window-shingles")
    keys, n_keys = counted(parts.select("key").distinct(), "shingle-keys")
    found = _positions(words, lengths).select("key").join(
        F.broadcast(keys) if n_keys <= limit else keys, "key")
    often = saved(found.groupBy("key").agg(F.count(F.lit(1)).alias("often")), "shingle-counts")
    rarest = parts.join(often, "key", "left").groupBy("win_id").agg(F.min(F.struct(
        F.coalesce("often", F.lit(0)).alias("often"), "key", "off")).alias("best"))
    return counted(rarest.where("best.often > 0").select("win_id", "best.key", "best.off").join(
        windows, "win_id"), "prefixes")


def occurrences(words: DataFrame, windows: DataFrame, shingle: int = 5,
                limit: int = BROADCAST_ROWS) -> DataFrame:
    """Every place (row_id, start, n_win, win_id) of a window in a document's words."""
    lengths = [r[0] for r in windows.select(
        F.least("n_win", F.lit(shingle)).alias("n")).distinct().sort("n").collect()]
    if not lengths:
        return words.select("row_id", F.lit(0).alias("start"), F.lit(0).alias("n_win"),
                            F.lit(0).cast("long").alias("win_id")).limit(0)
    prefixes, rows = _prefixes(windows, words, lengths, shingle, limit)
    start = F.col("pos") - F.col("off")
    fits = (start >= 0) & (start + F.col("n_win") <= F.col("n_words"))
    if rows <= limit:
        near = _positions(words, lengths, "words").join(F.broadcast(prefixes), "key").where(fits)
    else:
        near = _positions(words, lengths).join(prefixes, "key").where(fits).join(
            words.select("row_id", "words"), "row_id")
    same = F.slice("words", start + 1, F.col("n_win")) == F.col("win_words")
    return near.where(same).select("row_id", start.alias("start"), "n_win", "win_id")


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, shingle: int = 5,
                  broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """A row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    table = saved(docs.select(
        F.monotonically_increasing_id().alias("row_id"), "doc_id",
        normalised(F.col("text")).alias("norm")).withColumn("n_words", F.when(
            F.col("norm") == "", 0).otherwise(F.size(_split(F.col("norm"))))), "doc-words")
    words = table.where("n_words > 0").select(
        "row_id", "n_words", _split(F.col("norm")).alias("words"))
    windows, owners = benchmark_windows(items, window)
    hits = saved(occurrences(words, windows, shingle, broadcast_rows), "hits")

    before = F.max("end").over(Window.partitionBy("row_id").orderBy("start", "end").rowsBetween(
        Window.unboundedPreceding, -1))
    spans = hits.select("row_id", "start", (F.col("start") + F.col("n_win")).alias("end"))
    new = F.col("end") - F.greatest(F.col("start"), F.coalesce("before", "start"))
    n_hit = spans.distinct().withColumn("before", before).groupBy("row_id").agg(
        F.sum(F.greatest(new, F.lit(0))).alias("n_hit"))
    found = hits.select("row_id", "win_id").distinct().join(owners, "win_id").select(
        "row_id", F.col("item_id").cast("string").alias("item")).distinct()
    listed = found.groupBy("row_id").agg(F.sort_array(F.collect_list("item")).alias("items"))
    items_of = F.coalesce("items", F.array().cast("array<string>"))
    return (
        table.select("row_id", "doc_id", "n_words")
        .join(n_hit, "row_id", "left").join(listed, "row_id", "left")
        .select(
            "doc_id", F.col("n_words").cast("long").alias("n_words"),
            F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.size(items_of).cast("long").alias("n_items"),
            F.sha2(F.array_join(items_of, ","), 256).alias("items_sha256"),
            (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated")))
