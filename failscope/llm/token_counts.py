"""Token counts of whole texts; huge documents are counted in overlapping chunks.

A text of up to ``chunk_chars`` characters is encoded whole. A longer one is cut into chunks
that share ``overlap_chars`` with their neighbours, so that its work spreads over tasks. Two
neighbours are spliced at a place in the overlap where both begin a token and which is proven
stable. For sentencepiece that proof is the vocabulary: a space after another character can
begin a piece but no piece holds one further in, and no merge crosses it, so the pieces on
either side do not depend on what lies beyond. For a ``tokenizers`` file the offsets of both
chunks must begin a pre-token at the place, after a letter and before a space. Where an
overlap shows no such place, the document goes to the next round with twice the overlap, and
chunks as long again; at the end it is encoded whole. Rounds stop when no document is left.

Null texts are empty and have no bytes and no tokens. Repeated rows each get a row. Only the
id and text columns are read.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from failscope.llm.common import counted, saved, tokenizer_path

#: Characters handed to the library at a time.
BATCH_CHARS = 1 << 20


class PieceCounter:
    """Whole-text counts and token places by a sentencepiece model."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        inside = [p for p in pieces if "▁" in p.lstrip("▁")]
        #: Pieces with a space after another character would make no place stable.
        self.stable = not inside

    def counts(self, texts: list[str]) -> list[int]:
        return [len(ids) for ids in self.model.encode(texts, num_threads=1)]

    def places(self, text: str, spaced: bool) -> tuple[np.ndarray, int]:
        """Where in ``text`` tokens begin, and how many tokens there are.

        ``spaced``: the text follows a space, which the library's own leading space stands
        for, so a chunk begins as it would in the whole text.
        """
        found = self.model.encode(text, return_type="proto").pieces
        at = np.fromiter((p.begin for p in found), np.int64, len(found))  # in bytes
        first = (np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80
        return np.append(0, np.cumsum(first))[at], len(found)


class FastCounter:
    """The same by a ``tokenizers`` file."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.stable = self.model.pre_tokenizer is not None

    def counts(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def places(self, text: str, spaced: bool) -> tuple[np.ndarray, int]:
        found = self.model.encode(text, add_special_tokens=False).offsets
        return np.fromiter((begin for begin, _ in found), np.int64, len(found)), len(found)


def counter(name: str, folder: str | None) -> PieceCounter | FastCounter:
    path = tokenizer_path(name, folder)
    return FastCounter(path) if name.endswith(".json") else PieceCounter(path)


def cut(text: str, chunk: int, overlap: int) -> list[tuple[int, int]]:
    """Spans of overlapping chunks. Each but the first begins behind a lone space after a
    letter or digit, where one is near; without one it begins where it falls."""
    spans, begin = [], 0
    while True:
        end = min(len(text), begin + chunk)
        spans.append((begin, end))
        if end == len(text):
            return spans
        begin = end - overlap
        at = text.find(" ", begin, end)
        while at >= 0 and at + 1 < end and not (
                at and text[at - 1].isalnum() and text[at + 1].isalnum()):
            at = text.find(" ", at + 1, end)
        if at >= 0 and at + 1 < end:
            begin = at + 1


def _whole(docs: DataFrame, make: Callable) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = make()
        for batch in batches:
            texts = batch.column(2).to_pylist()
            found, part, size = [], [], 0
            for text in texts:
                part.append(text)
                size += len(text)
                if size >= BATCH_CHARS:
                    found += tool.counts(part)
                    part, size = [], 0
            found += tool.counts(part) if part else []
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens"])

    return docs.select("doc_id", "n_bytes", "text").mapInArrow(
        run, "doc_id long, n_bytes long, n_tokens long")


def _chunks(docs: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """(row_id, last, no, begin, seam_to, text); ``seam_to`` ends the overlap at its start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                spans = cut(text, chunk, overlap)
                last = len(spans) - 1
                for no, (begin, end) in enumerate(spans):
                    yield pa.RecordBatch.from_pydict({
                        "row_id": [row], "last": [last], "no": [no], "begin": [begin],
                        "seam_to": [spans[no - 1][1] if no else 0],
                        "next": [spans[no + 1][0] if no < last else end],
                        "text": [text[begin:end]]})

    return docs.select("row_id", "text").mapInArrow(
        run, "row_id long, last long, no long, begin long, seam_to long, next long, text string")


def _seams(chunks: DataFrame, make: Callable) -> DataFrame:
    """Per chunk and seam: the stable token places there, and the tokens before each.

    A chunk has a row for the seam at its start (side 1) and one for that at its end (side 0);
    ``total`` is on the row of its end, ``places`` are characters of the whole text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = make()
        for batch in batches:
            for row, last, no, begin, seam_to, nxt, text in zip(
                    *[c.to_pylist() for c in batch.columns]):
                at, total = tool.places(text, no > 0)
                letters = [p for p in range(len(at)) if tool.stable and 0 < at[p] < len(text)
                           and text[at[p]] == " " and text[at[p] - 1].isalnum()
                           and (at[p] + begin < seam_to or at[p] + begin >= nxt)]
                ranks = np.asarray(letters, np.int64)
                places = at[ranks] + begin if len(ranks) else ranks
                left, right = places < seam_to, places >= nxt
                yield pa.RecordBatch.from_pydict({
                    "row_id": [row, row], "last": [last, last], "seam": [no, no + 1],
                    "side": [1, 0], "total": [0, total],
                    "places": [places[left].tolist(), places[right].tolist()],
                    "before": [ranks[left].tolist(), ranks[right].tolist()]},
                    schema=pa.schema([
                        ("row_id", pa.int64()), ("last", pa.int64()), ("seam", pa.int64()),
                        ("side", pa.int64()), ("total", pa.int64()),
                        ("places", pa.list_(pa.int64())), ("before", pa.list_(pa.int64()))]))

    return chunks.mapInArrow(run, (
        "row_id long, last long, seam long, side long, total long, places array<long>, "
        "before array<long>"))


def _spliced(seams: DataFrame) -> DataFrame:
    """(row_id, n_tokens) of long documents; null where a seam has no common stable place."""
    a, b = seams.where("side = 0").alias("a"), seams.where("side = 1").alias("b")
    both = a.join(b, (F.col("a.row_id") == F.col("b.row_id")) & (
        F.col("a.seam") == F.col("b.seam")), "left")
    place = F.get(F.array_intersect("a.places", "b.places"), 0)
    ahead = F.get(F.col("a.before"), F.array_position("a.places", place).cast("int") - 1)
    behind = F.get(F.col("b.before"), F.array_position("b.places", place).cast("int") - 1)
    # the left chunk counts up to the place, the right one from it on
    part: Column = F.when(F.col("a.seam") == F.col("a.last") + 1, F.col("a.total")).otherwise(
        ahead - behind)
    return both.select(F.col("a.row_id").alias("row_id"), part.alias("part")).groupBy("row_id").agg(
        F.when(F.count("part") == F.count(F.lit(1)), F.sum("part")).alias("n_tokens"))


def token_counts(docs: DataFrame, model: str = "piece_bpe_32k.model", folder: str | None = None,
                 limit: int = 4096, chunk_chars: int = 65_536,
                 overlap_chars: int = 1_024) -> DataFrame:
    """A row per document: doc_id, n_bytes, n_tokens, over_limit (n_tokens > ``limit``)."""

    def make() -> PieceCounter | FastCounter:
        return counter(model, folder)

    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    short = F.char_length("text") <= chunk_chars
    done = _whole(rows.where(short), make)
    long_, n_long = counted(rows.where(~short).select(
        F.monotonically_increasing_id().alias("row_id"), "*"), "long-texts")
    chunk, overlap, left = chunk_chars, overlap_chars, long_
    while n_long:
        chunks = _chunks(left, chunk, overlap).repartition("row_id", "no")
        counts = saved(_spliced(saved(_seams(chunks, make), "seams")), "spliced")
        done = done.union(counts.where("n_tokens IS NOT NULL").join(long_, "row_id").select(
            "doc_id", "n_bytes", "n_tokens"))
        failed = counts.where("n_tokens IS NULL").select("row_id")
        chunk, overlap = 2 * chunk, 2 * overlap
        left = long_.join(failed, "row_id", "left_semi")
        fits = F.char_length("text") <= chunk
        done = done.union(_whole(left.where(fits), make))
        left, n_long = counted(left.where(~fits), "long-texts")
    return done.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
