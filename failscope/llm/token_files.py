"""Token ids as compressed binary files with one shared zstandard dictionary.

Every document is tokenised once, its ids (with an end id) are serialised as little-endian
numbers of 16 or 32 bits and compressed as a frame of its own against a shared dictionary. The
dictionary is trained on a bounded sample of serialised id arrays and stored beside the data;
every block carries its hash, and a reader refuses frames of another dictionary.

A store is a folder that Spark writes and commits, so lost executors leave no half files:

* ``dictionary``: one row (dictionary_id, dictionary),
* ``blocks``: in ascending doc_id order, rows of up to ``block_bytes`` of frames back to back
  (``payload``) with their offset index (doc_id, offset and count arrays). The index is columns
  of their own, so the position of a document is found without reading payloads, and one
  document is read by slicing one frame out of one block.

Ids are compressed before the sort by doc_id, so the shuffle moves frames and not texts. A
null text is an empty one: its only id is the end id. Rows without an id come first; repeated
rows are each stored. Only the id and text columns are read.

The tokenizer never joins characters across white space, and its word pattern never joins
letters with other characters, so the ids of a text are those of its words in order. Every
distinct word, or part of a word, goes to the tokenizers library once per worker and cache
filling; the caches are cleared at a fixed number of words, which only costs time.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from failscope.llm.common import counted, sampled, saved, small, tokenizer_path
from failscope.session import new_path

CACHED_WORDS = 400_000
#: Letters that composing leaves alone and that have one lower case each: ASCII and the
#: accented letters from U+00C0 to U+017E, without the dotted capital I and the n after a quote.
_LETTER = "a-z\u00df-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u017e"
_PLAIN = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u017e]+")
_WORD_PARTS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[0-9]|[^\\s{_LETTER}0-9]+")
_ODD_SPACE = re.compile("[\x1c-\x1f]")


def train_dictionary(samples: list[bytes], size: int = 65_536) -> bytes:
    """A zstandard dictionary of the samples; empty if they are too few to train one."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def dictionary_hash(dictionary: bytes) -> int:
    return zlib.crc32(dictionary)


def _compressor(dictionary: bytes):
    d = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdCompressor(level=3, dict_data=d, write_dict_id=False)


def _decompressor(dictionary: bytes):
    d = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdDecompressor(dict_data=d)


class WordEncoder:
    """Serialised ids of whole texts by a ``tokenizers`` file that splits at white space."""

    def __init__(self, name: str, folder: str | None = None, kind: str = "<u2") -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(tokenizer_path(name, folder))
        self.kind = kind
        self.model = self.tokenizer.model
        self.to_bytes = ByteLevel(add_prefix_space=False, use_regex=False)
        self.size = np.dtype(kind).itemsize
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def _library(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.asarray(e.ids, self.kind).tobytes() for e in found]

    def _library_part(self, part: str) -> bytes:
        """Ids of what the tokenizer's pattern keeps in one piece: straight to its model."""
        if not part.isascii():
            part = self.to_bytes.pre_tokenize_str(part)[0][0]
        return b"".join([t.id.to_bytes(self.size, "little") for t in self.model.tokenize(part)])

    def _learn(self, new: list[str]) -> None:
        """Plain words go by their parts, which repeat more often than words do."""
        split = {}
        whole = []
        for word in new:
            if _PLAIN.fullmatch(word) and "<|" not in word:
                split[word] = _WORD_PARTS.findall(word.lower())
            else:
                whole.append(word)
        missing = list({p for parts in split.values() for p in parts if p not in self.parts})
        if len(self.parts) + len(missing) > CACHED_WORDS:
            self.parts = {}
            missing = list({p for parts in split.values() for p in parts})
        for part in missing:
            self.parts[part] = self._library_part(part)
        for word, parts in split.items():
            self.words[word] = b"".join([self.parts[p] for p in parts])
        self.words.update(zip(whole, self._library(whole)))

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        for text in texts:
            if _ODD_SPACE.search(text):  # white space to split(), but not to the tokenizer
                yield self._library([text])[0]
                continue
            words = text.split()
            try:
                yield b"".join([self.words[w] for w in words])
                continue
            except KeyError:
                if len(self.words) > CACHED_WORDS:
                    self.words = {}
            self._learn(list({w for w in words if w not in self.words}))
            yield b"".join([self.words[w] for w in words])


@cache
def _encoder(name: str, folder: str | None, kind: str) -> WordEncoder:
    """One for each worker process, so that its caches outlast a task."""
    return WordEncoder(name, folder, kind)


def _frames(docs: DataFrame, name: str, folder: str | None, end_id: int, kind: str,
            dictionary: bytes | None) -> DataFrame:
    """(doc_id, n_tokens, frame); the frame is the plain ids without a ``dictionary``."""
    tail = np.asarray([end_id], kind).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(name, folder, kind)
        pack = None if dictionary is None else _compressor(dictionary).compress
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column(1).fill_null("").to_pylist()
                ids = [raw + tail for raw in encoder.encode(texts)]
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array([len(x) // len(tail) for x in ids], pa.int64()),
                    pa.array(ids if pack is None else [pack(x) for x in ids], pa.binary())],
                    names=["doc_id", "n_tokens", "frame"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n_tokens long, frame binary")


def _pack(block_bytes: int, block_docs: int, dictionary_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, counts, offsets, frames, size = [], [], [], [], 0

        def block() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([
                pa.array([dictionary_id], pa.int64()), pa.array([b"".join(frames)], pa.binary()),
                pa.array([ids], pa.list_(pa.int64())), pa.array([offsets], pa.list_(pa.int64())),
                pa.array([counts], pa.list_(pa.int64())), pa.array([sum(counts)], pa.int64())],
                names=["dictionary_id", "payload", "doc_ids", "offsets", "counts", "n_tokens"])

        for batch in batches:
            for doc, count, frame in zip(*[c.to_pylist() for c in batch.columns]):
                ids.append(doc)
                counts.append(count)
                offsets.append(size)
                frames.append(frame)
                size += len(frame)
                if size >= block_bytes or len(ids) >= block_docs:
                    yield block()
                    ids, counts, offsets, frames, size = [], [], [], [], 0
        if ids:
            yield block()

    return run


_BLOCK = ("dictionary_id long, payload binary, doc_ids array<long>, offsets array<long>, "
          "counts array<long>, n_tokens long")
_STORED = _BLOCK + ", partition int, block long"


def write_tokens(docs: DataFrame, path: str, tokenizer: str = "word_bpe_49k.json",
                 tokenizer_folder: str | None = None, end_id: int = 1, kind: str = "<u2",
                 sample_docs: int = 2_000, sample_bytes: int = 8_192,
                 block_bytes: int = 1 << 20, block_docs: int = 4_096) -> None:
    """Write the ids of every document to a store at ``path``, in ascending doc_id order.

    ``kind`` is the numpy type of an id: "<u2" for vocabularies of up to 65,536 ids, else
    "<u4". The dictionary is trained on the first ``sample_bytes`` of the ids of
    ``sample_docs`` documents, chosen by a hash of the id; everything else covers all rows.
    """
    spark = docs.sparkSession
    sample = sampled(docs.select(
        "doc_id", F.substring("text", 1, sample_bytes).alias("text")), sample_docs)
    plain = _frames(sample, tokenizer, tokenizer_folder, end_id, kind, None)
    dictionary = train_dictionary([r[0][:sample_bytes] for r in plain.select("frame").collect()])
    number = dictionary_hash(dictionary)
    spark.createDataFrame(
        [(number, bytearray(dictionary))], "dictionary_id long, dictionary binary"
    ).write.parquet(f"{path}/dictionary")
    frames = saved(_frames(docs, tokenizer, tokenizer_folder, end_id, kind, dictionary), "frames")
    ordered = frames.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "n_tokens", "frame")
    blocks = ordered.mapInArrow(_pack(block_bytes, block_docs, number), _BLOCK)
    blocks.select("*", F.spark_partition_id().alias("partition"),
                  F.monotonically_increasing_id().alias("block")).write.option(
        "compression", "none").parquet(f"{path}/blocks")


def _blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_STORED).parquet(f"{path}/blocks")


def read_dictionary(spark: SparkSession, path: str) -> bytes:
    row = spark.read.parquet(f"{path}/dictionary").first()
    dictionary = bytes(row["dictionary"])
    if dictionary_hash(dictionary) != row["dictionary_id"]:
        raise ValueError("the stored dictionary is damaged")
    return dictionary


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, block, offset, length, n_tokens) of every document; no payload is read.

    The length is null for a block's last frame, which goes to the payload's end.
    """
    spans = F.arrays_zip("doc_ids", "offsets", "counts")
    rows = _blocks(spark, path).select(
        "block", "offsets", F.posexplode(spans).alias("at", "span"))
    return rows.select(
        F.col("span.doc_ids").alias("doc_id"), "block", F.col("span.offsets").alias("offset"),
        (F.get("offsets", F.col("at") + 1) - F.col("span.offsets")).alias("length"),
        F.col("span.counts").alias("n_tokens"))


def read_document(spark: SparkSession, path: str, doc_id: int, kind: str = "<u2") -> list[int]:
    """The ids of one document: one index look-up, one block, one frame."""
    place = read_index(spark, path).where(F.col("doc_id") == doc_id).first()
    if place is None:
        raise KeyError(doc_id)
    size = place["length"] if place["length"] is not None else F.length("payload")
    row = _blocks(spark, path).where(F.col("block") == place["block"]).select(
        "dictionary_id", F.substring("payload", place["offset"] + 1, size).alias("frame")).first()
    dictionary = read_dictionary(spark, path)
    if row["dictionary_id"] != dictionary_hash(dictionary):
        raise ValueError("the block belongs to another dictionary")
    return np.frombuffer(_decompressor(dictionary).decompress(bytes(row["frame"])), kind).tolist()


def read_tokens(spark: SparkSession, path: str, kind: str = "<u2") -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of every document, from the files.

    ``start`` counts the ids of all documents before it. ``ids`` is binary: little-endian
    unsigned 32-bit numbers.
    """
    dictionary = read_dictionary(spark, path)
    number = dictionary_hash(dictionary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = _decompressor(dictionary)
        for batch in batches:
            for part, owner, payload, docs, offsets, block in zip(
                    *[batch.column(i) for i in range(6)]):
                if owner.as_py() != number:
                    raise ValueError("the block belongs to another dictionary")
                whole = memoryview(payload.as_buffer())
                ends = offsets.as_py()
                ends.append(len(whole))
                start, out = block.as_py(), []
                for k, doc in enumerate(docs.as_py()):
                    ids = np.frombuffer(unpack.decompress(whole[ends[k]: ends[k + 1]]), kind)
                    raw = ids.astype("<u4").tobytes()
                    out.append((doc, part.as_py(), start, len(ids), zlib.crc32(raw), raw))
                    start += len(ids)
                yield pa.RecordBatch.from_arrays([
                    pa.array(column, kinds) for column, kinds in zip(zip(*out), (
                        pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))],
                    names=["doc_id", "partition", "start", "n_tokens", "ids_crc32", "ids"])

    blocks = _blocks(spark, path)
    totals = blocks.groupBy("partition").agg(F.sum("n_tokens").alias("n"))
    before = totals.select("partition", F.coalesce(F.sum("n").over(Window.orderBy(
        "partition").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = blocks.select("partition", "block", "n_tokens").select(
        "block", "partition", F.coalesce(F.sum("n_tokens").over(Window.partitionBy(
            "partition").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0)).alias("inside"))
    starts, n_blocks = counted(inside.join(before, "partition").select(
        "block", (F.col("inside") + F.col("before")).alias("first")), "block-starts")
    rows = blocks.select("partition", "block", "dictionary_id", "payload", "doc_ids", "offsets").join(
        small(starts, n_blocks), "block")
    return rows.select("partition", "dictionary_id", "payload", "doc_ids", "offsets", "first").mapInArrow(
        run, "doc_id long, partition int, start long, n_tokens long, ids_crc32 long, ids binary"
    ).drop("partition")


def token_files(docs: DataFrame, **options) -> DataFrame:
    """Write the documents' ids to a store and return what its files hold, without the ids."""
    path = new_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, **options)
    return read_tokens(docs.sparkSession, path, options.get("kind", "<u2")).drop("ids")
