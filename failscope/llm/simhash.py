"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A text's words are what lies between ASCII white space, after lower-casing A-Z; its shingles,
repeats included, are ``words`` consecutive ones joined by single spaces (the whole sequence if
it is shorter). A bit of the 64-bit fingerprint is 1 if it is set in more than half of the
shingles' XXH64 hashes.

Fingerprints link if they differ in at most ``radius`` bits. Two that do meet at a fingerprint
half way: at most ``radius // 2`` bits from one and ``radius - radius // 2`` from the other. So
every distinct fingerprint emits all variants within the larger half, and variants are the key
of one shuffle. A variant gathers at most the size of that
ball (65 fingerprints for a radius of 2), however many documents there are, since copies have
been merged before. Whoever meets at a variant at the smaller half's distance is linked to all
that meet there, so a star around the least of them connects the same as all pairs; colliding
pairs are deduplicated and verified before they count. Components are found by contraction.

Defined results: null and wordless texts have the fingerprint 0 and link like any other. Rows
without an id have a fingerprint, but take no part in links and have no component. Rows that
share an id are decided on by their own text. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from failscope.llm.common import saved
from failscope.llm.components import components

SEED = 42
#: Shingles hashed at once.
CHUNK = 1 << 15


def fingerprint(text: bytes | None, words: int = 3) -> int:
    """The unsigned fingerprint of a text in UTF-8."""
    import xxhash

    parts = (text or b"").lower().split()
    if not parts:
        return 0
    if len(parts) <= words:
        return xxhash.xxh64_intdigest(b" ".join(parts), SEED)
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[: -words] + 1]).tolist()
    ends = ends[words - 1:].tolist()
    n, hashed = len(ends), xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        part = [hashed(joined[a:b], SEED) for a, b in zip(starts[at: at + CHUNK], ends[at: at + CHUNK])]
        raw = np.array(part, "<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(raw, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, mark): the fingerprint's bits as a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = np.fromiter((fingerprint(raw, words) for raw in batch.column(1).cast(
                pa.binary()).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(marks.view(np.int64))], names=["doc_id", "mark"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, mark long")


def _flips(bits: int) -> list[int]:
    """All signed masks of exactly ``bits`` of 64 bits."""
    masks = (sum(1 << i for i in chosen) for chosen in combinations(range(64), bits))
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(marks: DataFrame, radius: int) -> DataFrame:
    """Verified links (x, y) that connect the distinct ``marks`` (mark) within ``radius``.

    Not all pairs within the radius: a star for each variant, which connects the same.
    """
    if not 0 <= radius <= 4:
        raise ValueError("radius must be from 0 to 4: a ball of 5 bits has over eight million variants")
    near, far = radius // 2, radius - radius // 2
    flips = F.array(*[F.lit(m).cast("long") for bits in range(far + 1) for m in _flips(bits)])
    emitted = marks.select("mark", F.explode(flips).alias("flip")).select(
        "mark", F.col("mark").bitwiseXOR(F.col("flip")).alias("variant"))
    apart = F.bit_count(F.col("mark").bitwiseXOR(F.col("variant")))
    least = F.min(F.when(apart <= near, F.col("mark"))).over(Window.partitionBy("variant"))
    pairs = emitted.withColumn("least", least).where("least IS NOT NULL AND least != mark")
    pairs = pairs.select(F.least("least", "mark").alias("x"), F.greatest("least", "mark").alias("y"))
    return pairs.distinct().where(F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= radius)


def simhash_duplicates(docs: DataFrame, words: int = 3, radius: int = 2) -> DataFrame:
    """A row per document: doc_id, fingerprint (16 hex digits), component_id (least doc_id reachable)."""
    marks = saved(fingerprints(docs, words), "fingerprints")
    classes = saved(marks.where("doc_id IS NOT NULL").groupBy("mark").agg(
        F.min("doc_id").alias("first")), "fingerprint-classes")
    roots = components(links(classes.select("mark"), radius))
    placed = classes.join(roots.withColumnRenamed("node", "mark"), "mark", "left").withColumn(
        "root", F.coalesce("root", "mark"))
    least = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    placed = saved(placed.join(least, "root").select("mark", "component_id"), "components-of-fingerprints")
    return marks.join(placed, "mark", "left").select(
        "doc_id", F.lpad(F.lower(F.hex("mark")), 16, "0").alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
