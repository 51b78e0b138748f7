"""Small tables with the awkward rows that every operator must handle."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

CLASHING = ("row_id n_words words key pos hash line line_no ha hb drop label cid node n kept score "
            "text_sha256 sampled_id block frame").split()


def prose(seed: int, words: int) -> str:
    rng = random.Random(seed)
    parts = "ar bel con dis el fra gon hu ira jo kel lum".split()
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(words))


def rows() -> list[tuple]:
    base = prose(1, 120)
    return [
        (1, None), (2, ""), (3, "  \n\t "), (4, "one"), (5, "two words"), (6, base), (7, base),
        (8, base.replace(" ", "\n", 3)), (9, prose(2, 30_000)), (9, prose(2, 30_000)),
        (10, prose(3, 200) + "\n" + prose(4, 25)), (11, base + " tail"), (None, prose(5, 60)),
        (None, None), (12, "É é Σίγμα 日本 ▁ \x1c a\x00b 😀 <|endoftext|>"), (13, "x" * 70_000),
        (14, base.upper()),
    ]


def table(spark: SparkSession, data: list[tuple] | None = None) -> DataFrame:
    """(doc_id, text) and columns whose names operators might use themselves."""
    data = rows() if data is None else data
    schema = "doc_id long, text string, " + ", ".join(f"{c} string" for c in CLASHING)
    return spark.createDataFrame([(*r, *[None] * len(CLASHING)) for r in data], schema)
