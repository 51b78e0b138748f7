"""Merkle witnesses, SimHash links and hard negatives against brute force."""

from __future__ import annotations

import math
import random
import zlib
from hashlib import sha256
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from failscope.llm.components import components
from failscope.llm import hard_negatives as hard_negatives_module
from failscope.llm.common import tiles
from failscope.llm.hard_negatives import best, hard_negatives, merged, multiply, scores
from failscope.llm.merkle import manifest, verify
from failscope.llm.queries import ORACLES, QUERIES
from failscope.llm.simhash import fingerprint, links, simhash_duplicates
from tests.llm.cases import prose, table
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_merkle_manifest", "op13_hard_negatives"])
def test_query_equals_its_sql(spark, name):
    assert compare(QUERIES[name](spark, SF), connect(SF), ORACLES[name]) == []


# -- Merkle ------------------------------------------------------------------------------------

DOCS = "doc_id long, source string, lang string, n_chars long, text string, witness string, place int, root int"


def hashed(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def plain_tree(leaves: list[str]) -> tuple[str, list[list[tuple[str, str]]]]:
    """The root, and for each leaf the siblings (left, right) on each level."""
    level, at = leaves, list(range(len(leaves)))
    proofs: list[list] = [[] for _ in leaves]
    while len(level) > 1:
        for i, place in enumerate(at):
            low = place // 8 * 8
            proofs[i].append(("".join(level[low:place]), "".join(level[place + 1: low + 8])))
        level = [hashed(*level[i: i + 8]) for i in range(0, len(level), 8)]
        at = [place // 8 for place in at]
    return level[0], proofs


def expected_manifest(rows: list[tuple]) -> list[tuple]:
    def leaf(row, text):
        fields = [row[0], row[1], row[2], row[3], text]
        return hashed(*["-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields])

    def lowered(text):
        return text.encode().lower().decode() if text is not None else None

    branches: dict = {}
    for row in rows:
        tampered = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0
        item = (row[0], leaf(row, row[4]), leaf(row, lowered(row[4]) if tampered else row[4]))
        branches.setdefault(row[2], []).append(item)
    order = sorted(branches, key=lambda b: (b is not None, (b or "").encode()))
    trees = {}
    for b in order:
        branches[b].sort(key=lambda i: (i[0] is not None, i[0] or 0, i[1]))
        trees[b] = plain_tree([i[1] for i in branches[b]])
    root, tops = plain_tree([trees[b][0] for b in order])
    out = []
    for b, top in zip(order, tops):
        subroot, proofs = trees[b]
        for (doc, own, changed), proof in zip(branches[b], proofs):
            siblings = [*proof, *top]
            folded = changed
            for left, right in siblings:
                folded = hashed(left, folded, right)
            out.append((doc, own, subroot, root, hashed(*[x + y for x, y in siblings]), folded, folded == root))
    return sorted(out, key=str)


def check_manifest(spark, rows, levels):
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], DOCS)
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.translate(
        "text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    got = verify(manifest(docs, tampered, levels=levels)).select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    assert sorted(map(tuple, got.collect()), key=str) == expected_manifest(rows)


def test_witnesses_of_branches_of_all_sizes(spark):
    sizes = {"a": 1, "b": 8, "c": 9, "d": 64, "e": 65, "hot": 700, None: 3, "É": 2, "": 1, "-": 1, "+": 7}
    rows, doc = [], 0
    for lang, size in sizes.items():
        for i in range(size):
            rows.append((doc * 7 % 10_007, f"s{i % 3}", lang, i, f"Text {i} É"))
            doc += 1
    random.Random(3).shuffle(rows)
    check_manifest(spark, rows, 1)
    check_manifest(spark, rows, 3)


def test_awkward_rows_of_the_manifest(spark):
    rows = [(None, None, None, None, None), (None, "", "", 0, ""), (5, "s", "en", 1, "A b"), (5, "s", "en", 1, "A b"),
            (5, "s", "en", 1, "other"), (6, None, "en", None, None), (0, "s", "en", -3, "X" * 200_000),
            (-9, "s", "en", 2, "1:x-"), (None, "s", "en", 4, "No id")]
    check_manifest(spark, rows, 3)
    assert manifest(spark.createDataFrame([], DOCS)).count() == 0


def test_each_tampered_text_is_told(spark):
    rows = [(i, "s", "en", 1, "Upper" if i % 2 else "lower") for i in range(90)]
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], DOCS)
    got = verify(manifest(docs, F.lower("text"), levels=1)).collect()
    assert {r.doc_id for r in got if not r.verified} == {i for i in range(90) if i % 2}


# -- SimHash -----------------------------------------------------------------------------------

def plain_fingerprint(text: str | None) -> int:
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for space in "\t\n\x0b\x0c\r":
        words = words.replace(space, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i: i + 3]).encode(), 42)
              for i in range(max(len(words) - 2, 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def joined(nodes, pairs) -> dict:
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_fingerprints_and_components_of_awkward_rows(spark):
    data = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "ONE"), (6, "two words"), (7, prose(1, 300)),
            (8, prose(1, 300)), (9, prose(1, 300) + " x"), (9, prose(2, 40)), (None, prose(1, 300)), (None, None),
            (10, prose(3, 90_000)), (11, "a\x1cb c d é"), (12, "a\x1cB\x0bc\x0cd é"), (13, "x" * 70_000)]
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash_duplicates(
        table(spark, data)).collect()), key=str)
    rows = [(doc, plain_fingerprint(text)) for doc, text in data]
    known = [(doc, mark) for doc, mark in rows if doc is not None]
    marks = sorted({mark for _, mark in known})
    roots = joined(marks, [(a, b) for a, b in combinations(marks, 2) if (a ^ b).bit_count() <= 2])
    least = {}
    for doc, mark in known:
        least[roots[mark]] = min(doc, least.get(roots[mark], doc))
    want = [(doc, f"{mark:016x}", None if doc is None else least[roots[mark]]) for doc, mark in rows]
    assert got == sorted(want, key=str)
    assert simhash_duplicates(table(spark, [])).count() == 0


def test_chunks_of_long_texts_give_one_fingerprint():
    text = prose(5, 70_000)
    assert fingerprint(text.encode()) == plain_fingerprint(text)


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_links_connect_what_all_pairs_connect(spark, radius):
    rng = random.Random(radius)
    marks = set()
    for _ in range(12):  # chains and clouds of near fingerprints, top bit included
        mark = rng.getrandbits(64)
        for _ in range(12):
            marks.add(mark)
            for bit in rng.sample(range(64), rng.randint(1, 4)):
                mark ^= 1 << bit
    signed = sorted(m - (1 << 64) if m >> 63 else m for m in marks)
    found = links(spark.createDataFrame([(m,) for m in signed], "mark long"), radius).collect()
    assert all((r.x ^ r.y) % (1 << 64) and ((r.x ^ r.y) % (1 << 64)).bit_count() <= radius for r in found)
    pairs = [(a, b) for a, b in combinations(signed, 2) if ((a ^ b) % (1 << 64)).bit_count() <= radius]
    assert joined(signed, [(r.x, r.y) for r in found]) == joined(signed, pairs)


def test_components_of_paths_rings_and_hubs(spark):
    edges = [(i, i + 1) for i in range(400)]  # in order: the slowest case for least neighbours
    edges += [(1000 + i, 1000 + (i + 1) % 50) for i in range(50)]
    edges += [(5000, 5001 + i) for i in range(300)] + [(9, 9), (7001, 7000), (7000, 7001)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "x long, y long")).collect()}
    nodes = {n for e in edges if e[0] != e[1] for n in e}
    assert got == joined(nodes, [e for e in edges])
    assert components(spark.createDataFrame([], "x long, y long")).count() == 0


# -- Hard negatives ----------------------------------------------------------------------------

@pytest.mark.parametrize("shape", [(1, 1, 1), (3, 5, 7), (33, 64, 65), (70, 101, 67), (0, 4, 5), (4, 0, 5)])
def test_products_equal_plain_ones(shape):
    m, k, n = shape
    rng = np.random.default_rng(m * 100 + n)
    a = rng.integers(-(1 << 20), 1 << 20, (m, k))
    b = rng.integers(-(1 << 20), 1 << 20, (n, k))
    for leaf in (1, 2, 16):
        assert np.array_equal(multiply(a, b, leaf), a @ b.T)
        assert np.array_equal(multiply(a.astype(object), b.astype(object), leaf), a.astype(object) @ b.T.astype(object))


def test_scores_beyond_a_long_are_cut():
    got = scores(np.array([[2.0**40, 1.0], [1.0, 0.0]]), np.array([[2.0**40, 3.0], [-(2.0**41), 5.0]]))
    assert got.tolist() == [[(1 << 63) - 1, -(1 << 63) + 2], [1 << 40, -(1 << 41)]]


def test_heaps_merge_like_one(spark=None):
    rng = np.random.default_rng(1)
    values, allowed = rng.integers(-3, 3, (20, 90)), rng.random((20, 90)) < 0.2
    ids = np.arange(90) * 3 - 40
    whole = best(values, allowed, ids, 4)
    parts = [best(values[:, i: i + 30], allowed[:, i: i + 30], ids[i: i + 30], 4) for i in (30, 0, 60)]
    top, owner = merged(merged(parts[0], parts[1]), parts[2])
    real = top > -((1 << 63) - 1)
    assert np.array_equal(top, whole[0]) and np.array_equal(owner[real], whole[1][real])


def plain_negatives(rows, positives, negatives, low, high, scale, every):
    usable = [(v, lab, [math.floor(scale * x) for x in e]) for v, lab, e in rows if None not in (v, lab) and e is not None
              and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for a, lab, e in usable:
        if a % every:
            continue
        scored = [(-sum(x * y for x, y in zip(e, f)), c, other) for c, other, f in usable if c != a]
        near = sorted((s, c) for s, c, other in scored if other == lab)[:positives]
        for place, (s, p) in enumerate(near, 1):
            inside = sorted((t, c) for t, c, other in scored if other != lab and low * -s <= 100 * -t <= high * -s)
            out += [(a, p, place, -s, rank, c, -t) for rank, (t, c) in enumerate(inside[:negatives], 1)]
    return sorted(out)


def test_hard_negatives_equal_brute_force(spark):
    rng = random.Random(7)
    rows = [(i, rng.choice([0, 0, 0, 1, 2]), [rng.choice([-0.5, 0.0, 0.26, 0.5, 0.75]) for _ in range(5)]) for i in range(300)]
    rows += [(400, 0, [1.0, 2.0]), (401, 1, []), (402, None, [1.0]), (None, 1, [1.0]), (404, 1, None), (405, 1, [1.0, None]),
             (406, 1, [math.nan]), (407, 1, [math.inf]), (-50, 1, [0.5, 0.5, 0.5]), (50, 1, [0.5] * 5), (60, 1, [0.5] * 5),
             (60, 1, [0.5] * 5), (450, 9, [0.3] * 5), (500, 2, [0.0] * 5)]
    schema = "vec_id long, label int, embedding array<double>, row string, score string, place string, slot string, kind int"
    frame = spark.createDataFrame([(*r, None, None, None, None, None) for r in rows], schema)
    got = hard_negatives(frame, every=10, scale=8, block_rows=37, block_anchors=5)
    got = sorted(map(tuple, got.select("anchor_id", "positive_id", "positive_rank", "positive_score", "rank",
                                       "negative_id", "negative_score").collect()))
    assert got == plain_negatives(rows, 5, 3, 50, 95, 8, 10)
    assert len(got) > 200
    assert hard_negatives(frame.limit(0)).count() == 0


def test_anchor_blocks_are_paired_in_tasks_not_by_broadcast(spark, monkeypatch):
    plans = []

    def seen(*sides):
        plans.append(tiles(*sides))
        return plans[-1]

    monkeypatch.setattr(hard_negatives_module, "tiles", seen)
    frame = spark.range(400).selectExpr(
        "id AS vec_id", "id % 3 AS label", "array(cast(id % 7 AS float), 1f) AS embedding")
    assert hard_negatives(frame, every=10, block_rows=20, block_anchors=2).count() > 0
    texts = [p._jdf.queryExecution().toString() for p in plans]
    assert len(texts) == 2 and all("CartesianProduct" in t and "Broadcast" not in t for t in texts)
