"""Quality, licences, search and pseudonyms."""

import random

import numpy as np
import pytest

from failscope.llm import exact_search as S
from failscope.llm import licences as L
from failscope.llm import pseudonyms as P
from failscope.llm import quality as Q
from tests.llm import cases


def brute_top(data, k=20):
    usable = [(i, [int(np.floor(64 * float(x))) for x in v]) for i, v in data
              if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in usable:
        if q % 20 == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in usable if i != q)[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scored, 1)]
    return sorted(out)


def test_top_k_equals_brute_force(spark):
    rng = random.Random(5)
    data = [(i, [rng.choice([0.0, rng.gauss(0, 0.2)]) for _ in range(12)]) for i in range(300)]
    data += [(1000 + i, [0.5] * 12) for i in range(60)]  # ties
    data += [(400, None), (None, [0.1] * 12), (420, [0.1, None, 0.2]), (440, [float("nan")] * 12),
             (460, [float("inf")]), (480, []), (500, [3e4] * 12), (501, [3e4] * 12), (-20, [-0.3] * 12)]
    schema = "vec_id long, embedding array<float>, slot int, ids string, rank int"
    df = spark.createDataFrame([(*r, None, None, None) for r in data], schema)
    got = S.exact_top_k(df, block_rows=50, block_queries=3)
    as_float = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in data]
    assert sorted(tuple(r) for r in got.collect()) == brute_top(as_float)
    assert S.exact_top_k(df.limit(0)).collect() == []


def test_blocks_are_paired_in_tasks_not_by_broadcast(spark):
    """The files of blocks are small, all their pairs are not."""
    df = spark.range(400).selectExpr("id AS vec_id", "array(cast(id % 7 AS float), 1f) AS embedding")
    plan = S.exact_top_k(df, block_rows=20, block_queries=2)._jdf.queryExecution().toString()
    assert "Broadcast" not in plan and "CartesianProduct" in plan


def test_winners_of_parts_are_those_of_all():
    rng = np.random.default_rng(2)
    scores, ids = rng.integers(-3, 3, (7, 30)).astype(object), np.arange(30) * 2
    scores[0, :5], scores[1, :5] = -(1 << 70), 1 << 70  # cut to the range of a long
    owners = np.arange(7) * 2
    for k in (4, 20, 40):
        there, top, found = S._winners(scores, ids, owners, k)
        some = S._winners(scores[:, :4], ids[:4], owners, k)
        for part in (slice(4, 11), slice(11, 30)):
            some = S.merged(some, S._winners(scores[:, part], ids[part], owners, k))
        assert np.array_equal(some[0], there) and there.sum() == 7 * min(k, 29)
        assert np.array_equal(some[1][there], top[there]) and np.array_equal(some[2][there], found[there])


def test_scores_stay_exact_beyond_doubles():
    big = np.array([[2.0**40, 1.0]])
    assert S.accumulate(big, big)[0, 0] == 2**80 + 1


def junk(seed):
    words = cases.prose(seed, 60).split()
    return [" ".join(w for w in words for _ in range(5)), " ".join(w.upper() + "!!" for w in words),
            " ".join(w + "$$$" for w in words), " | ".join(words)][seed % 4]


def natural(seed):
    rng = random.Random(seed)
    words = cases.prose(seed, 60).split()
    return " ".join(x for w in words for x in ([rng.choice(["the", "of", "and"]), w] if rng.random() < 0.4 else [w]))


def test_quality_tells_junk_from_text(spark):
    data = [(i, junk(i // 6) if i % 6 == 0 else natural(i)) for i in range(1_200)]
    docs = cases.table(spark, data)
    model = Q.fit(docs, sample_docs=800)
    got = {r.doc_id: r.kept for r in Q.quality(docs, model).collect()}
    assert sum(got[i] == (i % 6 != 0) for i in got) >= 0.97 * len(data)
    assert min(model.labels.accuracies()[x] for x in ("repeats", "symbols", "exclaims")) > 0.9
    kept = Q.keep_good(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i in got if got[i]}


def test_quality_agrees_with_the_labels_it_never_saw(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = Q.quality(docs, Q.fit(docs)).join(labels, "doc_id").collect()
    assert np.mean([r.kept == bool(r.quality) for r in rows]) > 0.95
    assert np.mean([r.kept for r in rows if r.quality]) > 0.98


def test_quality_of_awkward_rows(spark):
    docs = cases.table(spark)
    got = Q.quality(docs, Q.fit(docs)).collect()
    assert len(got) == len(cases.rows()) and not any(r.kept for r in got if r.doc_id in (1, 2, 3))
    empty = cases.table(spark, [])
    assert Q.quality(empty, Q.fit(empty)).collect() == []
    assert Q.quality(docs, Q.fit(cases.table(spark, [(1, None)]))).count() == len(cases.rows())


def test_quality_tells_short_junk_from_short_text(spark):
    data = [(i, natural(i)) for i in range(80)] + [(100 + i, junk(i)) for i in range(20)]
    bad = ["ndtion. | Erndnd | thndonea. |", "| x | y | 12 |", "BUY NOW!!! FREE!!! CLICK!!!", "$$$ ### @@@ %%%"]
    good = ["short one", "The cat sat on the mat.", "a walk in the park"]
    data += [(200 + i, t) for i, t in enumerate(bad)] + [(300 + i, t) for i, t in enumerate(good)]
    docs = cases.table(spark, data)
    got = {r.doc_id: r.kept for r in Q.quality(docs, Q.fit(docs)).collect()}
    assert not any(got[200 + i] for i in range(len(bad))) and all(got[300 + i] for i in range(len(good)))


def test_expectation_maximisation_recovers_accuracies():
    rng = np.random.default_rng(1)
    truth = rng.random(20_000) < 0.8
    right = np.array([0.95, 0.9, 0.85, 0.8, 0.9, 0.75, 0.7, 0.97])
    votes = np.where(rng.random((len(truth), 8)) < right, truth[:, None], ~truth[:, None]).astype(int)
    votes[rng.random(votes.shape) < 0.3] = -1
    patterns, counts = np.unique([Q._pattern(v) for v in votes], return_counts=True)
    found = Q.fit_labels(dict(zip(patterns.tolist(), counts.tolist())))
    assert np.allclose(list(found.accuracies().values()), right, atol=0.03)
    assert abs(found.high - 0.8) < 0.03


def test_licences_are_found_as_entire_texts(spark):
    data = [(1, "Some text.\nReleased under the MIT licence.\nMore."), (2, "RELEASED under the   M.I.T license"),
            (3, "// Copyright (c) 2020 Someone\n// Licensed under the Apache Licence, version 2.0"),
            (4, "It is released under the MIT License."), (5, None), (6, ""), (7, "Copyright 2020"),
            (8, "Licensed under CC BY-NC 4.0.\n\nLicensed under CC-BY-NC 4.0"), (None, "SPDX-License-Identifier: MIT"),
            (9, cases.prose(1, 20_000)), (10, "—  . * " * 5_000 + "Released under the MIT License."),
            (11, "Copyright 2020 " + cases.prose(2, 3_000) + "\n" + "Licensed under CC BY 4.0.\n" * 1), (1, "Some text.\nReleased under the MIT licence.\nMore.")]
    known = L.known_table(spark)
    got = sorted((r.doc_id or 0, tuple(r.licences)) for r in L.document_licences(cases.table(spark, data), known).collect())
    assert got == [(0, ("MIT",)), (1, ("MIT",)), (3, ("Apache-2.0",)), (8, ("CC-BY-NC-4.0",)), (10, ("MIT",)), (11, ("CC-BY-4.0",))]
    units = {(r.unit, r.at) for r in L.licence_scan(cases.table(spark, data[:1]), known).collect()}
    assert units == {("line", 1)}
    assert L.document_licences(cases.table(spark, []), known).count() == 0
    assert L.licence_scan(cases.table(spark, data), known.limit(0)).count() == 0


def test_paragraphs_part_at_any_blank_line(spark):
    notice = next(text for name, text in L.KNOWN if name == "MPL-2.0").replace(". If", ".\nIf")
    data = [(1, f"A text.\n\n{notice}\n\nMore."), (2, f"A text.\n\n{notice}\n\nMore.".replace("\n", "\r\n")),
            (3, f"A text.\n \t\n{notice}\n  \nMore."), (4, f"A text.\n{notice}\nMore.")]
    got = {(r.doc_id, r.unit, r.at, r.licence) for r in L.licence_scan(cases.table(spark, data), L.known_table(spark)).collect()}
    assert got == {(i, "paragraph", 1, "MPL-2.0") for i in (1, 2, 3)}


def test_full_licence_texts_are_found(spark):
    full = {name: text for name, text in L.known_texts() if len(text) > 400}
    assert {"MIT", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "MPL-2.0"} <= set(full)
    mit = next(text for name, text in L.known_texts() if name == "MIT" and len(text) > 400)
    wrapped = " ".join(mit.split()).replace(" COPYRIGHT HOLDERS", "\nCOPYRIGHT HOLDERS")
    data = [(1, "The MIT License (MIT)\n\nCopyright (c) 2020 Someone\n\n" + mit), (2, wrapped), (3, full["GPL-3.0"].upper()),
            (4, "# SPDX-License-Identifier: BSD-2-Clause\ncode"), (5, "a text\n\n" + " ".join(mit.split()) + "\n\nmore"),
            (6, mit.replace("free of charge", "for a charge"))]
    got = {r.doc_id: r.licences for r in L.document_licences(cases.table(spark, data), L.known_table(spark)).collect()}
    # a text of two paragraphs or more is found as a document only; one in one paragraph also as that
    assert got == {1: ["MIT"], 2: ["MIT"], 3: ["GPL-3.0"], 4: ["BSD-2-Clause"], 5: ["MIT"]}


@pytest.mark.parametrize("size", [1, 2, 3, 10, 97, 1000])
def test_permutations_are_bijections(size):
    p = P.Permutation(b"k", "x", size)
    assert sorted(p(i) for i in range(size)) == list(range(size))
    assert all(p.undo(p(i)) == i for i in range(size))


VALUES = ["4111 1111 1111 1111", "4944339490429605", "+1 (512) 555-4564", "44.161.181.40", "123-45-6789",
          "pfps.64@mail3.example.com", "2024-02-29", "29/02/2024", "GB82 WEST 1234 5698 7654 32"]
LEFT_ALONE = ["4944339490429606", "300.1.1.1", "666-12-1234", "000-12-3456", "2023-02-29", "31.11.2020",
              "GB83 WEST 1234 5698 7654 32", "+1 (112) 555-4564", "version 1.2.3.4.5", "id4944339490429605x"]


def test_formats_checks_and_links():
    tool = P.Pseudonyms(b"key")
    for value in VALUES:
        new, found = tool.replace(f"a {value}, b {value}.")
        assert len(found) == 2 and found[0][3] == found[1][3] != value
        assert len(found[0][3]) >= len(value) - 8 and tool.replace(found[0][3])[1]  # still a valid value
        assert tool.replace(new, back=True)[0] == f"a {value}, b {value}."
    for value in LEFT_ALONE:
        assert tool.replace(value) == (value, [])
    assert tool.replace("2024-02-29")[0].split("-")[0] == tool.replace("29.02.2024")[0].split(".")[2]
    assert P.Pseudonyms(b"other").replace(VALUES[1])[0] != tool.replace(VALUES[1])[0]


def test_different_values_stay_different():
    tool = P.Pseudonyms(b"key")
    cards = [b + P.luhn_digit(b) for b in (f"4{i:014d}" for i in range(1, 2_000))]
    assert len({tool.replace(c)[0] for c in cards}) == len(cards)
    numbers = [f"{a:03d}-45-6789" for a in range(1, 900) if a != 666]
    new = [tool.replace(n)[0] for n in numbers]
    assert len(set(new)) == len(numbers) and all(tool.replace(n, back=True)[0] == o for n, o in zip(new, numbers))


def test_pseudonyms_of_awkward_rows(spark):
    docs = cases.table(spark, [*cases.rows(), (50, " ".join(VALUES)), (50, " ".join(VALUES)), (51, "1" * 50_000)])
    new = P.pseudonymise(docs)
    assert new.columns == docs.columns and new.count() == docs.count()
    back = P.pseudonymise(new, back=True).select("doc_id", "text").collect()
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] or "")
    assert sorted(map(tuple, back), key=key) == sorted(map(tuple, docs.select("doc_id", "text").collect()), key=key)
    found = P.findings(docs).collect()
    assert [r.doc_id for r in found] == [50, 50] and all(r.n_found == len(VALUES) for r in found)
    assert P.findings(cases.table(spark, [])).collect() == []
