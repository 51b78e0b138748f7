"""Near-duplicates, line dedup and decontamination against brute force."""

import random
import re
from collections import Counter
from hashlib import sha256

import numpy as np
from pyspark.sql import functions as F

from failscope.llm import line_dedup as L
from failscope.llm import near_duplicates as N
from failscope.llm.decontaminate import decontaminate
from tests.llm import cases


def word_set(text, size):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i: i + size]) for i in range(max(1, len(words) - size + 1)))


def components(data, size, percent):
    sets = [(d, word_set(t, size)) for d, t in data if d is not None]
    root = {d: d for d, _ in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[i + 1:]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {d: top(d) for d, _ in sets}


def near_copies(seed, copies):
    """A text, copies with some words changed (each nearer to it than to one another)."""
    rng = random.Random(seed)
    base = cases.prose(seed, 200).split()
    out = [" ".join(base)]
    for k in range(copies):
        words = list(base)
        for _ in range(rng.randint(1, 6)):
            words[rng.randrange(len(words))] = f"new{k}{rng.random()}"
        out.append(" ".join(words))
    return out


def check(spark, data, size, percent, **options):
    got = N.near_duplicates(cases.table(spark, data), size, percent, **options).collect()
    assert len(got) == len(data)
    want = components(data, size, percent)
    for r in got:
        assert r.component_id == (want[r.doc_id] if r.doc_id is not None else None)
        assert r.kept == (r.doc_id == r.component_id)
    sizes = Counter((d, len(word_set(t, size))) for d, t in data)
    assert Counter((r.doc_id, r.n_shingles) for r in got) == sizes


def test_near_duplicates_of_awkward_rows(spark):
    check(spark, cases.rows(), 3, 85)
    assert N.near_duplicates(cases.table(spark, [])).count() == 0
    check(spark, [(1, None), (2, "")], 5, 80)


def test_large_groups_and_small_leaves(spark):
    data = [(100 + i, t) for i, t in enumerate(near_copies(3, 60))]
    data += [(300 + i, t) for i, t in enumerate(near_copies(4, 25))]
    data += [(500 + i, cases.prose(50 + i, 40)) for i in range(30)]
    check(spark, data, 3, 85, leaf=4, pivots=2)
    check(spark, data, 5, 80)


def linked_components(sets, percent):
    """Least id reachable from each id over links of similarity percent / 100 or more."""
    root = {x: x for x in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in sorted(sets):
        for y in sets:
            both = len(sets[x] & sets[y])
            if x < y and 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
                a, b = sorted((find(x), find(y)))
                root[b] = a
    return {x: find(x) for x in sets}


def test_family_links_connect_what_is_linked(spark):
    rng = random.Random(9)
    bases = [set(range(1_000)), set(range(500, 1_500)), set(range(2_000, 2_030))]
    bases = [set(rng.sample(sorted(b), min(len(b), 120))) for b in bases]
    sets = {}
    for i in range(150):  # copies around three bases; some just below or above the threshold
        base = bases[rng.choice([0, 0, 0, 1, 1, 2])]
        gone = rng.sample(sorted(base), rng.randint(0, len(base) // 7))
        sets[i + 1] = base - set(gone) | {10_000 + rng.randrange(400) for _ in range(len(gone) // 2)}
    sets[200] = sets[7] | set(rng.sample(range(20_000, 20_100), 3))
    sets[201], sets[202] = {1}, {1, 2}
    rows = spark.createDataFrame([(3, c) for c in sets] + [(201, c) for c in list(sets)[::2]] + [(201, 201)],
                                 "pivot long, cid long").distinct()
    items = spark.createDataFrame([(c, sorted(s)) for c, s in sets.items()], "cid long, items array<long>")
    for percent, pivots in ((85, 3), (85, 1), (80, 2)):
        links = [(r.x, r.y) for r in N._family_links(rows, items, percent, pivots).collect()]
        for x, y in links:
            both = len(sets[x] & sets[y])
            assert x < y and 100 * both >= percent * len(sets[x] | sets[y])
        got = {r.node: r.root for r in N.contract(
            spark.createDataFrame(links, "x long, y long")).collect()}
        want = linked_components(sets, percent)
        assert {x: got.get(x, x) for x in sets} == want
        assert 1 < len(set(want.values())) < len(sets)


def edited_copies(count):
    """Copies of 300 shingles; each edit replaces five that lie together. About half are no near copies."""
    rng = random.Random(count)
    sets = {0: set(range(300))}
    for i in range(1, count):
        places = rng.sample(range(60), rng.randint(1, 16))
        gone = {5 * at + k for at in places for k in range(5)}
        sets[i] = sets[0] - gone | {1_000 * i + j for j in gone}
    return sets


def test_copies_beyond_the_threshold_are_left_out_before_any_join(spark, monkeypatch):
    sets, spread, rarest = edited_copies(200), [], N._rarest

    def seen(members, *more):
        spread.append(members.count())
        return rarest(members, *more)

    monkeypatch.setattr(N, "_rarest", seen)
    rows = spark.createDataFrame([(0, c) for c in sets], "pivot long, cid long")
    items = spark.createDataFrame([(c, sorted(s)) for c, s in sets.items()], "cid long, items array<long>")
    links = [(r.x, r.y) for r in N._family_links(rows, items, 80, 3).collect()]
    got = {r.node: r.root for r in N.contract(spark.createDataFrame(links, "x long, y long")).collect()}
    want = linked_components(sets, 80)
    assert {x: got.get(x, x) for x in sets} == want
    assert len(sets) / 4 < len(set(want.values())) < len(sets) * 3 / 4
    assert sum(spread) < len(sets) / 4  # over all of them were joined on their shingles


def test_enough_trees():
    assert 1 - (1 - 0.85**4) ** N.trees_for(0.85, 4, 0.9999) >= 0.9999
    assert N.most_differing(1.0) == 0 < N.most_differing(0.85) < N.BINS


def test_contract_finds_least_nodes(spark):
    edges = [*((i, i + 1) for i in range(40)), (100, 99), (99, 98), *((7, 300 + i) for i in range(50))]
    df = spark.createDataFrame(edges, "x long, y long")
    got = {r.node: r.root for r in N.contract(df).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{300 + i: 0 for i in range(50)}, 98: 98, 99: 98, 100: 98}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_bounded_distance_equals_the_table():
    rng = random.Random(3)
    for _ in range(4_000):
        a = "".join(rng.choice("abc") for _ in range(rng.randint(0, 11)))
        b = "".join(c for c in a if rng.random() > 0.15) + rng.choice(["", "a", "cb"])
        for most in range(4):
            assert L.bounded_distance(a, b, most) == min(distance(a, b), most + 1)


def test_near_lines_share_a_key_that_leaves_near_remainders():
    rng = random.Random(5)
    for edits, cuts in ((1, 2), (1, 4), (2, 3), (2, 6), (3, 8)):
        known = L.ways(edits, cuts)
        for _ in range(150):
            a = "".join(rng.choice("abcab") for _ in range(rng.randint(4 * edits + 4, 45)))
            a, b = sorted((a, edited(rng, a, rng.randint(1, edits))), key=len)
            if a == b:
                continue
            found = L._Segments([a, b], np.zeros(2, np.int64), edits, cuts)
            rows = list(zip(found.line, found.key, found.probe, found.way))
            indexed = {key: L._left_out(a, known[way], cuts) for line, key, probe, way in rows
                       if line == 0 and not probe}
            left = [distance(indexed[key], L._left_out(b, known[way], cuts)) for line, key, _, way in rows
                    if line == 1 and key in indexed]
            assert min(left) <= edits, (edits, cuts, a, b)


def edited(rng, line, edits):
    for _ in range(edits):
        at = rng.randrange(len(line) + 1)
        line = rng.choice([line[:at] + "q" + line[at:], line[:at] + line[at + 1:], line[:at] + "z" + line[at + 1:]])
    return line


def test_edits_flip_few_bits_and_other_words_many():
    rng = random.Random(13)
    for edits in (1, 2, 3):
        for _ in range(200):
            a = cases.prose(rng.randrange(10**6), rng.randint(1, 8))
            one, two = L._Segments(["", a, edited(rng, a, edits), ""], np.zeros(4, np.int64), edits, edits + 1).odd()
            assert not one[0] and not two[3]
            for word, most in zip((one, two), L.FLIPS.values()):
                assert int(np.bitwise_count((word[1] ^ word[2]).view(np.uint64))) <= most * edits


def test_near_copies_that_are_not_near_lines_are_no_pairs(spark):
    copies = [c for c in dict.fromkeys(near_copies(7, 60))]
    docs = cases.table(spark, list(enumerate(copies)))
    lines = docs.select("text").select(*L._hashes(F.col("text")), F.col("text").alias("line"))
    assert L.candidates(docs, lines, 2, 20).count() < 20  # over 1,000 of them shared a segment
    assert line_links(spark, docs, 2) == set()


def line_links(spark, docs, edits):
    _, links = L.near_lines(docs, edits)
    texts = {(r.ha, r.hb): r.line for r in L._line_rows(docs).select(
        "line", *L._hashes(F.col("line"))).distinct().collect()}
    return {tuple(sorted((texts[r.xa, r.xb], texts[r.ya, r.yb]))) for r in links.collect()}


def test_near_lines_equal_brute_force_also_for_hot_keys(spark, monkeypatch):
    rng = random.Random(11)
    lines = [cases.prose(i, rng.randint(4, 9)) for i in range(40)]
    lines += [edited(rng, line, rng.randint(0, 3)) for line in lines for _ in range(3)]
    lines += [f"the same beginning of a line {i:04d}" for i in range(0, 3_000, 100)]
    rng.shuffle(lines)
    docs = cases.table(spark, [(i, "\n".join(lines[i * 5: i * 5 + 5])) for i in range(len(lines) // 5 + 1)])
    long_ones = sorted({line for line in lines if len(line) >= 20})
    want = {(a, b) for i, a in enumerate(long_ones) for b in long_ones[i + 1:] if distance(a, b) <= 2}
    assert len(want) > 60
    assert line_links(spark, docs, 2) == want
    monkeypatch.setattr(L, "PAIRS_PER_KEY", 6)
    assert line_links(spark, docs, 2) == want


def test_near_lines_of_hot_families_of_unequal_length(spark):
    lines = [f"Harbour log of the quay, page {i}" for i in range(1, 151)]
    docs = cases.table(spark, [(i, line) for i, line in enumerate(lines)])
    ordered = sorted(set(lines))
    want = {(a, b) for i, a in enumerate(ordered) for b in ordered[i + 1:] if distance(a, b) <= 2}
    assert ("Harbour log of the quay, page 1", "Harbour log of the quay, page 10") in want
    assert line_links(spark, docs, 2) == want


def test_lines_used_too_often_keep_their_first_use(spark):
    footer = "please read the whole footer of this page"
    data = [(i, f"{cases.prose(i, 12)}\n{footer if i % 2 else footer + '!'}\n") for i in range(1, 9)]
    data += [(20, footer), (21, None), (22, ""), (None, footer + "\nown line of a text without an id")]
    docs = cases.table(spark, data)
    got = {r.doc_id: r.text for r in L.dedup_lines(docs, allowed=6).collect()}
    assert got[1] == data[0][1] and 20 not in got and got[21] is None and got[22] == ""
    assert all(got[i] == cases.prose(i, 12) + "\n" for i in range(2, 9))
    assert got[None] == "own line of a text without an id"
    assert L.dedup_lines(docs).columns == docs.columns
    report = {r.doc_id: (r.n_lines, r.n_dropped) for r in L.line_report(docs).collect()}
    assert report[1] == (3, 0) and report[2] == (3, 1) and report[20] == (1, 1) and report[21] == (0, 0)
    few = {r.doc_id: r.text for r in L.dedup_lines(docs, allowed=50).collect()}
    assert few == {d: t for d, t in data}


def test_texts_that_share_an_id_lose_their_own_lines(spark):
    footer = "please read the whole footer of this page"
    data = [(i, f"{cases.prose(i, 12)}\n{footer}") for i in range(1, 8)]
    clean = f"{cases.prose(50, 12)}\n{cases.prose(51, 12)}"
    data += [(d, t) for d in (9, None) for t in (clean + f" {d}", f"{cases.prose(60, 12)} {d}\n{footer}")]
    got = {(r.doc_id, r.text) for r in L.dedup_lines(cases.table(spark, data)).collect()}
    assert got == {(d, t if d == 1 else t.replace("\n" + footer, "")) for d, t in data}
    dropped = [(r.doc_id, r.n_dropped) for r in L.line_report(cases.table(spark, data)).collect()]
    assert sorted(n for d, n in dropped if d in (9, None)) == [0, 0, 1, 1]


def test_long_passages_keep_only_their_first_use(spark):
    twice, thrice, six, alone = (cases.prose(i, 60) for i in (70, 71, 72, 73))
    few = cases.prose(74, 30)
    data = [(i, "\n".join([cases.prose(i, 12), six, *[few] * (i < 6), *[thrice] * (i < 4), *[twice] * (i < 3)]))
            for i in range(1, 7)]
    data += [(7, alone), (8, alone), (9, cases.prose(9, 12) + "\n" + alone + ".")]
    docs = cases.table(spark, data)
    want = {1: data[0][1], 7: alone, 9: cases.prose(9, 12)}
    want |= {i: cases.prose(i, 12) + ("\n" + few if i < 6 else "") for i in range(2, 7)}
    assert {r.doc_id: r.text for r in L.dedup_lines(docs, copies=True).collect()} == want
    assert {r.doc_id: r.text for r in L.dedup_lines(docs).collect()} == want | {8: alone}
    assert {r.doc_id for r in L.line_report(docs).collect() if r.n_dropped} == {2, 3, 4, 5, 6, 8, 9}


def test_line_dedup_of_awkward_rows(spark):
    assert L.line_report(cases.table(spark)).count() == len(cases.rows())
    assert L.dedup_lines(cases.table(spark)).count() == len(cases.rows())
    assert L.dedup_lines(cases.table(spark, [])).count() == 0


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return WORD.findall(lower)


def leaks(data, items):
    out = []
    for doc, text in data:
        words, hit, found = words_of(text), set(), set()
        for item, body in items:
            own = words_of(body)
            for at in range(max(1, len(own) - 9) if own else 0):
                win = own[at: at + 10]
                for p in range(len(words) - len(win) + 1):
                    if words[p: p + len(win)] == win:
                        hit |= set(range(p, p + len(win)))
                        if item is not None:
                            found.add(str(item))
        out.append((doc, len(words), len(hit), len(found), sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def test_leaks_equal_brute_force(spark):
    item = cases.prose(77, 30)
    items = [(1, item), (2, item), (10, "Three short-words"), (11, ""), (12, None), (None, cases.prose(78, 12)),
             (13, cases.prose(79, 10)), (13, cases.prose(79, 10)), (14, "single")]
    data = [(1, None), (2, ""), (3, "say THREE, short words; three short words"), (4, f"a {item} b {item}"),
            (5, " ".join(item.split()[4:15])), (6, " ".join(item.split()[4:13])), (7, cases.prose(79, 10)),
            (7, cases.prose(79, 10)), (None, cases.prose(78, 12)), (8, "été single été"), (9, cases.prose(2, 5_000))]
    schema = "item_id long, text string, key string, words string, win_id string"
    bench = spark.createDataFrame([(*i, None, None, None) for i in items], schema)
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    for limit in (300_000, 0):  # broadcast, and joined by a shuffle
        got = [tuple(r) for r in decontaminate(cases.table(spark, data), bench, broadcast_rows=limit).collect()]
        assert sorted(got, key=key) == sorted(leaks(data, items), key=key)
    assert decontaminate(cases.table(spark, []), bench).count() == 0
    none = decontaminate(cases.table(spark, data), bench.limit(0)).collect()
    assert len(none) == len(data) and not any(r.contaminated for r in none)
