"""Token files, token counts and piece segmentations against the libraries and brute force."""

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from failscope.llm import pieces as P
from failscope.llm import token_counts as C
from failscope.llm import token_files as T
from failscope.llm.common import tokenizer_path
from failscope.session import new_path
from tests.llm import cases


@pytest.fixture(scope="module")
def word_bpe():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [1]


def test_token_files_hold_the_librarys_ids(spark, word_bpe):
    docs = cases.table(spark)
    path = new_path(spark, "tokens")
    T.write_tokens(docs, path, block_docs=4, sample_docs=10)
    got = T.read_tokens(spark, path).collect()
    want = sorted(((d, ids_of(word_bpe, t)) for d, t in cases.rows()),
                  key=lambda r: (r[0] is not None, r[0] or 0))
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens) for r in got) == sorted(
        (d is not None, d or 0, len(i)) for d, i in want)
    got.sort(key=lambda r: r.start)
    assert [r.doc_id for r in got] == [d for d, _ in want]
    start = 0
    for r in got:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert r.start == start and r.n_tokens == len(ids) and r.ids_crc32 == zlib.crc32(r.ids)
        assert (r.doc_id, ids) in want
        start += len(ids)
    assert T.read_document(spark, path, 6) == ids_of(word_bpe, dict(cases.rows())[6])
    with pytest.raises(KeyError):
        T.read_document(spark, path, 99)


def test_token_files_of_nothing(spark):
    assert T.token_files(cases.table(spark, [])).collect() == []


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("aBz'sdl 10.,!?-é É Ÿ ŉ İ Σ ß \n\t\x1c\x85\xa0́<|>日½ªx")))
def test_word_by_word_equals_whole_text(text):
    encoder = test_word_by_word_equals_whole_text.__dict__.setdefault(
        "encoder", T.WordEncoder("word_bpe_49k.json"))
    want = np.asarray(encoder.tokenizer.encode(text, add_special_tokens=False).ids, "<u2").tobytes()
    assert list(encoder.encode([text])) == [want]


def test_a_damaged_dictionary_is_refused(spark):
    path = new_path(spark, "tokens")
    T.write_tokens(cases.table(spark, [(1, "a b c")]), path)
    spark.createDataFrame([(5, bytearray(b"other"))], "dictionary_id long, dictionary binary"
                          ).write.mode("overwrite").parquet(f"{path}/dictionary")
    with pytest.raises(ValueError):
        T.read_tokens(spark, path)


@pytest.mark.parametrize("chunk, overlap", [(65_536, 1_024), (500, 40), (120, 3)])
def test_counts_equal_whole_texts(spark, chunk, overlap):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    data = [r for r in cases.rows() if chunk > 200 or len(r[1] or "") < 5_000]
    got = C.token_counts(cases.table(spark, data), chunk_chars=chunk, overlap_chars=overlap)
    want = [(d, len((t or "").encode()), len(model.encode(t or ""))) for d, t in data]
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in got.collect()), key=key) == sorted(want, key=key)
    assert all(r.over_limit == (r.n_tokens > 4096) for r in got.collect())


def test_counts_by_a_byte_level_file(spark):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    data = [r for r in cases.rows() if r[0]]
    got = C.token_counts(cases.table(spark, data), "byte_bpe_50k.json", chunk_chars=2_000, overlap_chars=50)
    assert {(r.doc_id, r.n_tokens) for r in got.collect()} == {
        (d, len(model.encode(t or "", add_special_tokens=False).ids)) for d, t in data}
    assert C.token_counts(cases.table(spark, [])).count() == 0


def every_segmentation(pieces, marked):
    """(score, ids) of all segmentations."""
    if not marked:
        return [(0.0, ())]
    out = []
    for end in range(1, len(marked) + 1):
        known = pieces.score.get(marked[:end])
        if known:
            out += [(known[0] + s, (known[1], *i)) for s, i in every_segmentation(pieces, marked[end:])]
    if marked[0] not in pieces.score:
        raw = marked[0].encode()
        out += [(pieces.byte_score * len(raw) + s, (*[pieces.bytes[b] for b in raw], *i))
                for s, i in every_segmentation(pieces, marked[1:])]
    return out


@pytest.fixture(scope="module")
def vocabulary():
    return P.Pieces.load("piece_bpe_32k.model")


def test_n_best_equals_brute_force(vocabulary):
    rng = random.Random(7)
    parts = ["the ", "of", "in ", "q", "ation", "é", "日", "\n", "  ", ".", "ing "]
    for _ in range(60):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 4)))
        tool = P.Encoder(vocabulary, 5)
        _, raw, found = tool.encode(text)
        everything = every_segmentation(vocabulary, vocabulary.normalise(text))
        assert [s for s, _ in found] == sorted((s for s, _ in everything), reverse=True)[:5]
        ids = [tuple(tool.ids(text, picks)) for _, picks in found]
        assert len(set(ids)) == len(ids)
        assert all((s, i) in everything for (s, _), i in zip(found, ids))
        assert tuple(np.frombuffer(raw, "<i4").tolist()) == ids[0]
        assert vocabulary.decode(ids[-1]) == text


def test_ties_do_not_multiply():
    tied = P.Pieces([("a", -1.0, 0), ("aa", -2.0, 1), (P.MARK, -1.0, 2)], {}, dummy_prefix=False)
    found = tied.n_best("a" * 2_000, 4)
    assert [s for s, _ in found] == [-2_000.0] * 4 and len({i for _, i in found}) == 4


def test_segmentations_of_awkward_rows(spark):
    got = P.segmentations(cases.table(spark)).collect()
    assert len(got) == len(cases.rows()) and all(r.round_trip for r in got)
    assert all(r.n_best_scores == sorted(r.n_best_scores, reverse=True) for r in got)
    assert {r.n_pieces for r in got if r.doc_id in (1, 2)} == {0}
    assert P.segmentations(cases.table(spark, [])).count() == 0


def test_encode_and_decode_round_trip(spark):
    docs = cases.table(spark, [(1, "the cat\nsat"), (2, None), (3, "日本 x")])
    encoded = P.encode(docs, n=3)
    assert {(r.doc_id, r.text) for r in P.decode(encoded).collect()} == {
        (1, "the cat\nsat"), (2, ""), (3, "日本 x")}
    row = encoded.where("doc_id = 1").first()
    assert row.n_best[0].ids == row.ids and row.n_best[0].score == row.score and len(row.n_best) == 3


def test_segmentations_hold_the_ids_of_all_of_the_n_best(spark):
    docs = cases.table(spark, [(1, cases.prose(1, 40)), (2, "É é Σίγμα 日本 ▁ a"), (3, None), (4, cases.prose(4, 3_000))])
    rows = {r.doc_id: r for r in P.segmentations(docs).collect()}
    want = {r.doc_id: r for r in P.encode(docs).collect()}
    for doc, row in rows.items():
        assert row.n_best_ids == [list(e.ids) for e in want[doc].n_best] and row.round_trip
        assert len({tuple(x) for x in row.n_best_ids}) == len(row.n_best_scores) and row.n_best_ids[0] == want[doc].ids
    assert len(rows[1].n_best_ids) == len(rows[4].n_best_ids) == 4
    assert all(P.Pieces.load("piece_bpe_32k.model", None).decode(x) == cases.prose(1, 40) for x in rows[1].n_best_ids)


def test_a_workers_caches_end_with_the_task():
    import gc

    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["some words of a text", None]})
    assert sum(b.num_rows for b in P._encoded(iter([batch]), "piece_bpe_32k.model", None, 4)) == 2
    gc.collect()
    assert not [x for x in gc.get_objects() if isinstance(x, P.Encoder)]
