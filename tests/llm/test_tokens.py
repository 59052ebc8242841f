import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from parchment.llm import packing, token_store, tokenization
from tests.llm import cases

TOKENIZER = Tokenizer.from_file(tokenization.default_path())


def ids_of(t):
    return TOKENIZER.encode(t or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abéÉΣσς .,!'\n\t9#<|>ß́İre<|endoftext|>日x\x1c\x85")), max_size=60))
def test_words_give_the_ids_of_the_whole_text(text):
    assert np.frombuffer(tokenization.encoder(tokenization.default_path()).encode([text.encode()])[0], "<u4").tolist() == ids_of(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("aBé\u0301\u0307ΣI .,-#'<|\x1f=\u0338_3")), max_size=12), max_size=5))
def test_parting_at_punctuation_and_case_keep_the_ids(texts):
    got = tokenization.encoder(tokenization.default_path()).encode([t.encode() for t in texts])
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [ids_of(t) for t in texts]


def test_special_tokens_keep_their_case():
    texts = ["a<|endoftext|>b", "A<|ENDOFTEXT|>B", "x <|StartOfText|>, y"]
    got = tokenization.encoder(tokenization.default_path()).encode([t.encode() for t in texts])
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [ids_of(t) for t in texts]


def test_case_and_punctuation_make_no_new_words():
    e = tokenization.Encoder(tokenization.default_path())
    e.encode([b"word another , ."])
    known = len(e.words)
    e.encode([b"Word, WORD. (another),"])
    assert len(e.words) == known + 2  # the brackets


def test_the_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(tokenization, "CACHE_WORDS", 20)
    e = tokenization.Encoder(tokenization.default_path())
    for k in range(30):
        text = " ".join(f"word{chr(97 + k % 26)}{chr(97 + j)}," for j in range(15))
        assert np.frombuffer(e.encode([text.encode()])[0], "<u4").tolist() == ids_of(text)
        assert len(e.words) < 100 and len(e.old) < 100


@given(st.lists(st.integers(1, 64), max_size=80))
def test_best_fit_fills_without_overlap(lengths):
    lengths = np.array(lengths, np.int64)
    seq, off = packing.best_fit_decreasing(lengths, 64)
    for s in set(seq.tolist()):
        own = sorted(zip(off[seq == s].tolist(), lengths[seq == s].tolist(), strict=True))
        assert [a for a, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 64


@given(st.lists(st.integers(1, 64), max_size=60))
def test_best_fit_takes_the_tightest_window(lengths):
    room, used = [], []
    for n in sorted(lengths, reverse=True):  # brute force: the least room that suffices
        fits = [r for r in room if r >= n]
        if fits:
            room.remove(min(fits))
            room.append(min(fits) - n)
        else:
            room.append(64 - n)
    seq, _ = packing.best_fit_decreasing(np.array(lengths, np.int64), 64)
    used = [64 - sum(n for n, s in zip(lengths, seq, strict=True) if s == k) for k in set(seq.tolist())]
    assert sorted(used) == sorted(room)


def test_packing(spark):
    rows = [*enumerate(cases.texts()), (None, "null id"), (3, "again")]
    got = packing.pack(cases.documents(spark, rows), with_ids=True).collect()
    assert sum(r.length for r in got) == sum(len(ids_of(t)) + 1 for _, t in rows)
    by_doc, by_seq = {}, {}
    for r in got:
        assert r.length == len(r.ids) <= 2048 and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for i, t in rows:
        if i not in (3,):
            assert [x for r in sorted(by_doc[i], key=lambda r: r.start) for x in r.ids] == [*ids_of(t), 1]
            assert {r.doc_tokens for r in by_doc[i]} == {len(ids_of(t)) + 1}
    for own in by_seq.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))] and sum(r.length for r in own) <= 2048
    assert packing.pack(cases.empty(spark)).count() == 0


@settings(deadline=None)
@given(st.lists(st.lists(st.integers(3, 9), max_size=40), min_size=1, max_size=12), st.integers(2, 8))
def test_grammar_round_trip(docs, least):
    old, token_store.LEAST_COUNT = token_store.LEAST_COUNT, least
    try:
        parts = [np.array([*d, token_store.END], "<u4").tobytes() for d in docs]
        shard = token_store.Shard(token_store.encode_shard([None, *range(1, len(docs))], parts, 10))
    finally:
        token_store.LEAST_COUNT = old
    assert shard.all_ids().tolist() == [x for d in docs for x in [*d, token_store.END]]
    assert shard.lengths().tolist() == [len(d) + 1 for d in docs]
    assert [shard.document(i).tolist() for i in range(len(docs))] == [[*d, token_store.END] for d in docs]
    assert shard.doc_ids == [None, *range(1, len(docs))]


def test_no_frequent_pair_is_left():
    r = np.random.default_rng(4)
    words = [r.integers(3, 4000, r.integers(1, 12)) for _ in range(300)]
    ids = np.concatenate([np.append(np.concatenate([words[k] for k in r.zipf(1.3, 60) % 300]), token_store.END) for _ in range(500)])
    seq, left, right = token_store.grammar(ids, 4096)
    inside = seq[:-1][seq[:-1] != token_store.END]
    last = np.zeros(4096 + len(left), bool)  # symbols that end a document
    last[token_store.END] = True
    for k in range(len(left)):
        last[4096 + k] = last[right[k]]
    keep = ~last[seq[:-1]]
    _, counts = np.unique((seq[:-1] << 32 | seq[1:])[keep], return_counts=True)
    assert counts.max() < token_store.LEAST_COUNT and len(inside)
    size = token_store.rule_sizes(left, right, 4096)
    back = token_store.expand(seq, token_store.expansions(left, right, size, 4096), size, 4096)
    assert (back == ids).all() and size.max() > 16  # longer than four rounds of doubling reach


def test_the_store_is_smaller_than_the_ids(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    row = token_store.write_store(docs).selectExpr("sum(n_ids) as ids", "sum(octet_length(blob)) as size").first()
    assert row["size"] < 0.8 * 2 * row["ids"]  # an id alone takes two bytes


def test_documents_are_looked_up_by_id(spark):
    rows = [*enumerate(cases.texts()), (5, "again"), (None, "null id")]
    shards = token_store.write_store(cases.documents(spark, rows), shard_ids=50)
    wanted = spark.createDataFrame([(5,), (7,), (7,), (999,), (None,)], "doc_id long")
    got = sorted((r.doc_id, tuple(r.ids)) for r in token_store.documents(shards, wanted).collect())
    assert got == sorted((i, (*ids_of(t), 2)) for i, t in rows if i in (5, 7))
    assert shards.count() > 3


def test_frequent_pairs_shrink_the_sequence():
    seq, left, right = token_store.grammar(np.array([3, 4, 5, 6] * 500 + [2]), 10)
    assert len(seq) < 600 and len(left) >= 2


@pytest.mark.parametrize("shard_ids", [1 << 20, 50])
def test_store(spark, shard_ids):
    rows = [*enumerate(cases.texts()), (None, "null id")]
    got = {r.doc_id: r for r in token_store.read_store(token_store.write_store(cases.documents(spark, rows[::-1]), shard_ids=shard_ids), with_ids=True).collect()}
    at = 0
    for i, t in sorted(rows, key=lambda r: -1 if r[0] is None else r[0]):
        want = [*ids_of(t), 2]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32, got[i].ids) == (at, len(want), zlib.crc32(np.array(want, "<u4").tobytes()), want)
        at += len(want)
    assert token_store.read_store(token_store.write_store(cases.empty(spark))).count() == 0
