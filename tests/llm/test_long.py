"""Documents beyond the size of a chunk, and columns that clash with the operators' own names."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from parchment.llm import _common as C
from parchment.llm import decontamination, packing, quality_rules, secret_scan, simhash_dedup, substring_dedup, suffix_dedup, token_store, tokenization


@pytest.fixture(scope="module")
def long_text():
    r = random.Random(12)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(60000)]
    text = " ".join(r.choice(words) for _ in range(240_000))
    assert len(text) > C.CHUNK_BYTES
    return text


@pytest.fixture(scope="module")
def docs(spark, long_text):
    tail = " " + " ".join(f"tail{k}" for k in range(30))
    return spark.createDataFrame([(1, long_text), (2, long_text + tail), (3, "short text of a few words only")], "doc_id long, text string").cache()


def test_long_copies_are_removed_whole(docs, long_text):
    n = len(long_text)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup.kept_bytes(suffix_dedup.suffix_dedup(docs)).collect()}
    assert got[1] == (n, n, 1) and got[2][1:] == (n, 1) and got[3][1:] == (0, 0)
    words = len(long_text.split())
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup.kept_words(substring_dedup.substring_dedup(docs)).collect()}
    assert got == {1: (words, 0), 2: (words + 30, words), 3: (7, 0)}


def test_long_texts_keep_their_ids(docs, long_text):
    tokenizer = Tokenizer.from_file(tokenization.default_path())
    ids = tokenizer.encode(long_text, add_special_tokens=False).ids
    got = {r.doc_id: r for r in token_store.read_store(token_store.write_store(docs, shard_ids=1000)).collect()}
    assert got[1].n_tokens == len(ids) + 1 and got[1].ids_crc32 == zlib.crc32(np.array([*ids, 2], "<u4").tobytes())
    pieces = sorted((r.start, r.length, r.ids_crc32) for r in packing.pack(docs).collect() if r.doc_id == 1)
    whole = np.array([*ids, 1], "<u4")
    assert [zlib.crc32(whole[a : a + n].tobytes()) for a, n, _ in pieces] == [c for _, _, c in pieces] and sum(n for _, n, _ in pieces) == len(whole)


def test_long_texts_are_near_copies(docs):
    assert {r.doc_id: r.component_id for r in simhash_dedup.near_groups(docs).collect()} == {1: 1, 2: 1, 3: 3}
    assert quality_rules.judge(docs).where("doc_id = 2").first().n_words == 240_030


def test_secrets_and_items_deep_in_a_long_text(spark, long_text):
    item = "Which of the seven bridges near Oslo was built before the 12 others were torn down by floods?"
    rows = [(1, long_text + " token=abcdefghijklmnop " + item), (2, long_text)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.spans for r in secret_scan.digest(secret_scan.findings(docs)).collect()}
    at = len(long_text) + 1
    assert got == {1: f"assign:{at}:{at + 22}", 2: ""}
    bench = spark.createDataFrame([(5, item)], "item_id long, text string")
    assert [(r.doc_id, r.item_ids) for r in decontamination.report(docs, bench).collect()] == [(1, "5")]


def test_own_names_of_columns_stay(spark):
    names = ["_text", "_kept", "_blob", "blob", "_m", "hits", "tpl", "row_key", "h", "spans", "found", "votes", "hi", "lo", "n", "rep", "component", "_salt", "_s"]
    row = (1, "A note for the team of twelve people who met in the old hall near the river to speak of the plan for the next year and the work that it asks of them.", *["x"] * len(names))
    docs = spark.createDataFrame([row, (2, "token=abcdefghijklmnop", *["y"] * len(names))], "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    bench = spark.createDataFrame([(1, "nothing of this is anywhere in those texts at all today")], "item_id long, text string")
    for got in (quality_rules.keep(docs), simhash_dedup.one_of_each(docs), decontamination.clean(docs, bench), secret_scan.redacted(docs)):
        assert got.columns == docs.columns
        assert {tuple(r)[2:] for r in got.collect()} <= {("x",) * len(names), ("y",) * len(names)} and got.count() >= 1


def test_runs_of_names_and_numbers_of_any_length_are_one_placeholder(spark):
    texts = {"Word ": ["a"], "one ": ["n"], "1,": ["n"], "1 million ": ["n"] * 50_000, "hundred and ": ["n", "and"]}
    df = spark.createDataFrame([(k * 50_000,) for k in texts], "text string").coalesce(1)
    rows = df.select(decontamination.template(F.col("text")).alias("t"), F.size(decontamination.values(F.col("text"))).alias("n"), F.size(decontamination.words(F.col("text"))).alias("w")).collect()
    assert [(r.t, r.n) for r in rows] == [(t, len(t)) for t in texts.values()]
    assert [r.w for r in rows] == [50_000, 50_000, 1, 100_000, 100_000]
