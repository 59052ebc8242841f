"""Quotes of any length against plain search; orders, pages and keys on small tables."""

import random

import pytest
from pyspark.sql import functions as F

from parchment import catalog
from parchment.functions import text as rules
from parchment.operators import orders, records
from tests.oracles import assert_same, connection


@pytest.fixture
def small(spark, tmp_path):
    texts = ["alpha beta gamma", "alphabet soup, alpha beta", "beta", "", None, "“Curly” quotes — and a dash… end", "x" * 50 + " long " + "x" * 50, "aa bb aa", "The **bold** word\nand more"]
    quotes = ["beta", "alpha bet", "a", "aa", "alpha beta gamma", None, "", '"curly" quotes - and a dash. end', "x" * 45, "bold word and", "zz", "beta gamma delta", "ha b"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(quotes)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), texts, quotes


def unique(text, quote):
    at = text.find(quote)
    return at >= 0 and (len(quote) >= 40 or text.find(quote, at + 1) < 0)


def test_short_quotes_are_found(spark, small):
    path, texts, quotes = small
    got = {(r.item_id, r.doc_id, r.start_at, r.end_at) for r in catalog.QUERIES["anchor_exact_quotes"](spark, path).collect()}
    assert got == {(i, d, t.find(q), t.find(q) + len(q)) for i, q in enumerate(quotes) for d, t in enumerate(texts) if q and t and unique(t, q)}
    assert (0, 0, 6, 10) in got and (1, 0, 0, 9) in got


def test_folded_quotes_point_into_the_text(spark, small):
    path, texts, quotes = small
    got = {(r.item_id, r.doc_id, r.start_at, r.end_at) for r in catalog.QUERIES["anchor_normalised_quotes"](spark, path).collect()}
    want = {(i, d, *s) for i, q in enumerate(quotes) for d, t in enumerate(texts) if q and t and (s := rules.find_quote(t, q))}
    assert got == want
    assert texts[5][slice(*next(g[2:] for g in got if g[0] == 7))].startswith("“Curly")


def test_quotes_of_a_table_match_sql(spark):
    sf = "/root/testdata/sf0.01"
    for name in ("anchor_exact_quotes", "reanchor_after_edit"):
        assert_same(catalog.QUERIES[name](spark, sf), connection(sf), catalog.ORACLES[name])


def test_orders_are_total_and_pages_cover_them(spark):
    r = random.Random(3)
    day = lambda: None if r.random() < 0.4 else f"2020-01-0{r.randint(1, 3)}"
    rows = [(i, r.choice(["Élan", "elan", "Zoo", "apple"]), day(), day(), day(), day(), r.randint(0, 2)) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, title string, dated string, created string, modified string, added string, find_rank int").select("id", "title", "find_rank", *[F.col(c).cast("timestamp").alias(c) for c in ("dated", "created", "modified", "added")])
    whole = [x.id for x in df.orderBy(*orders.listing_order("modified")).collect()]
    undated = {i for i, _, a, b, c, _, _ in rows if not (a or b or c)}
    assert set(whole[len(whole) - len(undated) :]) == undated
    after, seen = whole[0], [whole[0]]
    while page := [x.id for x in orders.page_after(df, orders.listing_order("modified"), "id", after, len(seen), 7, orders.modified_keys()).collect()]:
        seen += page
        after = page[-1]
    assert seen == whole
    assert [x.id for x in orders.page_after(df, orders.listing_order("modified"), "id", 999, 14, 7, orders.modified_keys()).collect()] == whole[7:14]
    up = [x.id for x in df.orderBy(*orders.listing_order("dated-asc")).collect()]
    dates = [next(x[2] for x in rows if x[0] == i) for i in up]
    assert dates == sorted([d for d in dates if d]) + [None] * dates.count(None)


def test_sorts_and_names():
    assert orders.parse_sort("relevant", False) == "modified" and orders.parse_sort("relevant", True) == "relevant" and orders.parse_sort("odd", True) == "relevant" and orders.parse_sort("dated-asc", False) == "dated-asc"
    assert (orders.page_size(None), orders.page_size(0), orders.page_size(500)) == (30, 1, 100)


def test_surnames_and_name_keys(spark):
    names = ["Ann Garduño-Castañeda", "Bob Smith Jr.", "Cher", "Jr.", "  Dan   Ó Briain III "]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [tuple(r) for r in df.select(orders.surname(F.col("n")), orders.name_key(F.col("n"))).collect()]
    assert got == [("Garduño-Castañeda", "ann garduno castaneda"), ("Smith", "bob smith jr"), ("Cher", "cher"), ("Jr.", "jr"), ("Briain", "dan o briain iii")]
    assert [rules.name_key(n) for n in names] == [k for _, k in got]


def test_vote_decisions(spark):
    rows = [(1, "passed", "2020-01-02", 2), (1, "not_passed", "2020-01-01", 2), (1, "not_passed", "2021-01-01", 1), (2, "passed", None, 2), (2, "not_passed", "2020-01-01", 2), (3, "unknown", "2020-01-01", 2), (3, "passed", None, 1),
            (4, "passed", "2020-01-01", 1), (4, "not_passed", "2020-01-01", 1)]
    df = spark.createDataFrame(rows, "id int, status string, day string, reading int").withColumn("day", F.to_date("day"))
    got = {r.id: (r.status, str(r.day)) for r in records.decide(df, "id").collect()}
    assert got == {1: ("passed", "2020-01-02"), 2: ("ambiguous", "None"), 3: ("passed", "None"), 4: ("ambiguous", "None")}
