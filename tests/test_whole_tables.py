"""Queries over whole tables: held against SQL without bounds, or against brute force."""

import random
import re

import pytest

from parchment import catalog
from tests.oracles import assert_same, connection

SF = "/root/testdata/sf0.01"
#: Here some suppliers have no early order.
LARGE = "/root/testdata/sf0.1"

#: The registered SQL of these reads a part of the tables; this reads all of them.
WHOLE = {
    "span_containment": """with spans as (select l_orderkey, min(l_shipdate)::date as a, max(l_shipdate)::date as b from lineitem group by 1)
    select l_orderkey, a >= o_orderdate::date - 400 and (o_orderstatus = 'O' or b <= o_orderdate::date + 900) as usable from spans join orders on l_orderkey = o_orderkey""",
    "marker_ranges_with_gaps": """with m as (select l_orderkey, l_linenumber as starts, coalesce(lead(l_linenumber) over (partition by l_orderkey order by l_linenumber) - 1, 7) as ends from (select distinct l_orderkey, l_linenumber from lineitem))
    select l_orderkey, starts::int as starts, ends::int as ends, (ends - starts)::int as missing from m""",
    "relevant_provenance_merge": """with a as (select s_suppkey as target, s_suppkey as first from supplier where s_suppkey % 2 = 0), b as (select l_suppkey as target, min(l_orderkey * 8 + l_linenumber) as first from lineitem group by 1)
    select target, coalesce(a.first, b.first) as place, case when b.first is null then 1 else 2 end as row_from, case when a.first is null then 'minutes' when b.first is null then 'agenda' else 'agenda+minutes' end as provenance from a full join b using (target)""",
    "thread_view": "select conv_id, turn, role, length(text)::int as size, (row_number() over (partition by conv_id order by turn))::int as place from conversations where role <> 'system'",
    "date_offset_self_join": """with p as (select a.o_orderkey as key_a, b.o_orderkey as key_b, date_diff('day', a.o_orderdate::date, b.o_orderdate::date)::int as days from orders a join orders b on a.o_custkey = b.o_custkey)
    select * from p where days between 6 and 43 and (days + 1) % 7 < 3""",
}


@pytest.mark.parametrize("name", sorted(WHOLE))
def test_query_reads_the_whole_tables(spark, name):
    sf = LARGE if name == "relevant_provenance_merge" else SF
    assert_same(catalog.QUERIES[name](spark, sf), connection(sf), WHOLE[name])


def brute_pairs(people, accounts):
    """The greedy rule as it is stated: all pairs of a block, the best first, each side once."""
    score = lambda a, b: next((s for s, m in ((3, 100), (2, 10), (1, 5)) if a % m == b % m), 0)
    out, used_a, used_b = [], set(), set()
    for s, n, a, b in sorted((-score(a, b), n, a, b) for n, a in people for k, b in accounts if n == k and score(a, b)):
        if a not in used_a and b not in used_b:
            used_a.add(a)
            used_b.add(b)
            out.append((n, a, b, -s))
    return sorted(out)


def test_all_people_are_paired_as_by_brute_force(spark):
    read = lambda t, n, k: [tuple(r) for r in spark.read.parquet(f"{SF}/{t}.parquet").select(n, k).collect()]
    want = brute_pairs(read("customer", "c_nationkey", "c_custkey"), read("supplier", "s_nationkey", "s_suppkey"))
    got = catalog.QUERIES["pair_names_to_accounts"](spark, SF)
    assert sorted((r.nation, r.c_custkey, r.s_suppkey, r.score) for r in got.collect()) == want
    assert max(a for _, a, _, _ in want) >= 400


def test_residue_pairs_where_accounts_outnumber_people(spark):
    from parchment.operators.derivation import residue_pairs

    r = random.Random(5)
    people, accounts = ([(r.randint(1, 3), k) for k in r.sample(range(1000), n)] for n in (150, 250))
    got = residue_pairs(spark.createDataFrame(people, "n int, a long"), spark.createDataFrame([*accounts, (None, 5000)], "n int, b long"), "n", "a", "b")
    want = brute_pairs(people, accounts)
    assert sorted(tuple(r) for r in got.collect()) == want and {s for *_, s in want} == {1, 2, 3}


def one_edit(a, b):
    """By the definition: one letter struck, put in or changed."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute_components(names):
    left, out = set(names), {}
    while left:
        group, todo = set(), [min(left)]
        while todo:
            x = todo.pop()
            group.add(x)
            left.discard(x)
            near = {y for y in left if one_edit(x, y)}
            left -= near
            todo += near
        out |= {x: min(group) for x in group}
    return out


def test_names_are_compared_whole(spark, tmp_path):
    long = "a" * 60 + "bcdefghij" * 10
    texts = [
        "Christine went", "christina", "christophe", "christoph", "Peters said", "petersen", "petersens", "garciaé x", "garcia", "muñozes", "munozes", "four", "", None,
        long, long + "k", long[:-1] + "z", long[:120] + "qq", "straße-5", "strase", "5 apples",
    ]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    names = {re.match(r"[^\W\d_]*", (t or "").lower())[0] for t in texts}
    want = brute_components({n for n in names if len(n) >= 5})
    got = {r.name: r.component for r in catalog.QUERIES["name_typo_components"](spark, str(tmp_path)).collect()}
    assert got == want
    assert got["christine"] == "christina" and got["christoph"] == got["christophe"] and got["peters"] == "peters" and got["petersens"] == "petersen"


def test_names_of_a_table_against_brute_force(spark):
    texts = [r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    names = {re.match(r"[^\W\d_]*", t.lower())[0] for t in texts}
    got = {r.name: r.component for r in catalog.QUERIES["name_typo_components"](spark, SF).collect()}
    assert got == brute_components({n for n in names if len(n) >= 5})


def test_topic_words_end_at_accented_letters_as_in_sql(spark, tmp_path):
    texts = ["LAÉTIONAUX", "ÉLA", "LA", "lañ THE", "É THEÑ", "aLA LA_ LA1", "ñTHATñ", "THAT", "that_", "worthleſs", "worthleſſ", "worthleſſa", "éheon", "heoń", "", "GDPR."]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = connection(tmp_path)
    con.execute(f"create or replace view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert_same(catalog.QUERIES["topic_candidates"](spark, str(tmp_path)), con, catalog.ORACLES["topic_candidates"])
