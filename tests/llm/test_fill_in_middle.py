import hashlib

import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from parchment.llm import fill_in_middle as fim
from tests.llm import cases


@given(st.text(alphabet=st.sampled_from("a\x00é漢\U0001d11ez"), max_size=60))
def test_select_and_rank_against_slicing(text):
    units = fim.UnitEnds(np.frombuffer(text.encode(), np.uint8))
    k = np.arange(len(text) + 1)
    places = [len(text[:i].encode()) for i in k]
    assert units.select(k).tolist() == places and units.rank(np.array(places)).tolist() == k.tolist()


@given(st.text(alphabet=st.sampled_from("<PSM>a"), max_size=20), st.integers(0, 20), st.integers(0, 20))
def test_outputs_are_parted_again(text, x, y):
    raw, a, b = text.encode(), min(x, y, len(text)), min(max(x, y), len(text))
    forms = [fim.PLAIN] if any(m in raw for m in (fim.PREFIX, fim.SUFFIX, fim.MIDDLE)) else [fim.PLAIN, fim.PSM, fim.SPM]
    for form in forms:
        assert fim.restore(fim.arrange(raw, form, a, b), form) == raw


def brute(doc_id, text):
    t = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(t)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, t
    p, m, s = t[:a], t[a:b], t[b:]
    return (doc_id, n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (doc_id, n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def test_against_brute_force(spark):
    rows = [*enumerate(cases.texts()), *((100 + k, t) for k, t in enumerate(["<P>x", "a<S>", "<M>", "<", "𝄞" * 50, "é"])), (None, "null id"), (3, "again"), (3, "again"), (-5, "negative")]
    rows += [(1000 + k, "été " * k) for k in range(200)]
    got = fim.transform(cases.documents(spark, rows)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr(brute(i, t)) for i, t in rows)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_digests_rebuild_the_text(spark):
    rows = [*enumerate(cases.texts())]
    got = {r.doc_id: r for r in fim.digests(cases.documents(spark, rows)).collect()}
    for i, t in rows:
        assert got[i].restored_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
        assert got[i].output_sha256 == hashlib.sha256(brute(i, t)[5].encode()).hexdigest()


def test_empty_table(spark):
    assert fim.digests(cases.empty(spark)).collect() == []
