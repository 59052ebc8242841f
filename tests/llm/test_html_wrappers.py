import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parchment.llm import html_wrappers as W

SCHEMA = "page_id long, url string, html string, host string, wrapper string, pages long, salt int"


def words(r, n):
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(n)) + "."


def blocks(r):
    return [words(r, 6), *(words(r, r.randint(20, 60)) for _ in range(r.randint(2, 6)))]


def marked(r, k):
    b = blocks(r)
    body = "".join(f"<p>{x}</p>" for x in b[1:])
    side = f"<aside><p>{words(r, 30)}</p></aside><div class='widget-area sidebar-2'><p>{words(r, 25)}</p></div>"
    page = f"""<html><head><title>{b[0]}</title><script>if (a < b) document.write("<p>no</p>")</script></head><body class="single-post has-sidebar">
<header><h1>The site</h1><p>since 1900</p></header><nav><ul>{"<li><a href='/x'>menu</a></li>" * r.randint(2, 6)}</ul></nav>
<div class="cookie-notice">We use cookies on this page, and so on and on.</div>
<main><article id="post-{k}"><h1>{b[0]}</h1>{'<p class="ad">buy</p>' * r.randint(0, 1)}{body}<form><label>mail</label><button>go</button></form></article>
<section id="comments"><article><p>{words(r, 80)}</p></article></section></main>{side if r.random() < .5 else ""}<footer>&copy; all</footer></body></html>"""
    return page, b


def unmarked(r, k):
    b = blocks(r)
    body = "".join(f"<div>{x}</div>" if r.random() < .3 else f"<p>{x}" for x in b[1:])
    menu = "".join(f"<div><a href=/{i}>{words(r, 2)}</a></div>" for i in range(r.randint(2, 5)))
    return f"<body><div class=c1>{menu}</div><div class=c2><h2>{b[0]}</h2>{body}<div class=c9>Printed by the one and only press of this town</div></div><div class=c3>all rights are ours</div></body>", b


def content_block(r, k):
    b = blocks(r)
    quotes = "".join(f"<h3>{x}</h3><blockquote>{x}</blockquote>" for x in b[1:])
    return f"<div id='page'><div id='menu'>a b c</div><div class='entry-content'><h1>{b[0]}</h1>{quotes}</div><div id='related-posts'>{words(r, 90)}</div></div>", [b[0], *(x for y in b[1:] for x in (y, y))]


LAYOUTS = {"marked": marked, "unmarked": unmarked, "content": content_block}


def made(n=40, seed=5):
    r = random.Random(seed)
    rows, truth = [], {}
    for k in range(n):
        for j, (host, f) in enumerate(LAYOUTS.items()):
            html, b = f(r, k)
            rows.append((3 * k + j, f"http://{host}.example/{k}", html))
            truth[3 * k + j] = "\n".join(b)
    return rows, truth


def frame(spark, rows):
    return spark.createDataFrame([(*x, "h", "w", 1, 2) for x in rows], SCHEMA)


def test_layouts(spark):
    rows, truth = made()
    got = {r.page_id: r.text for r in W.extract(frame(spark, rows).repartition(5)).collect()}
    assert got == truth


def test_the_hosts_own_words_need_a_wrapper():
    rows, truth = made()
    page = next(h for i, _, h in rows if i % 3 == 1)
    assert "the one and only press" in W.main_text(page, None)


def test_salted_join_gives_the_same(spark, monkeypatch):
    rows, truth = made(12)
    monkeypatch.setattr(W, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(W, "HOT", 3)
    assert {r.page_id: r.text for r in W.extract(frame(spark, rows)).collect()} == {r.page_id: r.text for r in W.extract(frame(spark, rows)).collect()}
    assert len(W.extract(frame(spark, rows)).collect()) == len(rows)


ODD = [
    (1, None, "<article>a &amp; b&nbsp; c<br>d</article>", "a & b c d"), (2, "http://x.example/", None, ""), (3, "http://x.example/", "", ""), (4, "no host", "<p>one<p>two", "one\ntwo"),
    (5, "http://y.example/", "plain < text & more", "plain < text & more"), (6, "http://z.example/", "<article></article>", ""), (None, "http://z.example/", "<ul><li>a<li>b</ul>x", "a\nb\nx"),
    (8, "http://deep.example/", "<div>" * 3000 + "deep" + "</div>" * 3000 + "<nav>" * 500, "deep"), (9, "http://q.example/", "<article><p>a</p><script>x</article>", "a"),
    (10, "http://w.example/", '<article><p title="a>b">c</p></article>', "c"), (11, "http://v.example/", "<article>&lt;b&gt; <b>bold</b>ly</article>", "<b> boldly"),
    (12, "http://t.example/", "<article>" + "<p>long</p>" * 50_000 + "</article>", "\n".join(["long"] * 50_000)),
]


def test_defined_cases(spark):
    rows = [x[:3] for x in ODD] + [ODD[0][:3]]
    got = W.extract(frame(spark, rows)).collect()
    want = {i: (u, t) for i, u, _, t in ODD}
    assert len(got) == len(rows)
    for r in got:
        assert (r.url, r.text) == want[r.page_id] and r.n_chars == len(r.text)


def test_no_pages(spark):
    assert W.extract(frame(spark, [])).collect() == []


tree = st.recursive(st.sampled_from(["x"]), lambda kids: st.tuples(st.sampled_from(["p", "div", "h2", "ul"]), st.lists(kids, max_size=5)), max_leaves=14)


def spelled(t):
    return t if isinstance(t, str) else f"<{t[0]}>{''.join(map(spelled, t[1]))}</{t[0]}>"


def accepts(items, nodes):
    """Whether a wrapper's sequence accepts a page's unfolded nodes, by sets of places as for any regular expression."""
    places = {0}
    for item in items:
        def once(at, item=item):
            if item.label == "()":
                return accepts_from(item.kids, nodes, {at})
            return {at + 1} if at < len(nodes) and nodes[at].label == item.label and accepts(item.kids, nodes[at].kids) == {len(nodes[at].kids)} else set()

        reached = set(places) if item.maybe else set()
        new = set().union(*map(once, places))
        reached |= new
        while item.many and new:
            new = set().union(*map(once, new)) - reached
            reached |= new
        places = reached
    return places & {len(nodes)}


def accepts_from(items, nodes, places):
    for item in items:
        def once(at, item=item):
            if item.label == "()":
                return accepts_from(item.kids, nodes, {at})
            return {at + 1} if at < len(nodes) and nodes[at].label == item.label and accepts(item.kids, nodes[at].kids) == {len(nodes[at].kids)} else set()

        reached = set(places) if item.maybe else set()
        new = set().union(*map(once, places))
        reached |= new
        while item.many and new:
            new = set().union(*map(once, new)) - reached
            reached |= new
        places = reached
    return places


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(tree, max_size=4), min_size=1, max_size=5))
def test_a_wrapper_accepts_every_page_it_was_made_of(pages):
    html = ["".join(map(spelled, p)) for p in pages]
    wrapper = W.Wrapper.of_page(html[0])
    for h in html[1:]:
        wrapper.take(W.Wrapper.of_page(h))
    again = W.Wrapper.loads(wrapper.dumps())
    for h in html:
        nodes = W.Reader(h).root.kids
        assert accepts(again.tree.kids, nodes) == {len(nodes)}


def test_hosts(spark):
    rows = frame(spark, [(1, "HTTPS://User:x@A.Example:80/p?q", ""), (2, "ftp://b.example", ""), (3, "//c", "")])
    assert [r.host for r in W.with_host(rows).orderBy("page_id").select(F.col("host")).collect()] == ["a.example", "b.example", ""]


@pytest.mark.parametrize("mark, kind", [("div.ad-slot", "aside"), ("body.has-sidebar", ""), ("div.with-sidebar", ""), ("div.post-header", "header"), ("section#comments", "aside"), ("article", "article"), ("div.entry-content", "main"), ("nav", "never"), ("p.content", "")])
def test_kinds(mark, kind):
    assert W.kind_of(mark) == kind
