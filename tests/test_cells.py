"""Breaks restored in table cells: whole cases, and that nothing outside the cells moves."""

import random

from pyspark.sql import functions as F

from parchment.functions import cells
from parchment.operators import anchors
from tests.oracles import SMALL

CASES = [
    ("| Item | Notes |\n| --- | --- |\n| 1 | First line. Second **line.** Third |", "<table><tr><td>Item</td><td>Notes</td></tr><tr><td>1</td><td><p>First line.</p><p>Second line.</p><p>Third</p></td></tr></table>",
     "| Item | Notes |\n| --- | --- |\n| 1 | First line.<br>Second **line.**<br>Third |"),
    ("| see [the act](http://x/a_\\(b\\)) next |", "<table><tr><td>see the act<br>next</td></tr></table>", "| see [the act](http://x/a_\\(b\\))<br>next |"),
    ("| [S.B. 1 | The Act](u) and | b |", "<table><tr><td><li>S.B. 1 | The Act</li>and</td><td>b</td></tr></table>", "| [S.B. 1 | The Act](u)<br>and | b |"),
    ("| one two |", "<table><tr><td><p>one</p><p>three</p></td></tr></table>", "| one two |"),  # a line that isn't there
    ("| one<br>two |", "<table><tr><td><p>one</p><p>two</p></td></tr></table>", "| one<br>two |"),
    ("| said so[a] done |", '<table><tr><td><p>said so[a]</p><p>done<sup><a href="#cmnt1">[b]</a></sup></p></td></tr></table>', "| said so[a]<br>done |"),
    ("| it’s here and now |", "<table><tr><td><p>it&rsquo;s here</p><p>and now</p></td></tr></table>", "| it’s here<br>and now |"),
    ("text\n\n| alpha beta gamma |", "<table><tr><td>page <table><tr><td><p>alpha</p><p>beta gamma</p></td></tr></table></td></tr></table>", "text\n\n| alpha<br>beta gamma |"),
    ("| 1.2.1 old words 1.2.2 more |", "<table><tr><td><p>1.2.1 new words</p><p>1.2.2 more</p></td></tr></table>", "| 1.2.1 old words<br>1.2.2 more |"),
    ("| a \\| b c |", "<table><tr><td><p>a | b</p><p>c</p></td></tr></table>", None),
    ("no table", "<table><tr><td>x<br>y</td></tr></table>", "no table"), ("| a b |", "", "| a b |"), ("", "", ""), ("| a b |", "<table><tr><td>a<br>b", "| a<br>b |"),
    ("| |\n|---|\n||", "<table></table>", "| |\n|---|\n||"),
]


def test_cases():
    for markdown, html, want in CASES:
        got, _ = cells.restored(markdown, html)
        assert want is None or got == want, markdown


def test_nothing_outside_cells_moves():
    rnd = random.Random(3)
    word = lambda: rnd.choice(["ann", "bob", "cid", "dee", "**eve**", "[fox](u)", "~~hal~~"])
    bare = lambda w: w.strip("*_~").split("]")[0].strip("[")
    for _ in range(300):
        md, html, want = ["head " + word()], [], ["head "]
        want[0] = md[0]
        for _ in range(rnd.randrange(1, 4)):
            rows = [[[[word() for _ in range(rnd.randrange(1, 4))] for _ in range(rnd.randrange(1, 4))] for _ in range(2)] for _ in range(rnd.randrange(1, 4))]
            for row in rows:
                md.append("| " + " | ".join(" ".join(" ".join(line) for line in cell) for cell in row) + " |")
                want.append("| " + " | ".join("<br>".join(" ".join(line) for line in cell) for cell in row) + " |")
            html.append("<table>" + "".join("<tr>" + "".join("<td>" + "".join("<p>" + " ".join(map(bare, line)) + "</p>" for line in cell) + "</td>" for cell in row) + "</tr>" for row in rows) + "</table>")
            md.append("between " + word())
            want.append(md[-1])
        text = "\n".join(md)
        got, points = cells.restored(text, "<p>x</p>".join(html))
        assert got == "\n".join(want)
        for k, c in enumerate(text):
            if c != " ":
                assert got[cells.moved(k, text, points)] == c


def test_query_gives_every_text_its_lines(spark):
    want = anchors.tabled(spark, SMALL).select("doc_id", F.concat(F.lit("| a | b |\n| --- | --- |\n| x | "), F.array_join("lines", "<br>"), F.lit(" |\nafter")).alias("want"), (F.greatest(F.size("lines"), F.lit(1)) - 1).alias("n"))
    got = anchors.table_cells_restored(spark, SMALL).join(want, "doc_id")
    rows = got.select("doc_id", "n_breaks", "n", (F.md5("want") == F.col("digest")).alias("same")).collect()
    assert len(rows) == want.count() and [r for r in rows if r.n_breaks != r.n or not r.same] == []
    empty = spark.createDataFrame([(1, None, None)], "k int, markdown string, html string")
    assert [tuple(r) for r in anchors.cells_restored(empty, "k").collect()] == [(1, "", 0)]
