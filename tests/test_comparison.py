"""Text comparison against plain Python."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parchment.functions import text as rules
from parchment.operators import comparison


def brute_cosmetic(text):
    out = []
    for line in re.split(r"\r?\n", text):
        line = re.sub(r"\*\*|__", "", line.strip(" "))
        line = re.sub(r"(?<!\w)[*_]([^*_\n]+)[*_](?!\w)", r"\1", line, flags=re.A)
        line = re.sub(r"^(\d+(?:\.\d+)+)\.(?=\s)", r"\1", line, flags=re.A)
        if re.match(r"(?:bylaws|constitution)\s+of\b", line, re.I | re.A) and len(line) < 120 and not re.search(r"[.!?;:]", line):
            line = line.lower()
        line = re.sub(r"[\t ]+", " ", line)
        if line:
            out.append(line)
    return "\n".join(out)


TEXTS = ["The **Board** meets\n\n1.2. Each  term", "The Board meets\n1.2 Each term", "BYLAWS of the Club\nArticle", "Bylaws Of The Club\nArticle", "a_b_c *x* (_y_) __z__", "a_b_c x (y) z", "", "  \n ", "Constitution of it: now\nx", "CONSTITUTION of it: now\nx", "one\r\ntwo", "one\ntwo"]


def test_cosmetic_changes(spark):
    pairs = [(a, b) for a in TEXTS for b in TEXTS]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", comparison.is_cosmetic(F.col("a"), F.col("b"))).collect()
    assert [bool(r[2]) for r in got] == [brute_cosmetic(a) != "" and brute_cosmetic(a) == brute_cosmetic(b) for a, b in pairs]
    assert sum(bool(r[2]) for r in got) > len(TEXTS)


def brute_verdict(kind, before, after):
    d = rules.line_diff(before, after)
    if not before.strip():
        return "new", ""
    if before == after:
        return "unchanged", ""
    if kind.startswith("guiding."):
        return ("cosmetic" if brute_cosmetic(before) == brute_cosmetic(after) else "hold"), ""
    gone, left, least = comparison.STRICT if kind.startswith("bill.") else comparison.ORDINARY
    large = ""
    if not kind.startswith("working.") and d["removed"] >= least:
        large = "lines" if d["removed"] / len(before.split("\n")) >= gone else "length" if len(after) / len(before) < left else ""
    return "publish", large


def test_verdicts(spark):
    r = random.Random(2)
    rows = []
    for kind in ("guiding.rules", "bill.draft", "minutes.plenary", "working.notes"):
        for k in range(60):
            lines = [f"line {r.randint(0, 30)} " + "x" * r.randint(0, 20) for _ in range(r.randint(0, 60))]
            after = [x if r.random() > 0.05 else x.replace("line", "**line**") for x in lines if r.random() > r.choice((0.0, 0.05, 0.2, 0.6))]
            rows.append((kind, "\n".join(lines), "\n".join(after if k % 7 else lines)))
    got = comparison.verdicts(spark.createDataFrame(rows, "kind string, before string, after string")).collect()
    want = {(k, a, b): brute_verdict(k, a, b) for k, a, b in rows}
    assert all((x.verdict, x.large) == want[x.kind, x.before, x.after] for x in got)
    assert {"lines", "length"} & {x.large for x in got} and {x.verdict for x in got} >= {"unchanged", "hold", "publish"}


@settings(deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=30), st.lists(st.sampled_from("abcd"), max_size=30))
def test_differences_rebuild_both_texts(a, b):
    d = rules.line_diff("\n".join(a), "\n".join(b))
    old = [x for op, lines in d["ops"] if op != "add" for x in lines]
    new = [x for op, lines in d["ops"] if op != "remove" for x in lines]
    assert old == "\n".join(a).split("\n") and new == "\n".join(b).split("\n")
    short = rules.collapsed(d["ops"])
    assert sum(n for op, n, _ in short if op in ("same", "skipped")) == sum(len(x) for op, x in d["ops"] if op == "same")
    assert all(len(x) <= 6 for op, _, x in short if op == "same") or len(d["ops"]) == 1


@given(st.text(alphabet='ab ,"\t', max_size=25))
def test_cell_ranges_spell_the_cells(line):
    got = ["".join(line[a - 7 : b - 7] for a, b in cell) for cell in rules.cell_ranges(line, 7)]
    assert got == rules.parse_csv_line(line)


def test_quotes_around_names():
    text = "Ann Lee, chair\nBob Ray, Ann Lee\nCid"
    assert rules.unique_quote_around(text, "Cid") == "Cid"
    assert rules.unique_quote_around(text, "Ann Lee") == "Ann Lee, chair"
    assert rules.unique_quote_around(text, "Nobody") is None and rules.unique_quote_around(text, " ") is None


def test_topic_excerpts():
    parts = [f"# H{k}\n" + ("about dining " if k in (2, 9) else "about other ") * 40 + "\n" for k in range(12)]
    text = "".join(parts)
    assert rules.topic_excerpt(text, re.compile("dining")) == text
    short = rules.topic_excerpt(text, re.compile("dining"), whole=100, budget=2500)
    assert "dining" in short and rules.GAP in short and len(short) < 2600 and all(x in text for x in short.split(rules.GAP))
    assert rules.topic_excerpt(text, re.compile("zzz"), whole=100, budget=50) == text[:50]


@pytest.mark.parametrize(("content", "want"), [("a [3] b [1] [9] c [3].", "a [1] b [2] c [1]."), ("no marks", "no marks"), ("[9]", ""), ("x [2] , y", "x [1], y")])
def test_renumbered_citations(spark, content, want):
    df = spark.createDataFrame([(content,)], "c string")
    assert df.select(comparison.renumbered(F.col("c"), F.array(F.lit(1), F.lit(2), F.lit(3)))).first()[0] == want
