"""Positions against markers that are found again, quotes and citations against plain rules."""

import random

import pytest

from parchment.functions import text as rules
from parchment.operators import anchors

PIECES = ["![a](b)", "![]()", "![x][y]", "[]", "~[](u)", "[image3]", "[IMAGE12]", "  ", "\t", "\n", "\n\n\n\n", "word", "é", "\n[ref]: <data:image/png;base64,AAA> \"t\"\n", " \r\n", "[kept](u)", "[image]"]


@pytest.mark.parametrize("seed", range(3))
def test_positions_follow_their_characters(seed):
    """Marked characters are never removed: where each stands afterwards is its offset."""
    r = random.Random(seed)
    for _ in range(300):
        marks = [chr(0x4E00 + k) for k in range(6)]
        parts = [r.choice(PIECES) for _ in range(r.randint(0, 14))]
        for m in marks:
            parts.insert(r.randint(0, len(parts)), m)
        text = "".join(parts)
        content, offsets = rules.sanitised(text, [text.index(m) for m in marks])
        if all(m in content for m in marks):  # a mark may stand inside brackets that go
            assert [content.index(m) for m in marks] == offsets
        assert rules.sanitised(text, [])[0] == content


def test_positions_inside_what_goes():
    assert rules.sanitised("ab![x](y)cd", [0, 2, 4, 9, 10, 11]) == ("abcd", [0, 2, 2, 2, 3, 4])
    assert rules.sanitised("a\n\n\n\n\nb", [1, 2, 3, 4, 6, 7]) == ("a\n\nb", [1, 2, 3, 3, 3, 4])
    assert rules.sanitised("  x  ", [0, 1, 2, 3, 5]) == ("x", [0, 0, 0, 1, 1])
    assert rules.sanitised("", [0]) == ("", [0])


def test_exports(spark):
    rows = [(1, "a ![p](q)b", [0, 9]), (2, None, None), (3, "x", []), (3, "x", [])]
    got = anchors.sanitised(spark.createDataFrame(rows, "id int, markdown string, positions array<int>"), "id").collect()
    assert sorted((r.id, r.content, r.offsets) for r in got) == [(1, "a b", [0, 2]), (2, "", []), (3, "x", []), (3, "x", [])]


def test_reanchoring_and_what_turns_stale(spark):
    texts = [(1, "# New\nThe chair shall preside over “all” meetings of the council. The end."), (2, None), (3, "twice twice")]
    notes = [("a", 1, "The chair shall preside", None), ("b", 1, 'over "all" meetings', None), ("c", 1, "was dropped from here", None), ("d", 2, "anything", None), ("e", 3, "twice", None), ("f", 9, "elsewhere", None), ("g", 1, None, None)]
    got = anchors.reanchored(spark.createDataFrame(notes, "annotation_id string, doc_id int, quote string, orphaned_at timestamp"), spark.createDataFrame(texts, "doc_id int, text string"))
    rows = {r.annotation_id: r for r in got.collect()}
    text = texts[0][1]
    assert text[rows["a"].start_at : rows["a"].end_at] == "The chair shall preside" and text[rows["b"].start_at : rows["b"].end_at] == "over “all” meetings"
    assert {k for k, r in rows.items() if r.orphaned} == {"c", "d", "e", "g"} and "f" not in rows
    owners = lambda *x: spark.createDataFrame(list(x), "owner_id string, status string")
    cites = lambda *x: spark.createDataFrame(list(x), "owner_id string, annotation_id string")
    out = anchors.gone_stale(got.where("orphaned"), {
        "section": (owners(("s1", "fresh"), ("s2", "fresh"), ("s3", "failed")), cites(("s1", "a"), ("s2", "a"), ("s2", "c"), ("s2", "d"), ("s3", "c"))),
        "summary": (owners(("s1", "fresh"), ("s4", "fresh")), cites(("s1", "c"), ("s4", "b"))), "answer": (owners(("q", "fresh")), cites(("q", "e"))),
    })
    assert sorted(map(tuple, out.collect())) == [("answer", "q", "stale"), ("section", "s1", "fresh"), ("section", "s2", "stale"), ("section", "s3", "failed"), ("summary", "s1", "stale"), ("summary", "s4", "fresh")]
