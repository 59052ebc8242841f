"""Replay of edit scripts: what a bill states in full is cleared, anything else is held."""

import random

import pytest

from parchment.functions import amendments as rules
from parchment.operators import amendments

WORDS = "members senate meeting session quorum treasurer budget report student council election ballot office officer chair clerk".split()
REVISIONS, BILLS = "doc_id int, kind string, before string, after string", "doc_id int, bill_id int, kind string, content string, passed boolean"


def run(spark, revisions, bills):
    return {r.doc_id: r for r in amendments.cleared(spark.createDataFrame(revisions, REVISIONS), spark.createDataFrame(bills, BILLS)).collect()}


def script(r):
    """(before, after, bill) with random edits of distinct sentences."""
    sentences = [f"Clause {k}: the {r.choice(WORDS)} of {r.choice(WORDS)} number {k} shall {r.choice(WORDS)}." for k in range(12)]
    lines, out = ["## Amendments to the Bylaws"], []
    for k, s in enumerate(sentences):
        new = f"Clause {k}: a new {r.choice(WORDS)} is made {k}."
        how = r.choice(["", "", "replace", "passive", "delete", "after", "before", "table"])
        if how == "replace":
            lines.append(f"{r.choice(['- ', '3) ', ''])}Replace the text “{s}” with \"{new}\".")
            out.append(new)
        elif how == "passive":
            lines.append(f"The words \"{s}\" are hereby replaced by \"{new}\"")
            out.append(new)
        elif how == "delete":
            lines.append(f"Strike \"{s}\";")
        elif how in ("after", "before"):
            lines.append(f"Insert \"{new}\" immediately {how} \"{s}\".")
            out += [s, new] if how == "after" else [new, s]
        elif how == "table":
            lines += ["", "| Current Language | Proposed Language |", "|---|:---:|", f"| {s} | **{new}** |", ""]
            out.append(new)
        else:
            out.append(s)
    r.shuffle(lines[1:])
    return "**" + sentences[0][:6] + "**" + sentences[0][6:] + "\n\n" + "\n".join(sentences[1:]), " ".join(out), "\n".join(lines)


def test_random_scripts_replay(spark):
    r = random.Random(1)
    scripts = [s for s in (script(r) for _ in range(120)) if s[2].count("\n")]
    revisions = [(k, "guiding.bylaws", b, a if k % 3 else a.replace("new", "now", 1) + " Extra.") for k, (b, a, _) in enumerate(scripts)]
    got = run(spark, revisions, [(k, 7, "bill.other", bill, True) for k, (_, _, bill) in enumerate(scripts)])
    for k in range(len(scripts)):
        assert got[k].reason == ("exact" if k % 3 else "not all changes"), (scripts[k], got[k])
        assert got[k].clear == (k % 3 > 0) == bool(got[k].edits)


BEFORE, AFTER = "The chair shall preside. The clerk shall write.", "The head shall preside. The clerk shall write."
SAID = 'Replace "The chair shall" with "The head shall".'
CASES = [
    ("exact", "guiding.bylaws", BEFORE, AFTER, [("bill.bylaws_amendment", SAID, True)]),
    ("no instruction", "guiding.constitution", BEFORE, AFTER, [("bill.bylaws_amendment", SAID, True)]),
    ("no governing text", "minutes", BEFORE, AFTER, [("bill.bylaws_amendment", SAID, True)]),
    ("no passed bill", "guiding.bylaws", BEFORE, AFTER, [("bill.bylaws_amendment", SAID, False)]),
    ("incomplete", "guiding.bylaws", None, AFTER, [("bill.bylaws_amendment", SAID, True)]),
    ("looks only", "guiding.bylaws", BEFORE, "**The chair** shall preside.\nThe clerk shall write.", [("bill.bylaws_amendment", SAID, True)]),
    ("ambiguous", "guiding.bylaws", BEFORE + " " + BEFORE, AFTER + " " + BEFORE, [("bill.bylaws_amendment", SAID, True)]),
    ("conflicting", "guiding.bylaws", BEFORE, AFTER, [("bill.bylaws_amendment", SAID, True), ("bill.bylaws_amendment", SAID.replace("head", "boss"), True)]),
    ("overlapping", "guiding.bylaws", BEFORE, AFTER, [("bill.bylaws_amendment", SAID + '\nStrike "chair shall preside"', True)]),
    ("delayed", "guiding.bylaws", BEFORE, AFTER, [("bill.bylaws_amendment", SAID + "\nThis act shall take effect next year.", True)]),
    ("exact", "guiding.bylaws", BEFORE, AFTER, [("bill.bylaws_amendment", SAID + "\nThis act shall take effect immediately.", True), ("bill.bylaws_amendment", SAID, True)]),
    ("no instruction", "guiding.bylaws", BEFORE, AFTER, [("bill.bylaws_amendment", "Rationale\n" + SAID, True)]),
    ("exact", "guiding.bylaws", BEFORE, AFTER, [("bill.bylaws_amendment", "Rationale\nwhy\nAmendments\n" + SAID, True)]),
    ("exact", "guiding.constitution", BEFORE, AFTER, [("bill.bylaws_amendment", "Amendments to the Constitution:\n" + SAID, True)]),
    ("no instruction", "guiding.bylaws", BEFORE, AFTER, [("bill.bylaws_amendment", "This does not " + SAID.lower(), True)]),
    ("too many bills", "guiding.bylaws", BEFORE, AFTER, [("bill.bylaws_amendment", SAID, True)] * 13),
    ("bill too long", "guiding.bylaws", BEFORE, AFTER, [("bill.bylaws_amendment", SAID + "\n" + "x " * 95_000, True)]),
]


def test_what_is_held(spark):
    got = run(spark, [(k, kind, b, a) for k, (_, kind, b, a, _) in enumerate(CASES)], [(k, n, *x) for k, case in enumerate(CASES) for n, x in enumerate(case[4])])
    assert [got[k].reason for k in range(len(CASES))] == [c[0] for c in CASES]


@pytest.mark.parametrize("row", ["| old words here | none |", "| old words here |  |", "| old ... words | new words |", "|---|---|", "| short | shorter |"])
def test_rows_that_state_nothing(row):
    assert rules.read_edits(f"| Current | Proposed |\n{row}", "bylaws") == []


def test_struck_cells_and_parts():
    got = rules.read_edits("| Original text | New text |\n|-|-|\n| the ~~first~~ part<br>===<br>the second part | the ~~first~~ 1st part === the 2nd part |", "bylaws")
    assert [(e.before, e.after) for e in got] == [("the first part", "the 1st part"), ("the second part", "the 2nd part")]
