"""Kinds of files by the first rule that fits, and the lines that describe them."""

from pyspark.sql import functions as F

from parchment.functions import markdown
from parchment.operators import kinds
from tests.oracles import SMALL, assert_same, connection

#: (name, folder, content, kind): what each rule is there for.
CASES = [
    ("Senate GBM #15", "a/112", "", "minutes.senate"),
    ("Exec Minutes 4/1", "03_Committees/IA", "", "minutes.executive"),
    ("Fall Meeting", "03_Committees/Internal Affairs/Fall 2026", "", "minutes.committee"),
    ("SGA Bill Template", "bills", "A Bill to fund", "template"),
    ("Bylaws 2024", "Guiding documents", "", "guiding.bylaws"),
    ("Bylaws 2024", "Constitution", "", "guiding.bylaws"),
    ("Untitled", "Constitution", "", "guiding.constitution"),
    ("Constitution Amendment", "x", "", "bill.constitution_amendment"),
    ("Bylaws and constitution resolution", "x", "", "bill.bylaws_constitution_amendment"),
    ("The Accountability Act", "x", "", "bill.other"),
    ("The Accountability Act", "x", "Act to amend the Bylaws\nmore", "bill.bylaws_amendment"),
    ("The Accountability Act", "x", "Act to amend the Bylaws\nand the constitutional amendment proposed in this bill", "bill.bylaws_constitution_amendment"),
    ("Resolution on Dining", "x", "", "resolution"),
    ("S.B. 4", "x", "An SGA Bill\nto fund the **festival**", "bill.other"),
    ("S.B. 4 budget", "x", "An SGA Bill\nto fund the festival", "bill.funding"),
    ("SGA-B-3", "x", "A bill of Standing Rules", "bill.senate_rules"),
    ("Writ of Certiorari", "x", "", "judicial.writ_of_certiorari"),
    ("Opinion on the writ of certiorari", "Judiciary", "", "judicial.opinion"),
    ("filing", "Judiciary", "asks for an ADVISORY OPINION", "judicial.advisory_opinion"),
    ("filing", "Judiciary", "", "judicial.other"),
    ("Judiciary Minutes", "Judiciary", "", "minutes.judicial"),
    ("Complaint", "Judiciary", "", "judicial.complaint"),
    ("Attendance guidelines", "x", "", "reference"),
    ("Attendance 4/1", "x", "", "attendance"),
    ("Contact list", "x", "", "directory"),
    ("IMG_2.jpg", "x", "", "media"),
    ("My CV", "x", "", "resume"),
    ("Bill Voting Records", "x", "", "tracker"),
    ("Committee Updates", "x", "", "presentation"),
    ("Updates", "x/Agenda", "", "presentation"),
    ("untitled", "x", "Dear all,\nhello", "correspondence"),
    ("4/1", "x/Agendas and Minutes", "", "minutes.other"),
    ("Meeting with Dean", "x", "", "notes.meeting"),
    ("plain", "Guiding Documents", "", "guiding.other"),
    ("untitled", "x", "", "unknown"),
    (None, None, None, "unknown"),
]


def test_first_rule_that_fits(spark):
    rows = [(k, n, f, c, None, None) for k, (n, f, c, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "id int, name string, folder_path string, content string, shown string, mime string")
    got = {r.id: r.kind for r in kinds.classified(df).collect()}
    assert {k: got[k] for k in got if got[k] != CASES[k][3]} == {}
    slides = spark.createDataFrame([(1, "Updates", "x", "", "", "application/vnd.presentation"), (2, "x", "y", "", "Senate Agenda", ""), (2, "x", "y", "", "Senate Agenda", "")], df.schema)
    reviewed = spark.createDataFrame([(2, "plan"), (9, "report")], "id int, kind string")
    assert sorted(tuple(r) for r in kinds.classified(slides).collect()) == [(1, "presentation"), (2, "minutes.senate"), (2, "minutes.senate")]
    assert sorted(tuple(r) for r in kinds.classified(slides, reviewed).collect()) == [(1, "presentation"), (2, "plan"), (2, "plan")]
    assert kinds.classified(df.limit(0)).count() == 0


def test_descriptions(spark):
    long = "word " * 80
    cases = [
        ("# Title of it\n\nThe senate met **today** in [the hall](http://x).", "The senate met today in the hall."),
        ("# Only a heading\n\n## Second one", "Only a heading"), ("Join Zoom Meeting\n\nA text that tells.", "A text that tells."), ("Attendance\n\nPresent: Ann\n\n| a | b |\n|---|---|", ""),
        ("Absentees: excused\n\nIt was decided.", "It was decided."), ("Absentees: Ann Lee\n\nIt was decided.", "Absentees: Ann Lee"), ("", ""), (None, ""), ("![][image1]\n\n1. ## Call to Order here\n\n[image1]: <data:image/png;base64,xx>", "Call to Order here"),
        (long, ("word " * 59).strip() + "..."), ("x" * 400, "x" * 297 + "..."), ("a  \n b\\. and c", "a b. and c"), ("a b. c", ""), ("Tab 12\n\nMonday 5 pm EDT\n\nReal words follow.", "Real words follow."),
    ]
    got = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(cases)], "k int, t string").select("k", markdown.description(F.col("t")).alias("d")).collect()
    assert {r.k: r.d for r in got} == {k: d for k, (_, d) in enumerate(cases)}


def test_queries_equal_their_sql(spark):
    con = connection()
    for name in kinds.REGISTRY.queries:
        assert_same(kinds.REGISTRY.queries[name](spark, SMALL), con, kinds.REGISTRY.oracles[name])


def test_one_scan_without_a_shuffle(spark):
    plan = kinds.document_kinds(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_lines_of_a_whole_text(spark):
    """Replacements over a text find what they find line by line."""
    import random

    rnd, bits = random.Random(4), ["[a](b)", "[a]", "[]", "(x)", "![i](j)", "[image1]", "\n", "\n", "\n\n", " ", "  ", "\t", "|", "---", ":|-", "- ", "1. ", "2) ", "# ", "## ", "*", "_", "\\.", "\\", "[[", "]]", "word", "Ñu", "<br>", "> ", "[r]: u", "~", "[i]: <data:image/png;x>"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randrange(30))) for _ in range(1500)]
    by_line = F.array_join(F.transform(F.split("t", "\n"), markdown.prose), "\n")
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", by_line.alias("want"), markdown.prose_lines(F.col("t")).alias("got")).where("want is distinct from got").limit(5).collect()
    assert [tuple(r) for r in got] == []
