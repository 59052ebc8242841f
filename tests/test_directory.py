from pyspark.sql import functions as F

from parchment.operators import directory


def brute_split(text):
    """By walking over the characters with the depth of parentheses."""
    out, depth, start, i = [], 0, 0, 0
    while i < len(text):
        depth += text[i] == "("
        depth -= text[i] == ")"
        word = text[i : i + 3] == "and" and not (i and (text[i - 1].isalnum() or text[i - 1] == "_")) and not text[i + 3 : i + 4].isalnum() and text[i + 3 : i + 4] != "_"
        if depth == 0 and (text[i] in ",;&/•" or word):
            out.append(text[start:i])
            i += 2 * word
            start = i + 1
        i += 1
    return [x.strip() for x in [*out, text[start:]] if x.strip()]


def test_lists_are_parted_outside_parentheses(spark):
    texts = ["A, B (x, y) and C", "A & B; C/D • E", "Sandy and Anderson", "(a, b)", "", "and", "A (b and c) D, E", "A,and B"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", directory.split_people(F.col("t"))).collect()
    assert [list(r[1]) for r in got] == [brute_split(t) for t in texts]


def test_people_of_lines(spark):
    lines = [(1, 1, "Introduced by: Ann Lee (chair, x), Bob Ray"), (1, 2, "- Sponsors: Cid Moe"), (1, 3, "Authors: ANN LEE and Dan Poe"), (1, 4, "They said: Eve Fox"), (2, 1, "Present: ")]
    got = sorted(tuple(r) for r in directory.people_of_lines(spark.createDataFrame(lines, "doc int, line int, text string")).collect())
    assert got == [(1, "introducer", "Ann Lee", "chair, x", 1), (1, "introducer", "Bob Ray", "", 1), (1, "introducer", "Dan Poe", "", 3), (1, "sponsor", "Cid Moe", "", 2)]


def test_sections_are_carried_down(spark):
    rows = [(1, 1, "a,b"), (1, 2, "Board,"), (1, 3, "c,d"), (1, 4, "e,f"), (1, 5, "Staff,"), (1, 6, "g,"), (2, 1, "h,i")]
    df = spark.createDataFrame(rows, "sheet int, line int, text string")
    got = [(r.sheet, r.line, r.section) for r in directory.sections_carried(df, "sheet", "line", F.split("text", ",")).orderBy("sheet", "line").collect()]
    assert got == [(1, 1, None), (1, 3, "Board"), (1, 4, "Board"), (2, 1, None)]  # "g," has its first cell alone, so it heads what follows
