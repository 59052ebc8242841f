"""Line differences against every subsequence, words that changed against a plain count, decisions against each bill's own rows."""

import datetime as dt
import random
import re
import unicodedata
from collections import Counter
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from parchment.functions import text as rules
from parchment.operators import records, upkeep


def longest(x, y):
    @lru_cache(None)
    def n(i, j):
        return 0 if i == len(x) or j == len(y) else n(i + 1, j + 1) + 1 if x[i] == y[j] else max(n(i + 1, j), n(i, j + 1))

    return n(0, 0)


@pytest.mark.parametrize("seed", range(4))
def test_the_fewest_lines_go_and_come(seed):
    r = random.Random(seed)
    for _ in range(150):
        x, y = (tuple(r.choice("abcd") for _ in range(r.randint(1, 13))) for _ in range(2))
        d = rules.line_diff("\n".join(x), "\n".join(y))
        kept = sum(len(lines) for op, lines in d["ops"] if op == "same")
        assert kept == longest(x, y) and d["removed"] + kept == len(x) and d["added"] + kept == len(y) and not d["coarse"]
        side = lambda drop, d=d: tuple(line for op, lines in d["ops"] if op != drop for line in lines)
        assert side("add") == x and side("remove") == y
        assert all(a[0] != b[0] for a, b in zip(d["ops"], d["ops"][1:], strict=False))


def test_what_goes_comes_first():
    assert rules.line_diff("d\nb\nb\nd\nb", "b\nd\nd\nb\na")["removed"] == 2
    assert rules.line_diff("a\nb\nc", "a\nx\nc")["ops"] == [("same", ["a"]), ("remove", ["b"]), ("add", ["x"]), ("same", ["c"])]
    assert rules.line_diff("a\nb", "b\na")["ops"] == [("remove", ["a"]), ("same", ["b"]), ("add", ["a"])]
    assert rules.line_diff("same", "same") == {"ops": [("same", ["same"])], "added": 0, "removed": 0, "coarse": False}


def test_a_large_middle_is_replaced_whole():
    d = rules.line_diff("h\na\nb\nt", "h\nb\na\nt", cells=8)
    assert d == {"ops": [("same", ["h"]), ("remove", ["a", "b"]), ("add", ["b", "a"]), ("same", ["t"])], "added": 2, "removed": 2, "coarse": True}
    many = "\n".join(map(str, range(1900)))
    assert rules.line_diff(many, many.replace("77", "x"))["coarse"] is False


SNAPSHOTS = [
    (1, 1, "The old text"), (1, 2, "the OLD text, don’t cióñas 42 42"), (1, 3, "<b>the</b> ＡＢ old"), (2, 1, None), (2, 2, "first seen"), (2, 3, "first seen again"), (3, 1, "a b"), (3, 3, "b a b"), (3, 7, None), (3, 8, "x y z"), (3, 9, ""), (4, 1, "alone"),
]


def test_changed_words(spark):
    got = {(r.of, r.at): r.added for r in upkeep.changed_words(spark.createDataFrame(SNAPSHOTS, "of int, at int, text string"), "of", "at", "text").collect()}
    words = lambda t: Counter(re.findall(r"[^\W_]+(?:['’][^\W_]+)*", unicodedata.normalize("NFKC", re.sub("<[^>]*>", " ", t)).lower()))
    want, before = {}, {}
    for of, at, t in SNAPSHOTS:
        if before.get(of) is not None and t is not None:
            want[of, at] = sum((words(t) - words(before[of])).values())
        before[of] = t
    assert got == want and got[1, 2] == 4 and got[3, 9] == 0


def test_decisions_of_two_keys(spark):
    r = random.Random(3)
    days = [None, dt.date(2024, 1, 1), dt.date(2024, 5, 1)]
    rows = [(f"k{r.randrange(12)}", r.choice(["passed", "passed", "not_passed", "unknown"]), r.choice(days), r.choice([1, 2])) for _ in range(40)]

    def plain(matches):
        known = [m for m in matches if m[1] != "unknown"]
        if not known:
            return "unknown", None
        at = [m for m in known if m[3] == max(m[3] for m in known)]
        if len({m[1] for m in at}) > 1 and any(m[2] is None for m in at):
            return "ambiguous", None
        last = max(m[2] or dt.date.min for m in at)
        end = [m for m in at if (m[2] or dt.date.min) == last]
        return ("ambiguous", None) if len({m[1] for m in end}) > 1 else (end[0][1], end[0][2])

    each = records.decided(spark.createDataFrame(rows, "key string, status string, day date, reading int"), "key")
    a, b = each.select(F.col("key").alias("ka"), F.col("x").alias("a")), each.select(F.col("key").alias("kb"), F.col("x").alias("b"))
    status, day = records.verdict(F.col("x"))
    got = a.crossJoin(b).withColumn("x", F.when(F.col("ka") == F.col("kb"), F.col("a")).otherwise(records.later(F.col("a"), F.col("b")))).select("ka", "kb", status.alias("status"), day.alias("day")).collect()
    assert len(got) > 60
    for g in got:
        assert (g.status, g.day) == plain([m for m in rows if m[0] in (g.ka, g.kb)]), g
