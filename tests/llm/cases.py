"""Small tables with the odd cases: nulls, empty and long texts, ties, repeated rows, clashing column names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, runs string, h string, bucket int, label int, component_id long"


def texts(seed=7):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(2, 6)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = prose(90)
    base = prose(400)
    near = base.split()
    near[200] = "changed"
    return [
        None, "", "   \n\t ", "one", "one two three", prose(30), base, base, " ".join(near), prose(20) + " " + shared + " " + prose(25), prose(40) + "\n" + shared + "\n" + prose(15),
        "la " * 900, "la " * 900 + prose(10), shared + " " + prose(5) + " " + shared, prose(9000), "A" + prose(60), "a" + prose(60), "x\x0bword\x0cy  z", "same line\nsame line\nother\nsame line", "### $$$ " * 60, "日本語 テキスト " * 80,
    ]


def documents(spark, rows=None):
    got = [(i, t) for i, t in enumerate(texts())] if rows is None else rows
    return spark.createDataFrame([(i, t, "en", None, None if t is None else len(t), "r", "h", 1, 2, 3) for i, t in got], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
