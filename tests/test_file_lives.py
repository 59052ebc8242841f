"""Lives of files: each step, and the same end for any cut of a stream."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from parchment.operators.sync import files_ingested, observations
from parchment.streaming import files
from tests.oracles import SMALL

SCHEMA = "file_id int, seq long, action string, kind string, modified timestamp_ntz, content string"
#: Texts, and how they read without their looks.
TEXTS = {"one": "one", "**one**": "one", "two": "two", "  two": "two", "": "", "three\nfour": "three\nfour", "three\n\n__four__": "three\nfour"}
sha = lambda t: hashlib.sha256(t.encode()).hexdigest()


def brute(rows):
    """By walking with the texts themselves."""
    out, now = [], {}
    for f, seq, action, kind, modified, text in sorted(rows, key=lambda r: (r[0], r[1])):
        s = now.get(f)
        text = text or ""
        if s is None:
            if action == "seen":
                now[f] = {"pub": text, "held": None, "no": None, "at": modified}
            out.append((f, seq, "created" if action == "seen" else "ignored"))
            continue
        if action != "seen":
            what = "ignored" if s["held"] is None else action + "ed"
            if what == "accepted":
                s["pub"] = s["held"]
            elif what == "rejected":
                s["no"] = s["held"]
            s["held"] = None
        elif modified is not None and modified == s["at"] and (s["held"] is None or kind.startswith("guiding.")):
            what = "unchanged"
        else:
            s["at"] = modified
            if text == s["pub"]:
                what, s["held"] = "same", None
            elif text == s["no"]:
                what = "refused"
            elif kind.startswith("guiding.") and TEXTS[s["pub"]] and TEXTS[text] != TEXTS[s["pub"]]:
                what, s["held"] = "held", text
            else:
                what, s["pub"], s["held"] = "updated", text, None
        out.append((f, seq, what))
    ends = {f: tuple(None if s[k] is None else sha(s[k]) for k in ("pub", "held", "no")) for f, s in now.items()}
    return out, ends


def random_rows(spark, seed, n=400):
    from datetime import datetime, timedelta

    rnd, rows = random.Random(seed), []
    for seq in range(n):
        f = rnd.choice([0, 0, 0, 1, 2, 3, 4])
        at = rnd.choice([None, *(datetime(2024, 1, 1) + timedelta(days=d) for d in range(3))])
        rows.append((f, seq, rnd.choice(["seen"] * 5 + ["accept", "reject"]), "guiding.bylaws" if f < 3 else "minutes.senate", at, rnd.choice(list(TEXTS))))
    return rows, spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_each_step(spark, seed):
    rows, df = random_rows(spark, seed)
    want, ends = brute(rows)
    told = files.lives(df).cache()
    assert sorted((r.file_id, r.seq, r.outcome) for r in told.collect()) == want
    assert {r.file_id: (r.published, r.held, r.refused) for r in files.standing(told).collect()} == ends
    assert len({w for *_, w in want}) >= 8  # nearly all outcomes occur


@pytest.mark.parametrize("cuts", [1, 3, 7])
def test_a_stream_ends_alike_for_any_cut(spark, tmp_path, cuts):
    rows, df = random_rows(spark, 5, 200)
    for k in range(cuts):
        spark.createDataFrame(rows[k * len(rows) // cuts : (k + 1) * len(rows) // cuts], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    name = f"lives_{cuts}"
    files.living(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination(200)
    want, ends = brute(rows)
    assert sorted((r.file_id, r.seq, r.outcome) for r in spark.table(name).collect()) == want
    twice = spark.table(name).unionByName(spark.table(name))
    assert {r.file_id: (r.published, r.held, r.refused) for r in files.standing(twice).collect()} == ends


def test_nulls_repeats_and_nothing(spark):
    df = spark.createDataFrame([(1, 1, None, None, None, None), (1, 1, None, None, None, None), (None, 1, "seen", "x", None, "a"), (2, None, "seen", "x", None, "a"), (3, 1, "accept", "x", None, "a")], SCHEMA)
    got = sorted((r.file_id, r.seq, r.outcome) for r in files.lives(df).collect())
    assert got == [(1, 1, "created"), (1, 1, "ignored"), (3, 1, "ignored")]
    assert files.lives(df.limit(0)).collect() == []


def test_query_walks_every_turn(spark):
    n = observations(spark, SMALL).where("file_id is not null and seq is not null").count()
    got = files_ingested(spark, SMALL)
    assert got.agg(F.sum("n")).first()[0] == n
