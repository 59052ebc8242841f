"""Shown titles against rules that look at all documents for each."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from parchment.operators import titles


@pytest.mark.parametrize("raw, shown", [
    ("MINUTES of Senate GBM #14.docx", "Minutes of Senate GBM #14"), ("OPINION OF THE JUDICIARY.pdf", "Opinion of the Judiciary"), ("SGA-FC_budget   v2 , final.PDF", "SGA-FC budget v2, final"), ("THE sga", "The sga"),
    ("JHU SGA Bylaws 2025-2026", "JHU SGA Bylaws 2025-2026"), ("[TEMPLATE] AGENDA", "[Template] Agenda"), ("JHUMA FUNDING bill", "JHUMA Funding bill"), (".pdf", ""), ("", ""), ("ÉTAT NEW", "ÉTAT NEW"),
])
def test_clean_titles(spark, raw, shown):
    assert spark.createDataFrame([(raw,)], "t string").select(titles.clean_title(F.col("t"))).first()[0] == shown


@pytest.mark.parametrize("key, role, shown", [
    ("113:senate:13", "agenda", "Senate General Body Meeting #13 — Agenda (09/06/26)"), ("113:committee:health safety and sustainability:2", "minutes", "Health, Safety and Sustainability Committee Meeting #2 — Minutes (09/06/26)"),
    ("113:executive:summer:2026-07-01", "minutes", "Summer Executive Board Meeting — Minutes (07/01/26)"), ("113:caucus:class of 28:1", "minutes", "Class of 28 Caucus Meeting #1 — Minutes (09/06/26)"), ("113:party:1", "minutes", None), ("", "minutes", None), ("113:senate", "minutes", None),
])
def test_meeting_titles(spark, key, role, shown):
    row = spark.createDataFrame([(key, role, dt.date(2026, 9, 6))], "k string, r string, d date")
    assert row.select(titles.meeting_title(F.col("k"), F.col("r"), F.col("d"))).first()[0] == shown


def test_dates_of_meetings(spark):
    day = lambda d: dt.datetime(2026, 9, d, 15)
    rows = [("1:a:1", "agenda", None, day(1)), ("1:a:1", "minutes", None, day(2)), ("1:a:2", "minutes", None, day(5)), ("1:a:3", "minutes", None, day(5)), ("1:a:3", "agenda", dt.date(2026, 8, 1), day(6)),
            ("1:b:1", "minutes", dt.date(2026, 7, 7), day(5)), ("1:b:1", "agenda", dt.date(2026, 7, 1), None), ("1:b:2", "", None, day(9)), ("", "minutes", None, day(1))]
    got = titles.meeting_dates(spark.createDataFrame(rows, "key string, role string, stated date, created timestamp")).collect()
    assert {r.key: r.met and r.met.isoformat() for r in got} == {"1:a:1": "2026-09-02", "1:a:2": None, "1:a:3": "2026-08-01", "1:b:1": "2026-07-07", "1:b:2": "2026-09-09"}


def test_no_canonical_name_is_shared(spark):
    r = random.Random(2)
    rows = [(i, r.choice(["a.pdf", "b", "C D", "canon 1", "canon 2", "canon_3"]), r.choice([None, *(f"canon {k}" for k in range(14))]), r.random() < .2) for i in range(60)] + [(99, "canon 50", "canon 50", False), (98, "x", "canon 51", False)]
    clean = {i: t if s else t.removesuffix(".pdf").replace("_", " ") for i, t, _, s in rows}
    canonical = {i: None if s else c for i, _, c, s in rows}
    want = {}
    for i, c in canonical.items():
        free = c is not None and sum(x == c for x in canonical.values()) == 1 and not any(t == c for k, t in clean.items() if k != i)
        want[i] = c if free else clean[i]
    got = titles.shown_titles(spark.createDataFrame(rows, "id int, title string, canonical string, secondary boolean")).collect()
    assert {x.id: x.shown for x in got} == want and want[99] == "canon 50" and want[98] == "canon 51"
