import io
import zipfile
from datetime import datetime, timezone

import pytest

from parchment.functions.periods import parse_period, without_period
from parchment.sources import office, sinks

NOW = datetime(2026, 3, 18, 15, tzinfo=timezone.utc)


@pytest.mark.parametrize(
    ("question", "start", "end", "label"),
    [
        ("what is on today in April 2020", "2026-03-18T04:00", "2026-03-19T04:00", "today"),
        ("yesterday", "2026-03-17T04:00", "2026-03-18T04:00", "yesterday"),
        ("the last 2 weeks", "2026-03-05T05:00", "2026-03-19T04:00", "the past 14 days"),  # the clocks change in between
        ("over the past couple of months", "2026-01-18T05:00", "2026-03-19T04:00", "the past 2 months"),
        ("last month", "2026-02-17T05:00", "2026-03-19T04:00", "the past 30 days"),
        ("last week", "2026-03-12T04:00", "2026-03-19T04:00", "the past 7 days"),
        ("the previous year", "2025-03-19T04:00", "2026-03-19T04:00", "the past year"),
        ("last semester", "2025-08-01T04:00", "2026-01-01T05:00", "last semester"),
        ("this term", "2026-01-01T05:00", "2026-03-19T04:00", "this semester"),
        ("so far this week", "2026-03-15T04:00", "2026-03-19T04:00", "this week"),  # from Sunday
        ("this month", "2026-03-01T05:00", "2026-03-19T04:00", "this month"),
        ("this year", "2026-01-01T05:00", "2026-03-19T04:00", "this year"),
        ("since October", "2025-10-01T04:00", "2026-03-19T04:00", "October 2025 onwards"),
        ("since May of 2024", "2024-05-01T04:00", "2026-03-19T04:00", "May 2024 onwards"),
        ("since 2023", "2023-01-01T05:00", "2026-03-19T04:00", "2023 onwards"),
        ("recent bills in April 2025", "2025-04-01T04:00", "2025-05-01T04:00", "April 2025"),
        ("during December", "2025-12-01T05:00", "2026-01-01T05:00", "December 2025"),
        ("minutes from 2020", "2020-01-01T05:00", "2021-01-01T05:00", "2020"),
        ("the latest bills", "2026-02-17T05:00", "2026-03-19T04:00", "the past 30 days"),
    ],
)
def test_periods(question, start, end, label):
    p = parse_period(question, NOW)
    assert (p.start.isoformat()[:16], p.end.isoformat()[:16], p.label) == (start, end, label)
    assert p.matched not in without_period(question, p)


def test_no_period():
    assert parse_period("who may march on 99/99/2020?", NOW) is None
    assert parse_period("the most recent constitution", NOW) is None
    assert parse_period("what are the rules of 1850?", NOW) is None
    assert parse_period("the last 0 days", NOW) is None
    assert without_period("plain", None) == "plain"


def zipped(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
DOCX = zipped({"word/document.xml": f'<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p><w:p><w:r><w:t>a</w:t><w:tab/><w:t>b</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>x</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>y</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'})
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
XLSX = zipped({
    "xl/workbook.xml": f'<workbook {S}><sheets><sheet name="First" r:id="r1"/><sheet name="Second" r:id="r2"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/s1.xml"/><Relationship Id="r2" Target="worksheets/s2.xml"/></Relationships>',
    "xl/sharedStrings.xml": f"<sst {S}><si><t>na,me</t></si></sst>",
    "xl/styles.xml": f'<styleSheet {S}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>',
    "xl/worksheets/s1.xml": f'<worksheet {S}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" s="1"><v>45000</v></c></row></sheetData></worksheet>',
    "xl/worksheets/s2.xml": f'<worksheet {S}><sheetData><row><c r="A1"><v>7</v></c></row></sheetData></worksheet>',
})


def test_office_files():
    assert office.docx_text(DOCX) == "## Title\na\tb\n| x | y |"
    assert office.xlsx_sheets(XLSX) == [("First", [["na,me", "", "2023-03-15"]]), ("Second", [["7"]])]
    assert office.workbook_text(XLSX) == '"na,me",,2023-03-15\n\fSecond\n7'


def test_office_source(spark, tmp_path):
    for name, blob in (("a.docx", DOCX), ("b.xlsx", XLSX), ("c.docx", b"not a zip"), ("d.txt", b"x")):
        (tmp_path / name).write_bytes(blob)
    got = {r.path.rsplit("/", 1)[1]: r for r in office.read_office(spark, f"file://{tmp_path}").collect()}
    assert set(got) == {"a.docx", "b.xlsx", "c.docx"}
    assert got["a.docx"].content.startswith("## Title") and got["c.docx"].content is None and got["c.docx"].error.startswith("BadZipFile")


def test_sinks(spark, tmp_path):
    held = spark.createDataFrame([(1, "a", 5), (2, "b", 5)], "k int, v string, t int")
    new = spark.createDataFrame([(1, "c", 5), (2, "d", 4), (3, "e", 1), (3, "e", 1)], "k int, v string, t int")
    assert sorted(map(tuple, sinks.upserted(held, new, ["k"], "t").collect())) == [(1, "c", 5), (2, "b", 5), (3, "e", 1)]
    assert [tuple(r) for r in sinks.inserted_where_absent(held, new, ["k"]).collect()] == [(3, "e", 1)]
    path = f"file://{tmp_path}/t"
    held.write.partitionBy("t").parquet(path)
    sinks.replace_partitions(spark.createDataFrame([(9, "z", 4)], "k int, v string, t int"), path, "t")
    sinks.replace_partitions(spark.createDataFrame([(8, "y", 5)], "k int, v string, t int"), path, "t")
    assert sorted(r.k for r in spark.read.parquet(path).collect()) == [8, 9]
