"""Office files as text: word-processor documents and workbooks, read from their zipped XML."""

from __future__ import annotations

import io
import zipfile
from datetime import date, timedelta
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
#: Built-in number formats that show dates.
_DATE_FORMATS = {*range(14, 23), *range(45, 48)}


def docx_text(blob: bytes) -> str:
    """Paragraphs by line, headings as markdown, table rows with cells between bars."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(blob)).read("word/document.xml")).find(f"{_W}body")

    def paragraph(p) -> str:
        text = "".join("\t" if x.tag == f"{_W}tab" else "\n" if x.tag == f"{_W}br" else x.text or "" for x in p.iter() if x.tag in (f"{_W}t", f"{_W}tab", f"{_W}br"))
        style = p.find(f"{_W}pPr/{_W}pStyle")
        name = style.get(f"{_W}val", "") if style is not None else ""
        level = int(name[7:]) if name.startswith("Heading") and name[7:].isdigit() else 0
        return "#" * level + " " * bool(level) + text

    lines = []
    for child in body if body is not None else ():
        if child.tag == f"{_W}p":
            lines.append(paragraph(child))
        elif child.tag == f"{_W}tbl":
            lines += ["| " + " | ".join(" ".join(paragraph(p) for p in cell.iter(f"{_W}p")) for cell in row.iter(f"{_W}tc")) + " |" for row in child.iter(f"{_W}tr")]
    return "\n".join(lines).strip()


def _column(reference: str) -> int:
    n = 0
    for c in reference:
        if c.isalpha():
            n = 26 * n + ord(c.upper()) - 64
    return n - 1


def xlsx_sheets(blob: bytes) -> list[tuple[str, list[list[str]]]]:
    """(name, rows) of each sheet in order; dates as ISO text, missing cells empty."""
    z = zipfile.ZipFile(io.BytesIO(blob))
    names = set(z.namelist())
    shared = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
    dated = []
    if "xl/styles.xml" in names:
        styles = ElementTree.fromstring(z.read("xl/styles.xml"))
        own = {int(f.get("numFmtId")) for f in styles.iter(f"{_S}numFmt") if any(c in f.get("formatCode", "").lower() for c in "ymd")}
        formats = styles.find(f"{_S}cellXfs")
        dated = [int(x.get("numFmtId", 0)) in _DATE_FORMATS | own for x in (formats if formats is not None else ())]
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    out = []
    for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_S}sheet"):
        rows = []
        for row in ElementTree.fromstring(z.read("xl/" + targets[sheet.get(f"{_R}id")].removeprefix("/xl/"))).iter(f"{_S}row"):
            cells: list[str] = []
            for c in row.iter(f"{_S}c"):
                value, kind = c.find(f"{_S}v"), c.get("t")
                text = value.text if value is not None and value.text else "".join(t.text or "" for t in c.iter(f"{_S}t"))
                if kind == "s" and text:
                    text = shared[int(text)]
                elif kind in (None, "n") and text and int(c.get("s", 0)) < len(dated) and dated[int(c.get("s", 0))]:
                    text = (date(1899, 12, 30) + timedelta(days=int(float(text)))).isoformat()
                at = _column(c.get("r", "")) if c.get("r") else len(cells)
                cells += [""] * (at - len(cells)) + [text]
            rows.append(cells)
        out.append((sheet.get("name"), rows))
    return out


def workbook_text(blob: bytes) -> str:
    """Sheets as one text: cells by comma, rows by line, each later sheet after a form feed and its name."""
    quote = lambda c: '"' + c.replace('"', '""') + '"' if any(x in c for x in ',"\n') else c
    parts = [("\f" + name + "\n" if k else "") + "\n".join(",".join(map(quote, r)) for r in rows) for k, (name, rows) in enumerate(xlsx_sheets(blob))]
    return "\n".join(parts)


def read_office(spark: SparkSession, path: str) -> DataFrame:
    """(path, content, error) of the office files under a path, a file at a time; a file that can't be read gives its error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{docx,xlsx}").load(path).select("path", "content")

    def run(batches):
        for frame in batches:
            texts, errors = [], []
            for p, blob in zip(frame["path"], frame["content"], strict=True):
                try:
                    texts.append(docx_text(blob) if p.endswith(".docx") else workbook_text(blob))
                    errors.append(None)
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, ValueError) as e:
                    texts.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield frame.assign(content=texts, error=errors)[["path", "content", "error"]]

    return files.mapInPandas(run, "path string, content string, error string")
