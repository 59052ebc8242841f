"""Line breaks put back into the cells of markdown tables, out of the tables of an HTML export of the same text."""

from __future__ import annotations

import re
from bisect import bisect_right
from html.parser import HTMLParser

from parchment.functions.text import normalised

# What stands for a break inside a cell, what a row and the rule below a head row look like, a link, the numbers
# of clauses, from where on two tables are the same, what equal sizes add, and how much of a text tells that another holds it.
BREAK = "<br>"
ROW, RULE = re.compile(r"\s*\|"), re.compile(r"\s*\|(?:\s*:?-+:?\s*\|)+\s*$")
LINK = re.compile(r"\[([^\]\n]*)\]\(((?:\\.|[^()\s])*)\)")
CLAUSE, ANY_CLAUSE = re.compile(r"\d+(?:\.\d+){2,}\.?\s"), re.compile(r"\b\d+(?:\.\d+){2,}\.?\s")
SAME, SIZE, PREFIX = 0.4, 0.25, 80
_AFTER = re.compile(r"[*~]*(?:\]\((?:\\.|[^()\\]|\([^()]*\))*\)\**)?", re.S)
_BREAK_HERE = re.compile(r"<br\s*/?>", re.I)
_BLOCKS = frozenset(("p", "div", "li", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote"))


class _Tables(HTMLParser):
    """Tables in the order in which they open; a text counts for every cell around it, a row for the innermost table."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tables, self.open, self.cells, self.silent, self.note = [], [], [], 0, None

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.silent += 1
        elif tag == "table":
            self.open.append(([], len(self.cells)))
            self.tables.append(self.open[-1][0])
        elif tag == "tr" and self.open:
            self.open[-1][0].append([])
        elif tag in ("td", "th") and self.open and self.open[-1][0]:
            self.cells.append([])
            self.open[-1][0][-1].append(self.cells[-1])
        elif tag == "br":
            self._say("\n")
        elif tag == "sup":
            self.note = [(cell, len(cell)) for cell in self.cells]
        elif tag == "a" and self.note is not None and not re.match(r"#cmnt\d+", dict(attrs).get("href") or ""):
            self.note = None

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.silent = max(0, self.silent - 1)
        elif tag == "table" and self.open:
            del self.cells[self.open.pop()[1] :]
        elif tag in ("td", "th") and self.open and len(self.cells) > self.open[-1][1]:
            self.cells.pop()
        elif tag in _BLOCKS:
            self._say("\n")
        elif tag == "sup" and self.note is not None:  # a reviewer's mark
            for cell, n in self.note:
                del cell[n:]
            self.note = None

    def handle_data(self, data):
        if not self.silent:
            self._say(re.sub(r"\s+", " ", data))

    def _say(self, text):
        for cell in self.cells:
            cell.append(text)


def html_tables(html: str) -> list[list[list[list[str]]]]:
    """Tables as rows of cells of lines, nested ones too; what never closes ends with the page."""
    parser = _Tables()
    parser.feed(html)
    parser.close()
    lines = lambda cell: [x for x in (" ".join(line.split()) for line in "".join(cell).split("\n")) if x]
    return [[[lines(cell) for cell in row] for row in table] for table in parser.tables]


def _row_cells(line: str, at: int) -> list[tuple[int, int]]:
    """(start, end) of a row's cells without the blanks around them; escaped pipes and those in links part nothing."""
    bars, k = [], 0
    while k < len(line):
        link = LINK.match(line, k) if line[k] == "[" else None
        if line[k] == "|":
            bars.append(k)
        k = link.end() if link else k + 1 + (line[k] == "\\")
    if bars and line[bars[-1] + 1 :].strip():
        bars.append(len(line))
    out = []
    for a, b in zip(bars, bars[1:], strict=False):
        cell = line[a + 1 : b]
        start = a + 1 + len(cell) - len(cell.lstrip()) if cell.strip() else b
        out.append((at + start, at + max(start, a + 1 + len(cell.rstrip()))))
    return out


def markdown_tables(text: str) -> list[list[list[tuple[int, int]]]]:
    """Tables as rows of cells, which are ranges of the text; rules below head rows aren't rows."""
    tables, inside, at = [], False, 0
    for line in text.split("\n"):
        is_row = bool(ROW.match(line))
        if is_row and not inside:
            tables.append([])
        if is_row and not RULE.match(line):
            tables[-1].append(_row_cells(line, at))
        inside, at = is_row, at + len(line) + 1
    return tables


def folded(cell: str) -> tuple[str, list[int]]:
    """(the words of a cell as they are compared, where each character stands): links by their labels, nothing struck through."""
    kept, k = [], 0
    while k < len(cell):
        link = LINK.match(cell, k) if cell[k] == "[" else None
        if cell.startswith("~~", k):
            k += 2
        elif link:
            kept += range(*link.span(1))
            k = link.end()
        else:
            kept.append(k)
            k += 1
    text, places = normalised("".join(cell[i] for i in kept))
    return text, [kept[p] for p in places]


def likeness(a: str, b: str) -> float:
    """How much of one table's words another holds."""
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    if a[:PREFIX] in b or b[:PREFIX] in a:
        return 0.8
    words = {w for w in a.split(" ") if len(w) > 2}
    return sum(w in b for w in words) / len(words) if words else 0.0


def paired(text: str, tables: list, exported: list) -> list[tuple[list, list]]:
    """Markdown tables with their HTML ones: in order where they are as many, else each with the likest that none took before."""
    if len(tables) == len(exported):
        return list(zip(tables, exported, strict=True))
    said = [folded(" ".join(line for row in t for cell in row for line in cell))[0] for t in exported]
    out, free = [], list(range(len(exported)))
    for table in tables:
        words = folded(" ".join(text[a:b] for row in table for a, b in row))[0]
        size = lambda t: (len(t), len(t[0]) if t else 0)
        scores = [(likeness(words, said[k]) + SIZE * (size(exported[k]) == size(table)), -k) for k in free] if words else []
        if scores and max(scores)[0] >= SAME:
            k = -max(scores)[1]
            free.remove(k)
            out.append((table, exported[k]))
    return out


def _clause_end(text: str, cursor: int, line: str, following: str | None) -> int | None:
    """The last place of a line that differs, by the numbers of its clause and the next, if both stand there once; -1: it is the last."""
    own, then = CLAUSE.match(line), CLAUSE.match(following or "")
    start = text.find(own[0], cursor) if own else -1
    if start < 0:
        return None
    body = start + len(own[0])
    if following is None:
        return None if ANY_CLAUSE.search(text[body:]) else -1
    end = text.find(then[0], body) if then else -1
    if end < 0 or text.find(own[0], body) >= 0 or text.find(then[0], end + len(then[0])) >= 0 or ANY_CLAUSE.search(text[body:end]):
        return None
    return start + len(text[start:end].rstrip(" ")) - 1


def breaks(cell: str, lines: list[str]) -> list[int]:
    """Where a cell breaks into the lines; nowhere if one of them isn't found, as a wrong break is worse than none."""
    if len(lines) < 2:
        return []
    text, places = folded(cell)
    needles, out, cursor = [folded(x)[0] for x in lines], [], 0
    for k, needle in enumerate(needles):
        if not needle:
            continue
        found = text.find(needle, cursor)
        last = found + len(needle) - 1 if found >= 0 else _clause_end(text, cursor, needle, needles[k + 1] if k + 1 < len(needles) else None)
        if last is None:
            return []
        if last < 0:
            break
        if k < len(needles) - 1:
            out.append(_AFTER.match(cell, places[last] + 1).end())
        cursor = last + 1 + (text[last + 1 : last + 2] == " ")
    return sorted({p for p in out if not _BREAK_HERE.match(cell, p)})


def restored(markdown: str, html: str) -> tuple[str, list[int]]:
    """(the text with breaks in its cells, the places in ``markdown`` at which they were put), from the end to the start."""
    tables = markdown_tables(markdown)
    exported = html_tables(html) if tables else []
    points = []
    for table, other in paired(markdown, tables, exported) if exported else []:
        for row, other_row in zip(table, other, strict=False):
            for (a, b), lines in zip(row, other_row, strict=False):
                points += [(a + p, b) for p in breaks(markdown[a:b], lines)]
    out = markdown
    for at, end in sorted(points, reverse=True):
        blanks = len(out[at:end]) - len(out[at:end].lstrip(" \t"))
        out = out[:at] + BREAK + out[at + blanks :]
    return out, sorted(at for at, _ in points)


def moved(position: int, markdown: str, points: list[int]) -> int:
    """Where a position of ``markdown`` that isn't in a swallowed blank stands in the restored text."""
    shifts = [len(BREAK) - (len(markdown[p:]) - len(markdown[p:].lstrip(" \t"))) for p in points]
    return position + sum(shifts[: bisect_right(points, position)])
