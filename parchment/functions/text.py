"""Text rules in plain Python, one implementation each, for use in tests and in Arrow UDFs."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from itertools import accumulate, groupby
from operator import itemgetter

import numpy as np

TARGET, LONGEST, SHORTEST = 1400, 2600, 240
#: Characters that match as others, one for one.
FOLDS = {"\u2018": "'", "\u2019": "'", "\u201a": "'", "\u201c": '"', "\u201d": '"', "\u201e": '"', "\u2013": "-", "\u2014": "-", "\u2212": "-", "\u00a0": " ", "\u2026": "."}
_FOLD = str.maketrans(FOLDS)
_MARKS = set("*_`#\\")


#: How structure is headed in texts without markdown, what opens a workbook's further tab, longest such heading.
STRUCTURE = re.compile(r"\s*(?:\*\*|__)?\s*(article|section|amendment|title|chapter|part|clause)\s+([ivxlcdm]+|\d+)\b", re.I)
SHEET = "\f"
HEADING_CHARS = 100


def heading_level(line: str) -> int:
    """0 for ordinary lines; 1 for a sheet's tab, the markdown level, 3 for sections and clauses, 2 for other structure."""
    line = line.rstrip("\n")
    if line.startswith(SHEET):
        return int(bool(line.strip()))
    if m := re.match(r"(#{1,6})\s+\S", line):
        return len(m[1])
    m = STRUCTURE.match(line) if len(line) <= HEADING_CHARS else None
    return 0 if m is None else 3 if m[1].lower() in ("section", "clause") else 2


def heading_text(line: str) -> str:
    line = line.strip()
    return re.sub(r"\s*#*$", "", line.lstrip("#").strip()) if line.startswith("#") else re.sub(r"[*_#]", "", line).strip()


def split_passages(text: str, target: int = TARGET, longest: int = LONGEST, shortest: int = SHORTEST) -> list[tuple[int, str, str, int, int]]:
    """(ordinal, heading trail, content, start, end) in code points.

    A heading starts a passage; a blank line ends one of ``target`` characters; one of ``longest`` is cut where it stands;
    one under ``shortest`` joins the one after it if that stands under it, else the one before it under the same heading.
    """
    spans: list[list] = []
    trail: list[tuple[int, str]] = []
    at, open_ = 0, None

    def close(end: int) -> None:
        nonlocal open_
        if open_ is not None and text[open_[0] : end].strip():
            spans.append([open_[0], end, open_[1]])
        open_ = None

    for line in re.findall(r"[^\n]*\n|[^\n]+\Z", text):  # only \n ends a line
        level = heading_level(line)
        if level:
            close(at)
            trail = [t for t in trail if t[0] < level] + [(level, heading_text(line))]
        if open_ is None:
            open_ = (at, tuple(t[1] for t in trail))
        end = at + len(line)
        if not line.strip() and end - open_[0] >= target:
            close(end)
        while open_ is not None and end - open_[0] >= longest:
            start, names = open_
            close(start + longest)
            open_ = (start + longest, names) if start + longest < end else None
        at = end
    close(at)
    out: list[list] = []

    def keep(span: list) -> None:
        if out and span[1] - span[0] < shortest and span[2] == out[-1][2] and span[1] - out[-1][0] <= longest:
            out[-1][1] = span[1]
        else:
            out.append(span)

    held: list | None = None  # a short one, which goes with what stands under it
    for start, end, names in spans:
        if held is not None:
            if names[: len(held[2])] == held[2] and end - held[0] <= longest:
                start = held[0]
            else:
                keep(held)
        held = [start, end, names] if end - start < shortest else None
        if held is None:
            keep([start, end, names])
    if held is not None:
        keep(held)
    return [(k, " > ".join(names), text[a:b], a, b) for k, (a, b, names) in enumerate(out)]


def normalised(text: str) -> tuple[str, list[int]]:
    """Text for lenient matching, and for each of its characters the place it came from."""
    out, places, blank = [], [], True
    for i, c in enumerate(text.translate(_FOLD)):
        if c in _MARKS:
            continue
        if c.isspace():
            if not blank:
                out.append(" ")
                places.append(i)
            blank = True
            continue
        blank = False
        low = c.lower()
        out.append(low if len(low) == 1 else c)
        places.append(i)
    if out and out[-1] == " ":
        out.pop()
        places.pop()
    return "".join(out), places


def find_quote(text: str, quote: str, unique_below: int = 40) -> tuple[int, int] | None:
    """Where a quote stands: exactly first, then leniently; a short one only if it stands once."""
    if not quote.strip():
        return None
    found = text.find(quote)
    if found >= 0 and (len(quote) >= unique_below or text.find(quote, found + 1) < 0):
        return found, found + len(quote)
    if found >= 0:
        return None
    flat, places = normalised(text)
    want, _ = normalised(quote)
    found = flat.find(want) if want else -1
    if found < 0 or (len(want) < unique_below and flat.find(want, found + 1) >= 0):
        return None
    return places[found], places[found + len(want) - 1] + 1


def renumber_citations(content: str, quotes: list[tuple[str, str]], texts: dict[str, str]) -> tuple[str, list[int], int]:
    """(content with markers renumbered, kept citations in order of first use, rejected): [n] is the n-th of ``quotes``."""
    kept: list[int] = []
    seen: dict[tuple[str, str], int] = {}
    rejected: set[int] = set()

    def mark(m: re.Match) -> str:
        k = int(m[1]) - 1
        if not 0 <= k < len(quotes) or find_quote(texts.get(quotes[k][0], ""), quotes[k][1]) is None:
            rejected.add(k)
            return ""
        if quotes[k] not in seen:
            seen[quotes[k]] = len(kept) + 1
            kept.append(k)
        return f"[{seen[quotes[k]]}]"

    out = re.sub(r"\[(\d+)\]", mark, content)
    return re.sub(r" +([.,;])", r"\1", re.sub(r"[ \t]{2,}", " ", out)).strip(), kept, len(rejected)


def _common_lengths(x: list[str], y: list[str]) -> np.ndarray:
    """``t[i, j]``: lines of a longest common subsequence of x[i:] and y[j:]; a row is a running maximum of the row below."""
    number: dict[str, int] = {}
    a, b = (np.array([number.setdefault(line, len(number)) for line in side], np.int64) for side in (x, y))
    t = np.zeros((len(a) + 1, len(b) + 1), np.int32)
    for i in range(len(a) - 1, -1, -1):
        best = np.where(b == a[i], t[i + 1, 1:] + 1, t[i + 1, :-1])
        t[i, :-1] = np.maximum.accumulate(best[::-1])[::-1]
    return t


def line_diff(before: str, after: str, cells: int = 4_000_000) -> dict:
    """ops of (type, lines), lines added and removed: the fewest lines go and come, and where it is equal one goes first.

    Beyond ``cells`` of the table of the middle (what shared head and tail leave) the whole middle is replaced.
    """
    a, b = before.split("\n"), after.split("\n")
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    coarse = (len(x) + 1) * (len(y) + 1) > cells
    steps = [("same", line) for line in a[:head]]
    if coarse or not x or not y:
        steps += [("remove", line) for line in x] + [("add", line) for line in y]
    else:
        t, i, j = _common_lengths(x, y), 0, 0
        while i < len(x) or j < len(y):
            if i < len(x) and j < len(y) and x[i] == y[j]:
                steps.append(("same", x[i]))
                i, j = i + 1, j + 1
            elif j == len(y) or (i < len(x) and t[i + 1, j] >= t[i, j + 1]):
                steps.append(("remove", x[i]))
                i += 1
            else:
                steps.append(("add", y[j]))
                j += 1
    steps += [("same", line) for line in a[len(a) - tail :]] if tail else []
    ops = [(op, [line for _, line in run]) for op, run in groupby(steps, key=itemgetter(0))]
    return {"ops": ops, "added": sum(op == "add" for op, _ in steps), "removed": sum(op == "remove" for op, _ in steps), "coarse": coarse}


def collapsed(ops: list[tuple[str, list[str]]], context: int = 3) -> list[tuple[str, int, list[str]]]:
    """(op, lines, their texts) of a difference with long unchanged stretches cut to ``context`` lines beside each change."""
    out: list[tuple[str, int, list[str]]] = []
    for k, (op, lines) in enumerate(ops):
        before, after = context * (k > 0), context * (k < len(ops) - 1)
        if op != "same" or len(lines) <= before + after:
            out.append((op, len(lines), lines))
            continue
        pieces = (("same", lines[:before]), ("skipped", lines[before : len(lines) - after]), ("same", lines[len(lines) - after :]))
        out += [(name, len(x), [] if name == "skipped" else x) for name, x in pieces if x]
    return out


def cell_ranges(line: str, start: int = 0, delimiter: str = ",") -> list[list[tuple[int, int]]]:
    """The ranges of a line that make up each cell's value: several where quotes in it are written twice; trimmed.  Tabs don't quote."""
    cells: list[list[int]] = [[]]
    quoted, i = False, 0
    while i < len(line):
        c = line[i]
        if delimiter == "," and c == '"':
            if quoted and line[i + 1 : i + 2] == '"':
                cells[-1].append(i)
                i += 1
            else:
                quoted = not quoted
        elif c == delimiter and not quoted:
            cells.append([])
        else:
            cells[-1].append(i)
        i += 1
    out = []
    for places in cells:
        while places and line[places[0]].isspace():
            places.pop(0)
        while places and line[places[-1]].isspace():
            places.pop()
        ranges: list[tuple[int, int]] = []
        for p in places:
            if ranges and ranges[-1][1] == start + p:
                ranges[-1] = (ranges[-1][0], start + p + 1)
            else:
                ranges.append((start + p, start + p + 1))
        out.append(ranges)
    return out


def unique_quote_around(content: str, name: str) -> str | None:
    """The smallest quote around a name that stands once: the name, its line, the rest of its line, or ever more around it."""
    name = name.strip()
    at = content.lower().find(name.lower()) if name else -1
    if name and find_quote(content, name):
        return name
    if at < 0:
        return None
    begin, end = content.rfind("\n", 0, at) + 1, content.find("\n", at)
    end = len(content) if end < 0 else end
    line = content[begin:end].replace("\r", "").strip()
    tries = [line] if len(line) <= 280 else []
    tries.append(content[at : min(end, at + 160)])
    tries += [content[max(begin, at - r) : min(end, at + len(name) + r)] for r in range(24, 221, 16)]
    return next((q for x in tries if (q := x.replace("\r", "").strip()) and find_quote(content, q)), None)


WHOLE_EXCERPT, EXCERPT, GAP = 20_000, 14_000, "\n\n[...]\n\n"


def topic_excerpt(content: str, pattern: re.Pattern, whole: int = WHOLE_EXCERPT, budget: int = EXCERPT) -> str:
    """What a long text says about a topic: passages that match, then their neighbours, while the budget lasts, in reading order."""
    if len(content) <= whole:
        return content
    spans = [(a, b) for _, _, _, a, b in split_passages(content)]
    hits = [k for k, (a, b) in enumerate(spans) if pattern.search(content[a:b])]
    if not hits:
        return content[:budget]
    chosen: set[int] = set()
    used = 0
    for k in [*hits, *(n for k in hits for n in (k - 1, k + 1))]:
        if 0 <= k < len(spans) and k not in chosen:
            size = spans[k][1] - spans[k][0]
            if not chosen or used + size <= budget:
                chosen.add(k)
                used += size
    parts, last = [], None
    for k in sorted(chosen):
        if last is not None and k == last + 1:
            parts[-1] += content[spans[last][1] : spans[k][1]]
        else:
            parts.append(content[slice(*spans[k])])
        last = k
    return GAP.join(parts)


def name_key(name: str) -> str:
    """Lower case, marks dropped, anything but letters to one blank."""
    flat = "".join(c for c in unicodedata.normalize("NFKD", name.lower()) if not unicodedata.combining(c))
    return " ".join(re.findall(r"[^\W\d_]+", flat))


def parse_csv_line(line: str, delimiter: str = ",") -> list[str]:
    """Cells of a line, trimmed; a doubled quote inside quotes is one."""
    cells, cell, quoted, i = [], [], False, 0
    while i < len(line):
        c = line[i]
        if quoted and c == '"' and line[i + 1 : i + 2] == '"':
            cell.append('"')
            i += 1
        elif c == '"':
            quoted = not quoted
        elif c == delimiter and not quoted:
            cells.append("".join(cell).strip())
            cell = []
        else:
            cell.append(c)
        i += 1
    return [*cells, "".join(cell).strip()]


def workbook_sheets(text: str) -> list[tuple[str, str]]:
    """(name, content) of the tabs of a workbook kept as one text; tabs after the first start with a form feed and a name."""
    first, *rest = text.split("\n\f")
    return [("", first), *((x.split("\n", 1)[0], x.split("\n", 1)[1] if "\n" in x else "") for x in rest)]


# What an export leaves behind that isn't text, in the order in which it goes, and what stands for it.
_LINE_END = r"(?=[\r\n\u2028\u2029]|\Z)"
LEFTOVERS = tuple((re.compile(p, f), by) for p, f, by in (
    (rf"(?:(?m:^)|(?<=[\r\u2028\u2029]))[ \t]*(?:\[[^\]\n]+\])?:[ \t]*<data:image/[^>]*>(?:[ \t]+[\"'][^\r\n]*[\"'])?[ \t]*{_LINE_END}", 0, ""),
    (r"!\[[^\]\n]*\](?:\([^)\n]*\)|\[[^\]\n]*\])", 0, ""), (r"~?\[\](?:\([^)\n]*\)|\[[^\]\n]*\])?", 0, ""), (r"\[image\d+\]", re.I, ""),
    (rf"[ \t]+{_LINE_END}", 0, ""), (r"\n{3,}", 0, "\n\n"), (r"\A\s+|\s+\Z", 0, ""),
))


def sanitised(markdown: str, positions: list[int]) -> tuple[str, list[int]]:
    """(text without leftovers of its export, where the positions stand in it).

    Each step is a table of edits (start, end, what was gained or lost before it); a position finds by its end the first edit
    that it doesn't lie beyond, and moves to the edit's replacement if it lies inside, else by what came before.
    """
    text, places = markdown, list(positions)
    for pattern, by in LEFTOVERS:
        edits = [m.span() for m in pattern.finditer(text) if m.end() > m.start()]
        if not edits:
            continue
        ends, shift = [e for _, e in edits], [0, *accumulate(len(by) - (e - s) for s, e in edits)]
        moved = []
        for p in places:
            k = bisect_left(ends, p)
            inside = k < len(edits) and p >= edits[k][0]
            moved.append(edits[k][0] + shift[k] + min(p - edits[k][0], len(by)) if inside else p + shift[k])
        text, places = pattern.sub(by, text), moved
    return text, places
