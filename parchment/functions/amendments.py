"""What amendment bills say: instructions to replace, delete or insert quoted text, and tables of old beside new text."""

from __future__ import annotations

import re
from typing import NamedTuple

# How instructions are worded, what heads parts of a bill, and how table columns are named.
_QUOTE = '["“]([^"“”]+)["”]'
_NOUN = r"(?:(?:the\s+)?(?:words|text|phrase|language|clause)\s+)?"
_OPEN = r"(?:^\s*(?:[-*]\s+|\d+[.)]\s+)?(?:The\s+(?:words|text|language)\s+)?)"
_CLOSE = r"\s*[.;]?\s*$"
INSTRUCTIONS = {
    "replace": (rf"{_OPEN}(?:replace|replacing)\s+{_NOUN}{_QUOTE}\s+with\s+{_QUOTE}{_CLOSE}", rf"{_OPEN}{_QUOTE}\s+(?:shall\s+be|is|are)\s+(?:hereby\s+)?(?:replaced\s+(?:by|with)|amended\s+to\s+read)\s+{_QUOTE}{_CLOSE}"),
    "delete": (rf"{_OPEN}(?:delete|remove|strike)\s+{_NOUN}{_QUOTE}{_CLOSE}",),
    "insert": (rf"{_OPEN}(?:insert|add)\s+{_QUOTE}\s+(?:immediately\s+)?(after|before)\s+{_QUOTE}{_CLOSE}",),
}
_PART = r"(?:(?:section|part)\s+[\dIVXLC.:-]+\s*[:.—-]?\s*)?(?:(?:proposed\s+)?amendments?\s+to\s+(?:the\s+)?)?"
_REST = r"(?:\s+amendments?(?:\s+proposed\s+in\s+this\s+bill)?)?[:.]?"
SCOPES = {"bylaws": rf"{_PART}(?:(?:JHU\s+)?SGA\s+|senate\s+)?bylaws{_REST}", "constitution": rf"{_PART}(?:(?:JHU\s+)?SGA\s+)?constitution(?:al)?{_REST}"}
IDLE = r"(?:section [\dIVXLC.]+[ .:]*)?(?:rationale|examples?|illustrations?|findings(?: and purposes)?|purposes?|rejected amendments?|withdrawn amendments?)\b"
IN_FORCE = r"(?:section [\dIVXLC.]+[ .:]*)?amendments?\b"
COLUMNS = {"old": r"(?:current|existing|original)(?:\s+(?:language|text|wording|provision))?", "new": r"(?:proposed|amended|new|replacement)(?:\s+(?:language|text|wording|provision))?"}
NOTHING = r"(?:none|n/a|deleted|removed|no change)[.!]?"
BREAK = r"(?:<br\s*/?>|\s)*(?:\\?=){3,}(?:<br\s*/?>|\s)*"
DELAYED = (r"(?:this (?:act|bill)|these amendments?).*(?:take effect|effective|into effect|contingent|subject to|conditional)", r"(?:immediately|upon (?:its )?(?:passage|adoption|enactment))", r"(?:unless|except|contingent|subject to|conditional)")
LEAST_ANCHOR = 8
_STRUCK = re.compile(r"~~|<del\b|<s\b", re.I)


def normalised(text: str) -> str:
    """Text without what only its looks need; numbers, punctuation and case stay."""
    text = re.sub(r"<br\s*/?>", " ", text, flags=re.I)
    text = re.sub("[“”]", '"', text)
    text = re.sub("[‘’]", "'", text)
    text = re.sub(r"\\([\\`*{}\[\]()#+.!_>~|=-])", r"\1", text)
    text = re.sub(r"(?m)^\s*#{1,6}\s+", "", text)
    text = re.sub(r"\*\*|__", "", text)
    return " ".join(re.sub(r"(?<!\w)[*_]([^*_\n]+)[*_](?!\w)", r"\1", text).split())


class Edit(NamedTuple):
    before: str
    after: str
    scope: str | None
    operative: bool
    instruction: str


def _scope_heading(line: str) -> str | None:
    plain = " ".join(re.sub(r"[|#*_]", " ", line).split())
    return next((s for s, p in SCOPES.items() if re.fullmatch(p, plain, re.I)), None)


def _states(lines: list[str], scope: str | None) -> list[tuple[str | None, bool]]:
    """What is amended, and whether it is said to be done, where each line starts."""
    out, operative = [], True
    for line in lines:
        out.append((scope, operative))
        heading, plain = _scope_heading(line), normalised(re.sub(r"[|#]", " ", line))
        scope = heading or scope
        if heading or re.match(IN_FORCE, plain, re.I):
            operative = True
        elif re.match(IDLE, plain, re.I):
            operative = False
    return out


def _cells(line: str) -> list[str] | None:
    line = line.strip()
    if len(line) < 2 or line[0] != "|" or line[-1] != "|" or r"\|" in line:
        return None
    return [c.strip() for c in line[1:-1].split("|")]


def _table_edits(lines: list[str]):
    """(line number, old, new, instruction) of rows below a header that names an old and a new column."""
    columns, header = None, 0
    for k, line in enumerate(lines):
        row = _cells(line)
        if row is None:
            columns = None
            continue
        named = {kind: next((i for i, c in enumerate(row) if re.fullmatch(p, normalised(c), re.I)), None) for kind, p in COLUMNS.items()}
        if None not in named.values():
            columns, header = (named["old"], named["new"]), k
            continue
        if columns is None or len(row) <= max(columns) or all(re.fullmatch(":?-+:?", c) for c in row):
            continue
        old, new = row[columns[0]], row[columns[1]]
        if not old or not new or re.fullmatch(NOTHING, normalised(new), re.I):
            continue
        olds, news = re.split(BREAK, old), re.split(BREAK, new)
        if len(olds) != len(news):
            continue
        for x, y in zip(olds, news, strict=True):
            if not any(part.count("~~") % 2 or re.search(r"…|\.\.\.|<del\b|<s\b", part, re.I) for part in (x, y)):
                yield k, x.replace("~~", ""), re.sub(r"~~.*?~~", "", y, flags=re.S), "\n".join(lines[header : k + 1])


def _prose_edits(content: str):
    """(offset, old, new, instruction) of instructions in words."""
    for kind, patterns in INSTRUCTIONS.items():
        for pattern in patterns:
            for m in re.finditer(pattern, content, re.I | re.M):
                if kind == "insert":
                    added, anchor = normalised(m[1]), normalised(m[3])
                    yield m.start(), anchor, f"{anchor} {added}" if m[2].lower() == "after" else f"{added} {anchor}", m[0]
                else:
                    yield m.start(), m[1], m[2] if kind == "replace" else "", m[0]


def read_edits(content: str, scope: str | None) -> list[Edit]:
    """The edits that a bill states, each with the instrument it amends (``scope`` unless a heading says another)."""
    lines = content.split("\n")
    states = _states(lines, scope)
    found = [(*states[k], old, new, said) for k, old, new, said in _table_edits(lines)]
    found += [(*states[content.count("\n", 0, at)], old, new, said) for at, old, new, said in _prose_edits(content)]
    out = []
    for where, operative, old, new, said in found:
        old, new = normalised(old), normalised(new)
        if len(old) >= LEAST_ANCHOR and any(c.isalpha() for c in old) and old != new and not _STRUCK.search(old) and not _STRUCK.search(new):
            out.append(Edit(old, new, where, operative, said))
    return out


def is_delayed(content: str) -> bool:
    """Whether a bill takes effect later, or on a condition."""
    said, now, condition = (re.compile(p, re.I) for p in DELAYED)
    lines = [x for x in content.split("\n") if not x.strip().startswith("|") and said.search(x)]
    return any(not now.search(x) or condition.search(x) for x in lines)
