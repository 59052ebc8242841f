"""Markdown as readable prose and as a line that describes it, by built-in expressions; the same rules as SQL.

Lossy: never for anything that a place in the text is counted from.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What an export leaves behind, what markdown marks up, and what stands for each, in the order in which they go.
_IMAGES = (
    (r"(?m)^[ \t]*(?:\[[^\]\n]+\])?:[ \t]*<data:image/[^>]*>(?:[ \t]+[\"'][^\r\n]*[\"'])?[ \t]*$", ""),
    (r"!\[[^\]\n]*\](?:\([^)\n]*\)|\[[^\]\n]*\])", ""),
    (r"~?\[\](?:\([^)\n]*\)|\[[^\]\n]*\])?", ""),
    (r"(?i)\[image\d+\]", ""),
)
LEFTOVERS = (*_IMAGES, (r"(?m)[ \t]+$", ""), (r"\n{3,}", "\n\n"), (r"\A\s+|\s+\z", ""))
MARKUP = (
    *_IMAGES,
    (r"\[([^\]\n]*)\]\([^)\n]*\)", "$1"),
    (r"\[([^\]\n]*)\]\[[^\]\n]*\]", "$1"),
    (r"(?m)^\s*\[[^\]\n]+\]:\s*\S.*$", ""),
    (r"(?i)<br\s*/?>", " "),
    (r"(?m)^\s*\|?[\s:|-]{4,}\|?\s*$", " "),
    (r"\|", " "),
    (r"(?m)^\s*>\s?", ""),
    (r"(?m)^\s*[-*+]\s+", ""),
    (r"(?m)^\s*\d+[.)]\s+", ""),
    (r"#{1,6}\s+", ""),
    ("[*_`~]", ""),
    (r"\\([^A-Za-z0-9])", "$1"),
    (r"[\[\]]{2,}", " "),
    (r"\s+", " "),
    (r"\A\s+|\s+\z", ""),
)
# Openings of texts that say nothing of the document; headings of a roll, alone or with no name behind them, up
# to so many characters; marks of an invitation that only count together; words of a roll of which three are too many.
NOISE = (
    r"(?i)^join zoom\b", r"(?i)zoom\.us", r"(?i)^meeting minutes:?$", r"(?i)^(discussion|agenda items|committee members|attendance):?$", r"(?i)^call to order and attendance", r"(?i)^tab \d+$",
)
TOGETHER = ((r"(?i)^call to order\b", r"(?i)\(\d+\s*min\)"), (r"\b(PDT|MDT|CDT|EDT|EST|PST|GMT)\b", r"(?i)\b(join zoom|am|pm)\b"))
ABSENT, ROLL_WORDS, A_NAME = r"(?i)^absentees?:", "(?i)absentees?|excused|unexcused|present", "[A-Z][a-z]{2,}"
ROLL, ROLL_CHARS, MARKED, MARKS, SHORTEST = r"(?i)^(attendance|absent|present|excused|faculty|here)\b", 220, r"\b(Present|Absent|Excused)\b", 3, 8
LIMIT = 300


def _replaced(text: Column, steps) -> Column:
    for pattern, by in steps:
        text = F.regexp_replace(text, pattern, by)
    return text


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.transform(F.array(value), body)[0]


def prose(text: Column) -> Column:
    """A block of markdown as one line of prose."""
    return _replaced(text, MARKUP)


def _in_lines(pattern: str) -> str:
    """A pattern of ``MARKUP`` that finds in a text what it finds in each of its lines: its blanks, and what it excludes, end at a newline."""
    blank = r"[^\S\n]"
    out = pattern.replace(r"[\s:|-]", r"(?:[^\S\n]|[:|-])").replace(r"\s", blank).replace(r"[^A-Za-z0-9]", r"[^A-Za-z0-9\n]").replace(r"\A", "^").replace(r"\z", "$")
    return out if out.startswith("(?m)") else f"(?m){out}"


def prose_lines(text: Column) -> Column:
    """Each line by itself as prose, by replacements over the whole text."""
    return _replaced(text, [(_in_lines(p), by) for p, by in MARKUP])


def is_noise(line: Column) -> Column:
    """Whether a line of prose is what a meeting opens with, and no description."""
    out = F.length(line) < SHORTEST
    for p in NOISE:
        out = out | line.rlike(p)
    for a, b in TOGETHER:
        out = out | (line.rlike(a) & line.rlike(b))
    out = out | (line.rlike(ABSENT) & ~F.regexp_replace(line, ROLL_WORDS, "").rlike(A_NAME))
    return out | (line.rlike(ROLL) & (F.length(line) < ROLL_CHARS)) | (F.size(F.regexp_extract_all(line, F.lit(MARKED), F.lit(0))) >= MARKS)


def shortened(line: Column, limit: int = LIMIT) -> Column:
    """A line of at most ``limit`` characters, cut at a space if one is beyond six tenths."""
    head = F.substring(line, 1, limit - 3)
    at = F.length(head) - F.length(F.substring_index(head, " ", -1)) - 1
    cut = F.when(at > limit * 0.6, F.substring(head, F.lit(1), at)).otherwise(head)
    return F.when(F.length(line) <= limit, line).otherwise(F.concat(F.regexp_replace(cut, r"\s+\z", ""), F.lit("...")))


def description(text: Column, limit: int = LIMIT) -> Column:
    """The first block of prose that says something, else the first heading that does, else nothing; null texts are empty.

    Each block is made prose once, and whole texts are read.
    """
    blocks = F.split(_replaced(F.coalesce(text, F.lit("")), LEFTOVERS), r"\n\s*\n")
    read = F.transform(blocks, lambda b: F.struct(F.regexp_replace(b, r"\A\s+", "").startswith("#").alias("head"), prose(b).alias("line")))
    usable = F.filter(read, lambda x: ~is_noise(x["line"]))
    first = _let(usable, lambda u: F.coalesce(F.get(F.filter(u, lambda x: ~x["head"]), F.lit(0)), F.get(u, F.lit(0))))
    return _let(F.coalesce(first["line"], F.lit("")), lambda line: shortened(line, limit))


# --- the same as SQL -----------------------------------------------------------------------------------------------------


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def matches_sql(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, {quoted(pattern)})"


def replaced_sql(column: str, steps) -> str:
    for pattern, by in steps:
        column = f"regexp_replace({column}, {quoted(pattern)}, {quoted(by.replace('$1', chr(92) + '1'))}, 'g')"
    return column


def prose_sql(column: str) -> str:
    return replaced_sql(column, MARKUP)


def noise_sql(line: str) -> str:
    m = lambda p: matches_sql(line, p)
    parts = [f"length({line}) < {SHORTEST}", *map(m, NOISE), *(f"({m(a)} and {m(b)})" for a, b in TOGETHER)]
    parts += [f"({m(ABSENT)} and not {matches_sql(replaced_sql(line, ((ROLL_WORDS, ''),)), A_NAME)})", f"({m(ROLL)} and length({line}) < {ROLL_CHARS})", f"len(regexp_extract_all({line}, {quoted(MARKED)})) >= {MARKS}"]
    return "(" + " or ".join(parts) + ")"
