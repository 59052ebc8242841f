"""Periods named in questions, read in a calendar's time zone: half-open, with the words that named them."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import date, datetime, timedelta, timezone
from zoneinfo import ZoneInfo

ZONE = ZoneInfo("America/New_York")
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
#: Days of a unit when it is counted back, and what count words stand for.
UNIT_DAYS = {"day": 1, "night": 1, "week": 7, "fortnight": 14, "month": 30, "quarter": 90, "year": 365}
COUNT_WORDS = {"a": 1, "an": 1, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12, "couple": 2, "few": 3, "several": 3}
RECENT_DAYS = 30
#: The month in which the autumn term begins; the spring term begins in January.
AUTUMN = 8


@dataclass(frozen=True)
class Period:
    start: datetime
    end: datetime
    label: str
    matched: str


def _midnight(day: date) -> datetime:
    return datetime(day.year, day.month, day.day, tzinfo=ZONE).astimezone(timezone.utc)


def _of_months(name: str) -> int:
    return MONTHS.index(name.lower()) + 1


def _month_after(day: date) -> date:
    return (day.replace(day=1) + timedelta(days=32)).replace(day=1)


class _Calendar:
    """What words mean on a day: each method gives (first day, day after the last, label)."""

    def __init__(self, today: date):
        self.today, self.tomorrow = today, today + timedelta(days=1)

    def day(self, back: int, label: str):
        first = self.today - timedelta(days=back)
        return first, first + timedelta(days=1), label

    def rolling(self, count: int, unit: str):
        """That many units back from the end of today, so what was filed this morning is in."""
        days = count * UNIT_DAYS[unit]
        many = lambda n, word: f"{n} {word}{'s' * (n != 1)}"
        label = many(days, "day") if days <= 31 else unit if count == 1 else many(count, unit)
        return self.today - timedelta(days=days - 1), self.tomorrow, f"the past {label}"

    def counted(self, count: str, unit: str):
        n = COUNT_WORDS.get(count) or int(count)
        return self.rolling(n, unit) if n else None

    def term(self, last: bool):
        year, autumn = self.today.year, self.today.month >= AUTUMN
        starts = [date(year - 1, AUTUMN, 1), date(year, 1, 1), date(year, AUTUMN, 1)]
        k = 2 if autumn else 1
        return (starts[k - 1], starts[k], "last semester") if last else (starts[k], self.tomorrow, "this semester")

    def current(self, unit: str):
        if unit in ("semester", "term"):
            return self.term(last=False)
        first = {"week": self.today - timedelta(days=self.today.isoweekday() % 7), "month": self.today.replace(day=1), "year": date(self.today.year, 1, 1)}[unit]
        return first, self.tomorrow, f"this {unit}"

    def month(self, name: str, year: str | None, onwards: bool = False):
        """A month without a year is the last one that has begun."""
        k = _of_months(name)
        first = date(int(year) if year else self.today.year - (k > self.today.month), k, 1)
        return first, self.tomorrow if onwards else _month_after(first), f"{name.capitalize()} {first.year}" + " onwards" * onwards

    def year(self, year: str, onwards: bool = False):
        return date(int(year), 1, 1), self.tomorrow if onwards else date(int(year) + 1, 1, 1), year + " onwards" * onwards


_MONTH, _YEAR, _BACK = "|".join(MONTHS), r"(?:19|20)\d{2}", "last|past|previous|preceding|prior"
_UNITS = "|".join(UNIT_DAYS)
#: The first pattern that matches, the most specific first, tells the period.
_PATTERNS = tuple((re.compile(p, re.I), f) for p, f in (
    (r"\b(?:today|tonight)\b", lambda c, m: c.day(0, "today")),
    (r"\byesterday\b", lambda c, m: c.day(1, "yesterday")),
    (rf"\b(?:in|over|during|within|from)?\s*(?:the\s+)?(?:{_BACK})\s+(\d{{1,3}}|{'|'.join(COUNT_WORDS)})\s+(?:of\s+)?({_UNITS})s?\b", lambda c, m: c.counted(m[1].lower(), m[2].lower())),
    (rf"\b(?:in|over|during|within)?\s*(?:the\s+)?(?:{_BACK})\s+({_UNITS}|semester|term)\b", lambda c, m: c.term(last=True) if m[1].lower() in ("semester", "term") else c.rolling(1, m[1].lower())),
    (r"\b(?:so\s+far\s+)?this\s+(week|month|semester|term|year)\b", lambda c, m: c.current(m[1].lower())),
    (rf"\bsince\s+({_MONTH})(?:\s+(?:of\s+)?({_YEAR}))?\b", lambda c, m: c.month(m[1], m[2], onwards=True)),
    (rf"\bsince\s+({_YEAR})\b", lambda c, m: c.year(m[1], onwards=True)),
    (rf"\b({_MONTH})\s+(?:of\s+)?({_YEAR})\b", lambda c, m: c.month(m[1], m[2])),
    (rf"\b(?:in|during|for|throughout)\s+({_MONTH})\b", lambda c, m: c.month(m[1], None)),
    (rf"\b(?:in|during|for|from|throughout|of)\s+({_YEAR})\b", lambda c, m: c.year(m[1])),
    (r"\b(?:most\s+)?recent(?:ly)?\b|\blately\b|\bof\s+late\b|\bso\s+far\b|\blatest\b|\bnewest\b", lambda c, m: None if standing_lookup(m.string) else c.rolling(RECENT_DAYS, "day")),
))


def standing_lookup(question: str) -> bool:
    """Whether a question asks for the rules in force, rather than for what happened to them."""
    rules, happened = r"\b(?:constitution|bylaws?)\b", r"\b(?:happen(?:ed)?|minutes|meetings?|bills?|news|passed|voted|introduced)\b"
    return bool(re.search(rules, question, re.I)) and not re.search(happened, question, re.I)


def parse_period(question: str, now: datetime) -> Period | None:
    """The most specific period that a question names, or None.  ``now`` has a time zone."""
    calendar = _Calendar(now.astimezone(ZONE).date())
    for pattern, build in _PATTERNS:
        m = pattern.search(question)
        span = build(calendar, m) if m else None
        if span:
            return Period(_midnight(span[0]), _midnight(span[1]), span[2], m[0])
    return None


def without_period(question: str, period: Period | None) -> str:
    """The question without the words that named its period."""
    return re.sub(r"\s{2,}", " ", question.replace(period.matched, " ", 1)).strip() if period else question
