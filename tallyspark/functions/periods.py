"""Calendar periods: keys, labels, bounds and comparison windows.

Period *keys* are dates (the first day of the period) and stay dates through
every plan; labels are made for output only.
"""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

GRAINS = ("day", "week", "month", "quarter", "year")
COMPARES = ("previous", "year_ago")
PRESETS = ("MTD", "QTD", "YTD", "3M", "6M", "12M")
MONTHS_IN = {"month": 1, "quarter": 3, "year": 12}

# A text value is read as a timestamp only when it starts like a full date:
# Spark would otherwise accept '2025' and turn '12:30' into today.
_FULL_DATE = r"^\s*\d{4}-\d{1,2}-\d{1,2}"
_BOUND = re.compile(r"^\d{4}-\d{2}(-\d{2})?$")


def check_grain(grain: str) -> str:
    if grain not in GRAINS:
        raise ValueError(f"unknown grain {grain!r}")
    return grain


# ------------------------------------------------------------- columns ---

def tolerant_timestamp(text: Column) -> Column:
    return F.when(text.rlike(_FULL_DATE), text.try_cast("timestamp_ntz"))


def key(ts: Column, grain: str) -> Column:
    """First day of the period that contains ``ts``."""
    if check_grain(grain) == "day":
        return ts.cast("date")
    return F.trunc(ts.cast("date"), grain)


def label(period: Column, grain: str) -> Column:
    """The printed name of a period key."""
    if grain == "month":
        return F.date_format(period, "yyyy-MM")
    if grain == "quarter":
        return F.concat(F.date_format(period, "yyyy"), F.lit("-Q"), F.quarter(period).cast("string"))
    if grain == "year":
        return F.date_format(period, "yyyy")
    return F.date_format(period, "yyyy-MM-dd")


def last_day_of(period: Column, grain: str) -> Column:
    if grain == "day":
        return period
    if grain == "week":
        return F.date_add(period, 6)
    return F.date_sub(F.add_months(period, MONTHS_IN[grain]), 1)


def bounds(period: Column, grain: str) -> tuple[Column, Column]:
    """The inclusive (from, to) values that a drill into this period sends back."""
    shape = "yyyy-MM-dd" if grain in ("day", "week") else "yyyy-MM"
    return F.date_format(period, shape), F.date_format(last_day_of(period, grain), shape)


def year_ago(period: Column, grain: str) -> Column:
    """Same period last year; a week goes back 52 weeks to stay on a Monday."""
    return F.date_sub(period, 364) if grain == "week" else F.add_months(period, -12)


def step(grain: str) -> Column:
    """The interval from one period key to the next."""
    names = {"day": "1 day", "week": "7 days", "month": "1 month", "quarter": "3 months", "year": "1 year"}
    return F.expr(f"interval {names[check_grain(grain)]}")


def prose(period: Column, grain: str = "month") -> Column:
    if grain == "month":
        return F.date_format(period, "MMM yyyy")
    return F.date_format(period, "d MMM yyyy") if grain in ("day", "week") else label(period, grain)


# ------------------------------------------------------ literal windows ---

def is_bound(text: str) -> bool:
    if not _BOUND.match(str(text)):
        return False
    try:
        first_day(text)
    except ValueError:
        return False
    return True


# Days of the calendar are placed on a line of months, numbered from the year 0.

_DAY = dt.timedelta(days=1)


def _month(day: dt.date) -> int:
    return day.year * 12 + day.month - 1


def _start(month: int) -> dt.date:
    return dt.date(month // 12, month % 12 + 1, 1)


def first_day(text: str) -> dt.date:
    return dt.date.fromisoformat(text if len(text) == 10 else f"{text}-01")


def last_day(text: str) -> dt.date:
    return first_day(text) if len(text) == 10 else month_end(first_day(text))


def month_end(day: dt.date) -> dt.date:
    return _start(_month(day) + 1) - _DAY


def add_months(day: dt.date, months: int) -> dt.date:
    """The same day of another month, or that month's last."""
    to = _start(_month(day) + months)
    return min(to + _DAY * (day.day - 1), month_end(to))


@dataclass(frozen=True)
class Span:
    """An inclusive range of days."""

    first: dt.date
    last: dt.date

    @classmethod
    def of_months(cls, months: range) -> Span:
        return cls(_start(months.start), _start(months.stop) - _DAY)

    @property
    def days(self) -> int:
        return (self.last - self.first) // _DAY + 1

    @property
    def months(self) -> range | None:
        """The months that the span covers exactly, if it does."""
        touched = range(_month(self.first), _month(self.last) + 1)
        return touched if touched and Span.of_months(touched) == self else None

    @property
    def label(self) -> str:
        def day(d: dt.date, year: bool) -> str:
            return f"{d.day} {d:%b %Y}" if year else f"{d.day} {d:%b}"

        if self.months:
            ends = sorted({_start(self.months[0]), _start(self.months[-1])})
            return " – ".join(f"{d:%b %Y}" for d in ends)
        return day(self.last, True) if self.days == 1 else f"{day(self.first, False)} – {day(self.last, True)}"

    def head(self, days: int) -> Span:
        """At most its first ``days`` days."""
        return Span(self.first, min(self.last, self.first + _DAY * (days - 1)))

    def before(self, compare: str) -> Span:
        """The span to hold this one against: as many months before, if it is made of whole months;
        as many days before, if not; or the same a year earlier."""
        if compare not in COMPARES:
            raise ValueError(f"{compare!r} is no way to compare")
        m = self.months
        if m:
            back = len(m) if compare == "previous" else 12
            return Span.of_months(range(m.start - back, m.stop - back))
        if compare == "previous":
            return Span(self.first - _DAY * self.days, self.first - _DAY)
        return Span(*(add_months(d, -12) for d in (self.first, self.last)))


def span_around(day: dt.date, grain: str) -> Span:
    """The period of that grain in which a day falls; a week begins with Monday."""
    size = MONTHS_IN.get(check_grain(grain))
    if size:
        m = _month(day) - _month(day) % size
        return Span.of_months(range(m, m + size))
    first = day - _DAY * (day.weekday() if grain == "week" else 0)
    return Span(first, first + _DAY * (6 if grain == "week" else 0))


def span_of(label_text: str, grain: str) -> Span:
    """The days that a period label names; a label of another shape is refused."""
    shapes = {"day": r"(\d{4})-(\d\d)-(\d\d)", "week": r"(\d{4})-(\d\d)-(\d\d)", "month": r"(\d{4})-(\d\d)",
              "quarter": r"(\d{4})-Q([1-4])", "year": r"(\d{4})"}
    found = re.fullmatch(shapes[check_grain(grain)], str(label_text))
    if not found:
        raise ValueError(f"{label_text!r} names no {grain}")
    year, part, day = (*(int(x) for x in found.groups()), 1, 1)[:3]
    span = span_around(dt.date(year, part * 3 - 2 if grain == "quarter" else part, day), grain)
    if grain == "week" and span.first != dt.date(year, part, day):
        raise ValueError(f"{label_text!r} is no Monday")
    return span


def preset_start(last: dt.date, preset: str) -> dt.date:
    """Where a relative range that ends with the data begins."""
    if preset not in PRESETS:
        raise ValueError(f"{preset!r} is no preset")
    to_date = {"MTD": "month", "QTD": "quarter", "YTD": "year"}
    if preset in to_date:
        return span_around(last, to_date[preset]).first
    return _start(_month(last) + 1 - int(preset.removesuffix("M")))


@dataclass(frozen=True)
class Comparison:
    """Period B and the period A it is held against."""

    a: Span
    b: Span
    like_for_like: bool
    aligned: bool
    data_end: dt.date


def compare_spans(data_end: dt.date | None, grain: str, compare: str, date_from: str | None = None,
                  date_to: str | None = None) -> Comparison:
    """B is the range asked for, or the period in which the data ends; A is what
    comes before it.  If the data ends within B, both keep as many days as there are."""
    if data_end is None:
        raise ValueError("without dates there is nothing to compare")
    if date_to and not date_from:
        raise ValueError("give the first day too")
    asked = Span(first_day(date_from), last_day(date_to) if date_to else data_end) if date_from else span_around(data_end, grain)
    there = Span(asked.first, data_end).days
    if there < 1 and data_end < asked.last:
        raise ValueError("the data ends before that range")
    cut = data_end < asked.last
    a, b = (s.head(there) if cut else s for s in (asked.before(compare), asked))
    return Comparison(a, b, like_for_like=cut, aligned=span_around(asked.first, grain) == asked, data_end=data_end)
