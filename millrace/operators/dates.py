"""Dates, instants and clocks in filters. Zones are applied to literals, so a column stays bare and its filter is pushed down."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import UTC, date, datetime, time, timedelta, timezone, tzinfo
from functools import reduce
from operator import or_
from zoneinfo import ZoneInfo, ZoneInfoNotFoundError

from pyspark.sql import Column
from pyspark.sql import functions as F

_OFFSET = re.compile(r"([+-])(\d{2})(?::?(\d{2}))?$")
_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:\.(\d{1,9}))?)?"
_DATE_TIME = re.compile(rf"(.+?)[T ]{_CLOCK}\s*(Z|[+-]\d{{2}}(?::?\d{{2}})?)?$")
_TIME = re.compile(rf"{_CLOCK}\s*(Z|[+-]\d{{2}}(?::?\d{{2}})?)?$")
_YEAR_FIRST = re.compile(r"(\d{4})([-/.])(\d{1,2})\2(\d{1,2})$")
_YEAR_LAST = re.compile(r"(\d{1,2})([-/.])(\d{1,2})\2(\d{4})$")
MICRO = timedelta(microseconds=1)


class BadDate(ValueError):
    """A value or a zone that isn't one."""


def zone(name: str | None) -> tzinfo:
    """UTC, an offset from -12 to +14 hours, or an Area/City name; single words are refused."""
    if not name or name.upper() in ("UTC", "Z"):
        return UTC
    if m := _OFFSET.match(name):
        minutes = (int(m[2]) * 60 + int(m[3] or 0)) * (1 if m[1] == "+" else -1)
        if not -720 <= minutes <= 840 or int(m[3] or 0) > 59:
            raise BadDate(f"offset {name} is out of range")
        return timezone(timedelta(minutes=minutes))
    if "/" not in name:
        raise BadDate(f"{name} is no zone")
    try:
        return ZoneInfo(name)
    except (ZoneInfoNotFoundError, ValueError) as e:
        raise BadDate(f"{name} is no zone") from e


@dataclass(frozen=True)
class Moment:
    """A bare day, or an instant in UTC without zone; exact: no digits below a microsecond were cut off."""

    day: date | None
    at: datetime | None
    zone: tzinfo
    exact: bool = True

    def bounds(self) -> tuple[datetime, datetime]:
        return start_of(self.day, self.zone), start_of(self.day + timedelta(days=1), self.zone)


def start_of(day: date, tz: tzinfo) -> datetime:
    """The day's first instant, in UTC without zone."""
    return datetime.combine(day, time(), tz).astimezone(UTC).replace(tzinfo=None)


def parse_day(text: str) -> date | None:
    """Year first; else by slashes month, then day first; by dots and hyphens day first."""
    try:
        if m := _YEAR_FIRST.match(text):
            return date(int(m[1]), int(m[3]), int(m[4]))
        if m := _YEAR_LAST.match(text):
            a, b, year = int(m[1]), int(m[3]), int(m[4])
            if m[2] == "/" and a <= 12:
                return date(year, a, b)
            return date(year, b, a)
    except ValueError:
        return None
    return None


def parse(value: object, default: str | None = None) -> Moment | None:
    """None if the value is no date: the filter then compares it as it is."""
    tz = zone(default)
    if isinstance(value, datetime):
        value = value if value.tzinfo else value.replace(tzinfo=tz)
        return Moment(None, value.astimezone(UTC).replace(tzinfo=None), tz)
    if isinstance(value, date):
        return Moment(value, None, tz)
    if not isinstance(value, str):
        return None
    text = value.strip()
    if day := parse_day(text):
        return Moment(day, None, tz)
    if (m := _DATE_TIME.match(text)) and (day := parse_day(m[1].strip())):
        own = zone(m[6]) if m[6] else tz
        frac = (m[5] or "").ljust(9, "0")
        try:
            clock = time(int(m[2]), int(m[3]), int(m[4] or 0), int(frac[:6]))
        except ValueError:
            return None
        at = datetime.combine(day, clock, own).astimezone(UTC).replace(tzinfo=None)
        return Moment(None, at, own, exact=frac[6:] == "000")
    return None


def _literal(at: datetime, instant: bool) -> Column:
    return F.lit(at.replace(tzinfo=UTC)) if instant else F.lit(at.isoformat(sep=" ")).cast("timestamp_ntz")


def condition(col: Column, kind: str, mode: str, moment: Moment, instant: bool = False) -> Column:
    """One of the eight comparisons. instant: the column is a TIMESTAMP, else a TIMESTAMP_NTZ in UTC."""
    mode = {"before": "lt", "after": "gt"}.get(mode, mode)
    if kind == "date":
        day = F.lit(moment.day or moment.at.date())
        return {"equal": col == day, "notEqual": col != day, "gt": col > day, "gte": col >= day, "lt": col < day, "lte": col <= day}[mode]
    if moment.day:
        lo, hi = (_literal(x, instant) for x in moment.bounds())
        return {"equal": (col >= lo) & (col < hi), "notEqual": (col < lo) | (col >= hi), "gt": col >= hi, "gte": col >= lo, "lt": col < lo, "lte": col < hi}[mode]
    at = _literal(moment.at, instant)
    if not moment.exact:  # the value lies between two microseconds
        return {"equal": F.lit(False), "notEqual": col.isNotNull(), "gt": col > at, "gte": col > at, "lt": col <= at, "lte": col <= at}[mode]
    return {"equal": col == at, "notEqual": col != at, "gt": col > at, "gte": col >= at, "lt": col < at, "lte": col <= at}[mode]


def between(col: Column, kind: str, lo: Moment, hi: Moment, instant: bool = False) -> Column:
    """Each bound by itself: a bare first day opens with it, a bare last day closes with it."""
    return condition(col, kind, "gte", lo, instant) & condition(col, kind, "lte", hi, instant)


def among(col: Column, kind: str, moments: list[Moment], instant: bool = False) -> Column:
    return reduce(or_, (condition(col, kind, "equal", m, instant) for m in moments)) if moments else F.lit(False)


def parse_clock(value: object, default: str | None) -> tuple[str, tzinfo] | None:
    """A time of day as HH:mm:ss.SSSSSS and its zone."""
    m = _TIME.match(value.strip()) if isinstance(value, str) else None
    if not m:
        return None
    try:
        clock = time(int(m[1]), int(m[2]), int(m[3] or 0), int((m[4] or "").ljust(6, "0")[:6]))
    except ValueError:
        return None
    return clock.isoformat(timespec="microseconds"), zone(m[5]) if m[5] else zone(default)


def zone_id(tz: tzinfo) -> str:
    if isinstance(tz, ZoneInfo):
        return tz.key
    minutes = int(tz.utcoffset(None).total_seconds() // 60)
    return f"{'-' if minutes < 0 else '+'}{abs(minutes) // 60:02d}:{abs(minutes) % 60:02d}"


def clock_of(col: Column, kind: str, tz: tzinfo) -> Column:
    """The column's time of day; only a timestamptz column is put into the zone."""
    if kind == "clock":
        return col.cast("string")
    if kind == "timestamptz":
        col = F.convert_timezone(F.lit("UTC"), F.lit(zone_id(tz)), col.cast("timestamp_ntz"))
    return F.date_format(col, "HH:mm:ss.SSSSSS")


def day_in(col: Column, tz: str) -> Column:
    """The business day of a UTC wall clock in the zone."""
    return F.to_date(F.convert_timezone(F.lit("UTC"), F.lit(tz), col))


def parse_date_column(col: Column) -> Column:
    """Days of a text column in the order of parse_day(); null if none fits."""
    formats = ("yyyy-M-d", "yyyy/M/d", "yyyy.M.d", "M/d/yyyy", "d/M/yyyy", "d.M.yyyy", "d-M-yyyy")
    shape = col.rlike(r"^(\d{4}([-/.])\d{1,2}\2\d{1,2}|\d{1,2}([-/.])\d{1,2}\3\d{4})$")
    return F.when(shape, F.coalesce(*[F.to_date(F.try_to_timestamp(col, F.lit(f))) for f in formats]))
