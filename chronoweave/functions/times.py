"""Dates and instants as expressions that do not depend on the session time zone."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from chronoweave.errors import ValidationError

DAY_MICROS = 86_400_000_000
FAR_DAY = "9999-12-31"
_ISO_DAY = re.compile(r"\d{4}-\d{2}-\d{2}")

#: English month names by number; the first three letters suffice.
MONTHS = {
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "jun": 6,
    "jul": 7, "aug": 8, "sep": 9, "oct": 10, "nov": 11, "dec": 12,
}


def day_literal(value: str | dt.date, name: str = "date") -> Column:
    """A validated DATE literal from ``YYYY-MM-DD`` text or a ``date``."""
    # Text and a cast, folded before planning: Python dates before year 1000 do not survive conversion.
    return F.lit(parse_day(value, name).isoformat()).cast("date")


def parse_day(value: str | dt.date, name: str = "date") -> dt.date:
    if isinstance(value, dt.date) and not isinstance(value, dt.datetime):
        return value
    if not isinstance(value, str) or not _ISO_DAY.fullmatch(value):
        raise ValidationError(f"{name} must be text like 2024-01-31, not {value!r}")
    try:
        return dt.date.fromisoformat(value)
    except ValueError as exc:
        raise ValidationError(f"{name}: {exc}") from exc


def parse_instant(value: str | dt.datetime, name: str = "cutoff") -> dt.datetime:
    """A UTC instant; text without an offset is taken as UTC, a bare day as its midnight."""
    if isinstance(value, str):
        try:
            value = dt.datetime.fromisoformat(value)
        except ValueError as exc:
            raise ValidationError(f"{name} must be an ISO date or timestamp, not {value!r}") from exc
    if not isinstance(value, dt.datetime):
        raise ValidationError(f"{name} must be an ISO date or timestamp, not {value!r}")
    return value.replace(tzinfo=dt.timezone.utc) if value.tzinfo is None else value.astimezone(dt.timezone.utc)


def instant_literal(value: str | dt.datetime, name: str = "cutoff") -> Column:
    return F.timestamp_micros(F.lit(instant_micros(value, name)))


def instant_micros(value: str | dt.datetime, name: str = "cutoff") -> int:
    moment = parse_instant(value, name)
    return (moment - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)) // dt.timedelta(microseconds=1)


def utc_day(instant: Column) -> Column:
    """The UTC calendar day of a timestamp."""
    return F.date_from_unix_date(F.floor(F.unix_micros(instant) / F.lit(DAY_MICROS)).cast("int"))


def midnight_micros(day: Column) -> Column:
    """Microseconds since 1970 of 00:00 UTC of a day."""
    return F.unix_date(day).cast("bigint") * F.lit(DAY_MICROS)


def iso_day(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM-dd")


def month_of(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def written_day(text: Column) -> Column:
    """The calendar day that free text states, NULL where it states none that exists.

    Year-first notations (dashes, slashes, eight digits, with or without a
    clock time and offset), dotted day-first dates, and English month names
    with the day before or after them, are read.  Clock time and offset
    never move the day.
    """
    t = F.trim(text)
    year_first = r"^(\d{4})[-/.]?(\d{2})[-/.]?(\d{2})(?!\d)"
    dotted = r"^(\d{1,2})\.(\d{1,2})\.(\d{4})(?!\d)"
    day_month = r"(?i)^(?:[a-z]+,?\s+)?(\d{1,2})(?:st|nd|rd|th)?\s+([a-z]{3,9})\.?,?\s+(\d{4})(?!\d)"
    month_day = r"(?i)^(?:[a-z]+,\s+)?([a-z]{3,9})\.?\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{4})(?!\d)"

    def part(pattern: str, group: int) -> Column:
        return F.regexp_extract(t, pattern, group)

    def month_number(name: Column) -> Column:
        short = F.lower(F.substring(name, 1, 3))
        pairs = [x for k, v in MONTHS.items() for x in (F.lit(k), F.lit(f"{v:02d}"))]
        return F.element_at(F.create_map(*pairs), short)

    def iso(year: Column, month: Column, day: Column) -> Column:
        return F.try_to_date(F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd")

    def named(year: Column, month: Column, day: Column) -> Column:
        number = month_number(month)
        return F.when(number.isNotNull(), iso(year, number, day))

    return (
        F.when(F.length(part(year_first, 1)) > 0, iso(part(year_first, 1), part(year_first, 2), part(year_first, 3)))
        .when(F.length(part(dotted, 1)) > 0, iso(part(dotted, 3), part(dotted, 2), part(dotted, 1)))
        .when(F.length(part(day_month, 1)) > 0, named(part(day_month, 3), part(day_month, 2), part(day_month, 1)))
        .when(F.length(part(month_day, 1)) > 0, named(part(month_day, 3), part(month_day, 1), part(month_day, 2)))
    )
