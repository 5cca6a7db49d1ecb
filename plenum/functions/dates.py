"""Date parsing, plausibility and campaign calendar arithmetic."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

from plenum.functions import fixed
from plenum.functions.text import _col, strip


def excel_serial_to_date(c: Column | str) -> Column:
    days = strip(_col(c).cast("string")).try_cast("int")
    return F.date_add(F.lit("1899-12-30").cast("date"), days)


def plausible_date(c: Column | str, first: str = "2020-01-01", last: str = "2030-12-31") -> Column:
    """The date, null outside the plausible range or if it cannot be read."""
    day = _col(c).try_cast("date")
    return F.when(day.between(F.lit(first).cast("date"), F.lit(last).cast("date")), day)


def plausible_timestamp(c: Column | str, first_year: int = 2020, last_year: int = 2030) -> Column:
    ts = _col(c).try_cast("timestamp")
    return F.when(F.year(ts).between(first_year, last_year), ts)


def repair_timestamp(c: Column | str) -> Column:
    """Parse a timestamp after undoing the two export defects (``.000Z`` and ``..``)."""
    text = F.replace(F.replace(_col(c).cast("string"), F.lit(".000Z"), F.lit("Z")), F.lit(".."), F.lit("."))
    return text.try_cast("timestamp")


def first_timestamp(columns: list[str]) -> Column:
    """The first of the known timestamp columns that parses."""
    present = [c for c in fixed.TIMESTAMP_COLUMNS if c in columns]
    if not present:
        return F.lit(None).cast("timestamp")
    return F.coalesce(*[repair_timestamp(c) for c in present])


def presence(c: Column | str, *empty: str) -> Column:
    """1 when the field says something, else 0."""
    return F.coalesce((~_col(c).isin("", *empty)).cast("int"), F.lit(0))


def days_until(day: Column | str, election: Column | str) -> Column:
    return F.datediff(_col(election), _col(day))


def week_before_election(day: Column | str, election: Column | str) -> Column:
    left = days_until(day, election)
    return F.when(left < 0, 1).otherwise(F.floor(left / 7).cast("int") + 1)


def deadline_days(day: Column | str, election: Column | str) -> Column:
    left = days_until(day, election)
    return F.when(left >= 0, left)


def contact_goal(win_number: Column | str) -> Column:
    return (_col(win_number) * 3).cast("bigint")


def contact_budget(win_number: Column | str) -> Column:
    return _col(win_number) * 3 * F.lit(0.30) / F.lit(0.60)


def _window(start: Column, end: Column) -> Column:
    return F.struct(F.least(start, end).alias("start_date"), end.alias("end_date"))


def opening_window(election: Column | str, as_of: Column | str | date) -> Column:
    """Contact window of a primary, or of a general election without primary."""
    end = _col(election)
    today = F.lit(as_of) if isinstance(as_of, date) else _col(as_of)
    start = F.when(F.datediff(end, today) > 52, F.date_sub(end, 49)).otherwise(F.date_add(today, 3))
    return _window(F.when(start >= end, today).otherwise(start), end)


def closing_window(primary: Column | str, election: Column | str) -> Column:
    """Contact window between a primary and the general election."""
    end, next_day = _col(election), F.date_add(_col(primary), 1)
    start = F.greatest(next_day, F.date_sub(end, 49))
    return _window(F.when(start >= end, next_day).otherwise(start), end)


def parse_campaign_date(c: Column | str, election: Column | str, as_of: Column | str | date) -> Column:
    """A plan date such as ``JULY 15``, ``7/15`` or ``JULY 15, 2025`` in the election's year."""
    text = F.translate(F.upper(strip(c)), "[]", "")
    end = _col(election)
    today = F.lit(as_of) if isinstance(as_of, date) else _col(as_of)
    year = F.date_format(end, "yyyy")
    word = F.initcap(F.regexp_extract(text, r"^([A-Z]+)\s+\d{1,2}$", 1))
    day = F.regexp_extract(text, r"^[A-Z]+\s+(\d{1,2})$", 1)
    slashed = F.regexp_extract(text, r"^(\d{1,2}/\d{1,2})$", 1)
    full = F.initcap(F.regexp_replace(F.regexp_extract(text, r"^([A-Z]+\s+\d{1,2},\s+\d{4})$", 1), r"\s+", " "))
    named = F.concat_ws(" ", word, day, year)
    explicit = F.try_to_date(full, "MMMM d, yyyy")
    parsed = F.coalesce(
        F.try_to_date(named, "MMMM d yyyy"),
        F.try_to_date(named, "MMM d yyyy"),
        F.try_to_date(F.concat(slashed, F.lit("/"), year), "M/d/yyyy"),
        explicit,
    )
    # a date well before today is taken to mean the election's year
    moved = F.try_to_date(F.concat(year, F.date_format(parsed, "-MM-dd")), "yyyy-MM-dd")
    settled = F.when(parsed < F.date_sub(today, 30), moved).otherwise(parsed)
    return F.coalesce(settled, F.date_sub(end, 30))


def template_theme(description: Column | str) -> Column:
    text = F.lower(_col(description))
    hits = [F.when(text.rlike("|".join(words)), F.lit(theme)) for words, theme in fixed.THEME_WORDS]
    return F.coalesce(*hits, F.lit(fixed.THEME_DEFAULT))


def event_routing(event_name: Column | str) -> Column:
    """Flow type, call to action and theme of a timeline event."""
    text = F.lower(_col(event_name))

    def route(r: tuple[str, str, str]) -> Column:
        return F.struct(F.lit(r[0]).alias("flow_type"), F.lit(r[1]).alias("cta"), F.lit(r[2]).alias("theme"))

    hits = [F.when(text.rlike("|".join(words)), route(r)) for words, r in fixed.EVENT_WORDS]
    return F.coalesce(*hits, route(fixed.EVENT_DEFAULT))
