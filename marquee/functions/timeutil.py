"""Instants, local days and dates inside text. Instants are UTC timestamps without zone; `now` is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "Europe/Kyiv"
#: Month names in the genitive, fixed values.
MONTHS = {"січня": 1, "лютого": 2, "березня": 3, "квітня": 4, "травня": 5, "червня": 6, "липня": 7, "серпня": 8, "вересня": 9, "жовтня": 10, "листопада": 11, "грудня": 12}
_MONTH = "(" + "|".join(MONTHS) + ")"
#: A day, a month's name, perhaps a year, perhaps a time: groups day, month, year, hour, minute; fixed pattern.
DATE_IN_TEXT = rf"(?iu)(\d{{1,2}})\s+{_MONTH}(?:\s+(20\d{{2}}))?(?:\s*[,|—-]?\s*(\d{{1,2}}):(\d{{2}}))?"
#: A month's name with a time at least: groups day, month, year, hour, minute; fixed pattern.
DATE_LINE = rf"(?iu)(?<![\p{{L}}\p{{N}}_])(\d{{1,2}})\s+{_MONTH}\s+(?:(20\d{{2}})\s*[,—-]?\s*)?(\d{{1,2}}):(\d{{2}})(?!\p{{N}})"
#: Numbers with a time: groups day, month, year, hour, minute; fixed pattern.
NUMBERS = r"(\d{1,2})[./-](\d{1,2})[./-](20\d{2})\s*(?:[рР]\.?\s*)?(\d{1,2}):(\d{2})"
#: Numbers or a month's name, with a time, as generic cards have it; fixed pattern.
GENERIC_DATE = rf"(?iu)(\d{{1,2}})[./-](\d{{1,2}})[./-](20\d{{2}})\s*(?:р\.?\s*)?(\d{{1,2}}):(\d{{2}})|(\d{{1,2}})\s+{_MONTH}(?:\s+(20\d{{2}}))?\s*(?:р\.?\s*)?(\d{{1,2}}):(\d{{2}})"
#: A weekday's name or an apostrophe may stand between, and twelve characters before the time, as catalogue cards have it; fixed pattern.
CATALOGUE_DATE = rf"(?iu)(\d{{1,2}})\s+(?:[а-яіїєґ]+\s+)?{_MONTH}\s*(?:['’]\s*)?(20\d{{2}})?[^0-9]{{0,12}}(\d{{1,2}}):(\d{{2}})"
#: A weekday's name may stand between, as month pages have it; fixed pattern.
MONTH_PAGE_DATE = rf"(?iu)(?<![\p{{L}}\p{{N}}_])(\d{{1,2}})\s+(?:[а-яіїєґ]+\s+)?{_MONTH}\s*[’']?\s*(20\d{{2}})?\s*,?\s*(\d{{1,2}}):(\d{{2}})"
#: A line that is a date and a time, as markdown city pages have it; fixed pattern.
MARKDOWN_DATE = rf"(?iu)^(\d{{1,2}})\s+{_MONTH}\s+(\d{{4}}),\s*(\d{{1,2}}):(\d{{2}})$"


def to_local(instant: Column, zone: str = ZONE) -> Column:
    return F.from_utc_timestamp(instant.cast("timestamp"), zone)


def to_utc(local: Column, zone: str = ZONE) -> Column:
    return F.to_utc_timestamp(local.cast("timestamp"), zone)


def in_range(ts: Column, start: str, end: str) -> Column:
    """start <= ts < end; the ends are literals, so the scan can skip row groups."""
    return (ts >= F.lit(start).cast("timestamp_ntz")) & (ts < F.lit(end).cast("timestamp_ntz"))


def weekend_start(day: Column) -> Column:
    """The next Saturday; on a Saturday that day, on a Sunday the next weekend's."""
    return F.date_add(day, (5 - F.weekday(day) + 7) % 7)


def month_number(name: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in MONTHS.items() for x in pair))
    return F.try_element_at(table, F.lower(name))


def _parts(text: Column, pattern: str) -> list[Column]:
    return [F.nullif(F.regexp_extract(text, pattern, k), F.lit("")) for k in range(1, 6)]


def _stamp(year: Column, month: Column, day: Column, hour: Column, minute: Column) -> Column:
    return F.try_make_timestamp(year.cast("int"), month.cast("int"), day.cast("int"), F.coalesce(hour.cast("int"), F.lit(0)), F.coalesce(minute.cast("int"), F.lit(0)), F.lit(0))


def date_in_text(text: Column, now: Column, default_year: Column | None = None) -> Column:
    """The first date with a month's name in a text: no time is 00:00; a missing year is the default's, or the next one if that is past; null if there is none or it is no date."""
    day, month, year, hour, minute = _parts(text, DATE_IN_TEXT)
    base = F.coalesce(year.cast("int"), default_year if default_year is not None else F.year(now))
    found = _stamp(base, month_number(month), day, hour, minute)
    later = _stamp(base + 1, month_number(month), day, hour, minute)
    return F.when(year.isNull() & (found < now), later).otherwise(found)


def date_of_line(line: Column, default_year: Column) -> Column:
    """A catalogue line's date, a month's name with a time; numbers alone are none; null if there is none or it is no date."""
    day, month, year, hour, minute = _parts(line, DATE_LINE)
    return _stamp(F.coalesce(year.cast("int"), default_year), month_number(month), day, hour, minute)


def iso_instant(text: Column) -> Column:
    """ISO text with Z, an offset or none (then UTC), seconds or none; null if it is none."""
    return F.regexp_replace(text, r"([T ]\d{1,2}:\d{2})(?=$|Z|[+-])", "$1:00").try_cast("timestamp")


def year_in_text(text: Column, now: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(text, r"(?<!\d)(20\d{2})(?!\d)", 1), F.lit("")).cast("int"), F.year(now))


def month_slots(start: Column, months: int) -> Column:
    """The first days of `months` months from start's."""
    return F.transform(F.sequence(F.lit(0), F.lit(months - 1)), lambda k: F.add_months(F.trunc(start, "month"), k))


def _day(at: Column) -> Column:
    return F.date_trunc("day", at)


def date_numeric(text: Column) -> Column:
    """The first date of numbers alone, with a time; null if there is none or it is no date."""
    day, month, year, hour, minute = _parts(text, NUMBERS)
    return _stamp(year, month, day, hour, minute)


def date_generic(text: Column, now: Column) -> Column:
    """A generic card's date: the first in the text; a missing year is now's, or the next one if the day is past; null if it is no date."""
    part = [F.nullif(F.regexp_extract(text, GENERIC_DATE, k), F.lit("")) for k in range(1, 11)]
    base = F.coalesce(part[7].cast("int"), F.year(now))
    named = _stamp(base, month_number(part[6]), part[5], part[8], part[9])
    later = _stamp(base + 1, month_number(part[6]), part[5], part[8], part[9])
    named = F.when(part[7].isNull() & (named < _day(now)), later).otherwise(named)
    return F.when(part[0].isNotNull(), _stamp(part[2], part[1], part[0], part[3], part[4])).otherwise(named).cast("timestamp_ntz")


def date_catalogue(text: Column, default_year: Column) -> Column:
    """A catalogue card's date; a missing year is the default's; null if there is none or it is no date."""
    day, month, year, hour, minute = _parts(text, CATALOGUE_DATE)
    return _stamp(F.coalesce(year.cast("int"), default_year), month_number(month), day, hour, minute).cast("timestamp_ntz")


def date_month_page(text: Column, default_year: Column) -> Column:
    day, month, year, hour, minute = _parts(text, MONTH_PAGE_DATE)
    return _stamp(F.coalesce(year.cast("int"), default_year), month_number(month), day, hour, minute).cast("timestamp_ntz")


def date_markdown(line: Column) -> Column:
    day, month, year, hour, minute = _parts(line, MARKDOWN_DATE)
    return _stamp(year, month_number(month), day, hour, minute).cast("timestamp_ntz")


def iso_local(text: Column) -> Column:
    """The local fields of an ISO time; its offset or Z is dropped; null if it is none."""
    bare = F.regexp_replace(text, r"(?<=\d{2}:\d{2})(:\d{2}(?:\.\d+)?)?(?:Z|[+-]\d{2}:?\d{2})$", "$1")
    return F.regexp_replace(bare, r"([T ]\d{1,2}:\d{2})$", "$1:00").try_cast("timestamp_ntz")


#: Names of months in the addresses of month pages, fixed values.
MONTH_SLUGS = "january february march april may june july august september october november december".split()


def month_urls(base: str, now: str, months: int = 6) -> list[str]:
    """Addresses of the month pages from now's month on; December is followed by January."""
    first = int(now[5:7]) - 1
    return [f"{base.rstrip('/')}/{MONTH_SLUGS[(first + k) % 12]}/" for k in range(months)]
