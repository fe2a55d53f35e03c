"""Dates from text: many formats, first success wins; keyword windows; gaps and clamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vexarium.functions.text import _c, keyword_window

_ISO = ["yyyy-MM-dd'T'HH:mm:ss" + f for f in (".SSSSSS'Z'", ".SSS'Z'", "'Z'", "")] + ["yyyy-MM-dd'T'HH:mm"]
#: With a time of day. Zone names are cut off first, so the local fields are kept.
DATE_TIMES = [*_ISO, "yyyy/MM/dd HH:mm:ss", "MM/dd/yyyy HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", *[f"MMM {d}, yyyy{c} {t}" for c in (",", "") for d in ("d", "dd") for t in ("h:mm a", "hh:mm:ss a", "HH:mm:ss a", "H:mm a")], "dd MMM yyyy HH:mm a", "dd MMM yyyy HH a", "MMM dd HH:mm:ss yyyy"]
_MONTH_FIRST = [f"{m} {d}{c} yyyy" for m in ("MMM", "MMMM") for c in (",", "") for d in ("dd", "d")]
DATES = [*_MONTH_FIRST, "M/d/yyyy", "yyyy/MM/dd", "yyyy-MM-dd", "yyyy-MMM-dd", "MM-dd-yyyy", "MM dd yyyy", "d MMM yyyy", "d MMMM yyyy", "dd-MMM-yy", "dd-MM-yyyy", "d.M.yyyy"]


def parse_timestamp(x: Column | str) -> Column:
    """A timestamp from any of the formats; dates are midnight, month and year the first of the month; null if none matches.

    Weekday names, zone names and ordinal endings (1st, 2nd) are cut off before the formats are tried."""
    t = F.regexp_replace(_c(x), r"^(?i:mon|tue|wed|thu|fri|sat|sun)\s+", "")
    t = F.regexp_replace(t, r"(?<=\d:\d{2}|[AaPp][Mm])\s+(?!AM\b|PM\b)[A-Z]{2,5}(?=\s|$)", "")
    t = F.regexp_replace(t, r"(?<=\d)(?:st|nd|rd|th)(?=[ ,])", "")
    tries = [F.try_to_timestamp(t, F.lit(f)) for f in [*DATE_TIMES, *DATES]]
    return F.coalesce(*tries, F.try_to_timestamp(F.concat(t, F.lit(" 1")), F.lit("MMMM yyyy d"))).cast("timestamp_ntz")


def published(x: Column | str, as_of: Column) -> Column:
    return F.coalesce(parse_timestamp(x), as_of)


_MON = "(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
_LONG = "(?:January|February|March|April|May|June|July|August|September|October|November|December)"
_MM, _DD = "(?:1[0-2]|0[1-9])", r"(?:3[01]|0[1-9]|[12]\d)"
_DAY = r"(?:[12]\d|3[01]|[1-9])"
#: Raw dates inside text, tried in this order.
RAW_DATES = [
    r"^\d{8}$",
    r"^\d{1,2}-\d{1,2}-\d{4}$",
    rf"[12]\d{{3}}-{_MM}-{_DD}",
    rf"(?:{_MM}|[1-9])[-/.](?:{_DD}|[1-9])[-/.](?:20|19)\d{{2}}",
    r"^\d{4}/\d{1,2}/\d{1,2}$",
    rf"{_DAY}\s{_MON}\s[12]\d{{3}}",
    rf"{_DAY}\s{_LONG}\s[12]\d{{3}}",
    *[rf"^{d}(?:\s\d{{1,2}}:\d{{2}}(?::\d{{2}})?)?$" for d in (r"\d{1,2}-\d{1,2}-\d{4}", r"\d{4}-\d{1,2}-\d{1,2}", r"\d{1,2}/\d{1,2}/\d{4}", r"\d{4}/\d{1,2}/\d{1,2}", r"\d{1,2}\s[a-z]{3,}\s\d{4}")],
    r"^\d{12}(?:\d{2})?$",
    r"^\d{8}\s\d{4}(?:\d{2})?$",
    rf"(?i){_MON}[a-z]*?\s+\d{{1,2}}(?:[a-z]{{2}})?(?:,\s*|\s+)\d{{4}}\b",
    rf"\b{_LONG}\s\d{{4}}",
]


def raw_date(x: Column | str) -> Column:
    """The first raw date of the first pattern that finds one, or null."""
    return F.coalesce(*[F.nullif(F.regexp_extract(_c(x), p, 0), F.lit("")) for p in RAW_DATES])


def _by_keyword(x: Column | str, first: str, second: str) -> Column:
    low = F.lower(_c(x))
    near = F.when(low.contains(first), raw_date(keyword_window(x, first))).when(low.contains(second), raw_date(keyword_window(x, second)))
    return F.coalesce(near, raw_date(x))


def publish_date(x: Column | str) -> Column:
    """The raw date near `published`, else `created`, else any."""
    return _by_keyword(x, "published", "created")


def modified_date(x: Column | str) -> Column:
    return _by_keyword(x, "modified", "updated")


def hour_gap(a: Column | str, b: Column | str) -> Column:
    """Whole hours from a to b, truncated towards zero."""
    return F.timestamp_diff("HOUR", _c(a), _c(b))


def hour_gap_exact(a: Column | str, b: Column | str) -> Column:
    return F.timestamp_diff("MICROSECOND", _c(a), _c(b)) / 3.6e9


def first_date(*xs: Column | str) -> Column:
    """The first value that is neither null nor the zero date, as a date."""
    return F.coalesce(*[F.nullif(_c(x), F.lit("0000-00-00 00:00:00")) for x in xs]).cast("date")


def clamp_to_id_year(published_: Column | str, cve_id: Column | str) -> Column:
    """A publication after the year of the id counts as the last day of that year."""
    year = F.regexp_extract(_c(cve_id), r"CVE-(\d{4})-", 1).try_cast("int")
    return F.when(F.year(_c(published_)) > year, F.make_date(year, F.lit(12), F.lit(31))).otherwise(_c(published_).cast("date"))


def time_to_patch(published_: Column | str, committed: Column | str) -> Column:
    """Days and hours between publication and commit, whichever came first."""
    hours = F.abs(F.timestamp_diff("HOUR", _c(published_), _c(committed)))
    return F.concat(F.floor(hours / 24).cast("string"), F.lit(" days "), (hours % 24).cast("string"), F.lit(" hours"))


def is_stale(at: Column | str, as_of: Column, days: int = 1) -> Column:
    return F.coalesce(F.date_diff(as_of, _c(at)) >= days, F.lit(True))
