"""Date parsing, truncation and rounding (F12-F18). Results are DATE, never TIMESTAMP."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .nulls import col

# A form is a pattern with the parts of the date and the order that turns them into year-month-day. Text after the date
# is allowed in the first two lists and not in the third. Text that is in order already has no order to apply.
_PLAIN = (r"^\d{4}-\d{2}-\d{2}$", None)
ISO = (
    _PLAIN,
    (r"(?s)^\s*(\d{4})-(\d{1,2})-(\d{1,2}).*$", "$1-$2-$3"),
    (r"(?s)^\s*(\d{4})/(\d{1,2})/(\d{1,2}).*$", "$1-$2-$3"),
)
US = ((r"(?s)^\s*(\d{1,2})/(\d{1,2})/(\d{4}).*$", "$3-$1-$2"),)
YMD = (
    _PLAIN,
    (r"^\s*(\d{4})(\d{2})(\d{2})\s*$", "$1-$2-$3"),
    (r"^\s*(\d{4})[-/. ](\d{1,2})[-/. ](\d{1,2})\s*$", "$1-$2-$3"),
    (r"^\s*([0-5]\d|6[0-8])[-/. ](\d{1,2})[-/. ](\d{1,2})\s*$", "20$1-$2-$3"),
    (r"^\s*(69|[7-9]\d)[-/. ](\d{1,2})[-/. ](\d{1,2})\s*$", "19$1-$2-$3"),
)


def parse_date(c: str | Column, forms: Sequence[tuple[str, str | None]] = ISO) -> Column:
    """First form that fits wins; text that fits none, or names no real day, is NULL.

    The text is rearranged and cast, which answers NULL for a bad date; the format parsers raise and catch an exception
    for every row that does not fit.
    """
    x = col(c).cast("string")

    def read(pattern: str, order: str | None) -> Column:
        text = F.regexp_replace(x, pattern, order) if order else x
        return F.when(x.rlike(pattern), text.try_cast("date"))

    return F.coalesce(*[read(pattern, order) for pattern, order in forms])


def month_floor(c: str | Column) -> Column:
    return F.trunc(col(c), "MM")


def week_floor(c: str | Column) -> Column:
    """Start of the week, weeks begin on Sunday."""
    d = col(c).cast("date")
    return F.date_sub(d, F.dayofweek(d) - 1)


def month_round(c: str | Column) -> Column:
    """Nearest first of month, the exact middle goes up."""
    d = col(c).cast("date")
    floor = F.trunc(d, "MM")
    late = 2 * (F.dayofmonth(d) - 1) >= F.dayofmonth(F.last_day(d))
    return F.when(late, F.add_months(floor, 1)).otherwise(floor)


def date_parts(c: str | Column) -> dict[str, Column]:
    return {
        "served_year": F.year(col(c)),
        "served_month": F.month(col(c)),
        "served_day_of_month": F.dayofmonth(col(c)),
    }


def within_years(c: str | Column, first: int, last: int) -> Column:
    """Years ``first..last`` as a range on the raw column, so that it reaches the Parquet filter."""
    return (col(c) >= F.lit(dt.date(first, 1, 1))) & (col(c) < F.lit(dt.date(last + 1, 1, 1)))


def _next_month(day: dt.date) -> dt.date:
    return dt.date(day.year + day.month // 12, day.month % 12 + 1, 1)


def within_months(c: str | Column, first: str | None = None, last: str | None = None) -> Column:
    """Days whose month starts between two ISO dates, as a range on the raw column; an open end is ``None``."""
    kept = F.lit(True)
    if first is not None:
        day = dt.date.fromisoformat(first)
        kept = kept & (col(c) >= F.lit(day if day.day == 1 else _next_month(day)))
    if last is not None:
        kept = kept & (col(c) < F.lit(_next_month(dt.date.fromisoformat(last))))
    return kept
