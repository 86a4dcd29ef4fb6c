"""Dates of the archive: Russian month names, inclusive bounds of coarse dates."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from lorespark.functions.text import as_col

# Fixed values.
MONTHS = "янв фев мар апр мая июн июл авг сен окт ноя дек".split()
MONTHS_GENITIVE = "января февраля марта апреля мая июня июля августа сентября октября ноября декабря".split()
ARCHIVE_ZONE = "Europe/Moscow"
_DATE = r"(?U),\s*(\d{1,2})\s+([а-я]{3})\S*\s+(\d{4})\s+в\s+(\d{1,2}):(\d{2}):(\d{2})"


def parse_date(c: Column | str, zone: str = ARCHIVE_ZONE) -> Column:
    """", 27 дек 2018 в 0:58:19" as a timestamp of the archive's zone; null if there is none or it does not exist."""
    g = [F.regexp_extract(as_col(c), _DATE, i) for i in range(1, 7)]
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), g[1]).cast("int")
    n = [F.expr("cast(null as int)") if i == 1 else F.when(x != "", x.cast("int")) for i, x in enumerate(g)]
    local = F.try_make_timestamp(n[2], F.when(month > 0, month), n[0], n[3], n[4], n[5].cast("decimal(8,6)"), F.lit(zone))
    return F.when(g[0] != "", local)


def year_of_header(c: Column | str) -> Column:
    y = F.regexp_extract(as_col(c), r"(?U),\s*\d{1,2}\s+[а-я]{3}\S*\s+(\d{4})\s+в", 1)
    return F.when(y != "", y.cast("int"))


def bounds(date_from: str | None = None, date_to: str | None = None) -> tuple[dt.date | None, dt.date | None]:
    """(first day, first day after) of inclusive bounds given as YYYY, YYYY-MM or YYYY-MM-DD."""
    def start(s: str) -> dt.date:
        if not re.fullmatch(r"\d{4}(-\d{1,2}(-\d{1,2})?)?", s):
            raise ValueError(f"not a date: {s}")
        p = [int(x) for x in s.split("-")]
        return dt.date(*(p + [1, 1])[:3])

    def after(s: str) -> dt.date:
        d, n = start(s), s.count("-")
        if n == 0:
            return dt.date(d.year + 1, 1, 1)
        return dt.date(d.year + d.month // 12, d.month % 12 + 1, 1) if n == 1 else d + dt.timedelta(days=1)

    return (start(date_from) if date_from else None), (after(date_to) if date_to else None)


def between_dates(c: Column | str, date_from: str | None = None, date_to: str | None = None) -> Column:
    lo, hi = bounds(date_from, date_to)
    cond = F.lit(True)
    if lo:
        cond = cond & (as_col(c) >= F.lit(lo))
    if hi:
        cond = cond & (as_col(c) < F.lit(hi))
    return cond


def between_months(c: Column | str, lo: tuple[int, int], hi: tuple[int, int]) -> Column:
    """Undated rows fall out."""
    ym = F.year(as_col(c)) * 12 + F.month(as_col(c))
    return ym.between(lo[0] * 12 + lo[1], hi[0] * 12 + hi[1])


def spoken_day(c: Column | str) -> Column:
    """10 мая 2016; null for null."""
    c = as_col(c)
    return F.when(c.isNotNull(), F.concat_ws(" ", F.day(c).cast("string"), F.element_at(F.array(*[F.lit(m) for m in MONTHS_GENITIVE]), F.month(c)), F.year(c).cast("string")))
