"""Time ranges named in a query text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The longest relative distance, and the plausible years.
MAX_RELATIVE_DAYS = 3650
FIRST_YEAR, LAST_YEAR = 1900, 2100
WEEKDAYS = "月火水木金土日"


def _day(base: Column, days: Column | int) -> Column:
    return F.date_add(base, days if isinstance(days, Column) else F.lit(days))


def _span(start: Column, end: Column) -> Column:
    known = start.isNotNull() & end.isNotNull()
    return F.when(known, F.struct(start.cast("timestamp").alias("start"), end.cast("timestamp").alias("end")))


def time_range(query: Column, as_of: Column) -> Column:
    """struct(start, end) of the first rule that applies, NULL when none does.

    The rules are tried in order; one whose numbers make no date falls through
    to the next.
    """
    # full-width digits count as digits
    text = F.translate(query, "０１２３４５６７８９", "0123456789")
    today = F.to_date(as_of)
    month = F.trunc(today, "month")
    year = F.trunc(today, "year")

    def amount(pattern: str, cap: int) -> Column:
        digits = F.regexp_extract(text, pattern, 1)
        capped = F.least(F.coalesce(digits.try_cast("bigint"), F.lit(cap)), F.lit(cap))
        return F.when(text.rlike(pattern), capped.cast("int"))

    def said(pattern: str, start: Column, end: Column) -> Column:
        return F.when(text.rlike(pattern), _span(start, end))

    def ago(pattern: str, unit: int) -> Column:
        n = amount(pattern, MAX_RELATIVE_DAYS // unit)
        return _span(_day(today, -n * unit), F.when(n.isNotNull(), today))

    def later(pattern: str, unit: int) -> Column:
        start = _day(today, amount(pattern, MAX_RELATIVE_DAYS // unit) * unit)
        return _span(start, _day(start, unit))

    in_month = r"(\d{4})年(\d{1,2})月"
    named_month = F.regexp_extract(text, in_month, 2).try_cast("int")
    month_start = F.when(
        text.rlike(in_month) & named_month.between(1, 12),
        F.make_date(F.regexp_extract(text, in_month, 1).try_cast("int"), named_month, F.lit(1)),
    )
    in_year = r"(\d{4})年(?!\d{1,2}月)"
    named_year = F.regexp_extract(text, in_year, 1).try_cast("int")
    year_start = F.when(
        text.rlike(in_year) & named_year.between(FIRST_YEAR, LAST_YEAR), F.make_date(named_year, F.lit(1), F.lit(1))
    )
    in_weekday = rf"(?:先週|前)の([{WEEKDAYS}])曜"
    weekday = F.position(F.regexp_extract(text, in_weekday, 1), F.lit(WEEKDAYS))
    last_monday = _day(today, -F.weekday(today) - 7)
    that_day = F.when(text.rlike(in_weekday), _day(last_monday, weekday - 1))

    return F.coalesce(
        ago(r"(\d+)\s*日前", 1),
        ago(r"(\d+)\s*週間前", 7),
        ago(r"(\d+)\s*[かヶケ]月前", 30),
        later(r"(\d+)\s*日後", 1),
        later(r"(\d+)\s*週間後", 7),
        later(r"(\d+)\s*[かヶケ]月後", 30),
        _span(month_start, F.add_months(month_start, 1)),
        _span(year_start, F.add_months(year_start, 12)),
        said("おととい|一昨日", _day(today, -2), _day(today, -1)),
        said("昨日|きのう", _day(today, -1), today),
        _span(that_day, _day(that_day, 1)),
        said("先週", _day(today, -7), today),
        said("先月", F.add_months(month, -1), month),
        said("去年|昨年", F.add_months(year, -12), year),
        said("明後日|あさって", _day(today, 2), _day(today, 3)),
        said("明日|あした", _day(today, 1), _day(today, 2)),
        said("来週", _day(today, 1), _day(today, 8)),
        said("来月", F.add_months(month, 1), F.add_months(month, 2)),
        said("来年", F.add_months(year, 12), F.add_months(year, 24)),
        said("今日|きょう", today, _day(today, 1)),
    )
