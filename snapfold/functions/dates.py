"""Seasons, date formats and periods as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: how the file names of reports begin.
REPORT_NAME = "Injury-Report_"


def season(day: Column, first_month: int = 10, late_2020: bool = False) -> Column:
    """'2023-24' of a day: seasons begin with first_month. late_2020: the first eleven days of October 2020 are 2019-20."""
    start = F.year(day) - F.when(F.month(day) >= first_month, 0).otherwise(1)
    if late_2020:
        start = F.when(day.cast("date").between(F.lit("2020-10-01").cast("date"), F.lit("2020-10-11").cast("date")), 2019).otherwise(start)
    return F.format_string("%d-%02d", start, F.pmod(start + 1, F.lit(100)))


def parse(text: Column, *patterns: str) -> Column:
    """The first of the patterns that reads a text as a date; null if none does. Years of two digits are 1969 to 2068."""

    def read(p: str) -> Column:
        day = F.to_date(F.try_to_timestamp(text, F.lit(p)))
        if p.replace("yyyy", "").count("yy"):
            return F.when(F.year(day) >= 2069, F.add_months(day, -1200)).otherwise(day)
        return day

    return F.coalesce(*map(read, patterns))


def month(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def url_time(url: Column) -> Column:
    """Publication time of a report's address: date, hour, optional minute (30 if left out), AM or PM in any case; null if none.

    The address must end in the report's file name.
    """
    pattern = rf"(?i)/{REPORT_NAME}(\d{{4}}-\d{{2}}-\d{{2}})_(\d{{2}})(?:_(\d{{2}}))?([AP]M)\.pdf$"
    hour = F.regexp_extract(url, pattern, 2).try_cast("int")
    minute = F.coalesce(F.regexp_extract(url, pattern, 3).try_cast("int"), F.lit(30))
    in_day = F.pmod(hour, F.lit(12)) + F.when(F.upper(F.regexp_extract(url, pattern, 4)) == "PM", 12).otherwise(0)
    day = F.try_to_timestamp(F.regexp_extract(url, pattern, 1), F.lit("yyyy-MM-dd"))
    return F.when(hour.between(1, 12) & (minute < 60), day + F.make_interval(hours=in_day, mins=minute))
