"""Dates, periods, cyclic features and fixed holidays."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names by position, and national holidays as MM-dd.
MONTH_NAMES = ["Janeiro", "Fevereiro", "Março", "Abril", "Maio", "Junho", "Julho", "Agosto", "Setembro", "Outubro", "Novembro", "Dezembro"]
WEEKDAY_NAMES = ["Segunda", "Terça", "Quarta", "Quinta", "Sexta", "Sábado", "Domingo"]
FIXED_HOLIDAYS = ["01-01", "05-01", "09-07", "10-12", "11-02", "11-15", "12-25"]


def parse_moment(day: Column, time: Column) -> Column:
    """Day and time text -> timestamp without zone, null when unreadable."""
    text = F.concat_ws(" ", day, F.coalesce(time, F.lit("00:00:00")))
    return text.try_cast("timestamp_ntz")


def month_of(col: Column | str) -> Column:
    """First day of the month, as a date."""
    return F.trunc(col, "month")


def month_name(col: Column | str) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in MONTH_NAMES]), F.month(col))


def weekday_name(col: Column | str) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in WEEKDAY_NAMES]), F.weekday(col) + 1)


def cyclic(col: Column | str) -> dict[str, Column]:
    """Sine and cosine of weekday (Monday = 0) and of month number."""
    week = F.weekday(col) * (2 * math.pi / 7)
    year = F.month(col) * (2 * math.pi / 12)
    return {
        "dow_sin": F.sin(week),
        "dow_cos": F.cos(week),
        "month_sin": F.sin(year),
        "month_cos": F.cos(year),
    }


def is_fixed_holiday(col: Column | str) -> Column:
    return F.date_format(col, "MM-dd").isin(FIXED_HOLIDAYS).cast("int")


def period_index(col: Column | str, start: Column | str, days: int) -> Column:
    """Number of the equal-length period a date falls into."""
    return F.floor(F.datediff(col, start) / F.lit(days))


def iso_year_week(col: Column | str) -> Column:
    """ISO week with its own year, e.g. ``2024-W01``."""
    col = F.col(col) if isinstance(col, str) else col
    # the ISO year is the calendar year of that week's Thursday
    thursday = F.date_add(F.trunc(col, "week"), 3)
    return F.concat(F.year(thursday).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(col).cast("string"), 2, "0"))
