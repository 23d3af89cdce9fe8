"""Column expressions on dates, ages and bands."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Band = tuple[int, int | None]


def repaired_end(start: Column, end: Column) -> Column:
    """End date, or the start where the end is missing or earlier."""
    return F.greatest(F.coalesce(end, start), start)


def add_years(date: Column, years) -> Column:
    """Same day ``years`` later; 29 February falls back to 28 February."""
    return F.add_months(date, F.lit(12) * years)


def days_between(start: Column, end: Column, inclusive: bool = False) -> Column:
    """Days from ``start`` to ``end``, counting both ends when ``inclusive``."""
    gap = F.datediff(end, start)
    return gap + 1 if inclusive else gap


def _calendar_number(date: Column) -> Column:
    return F.year(date) * 10000 + F.month(date) * 100 + F.dayofmonth(date)


def age_at(birth: Column, date: Column) -> Column:
    """Completed years of life on ``date``."""
    lived = _calendar_number(date) - _calendar_number(birth)
    return F.floor(lived / 10000).cast("int")


def band_label(band: Band) -> str:
    """Text of an age band: ``0 to 19`` or ``80 or above``."""
    low, high = band
    return f"{low} or above" if high is None else f"{low} to {high}"


def age_band(age: Column, bands: Sequence[Band]) -> Column:
    """Label of the first band that holds ``age``; ``None`` as text otherwise."""
    label = None
    for low, high in bands:
        inside = age >= low if high is None else age.between(low, high)
        text = F.lit(band_label((low, high)))
        label = F.when(inside, text) if label is None else label.when(inside, text)
    return label.otherwise(F.lit("None"))


def year_start(year: Column) -> Column:
    return F.make_date(year, F.lit(1), F.lit(1))


def year_end(year: Column) -> Column:
    return F.make_date(year, F.lit(12), F.lit(31))
