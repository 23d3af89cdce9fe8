"""Closed date intervals: merging, clipping and splitting by year."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanwise.functions.dates import year_end, year_start


def merge_by_gaps(
    spans: DataFrame,
    keys: Sequence[str],
    gaps: Sequence[int | None],
    starts_unique: bool = False,
    keep_max: Sequence[str] = (),
) -> DataFrame:
    """Eras of ``spans`` under every allowed gap: ``keys, gap, start_date, end_date``.

    Two spans belong to one era when the next start is at most ``gap`` days
    after the furthest end so far; gap 0 means that they share a day, and the
    gap None is unbounded and gives one era per key. Ends must not precede
    starts. The columns in ``keep_max`` come back as their maximum per key.

    The spans of a key are first reduced to one row per start day, so the
    window sees a bounded number of rows for any key. One ordered pass gives
    the distance of each row to everything before it. A row opens an era under
    exactly the gaps smaller than that distance, and the era closes at the
    furthest end reached before the next opening. Only openings are kept, so
    more gaps cost no further shuffle and no copies of the spans. Pass
    ``starts_unique`` when the spans already have one row per key and start.
    """
    keys = list(keys)
    daily = spans.filter(F.col("start_date").isNotNull())
    if not starts_unique:
        daily = daily.groupBy(*keys, "start_date").agg(
            *[F.max(c).alias(c) for c in ("end_date", *keep_max)]
        )
    everything = Window.partitionBy(*keys)
    ordered = everything.orderBy("start_date")
    earlier = ordered.rowsBetween(Window.unboundedPreceding, -1)
    reached = (
        daily.withColumn("reach", F.max("end_date").over(earlier))
        .withColumn("furthest", F.max("end_date").over(everything))
        .withColumn("distance", F.datediff("start_date", "reach"))
        .withColumns({c: F.max(c).over(everything) for c in keep_max})
    )
    allowed = F.array(*[F.lit(g).cast("int") for g in dict.fromkeys(gaps)])
    opens = F.filter(
        allowed, lambda g: F.col("distance").isNull() | (F.col("distance") > g)
    )
    openings = reached.select(
        *keys,
        "start_date",
        "reach",
        "furthest",
        *keep_max,
        F.explode(opens).alias("gap"),
    )
    following = Window.partitionBy(*keys, "gap").orderBy("start_date")
    return openings.select(
        *keys,
        "gap",
        "start_date",
        F.coalesce(F.lead("reach").over(following), "furthest").alias("end_date"),
        *keep_max,
    )


def merge_intervals(
    spans: DataFrame, keys: Sequence[str], gap: int = 0, starts_unique: bool = False
) -> DataFrame:
    """Eras of ``spans`` under one allowed gap: ``keys, start_date, end_date``."""
    return merge_by_gaps(spans, keys, [gap], starts_unique).drop("gap")


def clip(
    start: Column, end: Column, low: Column | None, high: Column | None
) -> tuple[Column, Column]:
    """Both ends moved inside ``[low, high]``; None leaves a side open."""
    return (
        start if low is None else F.greatest(start, low),
        end if high is None else F.least(end, high),
    )


def held(spans: DataFrame) -> DataFrame:
    """Spans that hold a day: both dates are known and the end does not precede the start.

    Periods that came with the data are kept as they are; person-time, follow-up and
    outcomes only take those that pass here.
    """
    return spans.filter(F.col("start_date") <= F.col("end_date"))


def split_by_year(
    spans: DataFrame, and_whole: bool = False, by_year: bool = True
) -> DataFrame:
    """One row for each span and calendar year it touches, clipped to the year.

    With ``and_whole`` the span itself is one more row, without a year; without
    ``by_year`` it is the only one. Spans that hold no day give no row.
    """
    years = F.sequence(F.year("start_date"), F.year("end_date"))
    whole = F.array(F.lit(None).cast("int"))
    if not by_year:
        years = whole
    elif and_whole:
        years = F.concat(years, whole)
    year = F.col("year")
    # Without a year the limits are missing and do not clip.
    start, end = clip(
        F.col("start_date"), F.col("end_date"), year_start(year), year_end(year)
    )
    return (
        held(spans)
        .withColumn("year", F.explode(years))
        .withColumns({"start_date": start, "end_date": end})
    )
