"""Characteristics of each period."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanwise.functions.dates import days_between
from spanwise.operators.demographics import with_age, with_attributes
from spanwise.operators.records import stack
from spanwise.session import materialise
from spanwise.sources.cdm import Cdm

KEY = ("mode", "person_id", "start_date", "end_date", "period_id")

# The record tables counted inside periods.
COUNTED = {
    "number_drugs": "drug_exposure",
    "number_conditions": "condition_occurrence",
    "number_visits": "visit_occurrence",
}
RATES = {
    "drugs_per_day": "number_drugs",
    "conditions_per_day": "number_conditions",
    "visits_per_day": "number_visits",
}


def daily_counts(cdm: Cdm) -> DataFrame:
    """Records that start on each person-day, one count column per domain."""
    rows = stack(
        [
            cdm.dates(table).select(
                "person_id",
                F.col("start_date").alias("day"),
                F.lit(name).alias("counted"),
            )
            for name, table in COUNTED.items()
        ]
    )
    return (
        rows.filter(F.col("day").isNotNull())
        .groupBy("person_id", "day")
        .agg(*[F.count_if(F.col("counted") == n).alias(n) for n in COUNTED])
    )


def _count_along_bounds(periods: DataFrame, daily: DataFrame) -> DataFrame:
    """Counts for derived periods, of which a person has few: one sort per person.

    Period bounds are put among the person's record days; a running count is
    read at both bounds, and the difference is the number inside. Periods and days
    go to their person before the bounds are made out, so no bound is shuffled.
    """
    day, turn, sign = "day", "turn", "sign"
    bounds = F.array(
        *[
            F.struct(F.col(c).alias(day), F.lit(t).alias(turn), F.lit(s).alias(sign))
            for c, t, s in (("start_date", 0, -1), ("end_date", 2, 1))
        ]
    )
    carried = [c for c in periods.columns if c not in KEY]
    marks = periods.repartition("person_id").select(*KEY, *carried, F.inline(bounds))
    counted = daily.repartition("person_id").withColumn(turn, F.lit(1))
    along = (
        Window.partitionBy("person_id")
        .orderBy(day, turn)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    running = [F.coalesce(F.sum(n).over(along), F.lit(0)).alias(n) for n in COUNTED]
    read = (
        counted.unionByName(marks, allowMissingColumns=True)
        .select(*KEY, *carried, sign, *running)
        .filter(F.col(sign).isNotNull())
    )
    inside = [F.sum(F.col(sign) * F.col(n)) for n in COUNTED]
    return read.groupBy(*KEY, *carried).agg(
        *[F.nullif(n, F.lit(0)).alias(c) for n, c in zip(inside, COUNTED, strict=True)]
    )


def _count_by_days(periods: DataFrame, daily: DataFrame) -> DataFrame:
    """Counts for source periods, of which a person may have any number.

    The running count is read at the distinct days of a person's bounds only, and
    looked up by person and day, so the periods of one person are spread out.
    """
    days = F.array(F.date_sub("start_date", 1), F.col("end_date"))
    bounds = periods.select("person_id", F.explode(days).alias("day")).distinct()
    # Records count on their day.
    known = bounds.withColumn("turn", F.lit(1)).unionByName(
        daily.withColumn("turn", F.lit(0)), allowMissingColumns=True
    )
    along = (
        Window.partitionBy("person_id")
        .orderBy("day", "turn")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    counts = [F.coalesce(F.sum(n).over(along), F.lit(0)).alias(n) for n in COUNTED]
    running = known.select("person_id", "day", "turn", *counts).filter("turn = 1").drop("turn")

    def until(label):
        names = {n: f"{label}_{n}" for n in COUNTED}
        return running.withColumnsRenamed({**names, "day": f"{label}_day"})

    inside = [
        F.nullif(F.col(f"last_{n}") - F.col(f"before_{n}"), F.lit(0)).alias(n)
        for n in COUNTED
    ]
    return (
        periods.withColumn("before_day", F.date_sub("start_date", 1))
        .withColumn("last_day", F.col("end_date"))
        .join(until("before"), ["person_id", "before_day"])
        .join(until("last"), ["person_id", "last_day"])
        .select(*periods.columns, *inside)
    )


def _next_in_order(periods: DataFrame) -> DataFrame:
    """Next start of derived periods, which have one row per person and start."""
    following = Window.partitionBy("person_id", "mode").orderBy("start_date")
    return periods.repartition("person_id").withColumn("coming", F.lead("start_date").over(following))


def _next_by_starts(periods: DataFrame) -> DataFrame:
    """Next start of source periods: the starts are ordered, not the periods.

    Of periods that start together, each is followed by another at once, but
    for the last by end and id.
    """
    place = F.struct("end_date", "period_id")
    key = ["person_id", "mode", "start_date"]
    following = Window.partitionBy("person_id", "mode").orderBy("start_date")
    starts = (
        periods.groupBy(*key)
        .agg(F.max(place).alias("final"))
        .withColumn("later", F.lead("start_date").over(following))
    )
    own = F.when(place == F.col("final"), F.col("later"))
    coming = own.when(place != F.col("final"), F.col("start_date"))
    joined = periods.join(starts, key).withColumn("coming", coming)
    return joined.select(*periods.columns, "coming")


def _distances(rows: DataFrame) -> DataFrame:
    start, end, coming = F.col("start_date"), F.col("end_date"), F.col("coming")
    return rows.withColumns(
        {
            "time_to_next_observation": days_between(start, coming),
            "gap_to_next": days_between(end, coming),
        }
    ).drop("coming")


def _each_kind(periods: DataFrame, sourced, derived) -> DataFrame:
    """Treat source periods, which have an id, and derived ones by their own way."""
    known = F.col("period_id").isNotNull()
    return sourced(periods.filter(known)).unionByName(derived(periods.filter(~known)))


def records_in_periods(periods: DataFrame, cdm: Cdm) -> DataFrame:
    """Periods with the number of records that start inside; NULL where none.

    Records and periods of a person are never joined with each other, however
    many of both there are; overlapping periods are fine.
    """
    return _counted(periods, cdm, lambda p: p, lambda p: p)


def _counted(periods: DataFrame, cdm: Cdm, sourced, derived) -> DataFrame:
    """Counts of both kinds of periods from one writing of the records per day.

    ``sourced`` and ``derived`` come before the counting, for the periods of their kind.
    Without periods no record is read.
    """
    if not periods.take(1):
        none = {n: F.lit(None).cast("long") for n in COUNTED}
        return _each_kind(periods, sourced, derived).withColumns(none)
    daily = materialise(daily_counts(cdm), "daily_counts")
    return _each_kind(
        periods,
        lambda p: _count_by_days(sourced(p), daily),
        lambda p: _count_along_bounds(derived(p), daily),
    )


def with_next(periods: DataFrame) -> DataFrame:
    """Periods with the days to the next start, and from the end to that start.

    ``time_to_next_observation`` runs from start to start, as the study defines
    it; ``gap_to_next`` is the uncovered stretch. Both are NULL on the last one.
    """
    return _distances(_each_kind(periods, _next_by_starts, _next_in_order))


def period_features(periods: DataFrame, cdm: Cdm) -> DataFrame:
    """One row per period: length, distance to the next, ages, sex and densities.

    The next start is found among the bare periods and carried through the counting;
    the record tables are read once, for the records per person and day.
    """
    rows = _counted(periods, cdm, _next_by_starts, _next_in_order)
    rows = with_attributes(_distances(rows), cdm)
    rows = with_age(rows, "start_date", "age_start", "age_group_start")
    rows = with_age(rows, "end_date", "age_end", "age_group_end")
    length = days_between(F.col("start_date"), F.col("end_date"), inclusive=True)
    rows = rows.withColumn("duration", length).drop("date_of_birth")
    return rows.withColumns(
        {rate: F.try_divide(F.col(n), F.col("duration")) for rate, n in RATES.items()}
    )
