"""Incidence of outcomes during follow-up."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanwise.functions.dates import days_between, year_end, year_start
from spanwise.functions.poisson import limits_of_count
from spanwise.operators.at_risk import columns_of, counter
from spanwise.operators.cohorts import in_each_sex
from spanwise.operators.intervals import held, merge_intervals, split_by_year

DAYS_PER_YEAR = 365.25
RATE_PER = 100_000

STRATUM = ("mode", "sex", "age_group", "year")
# Modes of which a person may have any number of periods, those that came with the data.
PILED = ("original_data",)


def events_and_rest(
    outcomes: DataFrame, washout: int | None, repeated: bool = True
) -> DataFrame:
    """``outcome, person_id, start_date, rest_end``: events and the days they cost.

    Outcomes at most ``washout`` days apart are one event. A person is at risk
    up to and including the event day, and again from ``washout`` days after its
    end. ``rest_end`` is NULL when the person never returns: without repeated
    events, or with an unbounded washout.
    """
    if washout is None or not repeated:
        return outcomes.groupBy("outcome", "person_id").agg(
            F.min("start_date").alias("start_date"),
            F.lit(None).cast("date").alias("rest_end"),
        )
    merged = merge_intervals(outcomes, ["outcome", "person_id"], gap=washout)
    return merged.select(
        "outcome",
        "person_id",
        "start_date",
        F.date_add("end_date", washout).alias("rest_end"),
    )


def _slot(names: Sequence[str]) -> Column:
    """The place of ``outcome`` among ``names``; others are an error."""
    place = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("outcome"))
    unknown = F.raise_error(F.concat(F.lit("outcome not asked for: "), F.col("outcome")))
    return F.when(place > 0, place - 1).otherwise(unknown.cast("long"))


def _knots(events: DataFrame, names: Sequence[str]) -> DataFrame:
    """Days on which the time off risk of an outcome begins or ends to run.

    Up to a day d, the days off risk of outcome i are ``slope_i * d - offset_i`` with the
    sums of both columns up to d, and its events the sum of ``event_i``. An event takes
    effect from its day on and a rest ends on its last day. Outcomes that are not among
    ``names`` are an error.
    """
    slot = _slot(names)

    def mark(day, slope, event):
        return F.struct(day.alias("day"), F.lit(slope).alias("slope"), F.lit(event).alias("event"))

    marks = F.array(
        mark(F.col("start_date"), 1, 1), mark(F.col("rest_end"), -1, 0)
    )
    rows = (
        events.withColumn("slot", slot)
        .select("person_id", "slot", F.inline(marks))
        .filter(F.col("day").isNotNull())
    )
    offset = F.col("slope") * F.unix_date("day")

    def of(i, column):
        return F.sum(F.when(F.col("slot") == i, column).otherwise(0))

    return rows.groupBy("person_id", "day").agg(
        *[of(i, F.col("slope")).alias(f"slope_{i}") for i in range(len(names))],
        *[of(i, offset).alias(f"offset_{i}") for i in range(len(names))],
        *[of(i, F.col("event")).alias(f"event_{i}") for i in range(len(names))],
    )


def _states(stretches: DataFrame, knots: DataFrame, names: int, by_year: bool) -> DataFrame:
    """``person_id, day`` with ``lost_i`` days off risk and ``started_i`` events up to that day.

    There is a row for each day at which a stretch is read: the day before it begins,
    its last day, and the ends of the years between. A person has one such row a day at
    most, however many stretches; the running sums are taken over these and the knots.
    """
    ends = F.array(F.date_sub("start_date", 1), F.col("end_date"))
    days = stretches.select("person_id", F.explode(ends).alias("day"))
    if by_year:
        first, last = F.year(F.min("start_date")) - 1, F.year(F.max("end_date"))
        reached = stretches.groupBy("person_id").agg(first.alias("first"), last.alias("last"))
        years = F.transform(F.sequence("first", "last"), year_end)
        days = days.unionByName(reached.select("person_id", F.explode(years).alias("day")))
    marks = [f"{what}_{i}" for what in ("slope", "offset", "event") for i in range(names)]
    # What a day brings takes effect on it.
    placed = days.distinct().withColumn("turn", F.lit(1)).unionByName(
        knots.withColumn("turn", F.lit(0)), allowMissingColumns=True
    )
    along = (
        Window.partitionBy("person_id")
        .orderBy("day", "turn")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    running = placed.select(
        "person_id", "day", "turn", *[F.coalesce(F.sum(c).over(along), F.lit(0)).alias(c) for c in marks]
    )
    lost = [
        (F.col(f"slope_{i}") * F.unix_date("day") - F.col(f"offset_{i}")).alias(f"lost_{i}")
        for i in range(names)
    ]
    started = [F.col(f"event_{i}").alias(f"started_{i}") for i in range(names)]
    return running.filter("turn = 1").select("person_id", "day", *lost, *started)


def _followed(
    follow_up: DataFrame, knots: DataFrame, names: int, intervals: Sequence[str]
) -> DataFrame:
    """``stratum, person_id, year``: days of follow-up, days off risk and events.

    ``stratum`` is a number for mode, sex and age group. Equal stretches are counted
    first. A value that grows with time adds up over a stretch as the difference of its
    states at the last day and at the day before the first, which are looked up by
    person and day: so the stretches of one person are spread over its days. The states
    are a row per person and day and compress far below their size, by which they would
    be sent to the driver whole; so they are always shuffled.
    """
    stretches = (
        follow_up.withColumn("stratum", F.xxhash64(*STRATUM[:3]))
        .groupBy("stratum", "person_id", "start_date", "end_date")
        .agg(F.count(F.lit(1)).alias("times"))
    )
    by_year = "years" in intervals
    pieces = split_by_year(stretches, and_whole="overall" in intervals, by_year=by_year)
    states = _states(follow_up, knots, names, by_year)
    values = [f"{what}_{i}" for what in ("lost", "started") for i in range(names)]

    def at(label: str) -> DataFrame:
        return states.withColumnsRenamed({"day": label, **{v: f"{label}_{v}" for v in values}})

    read = (
        pieces.withColumn("before", F.date_sub("start_date", 1))
        .withColumn("until", F.col("end_date"))
        .join(at("before").hint("merge"), ["person_id", "before"])
        .join(at("until").hint("merge"), ["person_id", "until"])
    )
    length = days_between(F.col("start_date"), F.col("end_date"), inclusive=True)
    passed = [F.sum(F.col("times") * (F.col(f"until_{v}") - F.col(f"before_{v}"))).alias(v) for v in values]
    return read.groupBy("stratum", "person_id", "year").agg(
        F.min("start_date").alias("first_day"),
        F.max("end_date").alias("last_day"),
        F.sum(F.col("times") * length).alias("days"),
        *passed,
    )


def _in_order(followed: DataFrame, events: DataFrame, names: Sequence[str], intervals: Sequence[str]) -> DataFrame:
    """``stratum, year`` with sums and persons at risk, from each person's rows and events in one task.

    Follow-up is shuffled once, before it is split by year, and of each row little more
    than its dates; what is read off the events, and each person's years, are not shuffled
    at all. A task holds one person's events, not its follow-up.
    """
    stretches = followed.select(
        F.col("person_id").cast("long").alias("person_id"),
        F.lit(1).alias("turn"),
        F.xxhash64(*STRATUM[:3]).alias("place"),
        F.unix_date("start_date").alias("first"),
        F.unix_date("end_date").alias("last"),
    )
    marks = events.select(
        F.col("person_id").cast("long").alias("person_id"),
        F.lit(0).alias("turn"),
        _slot(names).alias("place"),
        F.unix_date("start_date").alias("first"),
        F.unix_date("rest_end").alias("last"),
    )
    by_year = "years" in intervals
    count = counter(len(names), by_year, "overall" in intervals or not by_year)
    return (
        stretches.unionByName(marks)
        .filter("person_id IS NOT NULL AND first IS NOT NULL")
        .repartition("person_id")
        .sortWithinPartitions("person_id", "turn")
        .mapInArrow(count, columns_of(len(names)))
    )


def incidence(
    follow_up: DataFrame,
    outcomes: DataFrame,
    names: Sequence[str],
    washout: int | None = 30,
    repeated: bool = True,
    intervals: Sequence[str] = ("years", "overall"),
    complete_intervals: bool = False,
    piled: Sequence[str] = PILED,
) -> DataFrame:
    """Counts and time at risk per mode, outcome, sex, age group and interval.

    The days off risk and the events up to a day are running sums over a person's
    distinct days; the follow-up looks them up at its bounds. So neither the number of
    outcomes nor that of events multiplies the follow-up, and only the intervals asked
    for are split by year. Of the modes in ``piled``, of which a person may have any number
    of periods, the look-up is by person and day; of the others, a person's follow-up is
    read in one task. Outcomes that are not among ``names`` are an error. The interval
    ``overall`` has no year.
    """
    slots = range(len(names))
    events = events_and_rest(outcomes, washout, repeated)
    followed = held(follow_up)
    in_piles = F.coalesce(F.col("mode").isin(*piled), F.lit(False))
    per_person = _followed(followed.filter(in_piles), _knots(events, names), len(names), intervals)
    # A few rows: what the numbers of the strata stand for.
    strata_of = followed.select(*STRATUM[:3]).distinct().withColumn("stratum", F.xxhash64(*STRATUM[:3]))
    summed = ["days", *[f"lost_{i}" for i in slots], *[f"started_{i}" for i in slots]]
    merged = [
        F.min("first_day").alias("first_day"),
        F.max("last_day").alias("last_day"),
        *[F.sum(c).alias(c) for c in summed],
    ]
    at_risk = [
        F.count_if(F.col("days") > F.col(f"lost_{i}")).alias(f"persons_{i}")
        for i in slots
    ]
    persons = [F.sum(f"persons_{i}").alias(f"persons_{i}") for i in slots]
    spread = per_person.groupBy("stratum", "year").agg(*merged, *at_risk)
    ordered = _in_order(followed.filter(~in_piles), events, names, intervals)
    each = spread.unionByName(ordered.groupBy("stratum", "year").agg(*merged, *persons))
    strata = each.join(strata_of, "stratum").drop("stratum")
    totals = in_each_sex(strata).groupBy(*STRATUM).agg(*merged, *persons)
    if complete_intervals:
        totals = _complete_years(totals)
    interval = F.when(F.col("year").isNull(), "overall").otherwise("years")
    totals = totals.withColumn("analysis_interval", interval)
    outcome = F.array(
        *[
            F.struct(
                F.lit(name).alias("outcome"),
                F.col(f"persons_{i}").alias("denominator_count"),
                F.col(f"started_{i}").alias("outcome_count"),
                (F.col("days") - F.col(f"lost_{i}")).alias("person_days"),
            )
            for i, name in enumerate(names)
        ]
    )
    opened = F.coalesce(year_start(F.col("year")), "first_day")
    closed = F.coalesce(year_end(F.col("year")), "last_day")
    return totals.select(
        *STRATUM,
        "analysis_interval",
        opened.alias("incidence_start_date"),
        closed.alias("incidence_end_date"),
        F.inline(outcome),
    ).withColumn("person_years", F.col("person_days") / DAYS_PER_YEAR)


def _complete_years(totals: DataFrame) -> DataFrame:
    """Drop years that the follow-up of the mode does not cover from end to end."""
    mode = Window.partitionBy("mode")
    inside = (year_start(F.col("year")) >= F.col("opens")) & (
        year_end(F.col("year")) <= F.col("closes")
    )
    return (
        totals.withColumn("opens", F.min("first_day").over(mode))
        .withColumn("closes", F.max("last_day").over(mode))
        .filter(F.col("year").isNull() | inside)
        .drop("opens", "closes")
    )


def with_rates(counts: DataFrame) -> DataFrame:
    """Add the rate per 100,000 person-years with exact 95 % limits."""
    limits = limits_of_count(F.col("outcome_count"))
    per = F.try_divide(F.lit(float(RATE_PER)), F.col("person_years"))
    name = "incidence_100000_pys"
    return (
        counts.withColumn("limits", limits)
        .withColumns(
            {
                name: F.col("outcome_count") * per,
                f"{name}_95CI_lower": F.col("limits.lower") * per,
                f"{name}_95CI_upper": F.col("limits.upper") * per,
            }
        )
        .drop("limits")
    )
