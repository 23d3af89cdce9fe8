"""Clinical records as dated rows, and their reduction to person-days."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwise.config import RECORD_TABLES
from spanwise.functions.dates import repaired_end
from spanwise.sources.cdm import Cdm


def stack(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows of all frames, matched by column name."""
    return reduce(DataFrame.unionByName, frames)


def records(cdm: Cdm, tables: Sequence[str] = RECORD_TABLES) -> DataFrame:
    """Every record: ``person_id, domain, start_date, end_date`` as recorded."""
    unknown = set(tables) - set(RECORD_TABLES)
    if unknown or not tables:
        raise ValueError(f"records come from {RECORD_TABLES}, not {tuple(tables)}")
    return stack(
        [
            cdm.dates(t).select(
                "person_id", F.lit(t).alias("domain"), "start_date", "end_date"
            )
            for t in dict.fromkeys(tables)
        ]
    )


def repair_ends(rows: DataFrame) -> DataFrame:
    """Missing ends, and ends before the start, become the start."""
    end = repaired_end(F.col("start_date"), F.col("end_date"))
    return rows.withColumn("end_date", end)


def record_days(rows: DataFrame) -> DataFrame:
    """One row for each person and start day: the furthest end, repaired and raw.

    A person has at most one row for each calendar day, however many records
    they hold, and equal days are combined before the shuffle. Everything
    below that works person by person starts from this bounded table.
    """
    end = repaired_end(F.col("start_date"), F.col("end_date"))
    return (
        rows.filter(F.col("start_date").isNotNull())
        .groupBy("person_id", "start_date")
        .agg(F.max(end).alias("end_date"), F.max("end_date").alias("raw_end"))
    )


# Days in a window: its days, and the steps from each to the next, are bits of a long.
WINDOW_DAYS = 60


def record_sets(rows: DataFrame) -> DataFrame:
    """The days under records as mergeable sets, one row for each person and window of days.

    ``person_id, opens, covered, linked, reach, raw_end``: the window's first day; its
    days under a record that began in it; the steps to the next day that one such record
    spans, the step out of the window included; the furthest end beyond the window; the
    furthest end as recorded. Sets of two tasks merge by bitwise or and maximum, so they
    are merged before the shuffle, whatever the order of the records: a person has a
    row for every window at most, and each record goes into one row only.
    """
    first = F.unix_date("start_date")
    last = F.unix_date(repaired_end(F.col("start_date"), F.col("end_date")))
    placed = rows.filter(F.col("start_date").isNotNull()).select(
        "person_id",
        (first - F.pmod(first, F.lit(WINDOW_DAYS))).alias("opens"),
        F.pmod(first, F.lit(WINDOW_DAYS)).alias("at"),
        # Steps from day to day that the record spans.
        (last - first).alias("steps"),
        "end_date",
    )

    def bits(count: str) -> Column:
        return F.expr(f"shiftleft(shiftleft(1L, least({count}, {WINDOW_DAYS} - at)) - 1L, at)")

    beyond = F.when(F.col("at") + F.col("steps") >= WINDOW_DAYS, F.col("opens") + F.col("at") + F.col("steps"))
    return placed.groupBy("person_id", "opens").agg(
        F.bit_or(bits("steps + 1")).alias("covered"),
        F.bit_or(bits("steps")).alias("linked"),
        F.max(beyond).alias("reach"),
        F.max("end_date").alias("raw_end"),
    )


def record_runs(rows: DataFrame) -> DataFrame:
    """Days under records without a break, window by window, as spans with distinct starts.

    ``person_id, start_date, end_date, raw_end``. Records that share a day are in one
    span, or in spans that share a day where a window ends, so eras of any allowed gap
    are those of the records. ``raw_end`` is the furthest of the window.
    """
    begins = F.expr("covered & ~shiftleft(linked, 1)")
    # Most windows hold one or two spans; the places of more are looked for bit by bit.
    places = F.expr(
        f"""CASE bit_count(begins) WHEN 1 THEN array(bit_count(begins - 1L))
            WHEN 2 THEN array(bit_count((begins & -begins) - 1L), bit_count((begins & (begins - 1L)) - 1L))
            ELSE filter(sequence(0, {WINDOW_DAYS - 1}), i -> (shiftrightunsigned(begins, i) & 1L) = 1L) END"""
    )
    # Steps that follow each other from the place on: the ones before the lowest zero.
    runs = (
        record_sets(rows)
        .withColumn("begins", begins)
        .select("person_id", "opens", "reach", "raw_end", "linked", F.explode(places).alias("at"))
        .withColumn("rest", F.expr("shiftrightunsigned(linked, at)"))
        .withColumn("steps", F.expr("bit_count((~rest & (rest + 1L)) - 1L)"))
    )
    end = F.when(F.col("at") + F.col("steps") < WINDOW_DAYS, F.col("opens") + F.col("at") + F.col("steps"))
    return runs.select(
        "person_id",
        F.date_from_unix_date(F.col("opens") + F.col("at")).alias("start_date"),
        F.date_from_unix_date(F.coalesce(end, F.col("reach"))).alias("end_date"),
        "raw_end",
    )


def first_last(rows: DataFrame, end: str = "end_date") -> DataFrame:
    """Earliest start and latest known end of each person."""
    return rows.groupBy("person_id").agg(
        F.min("start_date").alias("start_date"), F.max(end).alias("end_date")
    )
