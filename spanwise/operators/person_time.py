"""Periods and person-days in observation by calendar year, sex and age."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanwise.config import AGE_BANDS
from spanwise.functions.dates import Band, days_between
from spanwise.operators.demographics import with_age, with_attributes
from spanwise.operators.intervals import split_by_year
from spanwise.sources.cdm import Cdm

STRATA = ("sex", "age_group")


def in_observation(
    periods: DataFrame, cdm: Cdm, bands: Sequence[Band] = AGE_BANDS
) -> DataFrame:
    """``mode, year, sex, age_group, records, person_days`` and their percentages.

    A period counts in every year it touches, with the age at its first day in
    that year. The rows are first added up per year, sex and age group, so the
    totals over strata are taken from a table of a few thousand rows. The
    percentages refer to all periods, or all person-days, of the mode.
    """
    spans = with_attributes(periods, cdm).withColumn("first_year", F.year("start_date"))
    yearly = split_by_year(spans)
    aged = with_age(yearly, "start_date", "age", "age_group", bands)
    days = days_between(F.col("start_date"), F.col("end_date"), inclusive=True)
    cells = aged.groupBy("mode", "year", *STRATA).agg(
        F.count("*").alias("records"),
        F.sum(days).alias("person_days"),
        F.sum((F.col("year") == F.col("first_year")).cast("long")).alias("opened"),
    )
    whole = Window.partitionBy("mode")
    cells = cells.withColumns(
        {
            "all_records": F.sum("opened").over(whole),
            "all_days": F.sum("person_days").over(whole),
        }
    )
    cell = ["mode", "year", *STRATA]
    sets = [cell, cell[:3], [*cell[:2], cell[3]], cell[:2]]
    totalled = cells.groupingSets(sets, *cell).agg(
        F.sum("records").alias("records"),
        F.sum("person_days").alias("person_days"),
        F.max("all_records").alias("all_records"),
        F.max("all_days").alias("all_days"),
    )
    overall = {c: F.coalesce(F.col(c), F.lit("overall")) for c in STRATA}
    return (
        totalled.withColumns(overall)
        .select(
            "mode",
            "year",
            *STRATA,
            "records",
            "person_days",
            (100 * F.col("records") / F.col("all_records")).alias("records_percentage"),
            (100 * F.col("person_days") / F.col("all_days")).alias(
                "person_days_percentage"
            ),
        )
    )
