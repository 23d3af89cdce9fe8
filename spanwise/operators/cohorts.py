"""Codelists, outcome cohorts and denominator cohorts."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanwise.config import DENOMINATOR_BANDS, DENOMINATOR_SEXES, StudyConfig
from spanwise.functions.dates import Band, add_years, band_label
from spanwise.operators.demographics import with_attributes
from spanwise.operators.intervals import held, merge_intervals
from spanwise.operators.periods import original_periods
from spanwise.operators.records import repair_ends
from spanwise.sources.cdm import Cdm


def ingredient_codelist(cdm: Cdm, names: Sequence[str]) -> DataFrame:
    """``codelist_name, concept_id``: all descendants of the named ingredients.

    Names are matched without regard to case; a codelist has the name it was asked for by.
    """
    asked = F.array(*[F.lit(n) for n in names])
    ingredients = (
        cdm["concept"]
        .filter(F.col("concept_class_id") == "Ingredient")
        .select(
            F.explode(
                F.filter(asked, lambda n: F.lower(n) == F.lower("concept_name"))
            ).alias("codelist_name"),
            F.col("concept_id").alias("ancestor_concept_id"),
        )
    )
    return (
        cdm["concept_ancestor"]
        .join(ingredients, "ancestor_concept_id")
        .select("codelist_name", F.col("descendant_concept_id").alias("concept_id"))
        .distinct()
    )


def drug_outcomes(cdm: Cdm, codelist: DataFrame, gap_era: int = 1) -> DataFrame:
    """``outcome, person_id, start_date, end_date``: exposure eras per codelist.

    Exposures count when they start inside an original period. They are reduced
    to one row per person and day, and the periods to the furthest end per person and
    first day; in the order of days, an exposure lies inside a period when the furthest
    end so far reaches it. So no exposure is compared with a period.
    """
    start, end = cdm.date_fields["drug_exposure"]
    exposures = (
        cdm["drug_exposure"]
        .join(codelist, F.col("drug_concept_id") == F.col("concept_id"))
        .select(
            F.col("codelist_name").alias("outcome"),
            "person_id",
            F.col(start).cast("date").alias("start_date"),
            F.col(end).cast("date").alias("end_date"),
        )
    )
    daily = (
        repair_ends(exposures)
        .groupBy("outcome", "person_id", "start_date")
        .agg(F.max("end_date").alias("end_date"))
    )
    observed = (
        held(original_periods(cdm))
        .groupBy("person_id", "start_date")
        .agg(F.max("end_date").alias("observed_to"))
    )
    along = (
        Window.partitionBy("person_id")
        .orderBy("start_date", "turn")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    kept = (
        daily.withColumn("turn", F.lit(1))
        .unionByName(observed.withColumn("turn", F.lit(0)), allowMissingColumns=True)
        .withColumn("reach", F.max("observed_to").over(along))
        .filter((F.col("turn") == 1) & (F.col("reach") >= F.col("start_date")))
        .select("outcome", "person_id", "start_date", "end_date")
    )
    return merge_intervals(kept, ["outcome", "person_id"], gap_era, starts_unique=True)


def followed_bands(
    periods: DataFrame,
    cdm: Cdm,
    bands: Sequence[Band] = DENOMINATOR_BANDS,
    study_start: dt.date | None = None,
    study_end: dt.date | None = None,
    days_prior: int = 0,
) -> DataFrame:
    """Stretches of follow-up: one row per period and age band that it crosses.

    ``mode, person_id, sex, age_group, start_date, end_date``; a stretch starts
    after ``days_prior`` days in the period, inside the study window and at the
    lowest age of the band, and ends the day before the band is outgrown.
    Persons without a birth date belong to no band, periods without an end or with
    an end before their start hold no follow-up.
    """
    banded = F.array(
        *[
            F.struct(
                F.lit(band_label(b)).alias("age_group"),
                F.lit(b[0]).alias("low"),
                F.lit(b[1]).cast("int").alias("high"),
            )
            for b in bands
        ]
    )
    born = F.col("date_of_birth")
    latest = [F.col("end_date"), F.date_sub(add_years(born, F.col("high") + 1), 1)]
    earliest = [
        F.date_add("start_date", days_prior),
        add_years(born, F.col("low")),
    ]
    if study_start is not None:
        earliest.append(F.lit(study_start))
    if study_end is not None:
        latest.append(F.lit(study_end))
    return (
        with_attributes(held(periods), cdm)
        .filter(born.isNotNull())
        .select("*", F.inline(banded))
        .withColumns(
            {"start_date": F.greatest(*earliest), "end_date": F.least(*latest)}
        )
        .filter(F.col("start_date") <= F.col("end_date"))
        .select("mode", "person_id", "sex", "age_group", "start_date", "end_date")
    )


def study_follow_up(periods: DataFrame, cdm: Cdm, config: StudyConfig) -> DataFrame:
    """Follow-up by age band under the settings of one study."""
    return followed_bands(
        periods,
        cdm,
        study_start=config.study_start,
        study_end=config.study_end,
        days_prior=config.days_prior,
    )


def in_each_sex(rows: DataFrame) -> DataFrame:
    """Rows once under ``Both`` and once under the person's own sex, when known."""
    own = F.when(F.col("sex").isin("Female", "Male"), F.col("sex"))
    groups = F.array_compact(F.array(F.lit("Both"), own))
    others = [c for c in rows.columns if c != "sex"]
    return rows.select(*others, F.explode(groups).alias("sex"))


def denominator_settings(bands: Sequence[Band] = DENOMINATOR_BANDS) -> dict:
    """``(age_group, sex)`` to the cohort id: all sexes of a band, band by band."""
    pairs = [(band_label(b), s) for b in bands for s in DENOMINATOR_SEXES]
    return {pair: i for i, pair in enumerate(pairs, start=1)}


def denominator_cohorts(
    follow_up: DataFrame, bands: Sequence[Band] = DENOMINATOR_BANDS
) -> DataFrame:
    """The follow-up as cohorts, one per sex and age band, with their ids."""
    ids = F.lit(None).cast("int")
    for (group, sex), ident in denominator_settings(bands).items():
        matches = (F.col("age_group") == group) & (F.col("sex") == sex)
        ids = F.when(matches, ident).otherwise(ids)
    return in_each_sex(follow_up).select(
        "mode",
        ids.alias("cohort_definition_id"),
        F.col("person_id").alias("subject_id"),
        F.col("start_date").alias("cohort_start_date"),
        F.col("end_date").alias("cohort_end_date"),
        "age_group",
        "sex",
    )
