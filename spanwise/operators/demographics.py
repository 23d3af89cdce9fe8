"""Sex, date of birth and age."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwise.config import AGE_BANDS, FEMALE_CONCEPT, MALE_CONCEPT
from spanwise.functions.dates import Band, age_at, age_band
from spanwise.sources.cdm import Cdm


def person_attributes(cdm: Cdm) -> DataFrame:
    """``person_id, sex, date_of_birth``; a missing month or day counts as 1."""
    birth_text = F.format_string(
        "%04d-%02d-%02d",
        F.col("year_of_birth").cast("int"),
        F.coalesce(F.col("month_of_birth").cast("int"), F.lit(1)),
        F.coalesce(F.col("day_of_birth").cast("int"), F.lit(1)),
    )
    gender = F.col("gender_concept_id")
    return cdm["person"].select(
        "person_id",
        F.when(gender == FEMALE_CONCEPT, "Female")
        .when(gender == MALE_CONCEPT, "Male")
        .otherwise("None")
        .alias("sex"),
        F.when(F.col("year_of_birth").isNotNull(), birth_text.try_cast("date")).alias(
            "date_of_birth"
        ),
    )


def with_attributes(rows: DataFrame, cdm: Cdm) -> DataFrame:
    """Rows with the sex and birth date of their person; unknown persons stay.

    Rows that carry both already, like a published period table, are not joined.
    """
    if {"sex", "date_of_birth"} <= set(rows.columns):
        return rows
    return rows.join(person_attributes(cdm), "person_id", "left").withColumn(
        "sex", F.coalesce("sex", F.lit("None"))
    )


def with_age(
    rows: DataFrame,
    date: str,
    age: str,
    group: str | None = None,
    bands: Sequence[Band] = AGE_BANDS,
) -> DataFrame:
    """Rows with the age at ``date`` and, when ``group`` is named, its band."""
    rows = rows.withColumn(age, age_at(F.col("date_of_birth"), F.col(date)))
    if group is None:
        return rows
    return rows.withColumn(group, age_band(F.col(age), bands))
