"""Summaries of period features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwise.config import (
    CATEGORICAL_VARIABLES,
    NUMERIC_ESTIMATES,
    NUMERIC_VARIABLES,
    QUANTILES,
)
from spanwise.operators.quantiles import numeric_estimates
from spanwise.sources.cdm import Cdm


def value_frequencies(
    rows: DataFrame, variables: Sequence[str] = NUMERIC_VARIABLES
) -> DataFrame:
    """``mode, variable, value, n``: how often each value occurs, NULLs left out."""
    values = F.array(
        *[
            F.struct(F.lit(v).alias("variable"), F.col(v).cast("double").alias("value"))
            for v in variables
        ]
    )
    return (
        rows.select("mode", F.inline(values))
        .filter(F.col("value").isNotNull() & F.col("mode").isNotNull())
        .groupBy("mode", "variable", "value")
        .agg(F.count("*").alias("n"))
    )


def numeric_summary(
    rows: DataFrame, variables: Sequence[str] = NUMERIC_VARIABLES
) -> DataFrame:
    """``mode, variable, median, q25, q75, min, max, mean, sd`` of each variable."""
    keys = ["mode", "variable"]
    estimates = numeric_estimates(value_frequencies(rows, variables), keys, QUANTILES)
    return estimates.select(*keys, *NUMERIC_ESTIMATES)


def categorical_summary(
    rows: DataFrame, variables: Sequence[str] = CATEGORICAL_VARIABLES
) -> DataFrame:
    """``mode, variable, level, count, percentage`` of each level."""
    combined = rows.groupBy("mode", *variables).agg(F.count("*").alias("n"))
    levels = F.array(
        *[
            F.struct(F.lit(v).alias("variable"), F.col(v).alias("level"))
            for v in variables
        ]
    )
    counts = (
        combined.select("mode", "n", F.inline(levels))
        .groupBy("mode", "variable", "level")
        .agg(F.sum("n").alias("count"))
    )
    totals = combined.groupBy("mode").agg(F.sum("n").alias("total"))
    share = 100 * F.col("count") / F.col("total")
    return counts.join(F.broadcast(totals), "mode").select(
        "mode", "variable", "level", "count", share.alias("percentage")
    )


def records_subjects(rows: DataFrame) -> DataFrame:
    """``mode, number_records, number_subjects``."""
    return (
        rows.groupBy("person_id", "mode")
        .agg(F.count("*").alias("n"))
        .groupBy("mode")
        .agg(
            F.sum("n").alias("number_records"), F.count("*").alias("number_subjects")
        )
    )


def periods_per_person(periods: DataFrame, cdm: Cdm) -> DataFrame:
    """``mode, person_id, op_per_person`` of the persons that are registered."""
    return (
        periods.groupBy("person_id", "mode")
        .agg(F.count("*").alias("op_per_person"))
        .join(cdm["person"].select("person_id"), "person_id", "left_semi")
    )


def snapshot(cdm: Cdm) -> DataFrame:
    """One row on the database: persons, periods, first and last day, version."""
    periods = cdm.dates("observation_period").agg(
        F.count("*").alias("observation_period_count"),
        F.min("start_date").alias("first_start_date"),
        F.max("end_date").alias("last_end_date"),
    )
    persons = cdm["person"].agg(F.count("*").alias("person_count"))
    whole = persons.withColumn("one", F.lit(1)).join(
        periods.withColumn("one", F.lit(1)), "one"
    )
    if "cdm_source" in cdm:
        source = cdm["cdm_source"].agg(
            F.max("cdm_source_name").alias("source_name"),
            F.max("cdm_version").alias("cdm_version"),
        )
        whole = whole.join(source.withColumn("one", F.lit(1)), "one")
    else:
        whole = whole.withColumns(
            {
                "source_name": F.lit(None).cast("string"),
                "cdm_version": F.lit(None).cast("string"),
            }
        )
    return whole.select(
        F.lit(cdm.name).alias("cdm_name"),
        "person_count",
        "observation_period_count",
        "first_start_date",
        "last_end_date",
        "source_name",
        "cdm_version",
    )
