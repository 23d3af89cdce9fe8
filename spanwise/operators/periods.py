"""The period definitions."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanwise.config import (
    INPATIENT_CONCEPTS,
    PERSISTENCE_RULES,
    RECORD_TABLES,
    StudyConfig,
    mode_name,
)
from spanwise.functions.dates import add_years
from spanwise.operators.demographics import person_attributes, with_attributes
from spanwise.operators.intervals import merge_by_gaps, merge_intervals
from spanwise.operators.records import (
    first_last,
    record_runs,
    records,
    repair_ends,
    stack,
)
from spanwise.session import materialise
from spanwise.sources.cdm import Cdm

SPAN = ("person_id", "start_date", "end_date")
PERIOD = ("mode", *SPAN, "period_id")


def first_deaths(cdm: Cdm) -> DataFrame:
    """Earliest death date of each person."""
    return cdm.dates("death").groupBy("person_id").agg(F.min("start_date").alias("died"))


def censor(
    spans: DataFrame, cdm: Cdm, data_end_date: dt.date, only: Column | None = None
) -> DataFrame:
    """End spans at the first death and at the data cut; drop what is left empty.

    ``only`` limits this to the rows that meet a condition. A missing end stays
    missing through both steps and is then dropped, hence the second ``when`` in
    place of ``otherwise``.
    """
    concerned = F.lit(True) if only is None else only
    end, cut = F.col("end_date"), F.lit(data_end_date)
    at_death = F.when(concerned & (F.col("died") <= end), F.col("died")).otherwise(end)
    at_cut = F.when(~concerned | (end <= cut), end).when(end > cut, cut)
    return (
        spans.join(first_deaths(cdm), "person_id", "left")
        .withColumn("end_date", at_death)
        .drop("died")
        .withColumn("end_date", at_cut)
        .filter(~concerned | (F.col("start_date") <= F.col("end_date")))
    )


def first_to_extract(
    cdm: Cdm, data_end_date: dt.date, censor_age: int, starts: DataFrame | None = None
) -> DataFrame:
    """First record until death, ``censor_age`` years of age or the data cut."""
    starts = first_last(records(cdm)) if starts is None else starts
    born = person_attributes(cdm).select("person_id", "date_of_birth")
    spans = starts.join(born, "person_id").select(
        "person_id",
        "start_date",
        add_years(F.col("date_of_birth"), F.lit(int(censor_age))).alias("end_date"),
    )
    return censor(spans, cdm, data_end_date)


def first_to_last(
    cdm: Cdm, data_end_date: dt.date, spans: DataFrame | None = None
) -> DataFrame:
    """First record to the latest recorded end; persons without any end drop out."""
    spans = first_last(records(cdm)) if spans is None else spans
    return censor(spans, cdm, data_end_date)


def record_eras(cdm: Cdm, days: DataFrame | None = None) -> DataFrame:
    """Time under an ongoing record of any kind, not censored."""
    days = record_runs(records(cdm)) if days is None else days
    return merge_intervals(days, ["person_id"], gap=0, starts_unique=True)


def persistence_periods(
    cdm: Cdm,
    data_end_date: dt.date,
    rules: Sequence[tuple[int, bool]] = PERSISTENCE_RULES,
    days: DataFrame | None = None,
) -> DataFrame:
    """Periods of all persistence rules at once, with their ``mode``.

    Extending every end by p days and merging what then touches gives the eras
    of gap p, closed p days later. So each persistence is merged once, and its
    surveillance variant only moves the end.
    """
    days = record_runs(records(cdm)) if days is None else days
    gaps = [persistence for persistence, _ in rules]
    eras = merge_by_gaps(days, ["person_id"], gaps, starts_unique=True)
    variants = F.array(
        *[
            F.struct(
                F.lit(p).alias("gap"),
                F.lit(p if s else 0).alias("tail"),
                F.lit(mode_name(p, s)).alias("mode"),
            )
            for p, s in rules
        ]
    )
    tagged = eras.select(
        *SPAN,
        F.inline(F.filter(variants, lambda v: v["gap"] == F.col("gap"))).alias(
            "rule_gap", "tail", "mode"
        ),
    )
    spans = tagged.select(
        "mode",
        "person_id",
        "start_date",
        F.date_add("end_date", F.col("tail")).alias("end_date"),
    )
    return censor(spans, cdm, data_end_date)


def inpatient_periods(cdm: Cdm) -> DataFrame:
    """Merged hospital stays, not censored."""
    visits = cdm["visit_occurrence"].filter(
        F.col("visit_concept_id").isin(*INPATIENT_CONCEPTS)
    )
    start, end = cdm.date_fields["visit_occurrence"]
    stays = visits.select(
        "person_id",
        F.col(start).cast("date").alias("start_date"),
        F.col(end).cast("date").alias("end_date"),
    )
    return merge_intervals(repair_ends(stays), ["person_id"], gap=0)


def original_periods(cdm: Cdm) -> DataFrame:
    """The periods that came with the data, unchanged, with their ids."""
    start, end = cdm.date_fields["observation_period"]
    return cdm["observation_period"].select(
        "person_id",
        F.col(start).cast("date").alias("start_date"),
        F.col(end).cast("date").alias("end_date"),
        F.col("observation_period_id").cast("long").alias("period_id"),
    )


def build_periods(
    cdm: Cdm,
    censor_date: dt.date,
    records_from: Sequence[str] = RECORD_TABLES,
    collapse_era: int | None = None,
    persistence_window: int | None = None,
    censor_age: int | None = 150,
) -> DataFrame:
    """General builder; None stands for an unbounded gap, window or age.

    Eras are merged over gaps of up to the larger of ``collapse_era`` and
    ``persistence_window`` and stay open for ``persistence_window`` days. An
    unbounded window follows a person from the first record to ``censor_age``
    years of age. All periods end at death and at ``censor_date``.
    """
    rows = records(cdm, records_from)
    if persistence_window is None:
        starts = first_last(rows)
        if censor_age is None:
            spans = starts.withColumn("end_date", F.lit(censor_date))
            return censor(spans, cdm, censor_date)
        return first_to_extract(cdm, censor_date, censor_age, starts)
    if collapse_era is None:
        eras = first_last(repair_ends(rows))
    else:
        gap = max(collapse_era, persistence_window)
        eras = merge_intervals(record_runs(rows), ["person_id"], gap, True)
    spans = eras.withColumn("end_date", F.date_add("end_date", persistence_window))
    return censor(spans, cdm, censor_date)


def _record_spans(days: DataFrame) -> DataFrame:
    """Spans of every definition that follows from the records, from one pass.

    The unbounded gap yields the whole span of a person next to the eras of the
    persistence rules, and the latest raw end travels along. So the first-record
    definitions need no reading and no shuffle of the records of their own.
    """
    rules = [(mode_name(p, s), p, p if s else 0) for p, s in PERSISTENCE_RULES]
    rules += [("min_extract", None, 0), ("min_max", None, 0)]
    eras = merge_by_gaps(
        days, ["person_id"], [gap for _, gap, _ in rules], True, keep_max=["raw_end"]
    )
    variants = F.array(
        *[
            F.struct(
                F.lit(mode).alias("mode"),
                F.lit(gap).cast("int").alias("rule_gap"),
                F.lit(tail).alias("tail"),
            )
            for mode, gap, tail in rules
        ]
    )
    own = F.filter(variants, lambda v: v["rule_gap"].eqNullSafe(F.col("gap")))
    end = F.when(F.col("mode") == "min_max", F.col("raw_end")).otherwise(
        F.date_add("end_date", F.col("tail"))
    )
    return eras.select("*", F.inline(own)).select(
        "mode", "person_id", "start_date", end.alias("end_date")
    )


def all_definitions(
    cdm: Cdm, config: StudyConfig, days: DataFrame | None = None
) -> DataFrame:
    """Periods of every definition in one table, with the person's attributes.

    ``mode, person_id, start_date, end_date, period_id, sex, date_of_birth``;
    only original periods have an id at this point. Original and inpatient
    periods are left as they are unless the study censors all. ``days`` takes
    the spans of all records, one for each person and start, when they are at hand as a
    written table.

    Inpatient and record-based periods, of which a person has one per day at
    most, come partitioned by person, so attributes and deaths are joined to
    all of them at once without a further shuffle. Original periods are joined
    by themselves, which lets a person with very many of them be split up.
    """
    days = record_runs(records(cdm)) if days is None else days
    derived = with_attributes(
        stack(
            [
                inpatient_periods(cdm).select(F.lit("impatient").alias("mode"), *SPAN),
                _record_spans(days).select("mode", *SPAN),
            ]
        ),
        cdm,
    )
    outgrown = add_years(F.col("date_of_birth"), F.lit(config.censor_age))
    end = F.when(F.col("mode") == "min_extract", outgrown).otherwise(F.col("end_date"))
    censored = censor(
        derived.withColumn("end_date", end),
        cdm,
        config.data_end_date,
        only=None if config.censor_all else F.col("mode") != "impatient",
    ).withColumn("period_id", F.lit(None).cast("long"))
    original = with_attributes(original_periods(cdm), cdm)
    if config.censor_all:
        original = censor(original, cdm, config.data_end_date)
    original = original.withColumn("mode", F.lit("original_data"))
    columns = (*PERIOD, "sex", "date_of_birth")
    return original.select(*columns).unionByName(censored.select(*columns))


def number_periods(spans: DataFrame, buckets: int = StudyConfig.id_buckets) -> DataFrame:
    """Publish spans with dense ids from 1 and the period type 0.

    Rows are numbered inside ``person_id % buckets`` and shifted by the counts
    of the buckets before, so no task ever sorts the whole table; only the
    counts, one row per bucket, are summed in one place. The ids depend on the
    data alone and come out equal when a lost task is run again. Rows without a
    person are numbered in the first bucket. The spans are written once and read
    twice, so what they are made from is read once.
    """
    bucket = F.coalesce(F.pmod("person_id", F.lit(buckets)), F.lit(0))
    placed = materialise(spans.select(*SPAN).withColumn("bucket", bucket), "numbered")
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        placed.groupBy("bucket")
        .count()
        .select(
            "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("shift")
        )
    )
    inside = Window.partitionBy("bucket").orderBy("person_id", "start_date", "end_date")
    return (
        placed.withColumn("place", F.row_number().over(inside))
        .join(F.broadcast(shifts), "bucket")
        .select(
            (F.col("shift") + F.col("place")).alias("observation_period_id"),
            "person_id",
            F.col("start_date").alias("observation_period_start_date"),
            F.col("end_date").alias("observation_period_end_date"),
            F.lit(0).alias("period_type_concept_id"),
        )
    )
