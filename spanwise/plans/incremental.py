"""Periods of a new data cut from those of the last one, recomputed for changed persons only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwise.config import RECORD_TABLES, StudyConfig
from spanwise.operators.periods import all_definitions
from spanwise.session import materialise
from spanwise.sources.cdm import Cdm

# What periods follow from besides the dates: fields read by their names in these tables.
FIELDS = {
    "visit_occurrence": ("visit_concept_id",),
    "observation_period": ("observation_period_id",),
    "person": ("gender_concept_id", "year_of_birth", "month_of_birth", "day_of_birth"),
}
SETTINGS = ("data_end_date", "censor_age", "censor_all")


@dataclass(frozen=True)
class Cut:
    """Periods of every definition, and a digest of what those of each person were made from."""

    periods: DataFrame
    digests: DataFrame


def person_digests(cdm: Cdm, config: StudyConfig) -> DataFrame:
    """``person_id, digest``: the person's rows in any order, and the settings that periods depend on.

    Rows are hashed and added up before the shuffle, so a person with very many rows is a
    row per task. A repeated row counts as often as it is there. Rows without a person
    are one person, null.
    """
    hashed = None
    for table in (*RECORD_TABLES, "observation_period", "person"):
        dates = [] if table == "person" else [F.col(c).cast("date") for c in dict.fromkeys(cdm.date_fields[table])]
        fields = [F.col(c).cast("long") for c in FIELDS.get(table, ())]
        # Each field with its place, as nulls leave a hash unchanged.
        values = [F.struct(F.lit(i), v, v.isNull()) for i, v in enumerate([*dates, *fields])]
        rows = cdm[table].select(F.col("person_id").cast("long"), F.xxhash64(F.lit(table), *values).alias("h"))
        hashed = rows if hashed is None else hashed.unionByName(rows)
    settings = "; ".join(f"{name} {getattr(config, name)}" for name in SETTINGS)
    # Halves of the hashes add up without an overflow for two billion rows of a person.
    return (
        hashed.groupBy("person_id")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.col("h").bitwiseAND(0xFFFFFFFF)).alias("low"),
            F.sum(F.shiftrightunsigned("h", 32)).alias("high"),
        )
        .select("person_id", F.xxhash64("n", "low", "high", F.lit(settings)).alias("digest"))
    )


def _same_person(a: DataFrame, b: DataFrame) -> Column:
    return a["person_id"].eqNullSafe(b["person_id"])


def changed_persons(before: DataFrame, now: DataFrame) -> DataFrame:
    """``person_id`` of those who came, went, or have another digest."""
    states = before.withColumn("cut", F.lit(0)).unionByName(now.withColumn("cut", F.lit(1)))
    seen = states.groupBy("person_id").agg(
        F.count(F.lit(1)).alias("cuts"), F.min("digest").alias("a"), F.max("digest").alias("b")
    )
    return seen.filter("cuts = 1 OR a <> b").select("person_id")


def of_persons(cdm: Cdm, persons: DataFrame) -> Cdm:
    """The clinical tables with the rows of ``persons`` only; tables without persons stay whole."""

    def kept(table: DataFrame) -> DataFrame:
        if "person_id" not in table.columns:
            return table
        return table.join(persons, _same_person(table, persons), "left_semi")

    tables = {name: kept(table) for name, table in cdm.tables.items()}
    return Cdm.from_tables(cdm.spark, tables, cdm.name, cdm.date_fields)


def first_cut(cdm: Cdm, config: StudyConfig) -> Cut:
    """All periods of a study, with what a later cut needs to tell who changed."""
    periods = materialise(all_definitions(cdm, config), "periods")
    return Cut(periods, materialise(person_digests(cdm, config), "digests"))


def next_cut(cdm: Cdm, config: StudyConfig, last: Cut) -> Cut:
    """The cut that ``first_cut`` would make of ``cdm``, from the ``last`` one.

    The new tables are read once for the digests, which needs no order and shuffles a row
    per person and task. Only rows of persons whose digest differs go through the
    definitions; periods of all others are taken over. Other settings change all
    digests. A cut without changes takes over everything; an empty one leaves nothing.
    """
    digests = materialise(person_digests(cdm, config), "digests")
    changed = materialise(changed_persons(last.digests, digests), "changed")
    made = all_definitions(of_persons(cdm, changed), config)
    old = last.periods.join(changed, _same_person(last.periods, changed), "left_anti")
    return Cut(materialise(old.unionByName(made), "periods"), digests)
