"""The study: all definitions, their characterisation, and the long result."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwise.config import (
    DENOMINATOR_BANDS,
    DENOMINATOR_SEXES,
    MODE_LABELS,
    NUMERIC_ESTIMATES,
    StudyConfig,
)
from spanwise.functions.dates import band_label, year_end, year_start
from spanwise.operators.cohorts import (
    drug_outcomes,
    ingredient_codelist,
    study_follow_up,
)
from spanwise.operators.features import period_features
from spanwise.operators.incidence import incidence, with_rates
from spanwise.operators.periods import all_definitions, number_periods
from spanwise.operators.person_time import in_observation
from spanwise.operators.summaries import (
    categorical_summary,
    numeric_summary,
    periods_per_person,
    records_subjects,
    snapshot,
)
from spanwise.results.exchange import export_result
from spanwise.results.longform import (
    SummarisedResult,
    bind,
    settings_table,
    summarised,
    to_rows,
)
from spanwise.session import materialise, run_folder
from spanwise.sources.cdm import Cdm

MODES = tuple(MODE_LABELS)


@dataclass(frozen=True)
class Characterisation:
    """The typed tables that describe a set of period definitions."""

    in_observation: DataFrame
    numeric: DataFrame
    categorical: DataFrame
    sizes: DataFrame
    per_person: DataFrame
    incidence: DataFrame


def outcome_cohorts(cdm: Cdm, config: StudyConfig) -> DataFrame:
    """Exposure eras of the study's ingredients, in the original periods."""
    codelist = ingredient_codelist(cdm, config.ingredients)
    return drug_outcomes(cdm, codelist, config.drug_gap_era)


def study_incidence(
    periods: DataFrame, cdm: Cdm, config: StudyConfig, outcomes: DataFrame
) -> DataFrame:
    """Incidence with rates under the settings of one study."""
    counts = incidence(
        study_follow_up(periods, cdm, config),
        outcomes,
        config.ingredients,
        washout=config.washout,
        repeated=config.repeated_events,
    )
    return with_rates(counts)


def op_per_person_summary(periods: DataFrame, cdm: Cdm) -> DataFrame:
    return numeric_summary(periods_per_person(periods, cdm), ["op_per_person"])


def characterise(
    periods: DataFrame,
    cdm: Cdm,
    config: StudyConfig,
    outcomes: DataFrame,
    features: DataFrame | None = None,
    keep: Callable[[DataFrame, str], DataFrame] = lambda table, name: table,
) -> Characterisation:
    """Describe all definitions in ``periods`` at once.

    Each table goes through ``keep`` with its name, so a study can write them one by one.
    Features that are not given are written before the tables that read them, and after
    the others.
    """
    incidence_table = keep(study_incidence(periods, cdm, config, outcomes), "incidence")
    observed = keep(in_observation(periods, cdm), "in_observation")
    per_person = keep(op_per_person_summary(periods, cdm), "per_person")
    if features is None:
        features = materialise(period_features(periods, cdm), "features")
    return Characterisation(
        in_observation=observed,
        numeric=keep(numeric_summary(features), "numeric"),
        categorical=keep(categorical_summary(features), "categorical"),
        sizes=keep(records_subjects(features), "sizes"),
        per_person=per_person,
        incidence=incidence_table,
    )


def _modes(spark, result_type: str, modes: Sequence[str], **pairs) -> DataFrame:
    entries = [{"mode": m} for m in modes]
    return settings_table(spark, result_type, entries, free=["mode"], **pairs)


def in_observation_result(table: DataFrame, cdm: Cdm, modes=MODES) -> SummarisedResult:
    """Person-time by year as long rows."""
    interval = F.concat_ws(
        " to ", year_start(F.col("year")), year_end(F.col("year"))
    )
    labelled = table.withColumns(
        {
            "omop_table": F.lit("observation_period"),
            "time_interval": interval,
            "interval": F.lit("years"),
        }
    )
    estimates = []
    for column, label in (
        ("records", "Number records in observation"),
        ("person_days", "Number person-days"),
    ):
        share = F.col(f"{column}_percentage")
        estimates.append((F.lit(label), None, "count", "integer", F.col(column)))
        estimates.append((F.lit(label), None, "percentage", "percentage", share))
    strata, additional = ("sex", "age_group"), ("time_interval", "interval")
    rows = to_rows(
        labelled, cdm.name, estimates, ["omop_table"], strata, additional
    )
    settings = _modes(
        cdm.spark,
        "summarise_in_observation",
        modes,
        group=["omop_table"],
        strata=strata,
        additional=additional,
    )
    return summarised(rows, settings, ["mode"])


def _numeric_rows(table: DataFrame, cdm: Cdm) -> DataFrame:
    variable = F.col("variable")
    estimates = [
        (variable, None, name, "numeric", F.col(name)) for name in NUMERIC_ESTIMATES
    ]
    return to_rows(table, cdm.name, estimates)


def characteristics_result(
    numeric: DataFrame,
    categorical: DataFrame,
    sizes: DataFrame,
    cdm: Cdm,
    modes=MODES,
) -> SummarisedResult:
    """Summaries of period features as long rows."""
    size_rows = to_rows(
        sizes,
        cdm.name,
        [
            (F.lit(f"number {what}"), None, "count", "integer", F.col(f"number_{what}"))
            for what in ("records", "subjects")
        ],
    )
    variable, level = F.col("variable"), F.col("level")
    level_rows = to_rows(
        categorical,
        cdm.name,
        [
            (variable, level, "count", "integer", F.col("count")),
            (variable, level, "percentage", "percentage", F.col("percentage")),
        ],
    )
    numeric_rows = _numeric_rows(numeric, cdm)
    shared = [c for c in size_rows.columns if c in numeric_rows.columns]
    rows = size_rows.select(shared)
    for more in (numeric_rows, level_rows):
        rows = rows.unionByName(more.select(shared))
    return summarised(rows, _modes(cdm.spark, "summarise_table", modes), ["mode"])


def per_person_result(table: DataFrame, cdm: Cdm, modes=MODES) -> SummarisedResult:
    """Periods per person as long rows."""
    rows = _numeric_rows(table, cdm)
    return summarised(rows, _modes(cdm.spark, "summarise_table", modes), ["mode"])


def density_result(table: DataFrame, cdm: Cdm, modes=MODES) -> SummarisedResult:
    """Smoothed densities as long rows: a pair of estimates for each point of a variable."""
    variable, point = F.col("variable"), F.col("point")
    estimates = [
        (variable, point, name, "numeric", F.col(name))
        for name in ("density_x", "density_y")
    ]
    rows = to_rows(table, cdm.name, estimates)
    return summarised(rows, _modes(cdm.spark, "summarise_table", modes), ["mode"])


def incidence_result(table: DataFrame, cdm: Cdm, modes=MODES) -> SummarisedResult:
    """Incidence as long rows, one result per mode and denominator cohort."""
    group = ("denominator_cohort_name", "outcome_cohort_name")
    additional = ("incidence_start_date", "incidence_end_date", "analysis_interval")
    cohort = F.concat_ws(
        "_", F.lit("denominator"), F.lower("sex"), F.translate("age_group", " ", "_")
    )
    named = table.withColumns(
        {
            "denominator_cohort_name": cohort,
            "outcome_cohort_name": F.col("outcome"),
            "denominator_age_group": F.col("age_group"),
            "denominator_sex": F.col("sex"),
            "incidence_start_date": F.col("incidence_start_date").cast("string"),
            "incidence_end_date": F.col("incidence_end_date").cast("string"),
        }
    )
    rate = "incidence_100000_pys"
    wanted = [
        ("Denominator", "denominator_count", "integer"),
        ("Denominator", "person_days", "numeric"),
        ("Denominator", "person_years", "numeric"),
        ("Outcome", "outcome_count", "integer"),
        ("Outcome", rate, "numeric"),
        ("Outcome", f"{rate}_95CI_lower", "numeric"),
        ("Outcome", f"{rate}_95CI_upper", "numeric"),
    ]
    estimates = [(F.lit(v), None, n, kind, F.col(n)) for v, n, kind in wanted]
    rows = to_rows(named, cdm.name, estimates, group=group, additional=additional)
    entries = [
        {"mode": m, "denominator_age_group": band_label(b), "denominator_sex": s}
        for m in modes
        for b in DENOMINATOR_BANDS
        for s in DENOMINATOR_SEXES
    ]
    keys = ["mode", "denominator_age_group", "denominator_sex"]
    settings = settings_table(
        cdm.spark, "incidence", entries, group=group, additional=additional, free=keys
    )
    return summarised(rows, settings, keys)


def snapshot_result(cdm: Cdm) -> SummarisedResult:
    """The database snapshot as long rows."""
    table = snapshot(cdm).drop("cdm_name").withColumn("of", F.lit("snapshot"))
    period = F.lit("observation_period")
    estimates = [
        (F.lit("person"), None, "count", "integer", F.col("person_count")),
        (period, None, "count", "integer", F.col("observation_period_count")),
        (period, None, "start_date", "date", F.col("first_start_date")),
        (period, None, "end_date", "date", F.col("last_end_date")),
        (F.lit("cdm"), None, "source_name", "character", F.col("source_name")),
        (F.lit("cdm"), None, "version", "character", F.col("cdm_version")),
    ]
    rows = to_rows(table, cdm.name, estimates)
    settings = settings_table(cdm.spark, "summarise_omop_snapshot", [{"of": "snapshot"}])
    result = summarised(rows, settings, ["of"])
    return SummarisedResult(result.rows, result.settings.drop("of"))


def study_result(tables: Characterisation, cdm: Cdm, modes=MODES) -> SummarisedResult:
    """All tables of one study as one long result."""
    described = [
        in_observation_result(tables.in_observation, cdm, modes),
        incidence_result(tables.incidence, cdm, modes),
        characteristics_result(
            tables.numeric, tables.categorical, tables.sizes, cdm, modes
        ),
        per_person_result(tables.per_person, cdm, modes),
    ]
    if not modes:
        # Without settings there are no rows; planned so, nothing is shuffled to find that.
        described = [r.with_rows(r.rows.filter(F.lit(False))) for r in described]
    return bind(snapshot_result(cdm), *described)


def run_study(cdm: Cdm, config: StudyConfig, folder: str) -> str:
    """Build, characterise and export; returns the path of the exported result.

    The tables that several steps read are written once to a folder of the run:
    the periods, their features and the outcomes. So is each table that describes
    them, one after the other: they are small, and what is shuffled for one is gone
    before the next. The folder is deleted after the export.
    """
    with run_folder(cdm.spark, "study"):
        periods = materialise(all_definitions(cdm, config), "periods")
        outcomes = materialise(outcome_cohorts(cdm, config), "outcomes")
        tables = characterise(periods, cdm, config, outcomes, keep=materialise)
        modes = present(periods)
        return export_result(
            study_result(tables, cdm, modes),
            folder=folder,
            cdm_name=cdm.name,
            min_cell_count=config.min_cell_count,
        )


def present(periods: DataFrame, modes: Sequence[str] = MODES) -> tuple[str, ...]:
    """Those of ``modes`` that have periods: a definition without any leaves no settings."""
    found = {r["mode"] for r in periods.select("mode").distinct().collect()}
    return tuple(m for m in modes if m in found)


def publish_periods(
    periods: DataFrame, mode: str, buckets: int = StudyConfig.id_buckets
) -> DataFrame:
    """The period table of one definition in the CDM layout, with dense ids.

    Original periods keep the ids they came with.
    """
    chosen = periods.filter(F.col("mode") == mode)
    if mode != "original_data":
        return number_periods(chosen, buckets)
    return chosen.select(
        F.col("period_id").alias("observation_period_id"),
        "person_id",
        F.col("start_date").alias("observation_period_start_date"),
        F.col("end_date").alias("observation_period_end_date"),
        F.lit(0).alias("period_type_concept_id"),
    )
