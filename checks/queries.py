"""The registered queries: every operator on the clinical tables of a folder.

As in a study run, the periods of all definitions, their features and the
outcomes are written to the shared folder once, and later steps read them; the
queries that build them start from the clinical tables.
"""

from __future__ import annotations

import dataclasses
import datetime as dt
from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from checks import oracles as O
from spanwise.config import (
    CATEGORICAL_VARIABLES,
    MODE_LABELS,
    NUMERIC_VARIABLES,
    PERSISTENCE_RULES,
    RECORD_TABLES,
    mode_name,
)
from spanwise.functions.dates import add_years
from spanwise.operators import (
    cohorts,
    density,
    features,
    incidence,
    periods,
    person_time,
    records,
    summaries,
)
from spanwise.operators.demographics import person_attributes, with_age
from spanwise.plans import incremental, study
from spanwise.report import overview, prepare, selection
from spanwise.results import exchange, longform, reshape
from spanwise.session import materialise, shared_folder
from spanwise.sources.cdm import Cdm
from spanwise.sources.fixtures import STUDY, fixture_cdm

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
CUT = STUDY.data_end_date


def register(name: str, sql: str | None = None):
    """Register a query; ``sql`` selects from the reference expressions."""

    def add(function):
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = O.query(sql)
        return function

    return add


def rounded(rows: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Doubles at a precision that two engines can agree on."""
    return rows.withColumns({c: F.round(c, digits) for c in columns})


def round_sql(*columns: str, digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in columns)


@cache
def _bound(application: str, spark: SparkSession, folder: str):
    return fixture_cdm(spark, folder)


def clinical(spark: SparkSession, folder: str):
    """The clinical tables of a folder, bound once per session."""
    return _bound(spark.sparkContext.applicationId, spark, folder)


@cache
def _table(application: str, spark: SparkSession, folder: str, name: str) -> DataFrame:
    cdm = clinical(spark, folder)
    if name == "periods":
        return materialise(periods.all_definitions(cdm, STUDY), name)
    if name == "features":
        spans = written(spark, folder, "periods")
        return materialise(features.period_features(spans, cdm), name)
    return materialise(study.outcome_cohorts(cdm, STUDY), name)


def written(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table that the study writes for its later steps, made once per session."""
    return _table(spark.sparkContext.applicationId, spark, folder, name)


def all_periods(spark, folder):
    return clinical(spark, folder), written(spark, folder, "periods")


# Records -------------------------------------------------------------------


@register("records_union", "SELECT * FROM recs")
def records_union(spark, folder):
    return records.records(clinical(spark, folder))


@register("records_repaired", "SELECT * FROM repaired")
def records_repaired(spark, folder):
    return records.repair_ends(records.records(clinical(spark, folder)))


@register(
    "record_days",
    """SELECT r.person_id, r.start_date, max(r.end_date) AS end_date,
              any_value(raw.raw_end) AS raw_end
       FROM repaired r JOIN (SELECT person_id, start_date, max(end_date) AS raw_end
                             FROM recs GROUP BY ALL) raw
         ON r.person_id = raw.person_id AND r.start_date = raw.start_date
       GROUP BY r.person_id, r.start_date""",
)
def record_days(spark, folder):
    return records.record_days(records.records(clinical(spark, folder)))


O.define(
    "record_steps",
    """SELECT *, unnest(range(u, least(e, opens + 59) + 1)) AS d FROM (
           SELECT *, CAST(u - ((u % 60) + 60) % 60 AS INT) AS opens FROM (
               SELECT person_id, end_date AS raw, date_diff('day', DATE '1970-01-01', start_date) AS u,
                      date_diff('day', DATE '1970-01-01', greatest(coalesce(end_date, start_date), start_date)) AS e
               FROM recs WHERE start_date IS NOT NULL))""",
)


@register(
    "record_sets",
    """SELECT person_id, opens, bit_or(1::BIGINT << CAST(d - opens AS INT)) AS covered,
              bit_or(CASE WHEN d < e THEN 1::BIGINT << CAST(d - opens AS INT) ELSE 0 END) AS linked,
              CAST(max(CASE WHEN e >= opens + 60 THEN e END) AS INT) AS reach, max(raw) AS raw_end
       FROM record_steps GROUP BY person_id, opens""",
)
def record_sets(spark, folder):
    return records.record_sets(records.records(clinical(spark, folder)))


@register("first_last_record", "SELECT * FROM person_span")
def first_last_record(spark, folder):
    return records.first_last(records.records(clinical(spark, folder)))


# Period definitions --------------------------------------------------------


@register("period_min_extract", "SELECT * FROM min_extract")
def period_min_extract(spark, folder):
    cdm = clinical(spark, folder)
    return periods.first_to_extract(cdm, CUT, STUDY.censor_age)


@register("period_min_max", "SELECT * FROM min_max")
def period_min_max(spark, folder):
    return periods.first_to_last(clinical(spark, folder), CUT)


@register("visit_eras", "SELECT * FROM base_eras")
def visit_eras(spark, folder):
    return periods.record_eras(clinical(spark, folder))


def _persistence(days: int, tail: bool) -> None:
    name = f"period_persistence_{days}" + ("_surv" if tail else "")

    @register(name, f"SELECT * FROM {mode_name(days, tail)}")
    def one_rule(spark, folder):
        cdm = clinical(spark, folder)
        return periods.persistence_periods(cdm, CUT, [(days, tail)]).drop("mode")


for _days, _tail in PERSISTENCE_RULES:
    _persistence(_days, _tail)


@register("period_inpatient", "SELECT * FROM impatient")
def period_inpatient(spark, folder):
    return periods.inpatient_periods(clinical(spark, folder))


@register("period_original", "SELECT * FROM original_data")
def period_original(spark, folder):
    return periods.original_periods(clinical(spark, folder))


O.define(
    "some_records",
    "SELECT * FROM repaired WHERE domain IN ('visit_occurrence', 'drug_exposure')",
)
O.define("some_eras", O.eras("some_records", "person_id", 90))
O.define(
    "some_extended",
    "SELECT person_id, start_date, end_date + 60 AS end_date FROM some_eras",
)


@register("build_periods_general", O.censored("some_extended"))
def build_periods_general(spark, folder):
    return periods.build_periods(
        clinical(spark, folder),
        CUT,
        ["visit_occurrence", "drug_exposure"],
        collapse_era=90,
        persistence_window=60,
    )


O.define(
    "one_era",
    """SELECT person_id, min(start_date) AS start_date, max(end_date) + 30 AS end_date
       FROM some_records GROUP BY person_id""",
)


@register("build_periods_one_era", O.censored("one_era"))
def build_periods_one_era(spark, folder):
    return periods.build_periods(
        clinical(spark, folder),
        CUT,
        ["visit_occurrence", "drug_exposure"],
        collapse_era=None,
        persistence_window=30,
    )


O.define(
    "endless",
    "SELECT person_id, min(start_date) AS start_date, DATE '9999-12-31' AS end_date"
    " FROM recs GROUP BY person_id",
)


@register("build_periods_unbounded", O.censored("endless"))
def build_periods_unbounded(spark, folder):
    return periods.build_periods(clinical(spark, folder), CUT, censor_age=None)


@register("all_definitions", "SELECT * FROM all_periods")
def all_definitions(spark, folder):
    spans = periods.all_definitions(clinical(spark, folder), STUDY)
    return spans.drop("sex", "date_of_birth")


def before_the_last_week(cdm):
    """The tables as of a week before the study's data cut."""
    cut = STUDY.data_end_date - dt.timedelta(7)
    tables = {t: cdm[t].filter(F.col(cdm.date_fields[t][0]).cast("date") < cut) for t in RECORD_TABLES}
    return Cdm.from_tables(cdm.spark, cdm.tables | tables, cdm.name, cdm.date_fields)


@register("definitions_of_next_cut", "SELECT * FROM all_periods")
def definitions_of_next_cut(spark, folder):
    cdm = clinical(spark, folder)
    last = incremental.first_cut(before_the_last_week(cdm), STUDY)
    return incremental.next_cut(cdm, STUDY, last).periods.drop("sex", "date_of_birth")


O.define(
    "all_censored",
    O.union(
        f"SELECT '{m}' AS mode, * FROM ({O.censored(m)})"
        if m in ("original_data", "impatient")
        else f"SELECT '{m}' AS mode, person_id, start_date, end_date FROM {m}"
        for m in MODE_LABELS
    ),
)


@register("all_definitions_censored", "SELECT * FROM all_censored")
def all_definitions_censored(spark, folder):
    config = dataclasses.replace(STUDY, censor_all=True)
    spans = periods.all_definitions(clinical(spark, folder), config)
    return spans.select("mode", *periods.SPAN)


@register(
    "definition_totals",
    """SELECT mode, count(*) AS periods, count(DISTINCT person_id) AS persons,
              CAST(sum(end_date - start_date + 1) AS BIGINT) AS person_days
       FROM all_periods GROUP BY mode""",
)
def definition_totals(spark, folder):
    length = F.datediff("end_date", "start_date") + 1
    return (
        all_periods(spark, folder)[1]
        .withColumn("length", length)
        .groupBy("mode", "person_id")
        .agg(F.count("*").alias("n"), F.sum("length").alias("days"))
        .groupBy("mode")
        .agg(
            F.sum("n").alias("periods"),
            F.count("*").alias("persons"),
            F.sum("days").alias("person_days"),
        )
    )


@register("censor_death_cut", O.censored("base_eras"))
def censor_death_cut(spark, folder):
    cdm = clinical(spark, folder)
    return periods.censor(periods.record_eras(cdm), cdm, CUT)


@register(
    "published_periods",
    f"""SELECT row_number() OVER (ORDER BY person_id % {STUDY.id_buckets}, person_id,
                                  start_date, end_date) AS observation_period_id,
               person_id, start_date AS observation_period_start_date,
               end_date AS observation_period_end_date, 0 AS period_type_concept_id
        FROM persistence_180_surveillanceTRUE""",
)
def published_periods(spark, folder):
    cdm = clinical(spark, folder)
    return periods.number_periods(periods.persistence_periods(cdm, CUT, [(180, True)]))


# Characterisation ----------------------------------------------------------

STRATUM = "mode, year, sex, age_group"


@register(
    "in_observation",
    f"SELECT {STRATUM}, records, person_days,"
    f" {round_sql('records_percentage', 'person_days_percentage')} FROM in_obs",
)
def in_observation(spark, folder):
    cdm, spans = all_periods(spark, folder)
    table = person_time.in_observation(spans, cdm)
    return rounded(table, "records_percentage", "person_days_percentage")


KEY = "mode, person_id, start_date, end_date, period_id"


@register(
    "time_to_next_period",
    f"SELECT {KEY}, CAST(time_to_next_observation AS INT) AS time_to_next_observation,"
    " CAST(gap_to_next AS INT) AS gap_to_next FROM feats",
)
def time_to_next_period(spark, folder):
    spans = all_periods(spark, folder)[1].drop("sex", "date_of_birth")
    return features.with_next(spans)


@register(
    "age_sex_bands",
    f"""SELECT v.person_id, visit_start_date, sex, dob AS date_of_birth,
               {O.age("visit_start_date")} AS age,
               {O.band(O.age("visit_start_date"))} AS age_group,
               CAST(dob + INTERVAL 150 YEAR AS DATE) AS outgrown
        FROM visit_occurrence v JOIN attrs a ON v.person_id = a.person_id""",
)
def age_sex_bands(spark, folder):
    cdm = clinical(spark, folder)
    visits = cdm["visit_occurrence"].select("person_id", "visit_start_date")
    rows = visits.join(person_attributes(cdm), "person_id")
    rows = with_age(rows, "visit_start_date", "age", "age_group")
    return rows.withColumn("outgrown", add_years(F.col("date_of_birth"), F.lit(150)))


COUNTS = ", ".join(features.COUNTED)


@register("records_in_period", f"SELECT {KEY}, {COUNTS} FROM counted")
def records_in_period(spark, folder):
    cdm, spans = all_periods(spark, folder)
    return features.records_in_periods(spans.drop("sex", "date_of_birth"), cdm)


@register(
    "rates_per_day", f"SELECT {KEY}, {round_sql(*features.RATES, digits=9)} FROM feats"
)
def rates_per_day(spark, folder):
    rows = written(spark, folder, "features")
    return rounded(rows, *features.RATES, digits=9).select(
        *features.KEY, *features.RATES
    )


@register(
    "period_features",
    f"""SELECT {KEY}, {", ".join(f"CAST({v} AS DOUBLE) AS {v}" for v in NUMERIC_VARIABLES[:7])},
               {", ".join(CATEGORICAL_VARIABLES)} FROM feats""",
)
def period_features(spark, folder):
    cdm, spans = all_periods(spark, folder)
    rows = features.period_features(spans, cdm)
    numbers = [F.col(v).cast("double").alias(v) for v in NUMERIC_VARIABLES[:7]]
    return rows.select(*features.KEY, *numbers, *CATEGORICAL_VARIABLES)


ESTIMATES = ("median", "q25", "q75", "min", "max", "mean", "sd")


@register("numeric_summary", f"SELECT mode, variable, {round_sql(*ESTIMATES)} FROM num_summary")
def numeric_summary(spark, folder):
    rows = written(spark, folder, "features")
    return rounded(summaries.numeric_summary(rows), *ESTIMATES)


@register(
    "categorical_summary",
    f"SELECT mode, variable, level, count, {round_sql('percentage')} FROM cat_summary",
)
def categorical_summary(spark, folder):
    rows = written(spark, folder, "features")
    return rounded(summaries.categorical_summary(rows), "percentage")


@register("records_subjects", "SELECT * FROM sizes")
def records_subjects(spark, folder):
    return summaries.records_subjects(all_periods(spark, folder)[1])


@register("periods_per_person", "SELECT * FROM per_person")
def periods_per_person(spark, folder):
    cdm, spans = all_periods(spark, folder)
    return summaries.periods_per_person(spans, cdm)


@register(
    "periods_per_person_summary",
    f"SELECT mode, variable, {round_sql(*ESTIMATES)} FROM per_person_summary",
)
def periods_per_person_summary(spark, folder):
    cdm, spans = all_periods(spark, folder)
    return rounded(study.op_per_person_summary(spans, cdm), *ESTIMATES)


@register(
    "snapshot",
    f"""SELECT '{STUDY.cdm_name}' AS cdm_name, *, CAST(NULL AS VARCHAR) AS source_name,
               CAST(NULL AS VARCHAR) AS cdm_version FROM snap""",
)
def snapshot(spark, folder):
    return summaries.snapshot(clinical(spark, folder))


O.define(
    "lengths",
    " UNION ALL ".join(
        f"SELECT mode, '{v}' AS variable, CAST({v} AS DOUBLE) AS value FROM feats"
        f" WHERE {v} IS NOT NULL"
        for v in NUMERIC_VARIABLES
    ),
)
O.define(
    "shapes",
    """SELECT mode, variable, size, width, low - 3 * width AS origin,
              (high - low + 6 * width) / 511 AS step
       FROM (SELECT mode, variable, size, low, high, 0.9 * pow(size, -0.2)
               * CASE WHEN least(sd, iqr / 1.34) > 0 THEN least(sd, iqr / 1.34)
                      WHEN sd > 0 THEN sd WHEN abs(high) > 0 THEN abs(high)
                      ELSE 1 END AS width
             FROM (SELECT mode, variable, count(*) AS size, min(value) AS low,
                          max(value) AS high, stddev_samp(value) AS sd,
                          quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr
                   FROM lengths GROUP BY mode, variable))""",
)
O.define(
    "placed",
    """SELECT l.mode, l.variable, (value - origin) / step AS place FROM lengths l
       JOIN shapes s ON l.mode = s.mode AND l.variable = s.variable""",
)
O.define(
    "masses",
    """SELECT mode, variable, slot, sum(mass) AS mass FROM (
         SELECT mode, variable, CAST(floor(place) AS INT) AS slot,
                1 - (place - floor(place)) AS mass FROM placed
         UNION ALL
         SELECT mode, variable, CAST(floor(place) AS INT) + 1, place - floor(place)
         FROM placed) GROUP BY mode, variable, slot""",
)


@register(
    "density",
    """SELECT s.mode, s.variable AS variable_name, estimate_name,
              CAST(point AS VARCHAR) AS variable_level,
              round(CASE estimate_name WHEN 'density_x' THEN x ELSE y END, 6) AS num
       FROM (SELECT s.mode, s.variable, g.point,
                    any_value(origin + g.point * step) AS x,
                    sum(mass / size * exp(-pow((g.point - slot) * step / width, 2) / 2)
                        / (width * sqrt(2 * pi()))) AS y
             FROM masses m JOIN shapes s ON m.mode = s.mode AND m.variable = s.variable
             CROSS JOIN (SELECT unnest(range(0, 512)) AS point) g
             GROUP BY s.mode, s.variable, g.point) s
       CROSS JOIN (SELECT unnest(['density_x', 'density_y']) AS estimate_name)""",
)
def density_of_features(spark, folder):
    cdm = clinical(spark, folder)
    frequencies = summaries.value_frequencies(written(spark, folder, "features"))
    result = study.density_result(
        density.density(frequencies, ["mode", "variable"]), cdm
    )
    rows = reshape.add_settings(result.rows, result.settings, ["mode"])
    return rows.select(
        "mode",
        "variable_name",
        "estimate_name",
        "variable_level",
        F.round(F.col("estimate_value").cast("double"), 6).alias("num"),
    )


# Cohorts and incidence -----------------------------------------------------


@register("ingredient_codelist", "SELECT * FROM codelist")
def ingredient_codelist(spark, folder):
    return cohorts.ingredient_codelist(clinical(spark, folder), STUDY.ingredients)


@register("drug_outcome_eras", "SELECT * FROM outcomes")
def drug_outcome_eras(spark, folder):
    return study.outcome_cohorts(clinical(spark, folder), STUDY)


@register(
    "denominator_cohorts",
    """SELECT mode, CAST(cohort_definition_id AS INT) AS cohort_definition_id,
              person_id AS subject_id, entry AS cohort_start_date,
              leave AS cohort_end_date, age_group, sex FROM cohorts""",
)
def denominator_cohorts(spark, folder):
    cdm, spans = all_periods(spark, folder)
    return cohorts.denominator_cohorts(cohorts.study_follow_up(spans, cdm, STUDY))


INC = (
    "mode, outcome, sex, age_group, year, denominator_count, outcome_count,"
    " person_days, round(person_years, 6) AS person_years"
)


def _incidence(spark, folder, **options):
    cdm, spans = all_periods(spark, folder)
    follow_up = cohorts.study_follow_up(spans, cdm, STUDY)
    outcomes = written(spark, folder, "outcomes")
    counts = incidence.incidence(
        follow_up, outcomes, STUDY.ingredients, washout=STUDY.washout, **options
    )
    columns = [c for c in counts.columns if not c.endswith("_date")]
    return rounded(counts, "person_years").select(columns).drop("analysis_interval")


@register("incidence_years", f"SELECT {INC} FROM inc WHERE analysis_interval = 'years'")
def incidence_years(spark, folder):
    return _incidence(spark, folder, intervals=["years"])


@register(
    "incidence_overall", f"SELECT {INC} FROM inc WHERE analysis_interval = 'overall'"
)
def incidence_overall(spark, folder):
    return _incidence(spark, folder, intervals=["overall"])


@register("incidence_first_event", f"SELECT {INC} FROM inc_first")
def incidence_first_event(spark, folder):
    return _incidence(spark, folder, repeated=False)


@register(
    "incidence_complete_years",
    f"""SELECT {INC} FROM inc WHERE analysis_interval = 'years'
        AND EXISTS (SELECT 1 FROM covered c WHERE c.mode = inc.mode
                    AND inc.opened >= c.opens AND inc.closed <= c.closes)""",
)
def incidence_complete_years(spark, folder):
    return _incidence(spark, folder, intervals=["years"], complete_intervals=True)


@register(
    "incidence_ci",
    """SELECT mode, outcome, sex, age_group, analysis_interval, year, outcome_count,
              opened AS incidence_start_date, closed AS incidence_end_date,
              round(rate, 4) AS rate, round(rate_low, 4) AS lower,
              round(rate_high, 4) AS upper FROM inc_rates""",
)
def incidence_ci(spark, folder):
    cdm, spans = all_periods(spark, folder)
    outcomes = written(spark, folder, "outcomes")
    table = study.study_incidence(spans, cdm, STUDY, outcomes)
    rate = "incidence_100000_pys"
    return table.select(
        "mode",
        "outcome",
        "sex",
        "age_group",
        "analysis_interval",
        "year",
        "outcome_count",
        "incidence_start_date",
        "incidence_end_date",
        F.round(rate, 4).alias("rate"),
        F.round(f"{rate}_95CI_lower", 4).alias("lower"),
        F.round(f"{rate}_95CI_upper", 4).alias("upper"),
    )


# Long results --------------------------------------------------------------


def comparable(rows: DataFrame) -> DataFrame:
    """Estimate values as rounded numbers, or as text where they are none."""
    number = F.col("estimate_type").isin("integer", "numeric", "percentage")
    value = F.when(number, F.col("estimate_value").try_cast("double"))
    return rows.withColumns(
        {
            "num": F.round(value, 4),
            "txt": F.when(~number, F.col("estimate_value")),
        }
    ).drop("estimate_value")


LONG = O.LONG.replace(" num,", " round(num, 4) AS num,")


@register("summarised_result_long", f"SELECT {LONG} FROM long_in_obs")
def summarised_result_long(spark, folder):
    cdm, spans = all_periods(spark, folder)
    result = study.in_observation_result(person_time.in_observation(spans, cdm), cdm)
    # Ids follow the snapshot's single one when the study is bound together.
    shifted = result.rows.withColumn("result_id", F.col("result_id") + 1)
    return comparable(shifted)


@register(
    "bind_results",
    f"""SELECT {LONG} FROM long_snapshot UNION ALL SELECT {LONG} FROM long_in_obs
        UNION ALL SELECT {LONG.replace("result_id,", "result_id - 234 AS result_id,")}
        FROM long_periods""",
)
def bind_results(spark, folder):
    cdm, spans = all_periods(spark, folder)
    rows = written(spark, folder, "features")
    bound = longform.bind(
        study.snapshot_result(cdm),
        study.in_observation_result(person_time.in_observation(spans, cdm), cdm),
        study.characteristics_result(
            summaries.numeric_summary(rows),
            summaries.categorical_summary(rows),
            summaries.records_subjects(rows),
            cdm,
        ),
    )
    return comparable(bound.rows)


@register("suppressed_result", f"SELECT {LONG} FROM safe_in_obs")
def suppressed_result(spark, folder):
    cdm, spans = all_periods(spark, folder)
    result = study.in_observation_result(person_time.in_observation(spans, cdm), cdm)
    hidden = longform.suppress(result, STUDY.min_cell_count).rows
    return comparable(hidden.withColumn("result_id", F.col("result_id") + 1))


# Report: all that follows reads the exported files of one whole study run. ---


@cache
def _exported(application: str, spark: SparkSession, folder: str) -> str:
    cdm = clinical(spark, folder)
    target = f"{shared_folder(spark).rstrip('/')}/results-{folder.strip('/').replace('/', '-')}"
    study.run_study(cdm, STUDY, target)
    return target


def exported(spark: SparkSession, folder: str) -> str:
    """Folder with the exported result of the study, made once per session."""
    return _exported(spark.sparkContext.applicationId, spark, folder)


def imported(spark: SparkSession, folder: str) -> longform.SummarisedResult:
    return exchange.import_results(spark, exported(spark, folder))


def unsuppressed(spark: SparkSession, folder: str) -> longform.SummarisedResult:
    """The study's result before small counts are hidden."""
    cdm, spans = all_periods(spark, folder)
    tables = study.characterise(spans, cdm, STUDY, written(spark, folder, "outcomes"), written(spark, folder, "features"))
    return study.study_result(tables, cdm)


def placed_by(table: DataFrame, column: str) -> DataFrame:
    """A sorted table with ``position``: how many rows come before the first of its value of ``column``, plus one."""
    numbered = table.withColumn("row", F.row_number().over(Window.orderBy(F.monotonically_increasing_id())))
    first = F.min("row").over(Window.partitionBy(column))
    return numbered.withColumn("position", first.cast("long")).drop("row")


def of_type(spark, folder, kind: str) -> longform.SummarisedResult:
    return imported(spark, folder).filter_settings(F.col("result_type") == kind)


@register("study_result", f"SELECT {LONG} FROM safe_all")
def study_result(spark, folder):
    return comparable(imported(spark, folder).rows)


@register(
    "settings_rows",
    f"""SELECT result_id, mode, result_type, '{STUDY.min_cell_count}' AS min_cell_count,
               age_group AS denominator_age_group, sex AS denominator_sex FROM sets""",
)
def settings_rows(spark, folder):
    return imported(spark, folder).settings.select(
        "result_id",
        "mode",
        "result_type",
        "min_cell_count",
        "denominator_age_group",
        "denominator_sex",
    )


O.define(
    "split_in_obs",
    """SELECT * EXCLUDE (group_name, group_level, strata_name, strata_level,
                         additional_name, additional_level),
              'observation_period' AS omop_table,
              CASE strata_name WHEN 'sex' THEN strata_level
                   WHEN 'sex &&& age_group' THEN split_part(strata_level, ' &&& ', 1)
                   ELSE 'overall' END AS sex,
              CASE strata_name WHEN 'age_group' THEN strata_level
                   WHEN 'sex &&& age_group' THEN split_part(strata_level, ' &&& ', 2)
                   ELSE 'overall' END AS age_group,
              split_part(additional_level, ' &&& ', 1) AS time_interval,
              split_part(additional_level, ' &&& ', 2) AS interval
       FROM safe_in_obs""",
)
SPLIT = (
    "result_id, cdm_name, variable_name, variable_level, estimate_name, estimate_type,"
    " round(num, 4) AS num, txt, omop_table, sex, age_group, time_interval, interval"
)


@register("split_pairs", f"SELECT {SPLIT} FROM split_in_obs")
def split_pairs(spark, folder):
    result = of_type(spark, folder, "summarise_in_observation")
    return comparable(reshape.split_all(result.rows))


@register("split_unite", f"SELECT {LONG} FROM safe_in_obs")
def split_unite(spark, folder):
    result = of_type(spark, folder, "summarise_in_observation")
    pairs = {p: reshape.pair_columns(result.rows, p) for p in longform.PAIRS}
    rows = reshape.split_all(result.rows, pairs)
    order = {"strata": ["sex", "age_group"], "additional": ["time_interval", "interval"]}
    for pair, columns in {**pairs, **order}.items():
        rows = longform.unite_pair(rows, pair, columns)
    return comparable(rows)


O.define(
    "wide_in_obs",
    """SELECT s.mode, w.cdm_name, variable_name, variable_level, omop_table, w.sex,
              w.age_group, time_interval, interval,
              CAST(max(CASE WHEN estimate_name = 'count' THEN num END) AS BIGINT) AS count,
              max(CASE WHEN estimate_name = 'percentage' THEN num END) AS percentage
       FROM split_in_obs w JOIN sets s ON w.result_id = s.result_id GROUP BY ALL""",
)


@register(
    "pivot_estimates",
    """SELECT cdm_name, variable_name, variable_level, result_id, group_name, group_level,
              strata_name, strata_level, additional_name, additional_level,
              CAST(max(CASE WHEN estimate_name = 'count' THEN num END) AS BIGINT) AS count,
              round(max(CASE WHEN estimate_name = 'percentage' THEN num END), 5)
                AS percentage
       FROM safe_in_obs GROUP BY ALL""",
)
def pivot_estimates(spark, folder):
    result = of_type(spark, folder, "summarise_in_observation")
    return rounded(reshape.pivot_estimates(result.rows), "percentage", digits=5)


@register(
    "tidy_result", "SELECT * REPLACE (round(percentage, 5) AS percentage) FROM wide_in_obs"
)
def tidy_result(spark, folder):
    result = of_type(spark, folder, "summarise_in_observation")
    table = reshape.tidy(result).drop("denominator_age_group", "denominator_sex")
    return rounded(table, "percentage", digits=5)


O.define(
    "prepared_in_obs",
    """SELECT mode, cdm_name, variable_name, sex, age_group, count,
              CAST(substr(time_interval, 1, 4) AS INT) AS year,
              coalesce(list_position(['overall', 'Female', 'Male'], sex), 0) AS sex_order,
              coalesce(list_position(['overall', '0 to 19', '20 to 39', '40 to 59',
                '60 to 79', '80 or above'], age_group), 0) AS age_group_order
       FROM wide_in_obs""",
)


def _in_obs(spark, folder):
    result = of_type(spark, folder, "summarise_in_observation")
    table = prepare.prepare_in_observation(result)
    return table.drop("denominator_age_group", "denominator_sex")


@register("prepare_in_observation", "SELECT * FROM prepared_in_obs")
def prepare_in_observation(spark, folder):
    return _in_obs(spark, folder)


@register(
    "select_in_observation",
    """SELECT * FROM prepared_in_obs
       WHERE cdm_name IN ('IDRIL_1') AND sex IN ('Female', 'Male')
         AND age_group IN ('overall', '20 to 39')
         AND variable_name = 'Number person-days' AND mode IN ('min_max', 'impatient')
         AND year BETWEEN 1997 AND 2001""",
)
def select_in_observation(spark, folder):
    rows = selection.select_rows(
        _in_obs(spark, folder),
        cdm_name=["IDRIL_1"],
        sex=["Female", "Male"],
        age_group=["overall", "20 to 39"],
        variable_name=["Number person-days"],
        mode=["min_max", "impatient"],
    )
    return selection.year_range(rows, 1997, 2001)


O.define(
    "mode_labels",
    "SELECT * FROM (VALUES "
    + ", ".join(f"('{m}', '{label}')" for m, label in MODE_LABELS.items())
    + ") l(mode, label)",
)


@register(
    "relabel_modes",
    """SELECT s.result_id, s.result_type, l.label AS mode, 'IDRIL' AS cdm_name,
              count(*) AS result_rows
       FROM safe_all r JOIN sets s ON r.result_id = s.result_id
       LEFT JOIN mode_labels l ON s.mode = l.mode GROUP BY ALL""",
)
def relabel_modes(spark, folder):
    result = selection.relabel_result(
        imported(spark, folder), prepare.DATABASE_LABELS, MODE_LABELS
    )
    rows = reshape.add_settings(result.rows, result.settings, ["result_type", "mode"])
    return rows.groupBy("result_id", "result_type", "mode", "cdm_name").agg(
        F.count("*").alias("result_rows")
    )


O.define(
    "prepared_incidence",
    """SELECT cdm_name, split_part(group_level, ' &&& ', 2) AS outcome,
              CASE s.age_group WHEN '80 to 150' THEN '80 or above'
                   WHEN '0 to 150' THEN 'overall' ELSE s.age_group END AS age_group,
              CASE s.sex WHEN 'Both' THEN 'overall' ELSE s.sex END AS sex,
              CASE WHEN additional_level LIKE '%years' THEN 'years'
                   ELSE 'overall' END AS analysis_interval,
              CASE WHEN additional_level LIKE '%years'
                   THEN CAST(substr(additional_level, 1, 4) AS INT) END AS year,
              s.mode, estimate_name, estimate_type, num
       FROM safe_incidence r JOIN sets s ON r.result_id = s.result_id
       WHERE estimate_name NOT IN ('person_days', 'person_years')""",
)


def _prepared_incidence(spark, folder):
    return prepare.prepare_incidence(of_type(spark, folder, "incidence"))


@register(
    "relabel_incidence",
    "SELECT * REPLACE (round(num, 4) AS num) FROM prepared_incidence",
)
def relabel_incidence(spark, folder):
    return comparable(_prepared_incidence(spark, folder)).drop("txt")


RATE = "incidence_100000_pys"
O.define(
    "wide_incidence",
    f"""SELECT cdm_name, outcome, age_group, sex, analysis_interval, year, mode,
               max(CASE WHEN estimate_name = '{RATE}' THEN num END) AS rate,
               max(CASE WHEN estimate_name = '{RATE}_95CI_lower' THEN num END) AS lower,
               max(CASE WHEN estimate_name = '{RATE}_95CI_upper' THEN num END) AS upper
        FROM prepared_incidence WHERE estimate_name LIKE '%incidence%' GROUP BY ALL""",
)


def _named_rates(table: DataFrame) -> DataFrame:
    names = {RATE: "rate", f"{RATE}_95CI_lower": "lower", f"{RATE}_95CI_upper": "upper"}
    return rounded(table.withColumnsRenamed(names), "rate", "lower", "upper", digits=4)


@register(
    "incidence_series",
    f"""SELECT * EXCLUDE (rate, lower, upper, year, analysis_interval),
               {round_sql("rate", "lower", "upper", digits=4)}, 'overall' AS year
        FROM wide_incidence WHERE analysis_interval = 'overall'""",
)
def incidence_series(spark, folder):
    rows = selection.select_rows(
        _prepared_incidence(spark, folder), analysis_interval=["overall"]
    )
    return _named_rates(prepare.incidence_series(rows, "overall")).drop(
        "analysis_interval"
    )


@register(
    "paper_incidence",
    f"""SELECT cdm_name, outcome, age_group, sex, analysis_interval, year,
               mode AS definition, {round_sql("rate", "lower", "upper", digits=4)}
        FROM wide_incidence
        WHERE outcome = 'brand#2' AND year = 1999 AND sex = 'overall'
          AND age_group = 'overall' AND cdm_name <> 'CPRD AURUM 50'""",
)
def paper_incidence(spark, folder):
    rows = _prepared_incidence(spark, folder)
    table = prepare.paper_incidence(rows, outcome="brand#2", year=1999)
    return _named_rates(
        table.withColumnsRenamed(
            {
                "Observation period definition": "definition",
                "Incidence per 100,000 py": RATE,
            }
        )
    )


O.define(
    "figure_rows",
    """SELECT mode, cdm_name, variable_name, sex, age_group, sex_order, age_group_order,
              count, year FROM prepared_in_obs
       WHERE variable_name = 'Number person-days' AND age_group = 'overall'
         AND sex = 'overall' AND year >= 1997
         AND NOT regexp_matches(mode, '180|545')""",
)


@register(
    "paper_person_years",
    """SELECT *, round(count / 365.0, 6) AS person_years, mode AS definition FROM (
         SELECT * FROM figure_rows UNION ALL
         SELECT * REPLACE (0 AS count, 'Inpatient hospitalisation' AS mode)
         FROM figure_rows WHERE cdm_name = 'IDRIL_1' AND mode = 'original_data')""",
)
def paper_person_years(spark, folder):
    table = prepare.paper_person_years(
        _in_obs(spark, folder),
        first_year=1997,
        patch=("IDRIL_1", "original_data", "Inpatient hospitalisation"),
    )
    named = table.withColumnsRenamed(
        {"person-years": "person_years", "OP definition": "definition"}
    )
    return rounded(named, "person_years")


# Formatted tables ----------------------------------------------------------


def shown_sql(integer: int, numeric: int, percentage: int) -> str:
    """Estimate values as text with thousands marks."""

    def text(places):
        return f"format('{{:,.{places}f}}', num)"

    return f"""CASE estimate_type WHEN 'integer' THEN {text(integer)}
        WHEN 'numeric' THEN {text(numeric)} WHEN 'percentage' THEN {text(percentage)}
        ELSE txt END"""


O.define(
    "cells",
    f"""SELECT r.result_id, cdm_name, s.mode, variable_name, variable_level,
               {", ".join(
                   f"max(CASE WHEN estimate_name = '{e}' THEN {shown_sql(0, 2, 2)} END)"
                   f" AS {e}"
                   for e in ("count", "percentage", "median", "q25", "q75", "min", "max")
               )}
        FROM safe_tables r JOIN sets s ON r.result_id = s.result_id GROUP BY ALL""",
)
CELL = "result_id, cdm_name, mode, variable_name, variable_level"
O.define(
    "shown_cells",
    f"""SELECT {CELL}, 'N (%)' AS estimate_name,
               count || ' (' || percentage || '%)' AS estimate_value
        FROM cells WHERE percentage IS NOT NULL
        UNION ALL
        SELECT {CELL}, 'N', count FROM cells WHERE percentage IS NULL AND count IS NOT NULL
        UNION ALL
        SELECT {CELL}, 'median [Q25 - Q75]', median || ' [' || q25 || ' - ' || q75 || ']'
        FROM cells WHERE median IS NOT NULL
        UNION ALL
        SELECT {CELL}, 'Range', min || ' to ' || max FROM cells WHERE min IS NOT NULL""",
)


@register(
    "format_estimates",
    f"""SELECT {CELL}, estimate_name, estimate_value FROM shown_cells
        UNION ALL
        SELECT r.result_id, cdm_name, s.mode, variable_name, variable_level,
               estimate_name, {shown_sql(0, 2, 2)}
        FROM safe_tables r JOIN sets s ON r.result_id = s.result_id
        WHERE num IS NULL OR estimate_name IN ('mean', 'sd')""",
)
def format_estimates(spark, folder):
    result = of_type(spark, folder, "summarise_table")
    rows = reshape.format_values(result.rows, prepare.PANEL_DECIMALS)
    rows = reshape.format_names(rows, prepare.PANEL_TEMPLATES)
    rows = reshape.add_settings(rows, result.settings, ["mode"])
    return rows.select(
        "result_id",
        "cdm_name",
        "mode",
        "variable_name",
        "variable_level",
        "estimate_name",
        "estimate_value",
    )


def spread_sql(source: str, keys: str) -> str:
    """One column per mode, named like the header of database and mode."""
    columns = ", ".join(
        f"""max(CASE WHEN mode = '{m}' THEN estimate_value END)
            AS "{STUDY.cdm_name} / {m}" """
        for m in sorted(MODE_LABELS)
    )
    return f"SELECT {keys}, {columns} FROM {source} GROUP BY ALL"


O.define(
    "panel_cells",
    """SELECT cdm_name, mode, variable_name, variable_level, estimate_name,
              estimate_value FROM shown_cells
       UNION ALL
       SELECT cdm_name, s.mode, variable_name, variable_level, estimate_name, NULL
       FROM safe_tables r JOIN sets s ON r.result_id = s.result_id
       WHERE num IS NULL AND estimate_name NOT IN ('mean', 'sd')""",
)


@register(
    "format_header",
    spread_sql("panel_cells", "variable_name, variable_level, estimate_name"),
)
def format_header(spark, folder):
    return prepare.period_table(of_type(spark, folder, "summarise_table"))


O.define(
    "incidence_cells",
    f"""SELECT cdm_name, outcome, age_group, sex, mode,
               max(CASE WHEN estimate_name = 'outcome_count'
                   THEN {shown_sql(0, 2, 2)} END) AS n,
               max(CASE WHEN estimate_name = 'denominator_count'
                   THEN {shown_sql(0, 2, 2)} END) AS d,
               max(CASE WHEN estimate_name = '{RATE}' THEN {shown_sql(0, 2, 2)} END) AS r,
               max(CASE WHEN estimate_name = '{RATE}_95CI_lower'
                   THEN {shown_sql(0, 2, 2)} END) AS lo,
               max(CASE WHEN estimate_name = '{RATE}_95CI_upper'
                   THEN {shown_sql(0, 2, 2)} END) AS hi
        FROM (SELECT *, NULL AS txt FROM prepared_incidence
              WHERE analysis_interval = 'overall') GROUP BY ALL""",
)
O.define(
    "incidence_shown",
    """SELECT cdm_name, outcome, age_group, sex, mode, 'Outcomes' AS variable_estimate,
              n AS estimate_value FROM incidence_cells WHERE n IS NOT NULL
       UNION ALL SELECT cdm_name, outcome, age_group, sex, mode, 'Denominator', d
       FROM incidence_cells WHERE d IS NOT NULL
       UNION ALL SELECT cdm_name, outcome, age_group, sex, mode, 'Incidence',
              r || ' [' || lo || ' - ' || hi || ']'
       FROM incidence_cells WHERE r IS NOT NULL""",
)


@register(
    "incidence_table",
    spread_sql("incidence_shown", "outcome, age_group, sex, variable_estimate"),
)
def incidence_table(spark, folder):
    rows = selection.select_rows(
        _prepared_incidence(spark, folder), analysis_interval=["overall"]
    )
    table = prepare.incidence_table(rows, "overall")
    labels = list(prepare.INCIDENCE_TEMPLATES)
    kept = selection.select_rows(table, estimate_name=labels)
    return kept.withColumnRenamed("estimate_name", "variable_estimate")


O.define(
    "incidence_year_cells",
    f"""SELECT cdm_name, outcome, age_group, sex, year, mode,
               max(CASE WHEN estimate_name = 'outcome_count'
                   THEN {shown_sql(0, 2, 2)} END) AS n,
               max(CASE WHEN estimate_name = 'denominator_count'
                   THEN {shown_sql(0, 2, 2)} END) AS d,
               max(CASE WHEN estimate_name = '{RATE}' THEN {shown_sql(0, 2, 2)} END) AS r,
               max(CASE WHEN estimate_name = '{RATE}_95CI_lower'
                   THEN {shown_sql(0, 2, 2)} END) AS lo,
               max(CASE WHEN estimate_name = '{RATE}_95CI_upper'
                   THEN {shown_sql(0, 2, 2)} END) AS hi
        FROM (SELECT *, NULL AS txt FROM prepared_incidence
              WHERE analysis_interval = 'years') GROUP BY ALL""",
)
O.define(
    "incidence_year_shown",
    """SELECT cdm_name, outcome, age_group, sex, year, mode, 'Outcomes' AS variable_estimate,
              n AS estimate_value FROM incidence_year_cells WHERE n IS NOT NULL
       UNION ALL SELECT cdm_name, outcome, age_group, sex, year, mode, 'Denominator', d
       FROM incidence_year_cells WHERE d IS NOT NULL
       UNION ALL SELECT cdm_name, outcome, age_group, sex, year, mode, 'Incidence',
              r || ' [' || lo || ' - ' || hi || ']'
       FROM incidence_year_cells WHERE r IS NOT NULL""",
)


@register(
    "incidence_table_yearly",
    spread_sql(
        "incidence_year_shown", "outcome, age_group, sex, year, variable_estimate"
    ),
)
def incidence_table_yearly(spark, folder):
    rows = selection.select_rows(
        _prepared_incidence(spark, folder), analysis_interval=["years"]
    )
    table = prepare.incidence_table(rows, "years")
    labels = list(prepare.INCIDENCE_TEMPLATES)
    kept = selection.select_rows(table, estimate_name=labels)
    return kept.withColumnRenamed("estimate_name", "variable_estimate")


def left_over_sql(cells: str, templates: dict[str, tuple[str, ...]]) -> str:
    """Whether an estimate stands alone: those of a template that misses one of them."""
    alone = [
        f"(estimate_name IN {tuple(names) if len(names) > 1 else f"('{names[0]}')"} AND"
        f" ({' OR '.join(f'{cells}.{n} IS NULL' for n in names)}))"
        for names in templates.values()
    ]
    return f"({' OR '.join(alone)})"


PAPER = "'number records', 'number subjects', 'duration', 'time_to_next_observation', 'op_per_person'"
SHOWN = ("count", "median", "q25", "q75", "min", "max")
O.define(
    "paper_cells",
    f"""SELECT cdm_name, s.mode, variable_name,
               {", ".join(
                   f"max(CASE WHEN estimate_name = '{e}' THEN {shown_sql(0, 0, 1)} END)"
                   f" AS {e}" for e in SHOWN
               )}
        FROM safe_tables r JOIN sets s ON r.result_id = s.result_id
        WHERE variable_name IN ({PAPER}) AND NOT regexp_matches(s.mode, '180|545')
        GROUP BY ALL""",
)
O.define(
    "paper_shown",
    f"""SELECT variable_name, cdm_name, mode, 'N' AS estimate_name, count AS estimate_value
        FROM paper_cells WHERE count IS NOT NULL
        UNION ALL SELECT variable_name, cdm_name, mode, 'median [Q25 - Q75]',
            median || ' [' || q25 || ' - ' || q75 || ']'
        FROM paper_cells WHERE median IS NOT NULL AND q25 IS NOT NULL AND q75 IS NOT NULL
        UNION ALL SELECT c.variable_name, c.cdm_name, c.mode, estimate_name, {shown_sql(0, 0, 1)}
        FROM safe_tables r JOIN sets s ON r.result_id = s.result_id
        JOIN paper_cells c ON (c.variable_name, c.cdm_name, c.mode) = (r.variable_name, r.cdm_name, s.mode)
        WHERE {left_over_sql("c", {"n": ("count",), "m": ("median", "q25", "q75"), "r": ("min", "max")})}""",
)


@register(
    "paper_table",
    f"""SELECT CASE variable_name WHEN 'number records' THEN 'Number records'
                   WHEN 'number subjects' THEN 'Number subjects'
                   WHEN 'duration' THEN 'OP length'
                   WHEN 'time_to_next_observation' THEN 'Time between OP'
                   ELSE 'OP per person' END AS variable_name,
              cdm_name, mode, estimate_name, estimate_value,
              rank() OVER (ORDER BY list_position([{PAPER}], variable_name)) AS position
       FROM paper_shown""",
)
def paper_table(spark, folder):
    table = prepare.paper_table(of_type(spark, folder, "summarise_table"))
    return placed_by(table, "variable_name").select(
        "variable_name", "cdm_name", "mode", "estimate_name", "estimate_value", "position"
    )


@register(
    "paper_table_by_database",
    f"""SELECT mode, variable_name, estimate_name,
               max(estimate_value) AS "{STUDY.cdm_name}"
        FROM ({SQL["paper_table"]}) GROUP BY ALL""",
)
def paper_table_by_database(spark, folder):
    part = of_type(spark, folder, "summarise_table")
    table = prepare.paper_table_by_database(part)
    return table.select("mode", "variable_name", "estimate_name", STUDY.cdm_name)


O.define(
    "simple_cells",
    f"""SELECT cdm_name, s.mode, variable_name, variable_level,
               {", ".join(
                   f"max(CASE WHEN estimate_name = '{e}' THEN {shown_sql(0, 1, 0)} END)"
                   f" AS {e}"
                   for e in ("count", "percentage", "median", "q25", "q75", "min",
                             "max", "mean", "sd")
               )}
        FROM safe_tables r JOIN sets s ON r.result_id = s.result_id GROUP BY ALL""",
)
SIMPLE = "cdm_name, mode, variable_name, variable_level"
O.define(
    "simple_shown",
    f"""SELECT {SIMPLE}, 'N (%)' AS estimate_name,
               count || ' (' || percentage || '%)' AS estimate_value
        FROM simple_cells WHERE percentage IS NOT NULL
        UNION ALL SELECT {SIMPLE}, 'N', count FROM simple_cells
        WHERE percentage IS NULL AND count IS NOT NULL
        UNION ALL SELECT {SIMPLE}, 'median [Q25 - Q75]',
               median || ' [' || q25 || ' - ' || q75 || ']'
        FROM simple_cells WHERE median IS NOT NULL
        UNION ALL SELECT {SIMPLE}, 'mean (SD)', mean || ' (' || sd || ')'
        FROM simple_cells WHERE mean IS NOT NULL AND sd IS NOT NULL
        UNION ALL SELECT {SIMPLE}, 'range', '[' || min || ' ' || max || ']'
        FROM simple_cells WHERE min IS NOT NULL
        UNION ALL SELECT c.cdm_name, c.mode, c.variable_name, c.variable_level, estimate_name, {shown_sql(0, 1, 0)}
        FROM safe_tables r JOIN sets s ON r.result_id = s.result_id
        JOIN simple_cells c ON c.cdm_name = r.cdm_name AND c.mode = s.mode AND c.variable_name = r.variable_name
            AND c.variable_level IS NOT DISTINCT FROM r.variable_level
        WHERE {left_over_sql("c", {"n": ("count",), "m": ("median", "q25", "q75"), "s": ("mean", "sd"), "r": ("min", "max")})}
            OR estimate_name = 'percentage' AND c.percentage IS NULL""",
)


@register(
    "simple_table",
    f"""SELECT "variable_name; variable_level", estimate_name, {", ".join(
        f'max(CASE WHEN mode = {chr(39)}{m}{chr(39)} THEN estimate_value END)'
        f' AS "{m}"' for m in sorted(MODE_LABELS))}
        FROM (SELECT *, concat_ws('; ', variable_name, variable_level)
                AS "variable_name; variable_level" FROM simple_shown) GROUP BY ALL""",
)
def simple_table(spark, folder):
    return prepare.simple_table(
        of_type(spark, folder, "summarise_table"),
        header=["mode"],
        group=["variable_name", "variable_level"],
        hide=[
            "cdm_name",
            "result_type",
            "package_name",
            "package_version",
            "min_cell_count",
            "denominator_age_group",
            "denominator_sex",
        ],
    )


# Selections and overview ---------------------------------------------------


@register(
    "filter_result",
    f"""SELECT {LONG.replace("result_id,", "r.result_id,")} FROM safe_all r
        JOIN sets s ON r.result_id = s.result_id
        WHERE s.mode IN ('min_max', 'impatient')
          AND (strata_level LIKE 'Female%' OR strata_level LIKE 'Male%')
          AND result_type = 'summarise_in_observation'
          AND variable_name = 'Number person-days' AND estimate_name = 'count'""",
)
def filter_result(spark, folder):
    result = selection.filter_result(
        imported(spark, folder),
        settings={"mode": ["min_max", "impatient"], "unknown": ["ignored"]},
        grouping={"sex": ["Female", "Male"], "unknown": ["ignored"]},
        variable_name=["Number person-days"],
        estimate_name=["count"],
    )
    return comparable(result.rows)


@register("default_outcome", "SELECT min(outcome) AS outcome FROM prepared_incidence")
def default_outcome(spark, folder):
    return selection.first_value(_prepared_incidence(spark, folder), "outcome")


@register(
    "per_thousand",
    """SELECT s.mode, variable_name, estimate_name,
              round(CASE WHEN variable_name LIKE '%per_day' THEN num * 1000
                         ELSE num END, 4) AS num
       FROM safe_tables r JOIN sets s ON r.result_id = s.result_id
       WHERE estimate_type = 'numeric' AND num IS NOT NULL""",
)
def per_thousand(spark, folder):
    result = of_type(spark, folder, "summarise_table")
    rows = prepare.per_thousand(result.rows.filter("estimate_type = 'numeric'"))
    rows = comparable(reshape.add_settings(rows, result.settings, ["mode"]))
    kept = rows.filter(F.col("num").isNotNull())
    return kept.select("mode", "variable_name", "estimate_name", "num")


@register(
    "subset_panels",
    f"""SELECT CASE WHEN result_id <= 14 THEN 'first' ELSE 'last' END AS panel, {LONG}
        FROM safe_all WHERE result_id <= 14 OR result_id >= 262""",
)
def subset_panels(spark, folder):
    parts = selection.subset(
        imported(spark, folder), {"first": range(1, 15), "last": range(262, 275)}
    )
    return records.stack(
        [
            comparable(part.rows).withColumn("panel", F.lit(name))
            for name, part in parts.items()
        ]
    )


CHOSEN = ("original_data", "min_max")


@register(
    "select_characteristics",
    f"""SELECT {LONG} FROM safe_tables WHERE variable_name IN ('duration', 'age_start')
          AND cdm_name = '{STUDY.cdm_name}' AND result_id IN (
            SELECT result_id FROM sets WHERE mode IN {CHOSEN})""",
)
def select_characteristics(spark, folder):
    part = of_type(spark, folder, "summarise_table")
    chosen = selection.filter_result(
        part,
        settings={"mode": CHOSEN},
        grouping={"cdm_name": [STUDY.cdm_name]},
        variable_name=["duration", "age_start"],
    )
    # A selection without rows has no settings either, and adds none here.
    nothing = selection.filter_result(part, variable_name=["no such variable"])
    ids = chosen.settings.select("result_id").unionByName(
        nothing.settings.select("result_id")
    )
    return comparable(chosen.rows.join(ids, "result_id"))


@register(
    "select_incidence",
    f"""SELECT * REPLACE (round(num, 4) AS num) FROM prepared_incidence
        WHERE cdm_name = '{STUDY.cdm_name}' AND outcome = '{STUDY.ingredients[0]}'
          AND age_group IN ('overall', '20 to 39') AND sex = 'Female'
          AND analysis_interval = 'years' AND mode IN {CHOSEN}""",
)
def select_incidence(spark, folder):
    rows = selection.select_rows(
        _prepared_incidence(spark, folder),
        cdm_name=[STUDY.cdm_name],
        outcome=[STUDY.ingredients[0]],
        age_group=["overall", "20 to 39"],
        sex=["Female"],
        analysis_interval=["years"],
        mode=CHOSEN,
    )
    return comparable(rows).drop("txt")


@register(
    "filter_options",
    """SELECT DISTINCT 'in_obs_settings_mode' AS option, s.mode AS value FROM sets s
         WHERE result_type = 'summarise_in_observation'
       UNION ALL SELECT DISTINCT 'in_obs_grouping_cdm_name', cdm_name FROM split_in_obs
       UNION ALL SELECT DISTINCT 'in_obs_grouping_omop_table', omop_table
         FROM split_in_obs
       UNION ALL SELECT DISTINCT 'in_obs_grouping_sex', sex FROM split_in_obs
       UNION ALL SELECT DISTINCT 'in_obs_grouping_age_group', age_group FROM split_in_obs
       UNION ALL SELECT DISTINCT 'in_obs_grouping_time_interval', time_interval
         FROM split_in_obs
       UNION ALL SELECT DISTINCT 'in_obs_grouping_interval', interval FROM split_in_obs
       UNION ALL SELECT DISTINCT 'in_obs_variable_name', variable_name FROM split_in_obs
       UNION ALL SELECT DISTINCT 'in_obs_estimate_name', estimate_name FROM split_in_obs
       UNION ALL SELECT 'in_obs_tidy_columns', unnest(['mode', 'cdm_name', 'omop_table',
         'sex', 'age_group', 'time_interval', 'interval', 'variable_name',
         'estimate_name'])""",
)
def filter_options(spark, folder):
    options = selection.filter_options(
        imported(spark, folder), {"in_obs": range(2, 15)}
    )
    pairs = [(name, value) for name, values in options.items() for value in values]
    return spark.createDataFrame(pairs, "option string, value string")


@register(
    "package_versions",
    """SELECT 'spanwise' AS package_name, '0.1.0' AS package_version,
              count(*) AS result_ids, CAST(1 AS BIGINT) AS versions,
              'Consistent package versions' AS "group",
              'spanwise 0.1.0 in ' || count(*) || ' result id(s).' AS message
       FROM sets""",
)
def package_versions(spark, folder):
    return overview.package_versions(imported(spark, folder).settings)


@register(
    "suppression_tally",
    f"""SELECT '{STUDY.min_cell_count}' AS min_cell_count, count(*) AS n,
               count(*) || ' results suppressed at minCellCount = {STUDY.min_cell_count}.'
                 AS message FROM sets""",
)
def suppression_tally(spark, folder):
    return overview.suppression_tally(imported(spark, folder).settings)


@register(
    "overview",
    """SELECT count(*) AS result_rows, (SELECT count(*) FROM sets) AS result_ids,
              CAST(4 AS BIGINT) AS panels,
              (SELECT count(DISTINCT result_type) FROM sets) AS result_types,
              count(DISTINCT cdm_name) AS databases, min(cdm_name) AS cdm_names
       FROM safe_all""",
)
def result_overview(spark, folder):
    return overview.overview(imported(spark, folder), panels=len(prepare.PANELS))


@register(
    "overview_text",
    """SELECT CAST(unnest([0, 1, 2]) AS INT) AS line, unnest([
         format('Results contain {:,} rows with {:,} different result_id.', count(*),
                (SELECT count(*) FROM sets)),
         'Results contain 4 panels with 4 different result_type.',
         'Results contain data from ' || count(DISTINCT cdm_name)
           || ' different cdm objects: ' || min(cdm_name) || '.']) AS message
       FROM safe_all""",
)
def overview_text(spark, folder):
    return overview.overview_text(imported(spark, folder), panels=len(prepare.PANELS))


def labelled(mode: str) -> str:
    cases = " ".join(f"WHEN '{m}' THEN '{label}'" for m, label in MODE_LABELS.items())
    return f"CASE {mode} {cases} END"


LONG_KEY = (
    "r.result_id, cdm_name, group_name, group_level, strata_name, strata_level, variable_name,"
    " variable_level, estimate_name, additional_name, additional_level"
)
LISTED = {
    "cdm_names": [STUDY.cdm_name],
    "sexes": ["overall", "Female", "Male"],
    "age_groups": ["overall", "0 to 19", "20 to 39", "40 to 59", "60 to 79", "80 or above"],
    "modes": sorted(MODE_LABELS.values()),
}
BUNDLE = {
    "snapshot": ("cdm_name", "variable_name", "estimate_name"),
    "in_obs": ("cdm_name", "mode", "variable_name", "sex", "age_group", "year", "sex_order", "age_group_order"),
    "obs_period": tuple(LONG_KEY.replace("r.", "").replace(" ", "").split(",")),
    "obs_period_settings": ("result_id", "result_type", "mode", "min_cell_count"),
    "incidence": ("cdm_name", "outcome", "age_group", "sex", "analysis_interval", "year", "mode", "estimate_name"),
    "cdm_names": ("position", "cdm_name"),
    "sexes": ("position", "sex"),
    "age_groups": ("position", "age_group"),
    "modes": ("position", "mode"),
}


@register(
    "prepared_bundle",
    f"""SELECT 'snapshot' AS panel, concat_ws(' | ', cdm_name, variable_name, estimate_name) AS key,
               round(num, 4) AS num, txt FROM long_snapshot r
        UNION ALL SELECT 'in_obs', concat_ws(' | ', cdm_name, {labelled("mode")}, variable_name, sex, age_group, year,
               sex_order, age_group_order), count, NULL FROM prepared_in_obs
        UNION ALL SELECT 'obs_period', concat_ws(' | ', {LONG_KEY}), round(num, 4), txt FROM safe_tables r
        UNION ALL SELECT 'obs_period_settings', concat_ws(' | ', result_id, result_type, {labelled("mode")},
               '{STUDY.min_cell_count}'), NULL, NULL FROM sets WHERE result_type = 'summarise_table'
        UNION ALL SELECT 'incidence', concat_ws(' | ', cdm_name, outcome, age_group, sex, analysis_interval, year,
               {labelled("mode")}, estimate_name), round(num, 4), NULL FROM prepared_incidence
        UNION ALL {" UNION ALL ".join(f"SELECT '{name}', '{i} | {value}', NULL, NULL"
            for name, values in LISTED.items() for i, value in enumerate(values, 1))}""",
)
def prepared_bundle(spark, folder):
    """Every row of the nine tables, saved for this export and loaded again."""
    source = exported(spark, folder)
    version = exchange.results_version(spark, source)
    load = lambda: exchange.load_bundle(
        spark, f"{source}-bundle/{version}", BUNDLE, lambda: prepare.prepare_report(spark, source)
    )
    load()
    shown = []
    for name, table in load().items():
        key = F.concat_ws(" | ", *[F.col(c).cast("string") for c in BUNDLE[name]]).alias("key")
        none = F.lit(None)
        if "estimate_value" in table.columns:
            table = comparable(table)
            num, txt = F.col("num"), (none if name == "incidence" else F.col("txt"))
        else:
            num, txt = (F.col("count") if name == "in_obs" else none), none
        shown.append(
            table.select(
                F.lit(name).alias("panel"), key, num.cast("double").alias("num"), txt.cast("string").alias("txt")
            )
        )
    return records.stack(shown)


# Bindings and empty results ------------------------------------------------


@register("catalog_binding", "SELECT * FROM person_span")
def catalog_binding(spark, folder):
    """The extremes of the records, from tables of a catalog under a prefix."""
    prefix = "spanwise_check_"
    for name, table in clinical(spark, folder).tables.items():
        table.createOrReplaceGlobalTempView(f"{prefix}{name}")
    fields = clinical(spark, folder).date_fields
    cdm = Cdm.from_catalog(spark, "global_temp", prefix, name=STUDY.cdm_name, date_fields=fields)
    return records.first_last(records.records(cdm))


@register("study_without_periods", f"SELECT {LONG} FROM long_snapshot")
def study_without_periods(spark, folder):
    """The whole study where no definition has a period: the snapshot alone is left."""
    cdm, spans = all_periods(spark, folder)
    nobody = spans.filter("person_id IS NULL")
    tables = study.characterise(nobody, cdm, STUDY, written(spark, folder, "outcomes"))
    result = study.study_result(tables, cdm, study.present(nobody))
    return comparable(longform.suppress(longform.bind(longform.empty_result(spark), result)).rows)


@register("empty_selection", f"SELECT {LONG} FROM safe_all WHERE FALSE")
def empty_selection(spark, folder):
    """A selection that nothing meets gives an empty result, and so do the tables made of it."""
    result = selection.filter_result(
        imported(spark, folder), settings={"mode": ["unheard of"]}, variable_name=["duration"]
    )
    return comparable(longform.bind(result, longform.bind()).rows)
