"""Preparation of imported results for the report panels and figures."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwise.config import (
    AGE_GROUP_LEVELS,
    DATABASE_LABELS,
    MODE_LABELS,
    SEX_LEVELS,
)
from spanwise.report.selection import drop_rows, relabel, relabel_result, select_rows
from spanwise.results.exchange import import_results
from spanwise.results.longform import SummarisedResult
from spanwise.results.reshape import (
    add_settings,
    distinct_values,
    format_header,
    format_names,
    format_values,
    merge_columns,
    pivot_estimates,
    split_all,
    tidy,
)

# Result type of each panel.
PANELS = {
    "snapshot": "summarise_omop_snapshot",
    "in_obs": "summarise_in_observation",
    "obs_period": "summarise_table",
    "incidence": "incidence",
}

# How estimates are shown.
PANEL_TEMPLATES = {
    "N (%)": "<count> (<percentage>%)",
    "N": "<count>",
    "median [Q25 - Q75]": "<median> [<q25> - <q75>]",
    "Range": "<min> to <max>",
}
SIMPLE_TEMPLATES = {
    "N (%)": "<count> (<percentage>%)",
    "N": "<count>",
    "median [Q25 - Q75]": "<median> [<q25> - <q75>]",
    "mean (SD)": "<mean> (<sd>)",
    "[Q25 - Q75]": "[<q25> - <q75>]",
    "range": "[<min> <max>]",
    "[Q05 - Q95]": "[<q05> - <q95>]",
}
INCIDENCE_TEMPLATES = {
    "Outcomes": "<outcome_count>",
    "Denominator": "<denominator_count>",
    "Incidence": (
        "<incidence_100000_pys> [<incidence_100000_pys_95CI_lower>"
        " - <incidence_100000_pys_95CI_upper>]"
    ),
}
PANEL_DECIMALS = {"integer": 0, "numeric": 2, "percentage": 2}
SIMPLE_DECIMALS = {"integer": 0, "numeric": 1, "percentage": 0}
PAPER_DECIMALS = {"integer": 0, "numeric": 0, "percentage": 1}

# Variables of the paper's table, in display order.
PAPER_VARIABLES = {
    "number records": "Number records",
    "number subjects": "Number subjects",
    "duration": "OP length",
    "time_to_next_observation": "Time between OP",
    "op_per_person": "OP per person",
}

# Levels of incidence strata and what the report calls them.
STRATA_LABELS = {"80 to 150": "80 or above", "0 to 150": "overall", "Both": "overall"}

# Definitions left out of the paper's table and figures.
PAPER_LEFT_OUT = "180|545"


def display_order(column: str, levels: Sequence[str]) -> Column:
    """Position of a label among its levels, for sorting."""
    return F.array_position(F.array(*[F.lit(v) for v in levels]), F.col(column))


def label_year(column: str) -> Column:
    """The year a date label begins with; NULL where it does not."""
    return F.substring(column, 1, 4).try_cast("int")


def prepare_in_observation(result: SummarisedResult) -> DataFrame:
    """Tidy person-time: one row per database, mode, year and stratum."""
    wide = tidy(
        result,
        {
            "group": ["omop_table"],
            "strata": ["sex", "age_group"],
            "additional": ["time_interval", "interval"],
        },
        {"count": "integer", "percentage": "percentage"},
    )
    return wide.withColumns(
        {
            "year": label_year("time_interval"),
            "sex_order": display_order("sex", SEX_LEVELS),
            "age_group_order": display_order("age_group", AGE_GROUP_LEVELS),
        }
    ).drop("variable_level", "time_interval", "omop_table", "interval", "percentage")


def prepare_incidence(result: SummarisedResult) -> DataFrame:
    """Incidence estimates by outcome, stratum, interval, year and mode."""
    rows = split_all(
        result.rows,
        {
            "group": ["outcome_cohort_name"],
            "additional": ["incidence_start_date", "analysis_interval"],
        },
    )
    own = ["mode", "denominator_age_group", "denominator_sex"]
    rows = add_settings(rows, result.settings, own)
    yearly = F.when(
        F.col("analysis_interval") == "years", label_year("incidence_start_date")
    )
    rows = rows.select(
        "cdm_name",
        F.col("outcome_cohort_name").alias("outcome"),
        F.col("denominator_age_group").alias("age_group"),
        F.col("denominator_sex").alias("sex"),
        "analysis_interval",
        yearly.alias("year"),
        "mode",
        "estimate_name",
        "estimate_type",
        "estimate_value",
    )
    for column in ("age_group", "sex"):
        rows = relabel(rows, column, STRATA_LABELS, keep_unmapped=True)
    return drop_rows(rows, estimate_name=["person_days", "person_years"])


def per_thousand(rows: DataFrame, pattern: str = "_per_day") -> DataFrame:
    """Estimates of variables that match ``pattern``, times a thousand."""
    number = F.col("estimate_value").try_cast("double") * 1000
    scaled = F.when(F.col("variable_name").contains(pattern), number.cast("string"))
    return rows.withColumn(
        "estimate_value", F.coalesce(scaled, F.col("estimate_value"))
    )


def paper_table(
    result: SummarisedResult,
    variables: Mapping[str, str] = PAPER_VARIABLES,
    left_out: str = PAPER_LEFT_OUT,
) -> DataFrame:
    """The paper's characteristics: one formatted row per variable and mode."""
    rows = format_values(per_thousand(result.rows), PAPER_DECIMALS)
    rows = format_names(rows, PANEL_TEMPLATES)
    rows = add_settings(split_all(rows), result.settings, ["mode"])
    female = (F.col("variable_name") == "sex") & (F.col("variable_level") == "Female")
    rows = rows.withColumn(
        "variable_name",
        F.when(female, F.col("variable_level")).otherwise(F.col("variable_name")),
    )
    rows = drop_rows(
        rows, estimate_name=["mean", "sd", "density_x", "density_y", "Range"]
    ).drop("result_id", "variable_level")
    order = display_order("variable_name", list(variables))
    rows = relabel(rows.withColumn("order_id", order), "variable_name", variables)
    kept = rows.filter(~F.coalesce(F.col("mode").rlike(left_out), F.lit(False)))
    others = [c for c in kept.columns if c not in ("variable_name", "order_id")]
    return kept.orderBy("order_id").select("variable_name", *others)


def paper_table_by_database(
    result: SummarisedResult,
    variables: Mapping[str, str] = PAPER_VARIABLES,
    left_out: str = PAPER_LEFT_OUT,
) -> DataFrame:
    """The paper's characteristics with a column per database, definitions as groups."""
    rows = paper_table(result, variables, left_out)
    shown = rows.select(
        "mode", "variable_name", "estimate_name", "cdm_name", "estimate_value"
    )
    return format_header(shown, ["cdm_name"])


def paper_person_years(
    in_obs: DataFrame,
    first_year: int = 2012,
    left_out: str = PAPER_LEFT_OUT,
    days_per_year: float = 365,
    patch: tuple[str, str, str] | None = None,
) -> DataFrame:
    """Person-years per year and definition, the series of the paper's figure.

    ``patch`` is ``(database, mode, new mode)``: the rows of that database and
    mode are repeated with a count of zero under the new mode, to draw a line
    for a definition that the database cannot have. Rows come sorted by definition.
    """
    rows = in_obs.filter(
        (F.col("variable_name") == "Number person-days")
        & (F.col("age_group") == "overall")
        & (F.col("sex") == "overall")
        & (F.col("year") >= first_year)
        & ~F.col("mode").rlike(left_out)
    )
    if patch is not None:
        database, mode, new_mode = patch
        copies = select_rows(rows, cdm_name=[database], mode=[mode]).withColumns(
            {"count": F.lit(0).cast("long"), "mode": F.lit(new_mode)}
        )
        rows = rows.unionByName(copies)
    return rows.withColumns(
        {
            "person-years": F.col("count") / days_per_year,
            "OP definition": F.col("mode"),
        }
    ).orderBy("OP definition")


def incidence_estimates(rows: DataFrame) -> DataFrame:
    """The rate and its limits, pivoted to columns."""
    rate = "incidence_100000_pys"
    names = {n: "numeric" for n in (rate, f"{rate}_95CI_lower", f"{rate}_95CI_upper")}
    return pivot_estimates(
        rows.filter(F.col("estimate_name").contains("incidence")), names
    )


def paper_incidence(
    rows: DataFrame, outcome: str, year: int, without: Sequence[str] = ()
) -> DataFrame:
    """Rates of one outcome and year over all ages and both sexes."""
    chosen = select_rows(
        rows, outcome=[outcome], year=[year], sex=["overall"], age_group=["overall"]
    )
    return (
        incidence_estimates(drop_rows(chosen, cdm_name=without))
        .withColumnRenamed("mode", "Observation period definition")
        .withColumnRenamed("incidence_100000_pys", "Incidence per 100,000 py")
    )


def incidence_series(rows: DataFrame, interval: str) -> DataFrame:
    """Rates for plotting; without years the label is ``overall``."""
    series = incidence_estimates(rows)
    if interval == "overall":
        return series.withColumn("year", F.lit("overall"))
    return series


def incidence_table(rows: DataFrame, interval: str) -> DataFrame:
    """Formatted incidence, one column per database and mode."""
    rows = rows.drop("analysis_interval", *(["year"] if interval == "overall" else []))
    rows = format_names(format_values(rows, PANEL_DECIMALS), INCIDENCE_TEMPLATES)
    others = [c for c in rows.columns if c not in ("age_group", "sex", "estimate_type")]
    shown = rows.select("age_group", "sex", *others)
    return format_header(shown, ["cdm_name", "mode"])


def period_table(result: SummarisedResult) -> DataFrame:
    """Formatted characteristics, one column per database and mode."""
    wanted = ["count", "percentage", "median", "q25", "q75", "min", "max"]
    rows = select_rows(result.rows, estimate_name=wanted)
    rows = split_all(add_settings(rows, result.settings, ["mode"])).drop("result_id")
    rows = format_names(format_values(rows, PANEL_DECIMALS), PANEL_TEMPLATES)
    return format_header(rows.drop("estimate_type"), ["cdm_name", "mode"])


def simple_table(
    result: SummarisedResult,
    header: Sequence[str] = (),
    group: Sequence[str] = (),
    hide: Sequence[str] = (),
) -> DataFrame:
    """Any result as a formatted table: header spread out, group columns merged."""
    rows = split_all(add_settings(result.rows, result.settings)).drop("result_id")
    rows = format_names(format_values(rows, SIMPLE_DECIMALS), SIMPLE_TEMPLATES)
    rows = rows.drop("estimate_type", *hide)
    if header:
        rows = format_header(rows, header)
    return merge_columns(rows, group) if len(group) > 1 else rows


def prepare_report(
    spark: SparkSession,
    folder: str,
    databases: Mapping[str, str] | None = None,
    modes: Mapping[str, str] = MODE_LABELS,
) -> dict[str, DataFrame]:
    """Import all results below ``folder`` and prepare every panel's table."""
    result = relabel_result(import_results(spark, folder), databases, modes)
    return prepare_panels(result)


def prepare_panels(result: SummarisedResult) -> dict[str, DataFrame]:
    """The panels' tables, and the lists of databases, sexes, ages and modes."""
    parts = {
        name: result.filter_settings(F.col("result_type") == kind)
        for name, kind in PANELS.items()
    }
    in_obs = prepare_in_observation(parts["in_obs"])
    spark = result.rows.sparkSession

    def listed(name, values):
        pairs = list(enumerate(values, start=1))
        return spark.createDataFrame(pairs, f"position int, {name} string")

    return {
        "snapshot": parts["snapshot"].rows,
        "in_obs": in_obs,
        "obs_period": parts["obs_period"].rows,
        "obs_period_settings": parts["obs_period"].settings,
        "incidence": prepare_incidence(parts["incidence"]),
        "cdm_names": listed("cdm_name", distinct_values(result.rows, "cdm_name")),
        "sexes": listed("sex", SEX_LEVELS),
        "age_groups": listed("age_group", AGE_GROUP_LEVELS),
        "modes": listed("mode", distinct_values(in_obs, "mode")),
    }
