"""Overview of a set of results: sizes, package versions and suppression."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwise.results.longform import SummarisedResult


def overview(result: SummarisedResult, panels: int) -> DataFrame:
    """One row: numbers of rows, settings, panels, result types and databases."""
    one = F.lit(1).alias("one")
    rows = result.rows.agg(
        one,
        F.count("*").alias("result_rows"),
        F.countDistinct("cdm_name").alias("databases"),
        F.concat_ws(", ", F.array_sort(F.collect_set("cdm_name"))).alias("cdm_names"),
    )
    sets = result.settings.agg(
        one,
        F.count("*").alias("result_ids"),
        F.countDistinct("result_type").alias("result_types"),
    )
    return rows.join(sets, "one").select(
        "result_rows",
        "result_ids",
        F.lit(panels).cast("long").alias("panels"),
        "result_types",
        "databases",
        "cdm_names",
    )


def overview_text(result: SummarisedResult, panels: int) -> DataFrame:
    """The overview as one sentence per line, with thousands marks."""
    table = overview(result, panels)
    number = {
        c: F.format_number(c, 0)
        for c in ("result_rows", "result_ids", "panels", "result_types", "databases")
    }
    listed = F.when(
        F.col("cdm_names") == "", F.lit("")
    ).otherwise(F.concat(F.lit(": "), F.col("cdm_names")))
    lines = [
        ("Results contain %s rows with %s different result_id.", "result_rows", "result_ids"),
        ("Results contain %s panels with %s different result_type.", "panels", "result_types"),
    ]
    texts = [F.format_string(t, number[a], number[b]) for t, a, b in lines]
    texts.append(
        F.format_string(
            "Results contain data from %s different cdm objects%s.",
            number["databases"],
            listed,
        )
    )
    return table.select(F.posexplode(F.array(*texts)).alias("line", "message"))


def package_versions(settings: DataFrame) -> DataFrame:
    """Result ids per package version, and whether a package has just one."""
    counts = settings.groupBy("package_name", "package_version").agg(
        F.count("*").alias("result_ids")
    )
    versions = counts.groupBy("package_name").agg(
        F.countDistinct("package_version").alias("versions")
    )
    consistent = F.when(F.col("versions") > 1, "Inconsistent").otherwise("Consistent")
    message = F.format_string(
        "%s %s in %d result id(s).", "package_name", "package_version", "result_ids"
    )
    return (
        counts.join(versions, "package_name")
        .select(
            "package_name",
            "package_version",
            "result_ids",
            "versions",
            F.concat(consistent, F.lit(" package versions")).alias("group"),
            message.alias("message"),
        )
        .orderBy(F.desc("versions"), "package_name", "package_version")
    )


def suppression_tally(settings: DataFrame) -> DataFrame:
    """Result ids per smallest count shown; thresholds up to 1 hide nothing."""
    threshold = F.col("min_cell_count")
    level = F.when(threshold.try_cast("int") <= 1, "0").otherwise(threshold)
    tally = settings.groupBy(level.alias("min_cell_count")).agg(F.count("*").alias("n"))
    hidden = F.format_string(
        "%d results suppressed at minCellCount = %s.", "n", "min_cell_count"
    )
    shown = F.format_string("%d not suppressed results", "n")
    message = F.when(F.col("min_cell_count") == "0", shown).otherwise(hidden)
    return tally.withColumn("message", message).orderBy("min_cell_count")


