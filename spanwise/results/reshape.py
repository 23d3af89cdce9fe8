"""Reshaping of long results: splitting, pivoting and formatting."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwise.results.longform import (
    OVERALL,
    PAIRS,
    SEPARATOR,
    SETTINGS_COLUMNS,
    SummarisedResult,
)

ESTIMATE = ("estimate_name", "estimate_type", "estimate_value")

# Spark types of the estimate types.
TYPES = {
    "integer": "bigint",
    "numeric": "double",
    "percentage": "double",
    "proportion": "double",
    "date": "date",
    "logical": "boolean",
    "character": "string",
}


def distinct_values(rows: DataFrame, column: str) -> list:
    """Sorted values of a label column; for result tables, whose labels are few."""
    found = rows.select(column).distinct().filter(F.col(column).isNotNull()).collect()
    return sorted(row[0] for row in found)


def pair_columns(rows: DataFrame, pair: str) -> list[str]:
    """Names of the columns folded into one name/level pair."""
    texts = distinct_values(rows, f"{pair}_name")
    names = dict.fromkeys(n for text in texts for n in text.split(SEPARATOR))
    return [n for n in names if n != OVERALL]


def split_pair(
    rows: DataFrame, pair: str, columns: Sequence[str] | None = None
) -> DataFrame:
    """Expand one name/level pair; a row without a column's name gets ``overall``."""
    columns = pair_columns(rows, pair) if columns is None else columns
    name, level = f"{pair}_name", f"{pair}_level"
    told = F.map_from_arrays(
        F.split(name, SEPARATOR, -1), F.split(level, SEPARATOR, -1)
    )
    wide = rows.withColumn("told", told)
    for column in columns:
        text = F.coalesce(F.try_element_at("told", F.lit(column)), F.lit(OVERALL))
        wide = wide.withColumn(column, text)
    return wide.drop("told", name, level)


def split_all(
    rows: DataFrame, columns: Mapping[str, Sequence[str]] | None = None
) -> DataFrame:
    """Expand the group, strata and additional pairs."""
    for pair in PAIRS:
        rows = split_pair(rows, pair, None if columns is None else columns.get(pair, ()))
    return rows


def add_settings(
    rows: DataFrame, settings: DataFrame, columns: Sequence[str] | None = None
) -> DataFrame:
    """Rows with settings columns of their ``result_id``."""
    if columns is None:
        columns = [c for c in settings.columns if c not in (*rows.columns, *PAIRS)]
    chosen = F.broadcast(settings.select("result_id", *columns))
    return rows.join(chosen, "result_id", "left")


def pivot_estimates(
    rows: DataFrame, estimates: Mapping[str, str] | None = None
) -> DataFrame:
    """One typed column per estimate; ``estimates`` maps names to estimate types."""
    if estimates is None:
        pairs = rows.select("estimate_name", "estimate_type").distinct().collect()
        estimates = {n: t for n, t in sorted((p[0], p[1]) for p in pairs)}
        if len(estimates) < len(pairs):
            raise ValueError("an estimate occurs with more than one type")
    keys = [c for c in rows.columns if c not in ESTIMATE]
    wide = rows.groupBy(*keys).pivot("estimate_name", list(estimates)).agg(
        F.first("estimate_value")
    )
    typed = [
        F.col(f"`{n}`").try_cast(TYPES.get(t, "string")).alias(n)
        for n, t in estimates.items()
    ]
    return wide.select(*[F.col(f"`{k}`") for k in keys], *typed)


def tidy(
    result: SummarisedResult,
    columns: Mapping[str, Sequence[str]] | None = None,
    estimates: Mapping[str, str] | None = None,
) -> DataFrame:
    """Split pairs, settings and estimates into columns of one wide table."""
    free = [c for c in result.settings.columns if c not in SETTINGS_COLUMNS]
    rows = split_all(result.rows, columns)
    free = [c for c in free if c not in rows.columns]
    wide = add_settings(rows, result.settings, free).drop("result_id")
    return pivot_estimates(wide, estimates)


def format_values(rows: DataFrame, decimals: Mapping[str, int]) -> DataFrame:
    """Estimate values as text with thousands marks and decimals by type."""
    number = F.col("estimate_value").try_cast("double")
    text = F.col("estimate_value")
    for kind, places in decimals.items():
        shown = F.coalesce(F.format_number(number, places), F.col("estimate_value"))
        text = F.when(F.col("estimate_type") == kind, shown).otherwise(text)
    return rows.withColumn("estimate_value", text)


def _usable(names):
    return lambda e: e["estimate_name"].isin(names) & e["estimate_value"].isNotNull()


def _not_named(names):
    return lambda e: ~e["estimate_name"].isin(names)


def format_names(rows: DataFrame, templates: Mapping[str, str]) -> DataFrame:
    """Fill templates such as ``<count> (<percentage>%)`` from the estimates.

    Templates are tried in order. One is used where all its estimates are
    there, and these are then taken; estimates in no used template stay as rows
    of their own.
    """
    keys = [c for c in rows.columns if c not in ESTIMATE]
    entry = F.struct("estimate_name", "estimate_value", "estimate_type")
    cells = rows.groupBy(*keys).agg(F.collect_list(entry).alias("found"))
    cells = cells.withColumn("left_over", F.col("found"))
    filled = []
    for label, template in templates.items():
        wanted = list(dict.fromkeys(re.findall(r"<([^<>]+)>", template)))
        usable = F.filter("left_over", _usable(wanted))
        complete = F.size(usable) == len(wanted)
        values = F.map_from_entries(
            F.transform(usable, lambda e: F.struct(e["estimate_name"], e["estimate_value"]))
        )
        pieces = re.split(r"<([^<>]+)>", template)
        text = F.concat(
            *[
                F.try_element_at(values, F.lit(p)) if i % 2 else F.lit(p)
                for i, p in enumerate(pieces)
            ]
        )
        column = f"filled_{len(filled)}"
        cells = cells.withColumn(
            column,
            F.when(
                complete,
                F.struct(
                    F.lit(label).alias("estimate_name"),
                    text.alias("estimate_value"),
                    F.lit("character").alias("estimate_type"),
                ),
            ),
        ).withColumn(
            "left_over",
            F.when(
                complete,
                F.filter("left_over", _not_named(wanted)),
            ).otherwise(F.col("left_over")),
        )
        filled.append(F.col(column))
    shown = F.concat(F.array_compact(F.array(*filled)), F.col("left_over"))
    return cells.select(*keys, F.inline(shown)).select(*rows.columns)


def format_header(
    rows: DataFrame,
    header: Sequence[str],
    levels: Sequence[str] | None = None,
    separator: str = " / ",
) -> DataFrame:
    """Spread the values over one column per combination of the header columns."""
    keys = [c for c in rows.columns if c not in (*header, "estimate_value")]
    joined = rows.withColumn("header", F.concat_ws(separator, *header))
    levels = distinct_values(joined, "header") if levels is None else list(levels)
    return (
        joined.groupBy(*keys).pivot("header", levels).agg(F.first("estimate_value"))
    )


def merge_columns(rows: DataFrame, columns: Sequence[str], separator="; ") -> DataFrame:
    """Unite columns into one text column named after them, at their place."""
    name = separator.join(columns)
    text = F.concat_ws(separator, *columns).alias(name)
    kept = []
    for column in rows.columns:
        if column == columns[0]:
            kept.append(text)
        elif column not in columns:
            kept.append(F.col(f"`{column}`"))
    return rows.select(*kept)
