"""The long result table and its settings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanwise.operators.records import stack
from spanwise.results.disclosure import FOLLOWED, PLACE, hidden_places, with_places
from spanwise.session import materialise

# Columns of the long result and of its settings.
PAIRS = ("group", "strata", "additional")
RESULT_COLUMNS = (
    "result_id",
    "cdm_name",
    "group_name",
    "group_level",
    "strata_name",
    "strata_level",
    "variable_name",
    "variable_level",
    "estimate_name",
    "estimate_type",
    "estimate_value",
    "additional_name",
    "additional_level",
)
SETTINGS_COLUMNS = (
    "result_id",
    "result_type",
    "package_name",
    "package_version",
    "group",
    "strata",
    "additional",
    "min_cell_count",
)
SEPARATOR = " &&& "
OVERALL = "overall"
# Variables whose count is the size of their stratum.
STRATUM_COUNTS = (
    "number records",
    "number subjects",
    "Number records in observation",
    "Denominator",
)
PACKAGE = ("spanwise", "0.1.0")

RESULT_SCHEMA = T.StructType(
    [
        T.StructField(c, T.IntegerType() if c == "result_id" else T.StringType())
        for c in RESULT_COLUMNS
    ]
)


@dataclass(frozen=True)
class SummarisedResult:
    """Long rows and one settings row for each ``result_id``."""

    rows: DataFrame
    settings: DataFrame

    def filter_settings(self, condition: Column) -> SummarisedResult:
        """Keep the settings that meet ``condition``, and their rows."""
        kept = self.settings.filter(condition)
        ids = F.broadcast(kept.select("result_id"))
        return SummarisedResult(self.rows.join(ids, "result_id", "left_semi"), kept)

    def with_rows(self, rows: DataFrame) -> SummarisedResult:
        return SummarisedResult(rows, self.settings)


def empty_result(spark: SparkSession) -> SummarisedResult:
    """A result without rows and settings."""
    settings = T.StructType(
        [
            T.StructField(c, T.IntegerType() if c == "result_id" else T.StringType())
            for c in SETTINGS_COLUMNS
        ]
    )
    return SummarisedResult(
        spark.createDataFrame([], RESULT_SCHEMA), spark.createDataFrame([], settings)
    )


def settings_table(
    spark: SparkSession,
    result_type: str,
    entries: Sequence[Mapping[str, str]],
    group: Sequence[str] = (),
    strata: Sequence[str] = (),
    additional: Sequence[str] = (),
    free: Sequence[str] = (),
) -> DataFrame:
    """Settings with ids from 1, one row per entry of free columns.

    ``free`` names those that are there without any entry.
    """
    free = list(dict.fromkeys([*free, *(c for e in entries for c in e)]))
    fixed = (
        result_type,
        *PACKAGE,
        SEPARATOR.join(group),
        SEPARATOR.join(strata),
        SEPARATOR.join(additional),
        "0",
    )
    rows = [(i, *fixed, *(e.get(c) for c in free)) for i, e in enumerate(entries, 1)]
    fields = [
        T.StructField(c, T.IntegerType() if c == "result_id" else T.StringType())
        for c in (*SETTINGS_COLUMNS, *free)
    ]
    return spark.createDataFrame(rows, T.StructType(fields))


def united(columns: Sequence[str]) -> tuple[Column, Column]:
    """Name and level of several columns; missing and overall levels are left out."""
    told = [(c, F.col(c).isNotNull() & (F.col(c) != OVERALL)) for c in columns]
    names = [F.when(known, F.lit(c)) for c, known in told]
    levels = [F.when(known, F.col(c)) for c, known in told]

    def joined(parts):
        text = F.concat_ws(SEPARATOR, *parts) if parts else F.lit("")
        return F.when(text == "", OVERALL).otherwise(text)

    return joined(names), joined(levels)


def unite_pair(rows: DataFrame, pair: str, columns: Sequence[str]) -> DataFrame:
    """Replace ``columns`` by the name and level columns of ``pair``."""
    name, level = united(columns)
    return rows.withColumns({f"{pair}_name": name, f"{pair}_level": level}).drop(*columns)


def to_rows(
    table: DataFrame,
    cdm_name: str,
    estimates: Sequence[tuple[Column, Column | None, str, str, Column]],
    group: Sequence[str] = (),
    strata: Sequence[str] = (),
    additional: Sequence[str] = (),
) -> DataFrame:
    """Long rows of a typed table, its other columns kept to look up settings.

    Each estimate is ``(variable, level, name, type, value)``.
    """
    cells = F.array(
        *[
            F.struct(
                variable.cast("string").alias("variable_name"),
                (F.lit(None) if level is None else level)
                .cast("string")
                .alias("variable_level"),
                F.lit(name).alias("estimate_name"),
                F.lit(kind).alias("estimate_type"),
                value.cast("string").alias("estimate_value"),
            )
            for variable, level, name, kind, value in estimates
        ]
    )
    rows = table.select("*", F.inline(cells))
    for pair, columns in zip(PAIRS, (group, strata, additional), strict=True):
        rows = unite_pair(rows, pair, list(columns))
    return rows.withColumn("cdm_name", F.lit(cdm_name))


def summarised(
    rows: DataFrame, settings: DataFrame, keys: Sequence[str]
) -> SummarisedResult:
    """Give long rows the id of the settings row that agrees in ``keys``."""
    ids = F.broadcast(settings.select("result_id", *keys))
    return SummarisedResult(
        rows.join(ids, list(keys)).select(*RESULT_COLUMNS), settings
    )


def bind(*results: SummarisedResult) -> SummarisedResult:
    """Stack results; ids are renumbered from 1 in the order of the arguments.

    Nothing gives an empty result.
    """
    if not results:
        return empty_result(SparkSession.active())
    position = "bound_position"

    def placed(frames):
        return [f.withColumn(position, F.lit(i)) for i, f in enumerate(frames)]

    stacked = placed([r.settings for r in results])
    settings = stacked[0]
    for frame in stacked[1:]:
        settings = settings.unionByName(frame, allowMissingColumns=True)
    # One row per analysis and definition: small by construction.
    order = Window.orderBy(position, "result_id")
    settings = settings.withColumn("bound_id", F.row_number().over(order))
    ids = F.broadcast(settings.select(position, "result_id", "bound_id"))
    rows = stack(placed([r.rows for r in results])).join(ids, [position, "result_id"])
    others = [c for c in settings.columns if c not in (position, "result_id", "bound_id")]
    new_id = F.col("bound_id").alias("result_id")
    return SummarisedResult(
        rows.select(new_id, *RESULT_COLUMNS[1:]), settings.select(new_id, *others)
    )


def suppress(result: SummarisedResult, min_cell_count: int = 5) -> SummarisedResult:
    """Blank small counts, all of their cell or stratum, and what else would give them away.

    A count between 1 and ``min_cell_count - 1`` is blanked together with every
    estimate of the same cell; when it counts the subjects or records that a
    stratum is about, the whole stratum is blanked: the person-days of few periods,
    and the rates and limits of a small denominator, from which it could be
    worked out, go with it. Zero stays. Where totals over sexes, ages, years or levels
    are shown as well, further cells are blanked until no blanked count can be worked
    out from what is left (:mod:`spanwise.results.disclosure`). The rows are written
    first, as they are read twice.
    """
    value = F.col("estimate_value").try_cast("double")
    small = (
        F.col("estimate_name").endswith("count")
        & (value > 0)
        & (value < F.lit(min_cell_count))
    )
    base = F.col("variable_name").isin(*STRATUM_COUNTS)
    stratum = [
        "result_id",
        "cdm_name",
        *[f"{p}_{part}" for p in PAIRS for part in ("name", "level")],
    ]
    cell = Window.partitionBy(*stratum, "variable_name", "variable_level")
    whole = Window.partitionBy(*stratum)
    placed = materialise(with_places(result.rows, result.settings), "long-rows")
    further = hidden_places(placed, min_cell_count).withColumnRenamed("whole", "further")
    flagged = placed.join(further, list(PLACE), "left").withColumn("small", F.coalesce(small, F.lit(False)))
    beside = F.col("further") | (F.col("kind") != FOLLOWED) | (F.col("variable_name") == "Outcome")
    hidden = (
        F.bool_or("small").over(cell)
        | F.bool_or(F.col("small") & base).over(whole)
        | F.coalesce(F.col("further").isNotNull() & beside, F.lit(False))
    )
    rows = flagged.withColumn("hidden", hidden).withColumn(
        "estimate_value", F.when(~F.col("hidden"), F.col("estimate_value"))
    )
    settings = result.settings.withColumn(
        "min_cell_count", F.lit(str(int(min_cell_count)))
    )
    return SummarisedResult(rows.select(*RESULT_COLUMNS), settings)
