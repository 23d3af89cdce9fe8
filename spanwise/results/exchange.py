"""Export and import of result files."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanwise.results.longform import (
    OVERALL,
    RESULT_COLUMNS,
    RESULT_SCHEMA,
    SummarisedResult,
    bind,
    suppress,
)
from spanwise.session import shuffles_removed

SETTINGS_VARIABLE = "settings"
FILE_NAME = "observation_period_characterisation_{cdm_name}"


def settings_rows(settings: DataFrame) -> DataFrame:
    """Settings as long rows, to travel in the same file as the results."""
    names = [c for c in settings.columns if c != "result_id"]
    entries = F.array(
        *[
            F.struct(
                F.lit(n).alias("estimate_name"),
                F.col(f"`{n}`").cast("string").alias("estimate_value"),
            )
            for n in names
        ]
    )
    rows = settings.select("result_id", F.inline(entries)).filter(
        F.col("estimate_value").isNotNull()
    )
    fixed = {
        "variable_name": F.lit(SETTINGS_VARIABLE),
        "estimate_type": F.lit("character"),
        **{
            f"{pair}_{part}": F.lit(OVERALL)
            for pair in ("group", "strata", "additional")
            for part in ("name", "level")
        },
    }
    none = F.lit(None).cast("string")
    return rows.withColumns(
        {**fixed, "variable_level": none, "cdm_name": none}
    ).select(*RESULT_COLUMNS)


def export_result(
    *results: SummarisedResult,
    folder: str,
    cdm_name: str,
    min_cell_count: int = 5,
    file_name: str = FILE_NAME,
) -> str:
    """Bind, suppress and write results as CSV; returns the path written.

    The path is a folder of part files: nothing is gathered in one task.
    """
    result = suppress(bind(*results), min_cell_count)
    path = f"{folder.rstrip('/')}/{file_name.format(cdm_name=cdm_name)}"
    rows = result.rows.unionByName(settings_rows(result.settings))
    with shuffles_removed(rows.sparkSession):
        rows.write.mode("overwrite").option("header", True).csv(path)
    return path


def import_results(spark: SparkSession, folder: str) -> SummarisedResult:
    """Read every exported result below ``folder``; ids are renumbered.

    Part files of one export share their folder; other files stand alone.
    """
    read = (
        spark.read.schema(RESULT_SCHEMA)
        .option("header", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.csv")
        .csv(folder)
    )
    path = F.col("_metadata.file_path")
    source = F.regexp_replace(path, r"/part-[^/]*$", "")
    rows = read.select("*", source.alias("source"))
    is_setting = F.col("variable_name") == SETTINGS_VARIABLE
    told = rows.filter(is_setting)
    names = [r[0] for r in told.select("estimate_name").distinct().collect()]
    order = Window.orderBy("source", "result_id")
    settings = (
        told.groupBy("source", "result_id")
        .pivot("estimate_name", sorted(names))
        .agg(F.first("estimate_value"))
        .withColumn("new_id", F.row_number().over(order))
    )
    ids = F.broadcast(settings.select("source", "result_id", "new_id"))
    new_id = F.col("new_id").alias("result_id")
    found = (
        rows.filter(~is_setting)
        .join(ids, ["source", "result_id"])
        .select(new_id, *RESULT_COLUMNS[1:])
    )
    return SummarisedResult(found, settings.select(new_id, *sorted(names)))


def results_version(spark: SparkSession, folder: str) -> str:
    """A name for the exported files below ``folder`` as they are now; another export has another one."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.csv")
        .load(folder)
        .select("path", "length", "modificationTime")
    )
    mixed = F.xxhash64("path", "length", "modificationTime")
    found = files.agg(F.bit_xor(mixed).alias("mixed"), F.count(F.lit(1)).alias("files")).first()
    return f"{found['files']}-{(found['mixed'] or 0) % (1 << 64):016x}"


def save_bundle(tables: dict[str, DataFrame], folder: str) -> None:
    """Write prepared tables, one parquet folder each."""
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/{name}")


def load_bundle(spark: SparkSession, folder: str, names, rebuild) -> dict[str, DataFrame]:
    """Prepared tables from ``folder``, built by ``rebuild`` and saved if absent.

    Name the folder by :func:`results_version`, so that a later export is prepared anew.
    """
    paths = {name: f"{folder.rstrip('/')}/{name}" for name in names}
    try:
        return {name: spark.read.parquet(path) for name, path in paths.items()}
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
    save_bundle(rebuild(), folder)
    return {name: spark.read.parquet(path) for name, path in paths.items()}
