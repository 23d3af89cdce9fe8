"""Binding of clinical tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwise.config import DATE_FIELDS, RECORD_TABLES

REQUIRED_TABLES = (*RECORD_TABLES, "person", "observation_period")
OPTIONAL_TABLES = ("concept", "concept_ancestor", "cdm_source")


@dataclass(frozen=True)
class Cdm:
    """A named set of clinical tables; operators read it and never change it."""

    spark: SparkSession
    name: str
    tables: Mapping[str, DataFrame]
    date_fields: Mapping[str, tuple[str, str]] = field(
        default_factory=lambda: dict(DATE_FIELDS)
    )

    def __getitem__(self, table: str) -> DataFrame:
        if table not in self.tables:
            raise KeyError(f"table {table!r} is not part of {self.name!r}")
        return self.tables[table]

    def __contains__(self, table: str) -> bool:
        return table in self.tables

    def check(self) -> Cdm:
        """Raise when a table or a date field that the study needs is missing."""
        missing = [t for t in REQUIRED_TABLES if t not in self.tables]
        if missing:
            raise ValueError(f"missing tables: {', '.join(missing)}")
        for table in (*RECORD_TABLES, "observation_period"):
            columns = self.tables[table].columns
            wanted = {"person_id", *self.date_fields[table]}
            if not wanted <= set(columns):
                absent = ", ".join(sorted(wanted - set(columns)))
                raise ValueError(f"{table} lacks {absent}")
        return self

    def dates(self, table: str) -> DataFrame:
        """``person_id, start_date, end_date`` of one table, as dates."""
        start, end = self.date_fields[table]
        return self[table].select(
            "person_id",
            F.col(start).cast("date").alias("start_date"),
            F.col(end).cast("date").alias("end_date"),
        )

    @classmethod
    def from_tables(
        cls,
        spark: SparkSession,
        tables: Mapping[str, DataFrame],
        name: str = "cdm",
        date_fields: Mapping[str, tuple[str, str]] | None = None,
    ) -> Cdm:
        """Bind DataFrames; ``date_fields`` overrides single field names."""
        fields = {**DATE_FIELDS, **(date_fields or {})}
        return cls(spark, name, dict(tables), fields).check()

    @classmethod
    def from_catalog(
        cls, spark: SparkSession, schema: str, prefix: str = "", **options
    ) -> Cdm:
        """Bind catalog tables ``schema.prefix + table``."""
        tables = {t: spark.table(f"{schema}.{prefix}{t}") for t in REQUIRED_TABLES}
        for table in OPTIONAL_TABLES:
            if spark.catalog.tableExists(f"{schema}.{prefix}{table}"):
                tables[table] = spark.table(f"{schema}.{prefix}{table}")
        return cls.from_tables(spark, tables, **options)

    @classmethod
    def from_parquet(cls, spark: SparkSession, folder: str, **options) -> Cdm:
        """Bind ``folder/table.parquet`` or the directory ``folder/table``."""

        def read(table):
            for path in (f"{folder}/{table}.parquet", f"{folder}/{table}"):
                try:
                    return spark.read.parquet(path)
                except AnalysisException as error:
                    if error.getCondition() != "PATH_NOT_FOUND":
                        raise
            return None

        found = {t: read(t) for t in (*REQUIRED_TABLES, *OPTIONAL_TABLES)}
        tables = {t: df for t, df in found.items() if df is not None}
        return cls.from_tables(spark, tables, **options)

    @classmethod
    def from_jdbc(
        cls,
        spark: SparkSession,
        url: str,
        schema: str,
        person_id_range: tuple[int, int],
        partitions: int,
        tables: Sequence[str] = (*REQUIRED_TABLES, *OPTIONAL_TABLES),
        properties: Mapping[str, str] | None = None,
        **options,
    ) -> Cdm:
        """Bind database tables; those of persons are read in slices of ``person_id``.

        The bounds are those of the persons, so a table without persons is read whole.
        """
        low, high = person_id_range
        slices = {
            "column": "person_id",
            "lowerBound": low,
            "upperBound": high,
            "numPartitions": partitions,
        }

        def read(table):
            sliced = {} if table in OPTIONAL_TABLES else slices
            return spark.read.jdbc(
                url, f"{schema}.{table}", properties=dict(properties or {}), **sliced
            )

        return cls.from_tables(spark, {t: read(t) for t in tables}, **options)
