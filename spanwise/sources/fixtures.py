"""Clinical tables derived from the retail and event tables of the test data.

Customers act as persons, orders as visits, order lines as drug exposures and
events as the other records. Each expression is plain SQL and is used by the
Spark views and by the reference queries alike.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import SparkSession

from spanwise.config import StudyConfig
from spanwise.sources.cdm import Cdm

SOURCE_TABLES = ("customer", "orders", "lineitem", "part", "events")

STUDY = StudyConfig(
    data_end_date=dt.date(2024, 1, 20),
    cdm_name="IDRIL_1",
    study_start=dt.date(1996, 1, 1),
    ingredients=("brand#1", "brand#2", "brand#3"),
)


def _event_view(kind: str, start: str, end: str | None) -> str:
    day = "CAST(ts AS DATE)"
    columns = f"user_id AS person_id, {day} AS {start}"
    if end:
        columns += (
            ", CASE WHEN event_id % 4 = 0 THEN NULL"
            f" ELSE {day} + CAST(event_id % 9 AS INT) END AS {end}"
        )
    return f"SELECT {columns} FROM events WHERE event_type = '{kind}'"


# One SELECT per clinical table, valid in Spark and in DuckDB.
VIEWS = {
    "person": """
        SELECT c_custkey AS person_id,
               CASE WHEN c_nationkey % 2 = 0 THEN 8507 ELSE 8532 END AS gender_concept_id,
               CAST(1905 + (c_custkey * 7919) % 95 AS INT) AS year_of_birth,
               CASE WHEN c_custkey % 10 = 0 THEN NULL
                    ELSE CAST(1 + c_custkey % 12 AS INT) END AS month_of_birth,
               CASE WHEN c_custkey % 7 = 0 THEN NULL
                    ELSE CAST(1 + c_custkey % 28 AS INT) END AS day_of_birth
        FROM customer WHERE c_custkey % 97 <> 5""",
    "visit_occurrence": """
        SELECT o_custkey AS person_id,
               CASE o_orderstatus WHEN 'F' THEN 9201 WHEN 'P' THEN 262
                    ELSE 9202 END AS visit_concept_id,
               CAST(o_orderdate AS DATE) AS visit_start_date,
               CAST(o_orderdate AS DATE) + CAST(o_orderkey % 15 AS INT) AS visit_end_date
        FROM orders""",
    "drug_exposure": """
        SELECT o_custkey AS person_id,
               l_partkey AS drug_concept_id,
               CAST(l_shipdate AS DATE) AS drug_exposure_start_date,
               CASE l_linenumber
                    WHEN 5 THEN NULL
                    WHEN 6 THEN CAST(l_shipdate AS DATE) - CAST(3 AS INT)
                    ELSE CAST(l_shipdate AS DATE) + CAST(l_quantity AS INT)
               END AS drug_exposure_end_date
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "condition_occurrence": _event_view(
        "error", "condition_start_date", "condition_end_date"
    ),
    "procedure_occurrence": _event_view(
        "purchase", "procedure_start_date", "procedure_end_date"
    ),
    "device_exposure": _event_view(
        "click", "device_exposure_start_date", "device_exposure_end_date"
    ),
    "measurement": _event_view("view", "measurement_date", None),
    "observation": _event_view("signup", "observation_date", None),
    "death": """
        SELECT c_custkey AS person_id,
               DATE '1999-01-01' + CAST((c_custkey * 37) % 1000 AS INT) AS death_date
        FROM customer WHERE c_custkey % 20 = 0
        UNION ALL
        SELECT c_custkey AS person_id,
               DATE '1999-01-01' + CAST((c_custkey * 37) % 1000 + 30 AS INT) AS death_date
        FROM customer WHERE c_custkey % 40 = 0""",
    "observation_period": """
        SELECT 2 * c_custkey AS observation_period_id, c_custkey AS person_id,
               DATE '1995-01-01' AS observation_period_start_date,
               CASE WHEN c_custkey % 3 = 0 THEN DATE '1997-12-31'
                    ELSE DATE '2001-12-31' END AS observation_period_end_date,
               0 AS period_type_concept_id
        FROM customer
        UNION ALL
        SELECT 2 * c_custkey + 1 AS observation_period_id, c_custkey AS person_id,
               DATE '1999-01-01' AS observation_period_start_date,
               DATE '2001-12-31' AS observation_period_end_date,
               0 AS period_type_concept_id
        FROM customer WHERE c_custkey % 3 = 0""",
    "concept": """
        SELECT p_partkey AS concept_id, p_name AS concept_name,
               'Clinical Drug' AS concept_class_id
        FROM part
        UNION ALL
        SELECT DISTINCT 1000000 + CAST(substring(p_brand, 7) AS BIGINT) AS concept_id,
               lower(p_brand) AS concept_name, 'Ingredient' AS concept_class_id
        FROM part""",
    "concept_ancestor": """
        SELECT 1000000 + CAST(substring(p_brand, 7) AS BIGINT) AS ancestor_concept_id,
               p_partkey AS descendant_concept_id
        FROM part
        UNION ALL
        SELECT DISTINCT 1000000 + CAST(substring(p_brand, 7) AS BIGINT)
                   AS ancestor_concept_id,
               1000000 + CAST(substring(p_brand, 7) AS BIGINT) AS descendant_concept_id
        FROM part""",
}

FIXTURE_FIELDS = {"procedure_occurrence": ("procedure_start_date", "procedure_end_date")}


def fixture_cdm(spark: SparkSession, folder: str) -> Cdm:
    """The clinical tables derived from the parquet files in ``folder``."""
    sources = {t: spark.read.parquet(f"{folder}/{t}.parquet") for t in SOURCE_TABLES}

    def derive(select: str):
        for table in SOURCE_TABLES:
            select = select.replace(f"FROM {table}", f"FROM {{{table}}}")
            select = select.replace(f"JOIN {table}", f"JOIN {{{table}}}")
        used = {t: df for t, df in sources.items() if f"{{{t}}}" in select}
        return spark.sql(select, **used)

    tables = {name: derive(select) for name, select in VIEWS.items()}
    return Cdm.from_tables(spark, tables, STUDY.cdm_name, FIXTURE_FIELDS)
