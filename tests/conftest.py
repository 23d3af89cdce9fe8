import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

from spanwise.config import RECORD_TABLES  # noqa: E402
from spanwise.session import local_session  # noqa: E402
from spanwise.sources.cdm import Cdm  # noqa: E402
from tables import day  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(8, partitions=4, folder=str(tmp_path_factory.mktemp("shared")))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_cdm(spark):
    """Build clinical tables from short lists; absent tables are empty."""
    dated = {
        "drug_exposure": "person_id long, drug_concept_id long,"
        " drug_exposure_start_date date, drug_exposure_end_date date",
        "condition_occurrence": "person_id long, condition_start_date date,"
        " condition_end_date date",
        "procedure_occurrence": "person_id long, procedure_date date,"
        " procedure_end_date date",
        "visit_occurrence": "person_id long, visit_concept_id int,"
        " visit_start_date date, visit_end_date date",
        "device_exposure": "person_id long, device_exposure_start_date date,"
        " device_exposure_end_date date",
        "measurement": "person_id long, measurement_date date",
        "observation": "person_id long, observation_date date",
        "death": "person_id long, death_date date",
        "observation_period": "observation_period_id long, person_id long,"
        " observation_period_start_date date, observation_period_end_date date,"
        " period_type_concept_id int",
        "person": "person_id long, gender_concept_id int, year_of_birth int,"
        " month_of_birth int, day_of_birth int",
        "concept": "concept_id long, concept_name string, concept_class_id string",
        "concept_ancestor": "ancestor_concept_id long, descendant_concept_id long",
    }
    assert set(RECORD_TABLES) < set(dated)

    def build(**rows):
        tables = {
            name: spark.createDataFrame(rows.get(name, []), schema)
            for name, schema in dated.items()
        }
        return Cdm.from_tables(spark, tables, "toy")

    return build


@pytest.fixture
def spans(spark):
    """A span table from ``(person, start, end)`` texts."""

    def build(*rows):
        data = [(p, day(a), day(b)) for p, a, b in rows]
        schema = "person_id long, start_date date, end_date date"
        return spark.createDataFrame(data, schema)

    return build
