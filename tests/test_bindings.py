from pyspark.sql import DataFrameReader
from tables import day

from spanwise.operators import features, periods
from spanwise.operators.summaries import snapshot
from spanwise.plans import study
from spanwise.session import materialise
from spanwise.sources.cdm import OPTIONAL_TABLES, REQUIRED_TABLES, Cdm
from spanwise.sources.fixtures import STUDY, fixture_cdm

SMALL = "/root/testdata/sf0.001"
SOURCE = ("A source", "v5.4")


def test_catalog_tables_with_a_prefix(spark, tmp_path):
    bound = fixture_cdm(spark, SMALL)
    spark.sql(f"CREATE DATABASE clinical LOCATION '{tmp_path}'")
    try:
        for table in REQUIRED_TABLES:
            bound[table].limit(50).write.saveAsTable(f"clinical.own_{table}")
        columns = "cdm_source_name string, cdm_version string"
        spark.createDataFrame([SOURCE], columns).write.saveAsTable("clinical.own_cdm_source")
        cdm = Cdm.from_catalog(spark, "clinical", prefix="own_", name="hospital", date_fields=bound.date_fields)
        assert set(cdm.tables) == {*REQUIRED_TABLES, "cdm_source"}
        row = snapshot(cdm).first()
        assert (row["source_name"], row["cdm_version"], row["person_count"]) == (*SOURCE, 50)
    finally:
        spark.sql("DROP DATABASE clinical CASCADE")


def test_database_tables_are_sliced_by_person_only(spark, monkeypatch):
    """No database is started: the options given to the reader are looked at."""
    bound = fixture_cdm(spark, SMALL)
    seen = {}

    def jdbc(self, url, table, column=None, lowerBound=None, upperBound=None, numPartitions=None, properties=None):
        name = table.split(".")[1]
        seen[name] = (column, lowerBound, upperBound, numPartitions)
        return bound[name] if name in bound else spark.range(0)

    monkeypatch.setattr(DataFrameReader, "jdbc", jdbc)
    Cdm.from_jdbc(spark, "jdbc:none", "clinical", (1, 900), 4, date_fields=bound.date_fields)
    assert set(seen) == {*REQUIRED_TABLES, *OPTIONAL_TABLES}
    assert all(v == ("person_id", 1, 900, 4) for t, v in seen.items() if t in REQUIRED_TABLES)
    assert all(v == (None,) * 4 for t, v in seen.items() if t in OPTIONAL_TABLES)


def test_a_definition_without_periods_leaves_no_settings(spark):
    cdm = fixture_cdm(spark, SMALL)
    rows = study.all_definitions(cdm, STUDY).filter("mode <> 'impatient'")
    modes = study.present(rows)
    assert len(modes) == 12 and "impatient" not in modes
    result = study.in_observation_result(study.in_observation(rows, cdm), cdm, modes)
    assert {r["mode"] for r in result.settings.collect()} == set(modes)
    assert result.settings.join(result.rows.select("result_id").distinct(), "result_id", "left_anti").isEmpty()


def test_without_periods_no_record_is_counted_and_nothing_is_planned(spark, make_cdm, monkeypatch):
    """The snapshot alone is left, and finding that takes neither the records nor their outcomes."""
    cdm = make_cdm(
        person=[(1, 8507, 1980, 1, 1)],
        drug_exposure=[(1, 1, day("2010-01-01"), None)],
        observation_period=[(7, 1, day("2010-01-01"), day("2010-12-31"), 0)],
    )
    written = []
    monkeypatch.setattr(features, "materialise", lambda df, name: (written.append(name), materialise(df, name))[1])
    nobody = periods.all_definitions(cdm, STUDY).filter("mode IS NULL")
    outcomes = study.outcome_cohorts(cdm, STUDY)
    result = study.study_result(study.characterise(nobody, cdm, STUDY, outcomes), cdm, ())
    assert written == []
    assert {r["variable_name"] for r in result.rows.collect()} == {"person", "observation_period", "cdm"}
    planned = result.rows._jdf.queryExecution().optimizedPlan().toString()
    # Those of the snapshot, over persons and periods.
    assert planned.count("Aggregate [") == 2


def test_features_are_written_before_their_tables_read_them(spark, make_cdm, monkeypatch):
    cdm = make_cdm(
        person=[(1, 8507, 1980, 1, 1)], observation_period=[(7, 1, day("2010-01-01"), day("2010-12-31"), 0)]
    )
    written = []
    monkeypatch.setattr(study, "materialise", lambda df, name: (written.append(name), materialise(df, name))[1])
    spans = periods.all_definitions(cdm, STUDY)
    tables = study.characterise(spans, cdm, STUDY, study.outcome_cohorts(cdm, STUDY))
    assert written == ["features"]
    assert [(r["mode"], r["number_records"]) for r in tables.sizes.collect()] == [("original_data", 1)]


def test_a_study_writes_its_tables_one_by_one(spark, make_cdm, monkeypatch, tmp_path):
    """Incidence goes before the features are on the disks."""
    cdm = make_cdm(
        person=[(1, 8507, 1980, 1, 1)], observation_period=[(7, 1, day("2010-01-01"), day("2010-12-31"), 0)]
    )
    written = []
    monkeypatch.setattr(study, "materialise", lambda df, name: (written.append(name), materialise(df, name))[1])
    study.run_study(cdm, STUDY, str(tmp_path))
    assert written[:3] == ["periods", "outcomes", "incidence"]
    assert set(written[3:]) == {"in_observation", "per_person", "features", "numeric", "categorical", "sizes"}
    assert written.index("per_person") < written.index("features") < written.index("numeric")
