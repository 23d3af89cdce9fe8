import datetime as dt

import pytest
from tables import day, rows_of
from pyspark.sql import functions as F

from checks.queries import QUERIES
from spanwise.config import StudyConfig
from spanwise.functions.dates import add_years, age_at, age_band
from spanwise.operators import periods as P
from spanwise.plans.study import publish_periods
from spanwise.sources.cdm import Cdm
from spanwise.sources.fixtures import STUDY, fixture_cdm

CUT = dt.date(2024, 1, 20)

# Periods, persons and person-days of each definition on the sf0.01 tables.
GOLDEN = {
    "original_data": (2000, 1500, 3653000),
    "min_extract": (1484, 1484, 15021653),
    "min_max": (1500, 1500, 4702679),
    "impatient": (9817, 1496, 79270),
    "persistence_0_surveillanceFALSE": (52349, 1500, 1046838),
    "persistence_180_surveillanceFALSE": (3339, 1500, 3129731),
    "persistence_180_surveillanceTRUE": (3339, 1500, 3691691),
    "persistence_365_surveillanceFALSE": (1775, 1500, 3494983),
    "persistence_365_surveillanceTRUE": (1775, 1500, 4063653),
    "persistence_545_surveillanceFALSE": (1665, 1500, 3542466),
    "persistence_545_surveillanceTRUE": (1665, 1500, 4331626),
    "persistence_730_surveillanceFALSE": (1648, 1500, 3552761),
    "persistence_730_surveillanceTRUE": (1648, 1500, 4597391),
}


def test_golden_counts(spark):
    table = QUERIES["definition_totals"](spark, "/root/testdata/sf0.01").collect()
    assert {r["mode"]: (r["periods"], r["persons"], r["person_days"]) for r in table} == GOLDEN


def test_all_definitions_agree_with_each_alone(spark):
    cdm = fixture_cdm(spark, "/root/testdata/sf0.001")
    whole = P.all_definitions(cdm, STUDY)
    alone = {
        "min_extract": P.first_to_extract(cdm, CUT, 150),
        "min_max": P.first_to_last(cdm, CUT),
        "persistence_365_surveillanceTRUE": P.persistence_periods(cdm, CUT, [(365, True)]),
    }
    for mode, spans in alone.items():
        same = whole.filter(F.col("mode") == mode)
        assert rows_of(same, *P.SPAN) == rows_of(spans, *P.SPAN), mode


@pytest.mark.parametrize(
    ("options", "mode"),
    [
        ({"collapse_era": None, "persistence_window": None}, "min_extract"),
        ({"collapse_era": 180, "persistence_window": 0}, "persistence_180_surveillanceFALSE"),
        ({"collapse_era": 0, "persistence_window": 180}, "persistence_180_surveillanceTRUE"),
    ],
)
def test_builder_covers_the_definitions(spark, options, mode):
    cdm = fixture_cdm(spark, "/root/testdata/sf0.001")
    built = P.build_periods(cdm, CUT, **options)
    whole = P.all_definitions(cdm, STUDY).filter(F.col("mode") == mode)
    assert rows_of(built, *P.SPAN) == rows_of(whole, *P.SPAN)


def test_censoring(make_cdm, spans):
    cdm = make_cdm(death=[(1, day("2000-04-01")), (2, day("2000-05-01")), (3, day("2000-06-15")), (3, day("2000-07-01"))])
    given = spans(
        (1, "2000-05-01", "2000-06-01"),
        (2, "2000-05-01", "2000-06-01"),
        (3, "2000-05-01", "2000-12-01"),
        (4, "2000-05-01", "2030-01-01"),
        (5, "2000-05-01", None),
        (3, "2000-05-01", None),
    )
    assert rows_of(P.censor(given, cdm, CUT)) == [
        (2, day("2000-05-01"), day("2000-05-01")),
        (3, day("2000-05-01"), day("2000-06-15")),
        (4, day("2000-05-01"), CUT),
    ]


def test_min_max_needs_an_end(make_cdm):
    cdm = make_cdm(
        condition_occurrence=[(1, day("2000-01-01"), None), (1, day("2001-01-01"), None), (2, day("2000-01-01"), None)],
        measurement=[(2, day("2000-03-01"))],
    )
    assert rows_of(P.first_to_last(cdm, CUT)) == [(2, day("2000-01-01"), day("2000-03-01"))]


def test_min_extract_needs_a_birth_date(make_cdm):
    cdm = make_cdm(
        measurement=[(1, day("2000-03-01")), (2, day("2000-03-01"))],
        person=[(2, 8507, 1990, None, None)],
    )
    assert rows_of(P.first_to_extract(cdm, CUT, 20)) == [(2, day("2000-03-01"), day("2010-01-01"))]
    config = StudyConfig(CUT, censor_age=20)
    found = P.all_definitions(cdm, config).filter("mode = 'min_extract'")
    assert rows_of(found, *P.SPAN) == [(2, day("2000-03-01"), day("2010-01-01"))]


def test_inpatient_stays_are_repaired_and_not_censored(make_cdm):
    cdm = make_cdm(
        visit_occurrence=[
            (1, 9201, day("2000-01-01"), day("2000-01-05")),
            (1, 262, day("2000-01-05"), day("2000-01-02")),
            (1, 9202, day("2000-01-06"), day("2000-02-05")),
            (2, 262, day("2030-01-01"), None),
        ],
        death=[(1, day("1999-01-01"))],
    )
    assert rows_of(P.inpatient_periods(cdm)) == [
        (1, day("2000-01-01"), day("2000-01-05")),
        (2, day("2030-01-01"), day("2030-01-01")),
    ]


def test_published_ids_are_dense_and_repeatable(spark):
    cdm = fixture_cdm(spark, "/root/testdata/sf0.001")
    whole = P.all_definitions(cdm, STUDY)
    mode = "persistence_0_surveillanceFALSE"
    table = publish_periods(whole, mode)
    ids = [r[0] for r in rows_of(table, "observation_period_id")]
    assert sorted(ids) == list(range(1, len(ids) + 1))
    assert rows_of(table) == rows_of(publish_periods(whole, mode).repartition(3))
    kept = publish_periods(whole, "original_data")
    assert set(rows_of(kept, "observation_period_id", "person_id")) == set(
        rows_of(cdm["observation_period"], "observation_period_id", "person_id")
    )


def test_ages(spark):
    born, index = day("2000-02-29"), [day("2001-02-28"), day("2001-03-01"), day("1999-01-01")]
    frame = spark.createDataFrame([(born, d) for d in index], "born date, at date")
    age = age_at(F.col("born"), F.col("at"))
    labels = age_band(age, [(0, 0), (1, None)])
    assert [tuple(r) for r in frame.select(age, labels).collect()] == [
        (0, "0 to 0"),
        (1, "1 or above"),
        (-2, "None"),
    ]
    assert frame.select(add_years(F.col("born"), F.lit(150))).first()[0] == day("2150-02-28")


def test_bad_arguments(make_cdm, spark):
    with pytest.raises(TypeError):
        StudyConfig("2020-01-01")
    with pytest.raises(ValueError):
        P.build_periods(make_cdm(), CUT, ["unknown_table"])
    with pytest.raises(ValueError):
        make_cdm().from_tables(spark, {})


def test_binding_from_folders(spark, make_cdm, tmp_path):
    cdm = make_cdm(measurement=[(1, day("2000-03-01"))])
    for name, table in cdm.tables.items():
        table.write.parquet(str(tmp_path / f"{name}.parquet"))
    bound = Cdm.from_parquet(spark, str(tmp_path), name="files")
    assert rows_of(bound["measurement"]) == [(1, day("2000-03-01"))]
    assert "cdm_source" not in bound and "concept" in bound
    with pytest.raises(ValueError, match="missing tables"):
        Cdm.from_parquet(spark, str(tmp_path / "nowhere"))
    with pytest.raises(KeyError):
        bound["unknown"]


def test_dirty_source_periods_hold_no_person_time(make_cdm):
    """Inverted, open-ended and person-less periods stay in the table and hold no days."""
    from spanwise.operators.person_time import in_observation

    cdm = make_cdm(
        person=[(1, 8507, 1980, 1, 1)],
        observation_period=[
            (1, 1, day("2001-03-01"), day("1999-06-01"), 0),
            (2, 1, day("2002-01-01"), None, 0),
            (3, 1, day("2003-01-01"), day("2003-01-10"), 0),
            (4, None, day("2003-01-01"), day("2003-01-10"), 0),
        ],
    )
    spans = P.original_periods(cdm).withColumn("mode", F.lit("original_data"))
    assert spans.count() == 4
    table = in_observation(spans.filter("person_id IS NOT NULL"), cdm).filter("sex = 'overall' AND age_group = 'overall'")
    assert [(r["year"], r["records"], r["person_days"]) for r in table.collect()] == [(2003, 1, 10)]
    numbered = P.number_periods(spans, buckets=7)
    assert sorted(r["observation_period_id"] for r in numbered.collect()) == [1, 2, 3, 4]
