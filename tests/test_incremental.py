"""Data cuts made from the last one against cuts made anew."""

import dataclasses

import pytest
from pyspark.sql import functions as F
from tables import day, rows_of

from checks.queries import before_the_last_week
from spanwise.config import StudyConfig
from spanwise.plans import incremental
from spanwise.sources.fixtures import STUDY, fixture_cdm

SMALL = "/root/testdata/sf0.001"
CONFIG = StudyConfig(data_end_date=day("2024-01-20"))


def visit(person, start, end=None, kind=9201):
    return (person, kind, day(start), day(end or start))


VISITS = [visit(p, f"200{p}-01-01", f"200{p}-02-01") for p in range(1, 8)] + [visit(None, "2001-01-01")]
PEOPLE = [(p, 8507, 1950, 1, 1) for p in range(1, 8)]
PERIODS = [(p, p, day("2000-01-01"), day("2010-01-01"), 0) for p in range(1, 8)]


@pytest.fixture
def tables(make_cdm):
    def build(visits=VISITS, people=PEOPLE, periods=PERIODS, **more):
        return make_cdm(visit_occurrence=visits, person=people, observation_period=periods, **more)

    return build


def changed(before, now, config=CONFIG, later=CONFIG):
    digests = [incremental.person_digests(c, s) for c, s in ((before, config), (now, later))]
    return {r["person_id"] for r in incremental.changed_persons(*digests).collect()}


def test_whose_digests_differ(tables):
    before = tables()
    later = [v for v in VISITS if v[0] != 1]
    assert changed(before, tables(visits=VISITS[::-1], people=PEOPLE[::-1])) == set()
    assert changed(before, tables(visits=[*VISITS, VISITS[2]])) == {3}
    assert changed(before, tables(visits=[*later, visit(1, "2001-01-01", "2001-02-01", 262)])) == {1}
    assert changed(before, tables(visits=[*later, (1, 9201, day("2001-01-01"), None)])) == {1}
    assert changed(before, tables(visits=[*VISITS, visit(None, "2009-01-01"), visit(30, "2009-01-01")])) == {None, 30}
    assert changed(before, tables(people=PEOPLE[1:], periods=PERIODS[:-1])) == {1, 7}
    assert changed(before, tables(people=[*PEOPLE[1:], (1, 8507, 1950, None, 1)])) == {1}
    assert changed(before, tables(death=[(4, day("2006-01-01"))])) == {4}
    everyone = {None, *range(1, 8)}
    assert changed(before, before, later=dataclasses.replace(CONFIG, censor_age=90)) == everyone
    assert changed(before, tables([], [], [])) == everyone == changed(tables([], [], []), before)
    assert changed(tables([], [], []), tables([], [], [])) == set()


def test_a_row_is_not_taken_for_one_of_another_table_or_field(make_cdm):
    date = day("2001-01-01")
    only = [{"measurement": [(1, date)]}, {"observation": [(1, date)]}, {"condition_occurrence": [(1, date, None)]}, {"condition_occurrence": [(1, None, date)]}]
    cuts = [make_cdm(**rows) for rows in only]
    digests = {incremental.person_digests(c, CONFIG).first()["digest"] for c in cuts}
    assert len(digests) == len(only)


def test_next_cut_equals_a_cut_made_anew(tables):
    before = tables()
    visits = [*VISITS[1:], visit(2, "2003-05-01"), visit(40, "2004-01-01"), visit(None, "2002-01-01"), visit(6, "2006-03-03")]
    last = incremental.first_cut(before, CONFIG)
    for now in (tables(visits=visits, death=[(5, day("2005-01-10"))], people=PEOPLE[:-1]), before, tables([], [], [])):
        made, anew = incremental.next_cut(now, CONFIG, last), incremental.first_cut(now, CONFIG)
        assert rows_of(made.periods) == rows_of(anew.periods, *made.periods.columns)
        assert rows_of(made.digests) == rows_of(anew.digests)
        last = made


def test_only_changed_persons_go_through_the_definitions(spark):
    """What enters the definitions: rows of persons with records in the last week, and of nobody else."""
    cdm = fixture_cdm(spark, SMALL)
    before = before_the_last_week(cdm)
    digests = [incremental.person_digests(c, STUDY) for c in (before, cdm)]
    persons = incremental.changed_persons(*digests)
    late = {
        r["person_id"]
        for t in ("visit_occurrence", "measurement", "condition_occurrence", "procedure_occurrence", "device_exposure", "observation", "drug_exposure", "death")
        for r in cdm[t].join(before[t], ["person_id"], "left_anti").unionByName(cdm[t].exceptAll(before[t])).select("person_id").distinct().collect()
    }
    assert {r["person_id"] for r in persons.collect()} == late
    few = incremental.of_persons(cdm, persons.orderBy("person_id").limit(3))
    for table in ("visit_occurrence", "person", "observation_period"):
        assert few[table].select("person_id").distinct().count() <= 3
    assert few["concept"].count() == cdm["concept"].count()
    assert few["measurement"].filter(F.col("person_id").isNull()).isEmpty()
