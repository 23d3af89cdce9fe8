import datetime as dt
import random
import re

import numpy as np
import pytest
from tables import day, rows_of
from pyspark.sql import functions as F

from spanwise.config import AGE_BANDS
from spanwise.operators import features, summaries
from spanwise.operators.density import density
from spanwise.operators.person_time import in_observation
from spanwise.operators.quantiles import numeric_estimates

PERIOD = "mode string, person_id long, start_date date, end_date date, period_id long"


PERIOD_COLUMNS = ("mode", "person_id", "start_date", "end_date", "period_id")


def periods_of(spark, rows, sourced=False):
    data = [(m, p, day(a), day(b), i if sourced else None) for i, (m, p, a, b) in enumerate(rows)]
    return spark.createDataFrame(data, PERIOD)


@pytest.mark.parametrize("sourced", [True, False])
def test_records_are_counted_like_a_join(spark, make_cdm, sourced):
    rng = random.Random(3)
    origin = dt.date(2010, 1, 1)

    def some_day():
        return origin + dt.timedelta(rng.randint(0, 200))

    tables = {
        "drug_exposure": [(rng.randint(1, 8), 1, some_day(), None) for _ in range(400)],
        "condition_occurrence": [(rng.randint(1, 8), some_day(), None) for _ in range(50)],
        "visit_occurrence": [(rng.randint(1, 8), 9201, some_day(), None) for _ in range(200)],
    }
    # Overlapping and equal periods, as a source table may hold.
    spans = []
    for i in range(90):
        start = some_day()
        spans.append((rng.choice("ab"), rng.randint(1, 9), start, start + dt.timedelta(rng.randint(0, 60)), i))
    if sourced:
        spans.append((*spans[0][:4], 1000))
    else:
        spans = [(*s[:4], None) for s in spans]
    frame = spark.createDataFrame(spans, PERIOD)
    found = {
        tuple(r[c] for c in PERIOD_COLUMNS): (r["number_drugs"], r["number_conditions"], r["number_visits"])
        for r in features.records_in_periods(frame, make_cdm(**tables)).collect()
    }

    def inside(rows, position, span):
        n = sum(r[0] == span[1] and span[2] <= r[position] <= span[3] for r in rows)
        return n or None

    assert found == {
        s: (
            inside(tables["drug_exposure"], 2, s),
            inside(tables["condition_occurrence"], 1, s),
            inside(tables["visit_occurrence"], 2, s),
        )
        for s in spans
    }


@pytest.mark.parametrize("sourced", [True, False])
def test_next_period(spark, sourced):
    rows = [("a", 1, "2000-01-01", "2000-01-10"), ("a", 1, "2000-03-01", "2000-03-01"), ("b", 1, "2000-02-01", "2000-02-01")]
    frame = periods_of(spark, rows, sourced)
    found = features.with_next(frame)
    assert rows_of(found, "mode", "start_date", "time_to_next_observation", "gap_to_next") == [
        ("a", day("2000-01-01"), 60, 51),
        ("a", day("2000-03-01"), None, None),
        ("b", day("2000-02-01"), None, None),
    ]


def test_next_of_periods_that_start_together(spark):
    rows = [("a", 1, "2000-01-01", "2000-01-10"), ("a", 1, "2000-01-01", "2000-01-05"), ("a", 1, "2000-01-01", "2000-01-10"), ("a", 1, "2000-02-01", "2000-02-01")]
    found = features.with_next(periods_of(spark, rows, sourced=True))
    assert rows_of(found, "period_id", "time_to_next_observation") == [(0, 0), (1, 0), (2, 31), (3, None)]


def test_duration_and_unknown_person(spark, make_cdm):
    frame = periods_of(spark, [("a", 1, "2000-01-01", "2000-01-01")])
    row = features.period_features(frame, make_cdm()).first()
    assert (row["duration"], row["sex"], row["age_group_start"], row["drugs_per_day"]) == (1, "None", "None", None)


def test_person_days_add_up(spark, make_cdm):
    people = [(p, 8507 if p % 2 else 8532, 1950 + p, 5, None) for p in range(10)]
    rows = [("a", p, f"200{p}-06-01", f"201{p}-02-03") for p in range(10)]
    frame = periods_of(spark, rows)
    table = in_observation(frame, make_cdm(person=people))
    total = sum((day(b) - day(a)).days + 1 for _, _, a, b in rows)
    sums = {
        key: table.filter(condition).agg(F.sum("person_days")).first()[0]
        for key, condition in {
            "all": "sex = 'overall' and age_group = 'overall'",
            "by sex": "sex <> 'overall' and age_group = 'overall'",
            "by age": "sex = 'overall' and age_group <> 'overall'",
            "by both": "sex <> 'overall' and age_group <> 'overall'",
        }.items()
    }
    assert set(sums.values()) == {total}
    shares = table.filter("sex = 'overall' and age_group = 'overall'")
    assert shares.agg(F.sum("person_days_percentage")).first()[0] == pytest.approx(100)


def test_person_time_against_every_year_of_every_period(spark, make_cdm):
    """Bands change on birthdays, periods last up to a century, and some people have no birth date."""
    rng = random.Random(12)
    people, rows = [], []
    for p in range(60):
        year = rng.choice([None, rng.randint(1890, 2010)])
        people.append((p, rng.choice([8507, 8532, 0]), year, rng.choice([None, 1, 2, 12]), rng.choice([None, 1, 2, 28])))
        for _ in range(rng.randint(0, 4)):
            start = dt.date(1900, 1, 1) + dt.timedelta(rng.choice([0, 365, 59 + rng.randrange(40_000)]))
            end = start + dt.timedelta(rng.choice([-1, 0, 1, 364, 365, 366, rng.randrange(36_500)]))
            rows.append(("a" if p % 3 else "b", p, str(start), str(end)))
    rows += [("a", 0, "2004-01-01", "2004-12-31"), ("a", 0, "2004-12-31", "2005-01-01"), ("c", 999, "1999-06-01", "2003-02-01")]
    births = {p: y and dt.date(y, m or 1, d or 1) for p, _, y, m, d in people}
    sexes = {p: {8507: "Male", 8532: "Female"}.get(g, "None") for p, g, *_ in people}
    frame, cdm = periods_of(spark, rows), make_cdm(person=people)
    # Bands in no order, with a gap, and one inside another.
    for bands in (AGE_BANDS, ((40, 59), (0, 0), (1, 17), (10, 30), (70, None)), ((5, 9),)):
        wanted = {}
        for mode, person, a, b in rows:
            start, end = day(a), day(b)
            for year in range(start.year, end.year + 1 if start <= end else 0):
                first, last = max(start, dt.date(year, 1, 1)), min(end, dt.date(year, 12, 31))
                birth = births.get(person)
                age = birth and first.year - birth.year - ((first.month, first.day) < (birth.month, birth.day))
                names = (f"{low} or above" if high is None else f"{low} to {high}" for low, high in bands if birth and low <= age and (high is None or age <= high))
                cell = wanted.setdefault((mode, year, sexes.get(person, "None"), next(names, "None")), [0, 0])
                cell[0] += 1
                cell[1] += (last - first).days + 1
        found = in_observation(frame, cdm, bands).filter("sex <> 'overall' AND age_group <> 'overall'")
        assert {tuple(r)[:4]: list(r)[4:6] for r in found.collect()} == wanted


def test_estimates_match_numpy(spark):
    rng = np.random.default_rng(11)
    groups = {
        "even": rng.integers(-50, 50, 3001).astype(float),
        "skewed": np.concatenate([np.full(2000, 7.0), rng.lognormal(0, 6, 1000)]),
        "near": 40_000 + rng.normal(0, 0.1, 500),
        "single": np.array([0.25]),
        "equal": np.full(40, 1 / 3),
        "pair": np.array([-1e-9, 4.0]),
    }
    data = [(k, float(v)) for k, values in groups.items() for v in values]
    frequencies = (
        spark.createDataFrame(data, "name string, value double")
        .groupBy("name", "value")
        .agg(F.count("*").alias("n"))
    )
    wanted = {"q05": 0.05, "q25": 0.25, "median": 0.5, "q75": 0.75, "top": 1.0}
    for row in numeric_estimates(frequencies, ["name"], wanted).collect():
        values = groups[row["name"]]
        for name, q in wanted.items():
            assert row[name] == pytest.approx(np.quantile(values, q), rel=1e-12, abs=1e-15)
        assert row["size"] == len(values)
        assert row["mean"] == pytest.approx(values.mean(), rel=1e-12)
        if len(values) == 1:
            assert row["sd"] is None
        else:
            assert row["sd"] == pytest.approx(values.std(ddof=1), rel=1e-7, abs=1e-12)


def test_categories_and_sizes(spark):
    rows = [("a", 1, "Male", "x", "y"), ("a", 1, "Female", "x", "z"), ("a", 2, "Male", "x", "z"), ("b", 1, "None", "x", "y")]
    frame = spark.createDataFrame(rows, "mode string, person_id long, sex string, age_group_start string, age_group_end string")
    table = summaries.categorical_summary(frame).filter("variable = 'sex'")
    assert rows_of(table, "mode", "level", "count") == [("a", "Female", 1), ("a", "Male", 2), ("b", "None", 1)]
    assert table.filter("mode = 'a' and level = 'Male'").first()["percentage"] == pytest.approx(200 / 3)
    assert rows_of(summaries.records_subjects(frame)) == [("a", 3, 2), ("b", 1, 1)]


def test_only_registered_persons_have_period_counts(spark, make_cdm):
    frame = periods_of(spark, [("a", 1, "2000-01-01", "2000-01-01"), ("a", 1, "2001-01-01", "2001-01-01"), ("a", 2, "2000-01-01", "2000-01-01")])
    cdm = make_cdm(person=[(1, 8507, 1980, 1, 1), (3, 8507, 1980, 1, 1)])
    assert rows_of(summaries.periods_per_person(frame, cdm), "mode", "person_id", "op_per_person") == [("a", 1, 2)]


def test_density_integrates_to_one(spark):
    rng = np.random.default_rng(2)
    data = [("m", "v", float(x)) for x in rng.gamma(2, 50, 800).round()]
    frequencies = spark.createDataFrame(data, "mode string, variable string, value double").groupBy("mode", "variable", "value").agg(F.count("*").alias("n"))
    table = density(frequencies, ["mode", "variable"]).toPandas().sort_values("point")
    assert len(table) == 512
    assert np.trapezoid(table["density_y"], table["density_x"]) == pytest.approx(1, abs=2e-3)


def test_counts_are_looked_up_at_the_bounds_of_source_periods_only(spark, make_cdm):
    """The kinds are told apart before the next start is looked for, and days between bounds are not shuffled on."""
    cdm = make_cdm(drug_exposure=[(1, 1, day("2010-01-01") + dt.timedelta(i), None) for i in range(50)])
    derived = [("a", 1, day("2010-01-01") + dt.timedelta(i), day("2010-02-01"), None) for i in range(9)]
    frame = spark.createDataFrame([*derived, ("b", 1, day("2010-01-03"), day("2010-01-10"), 7)], PERIOD)
    made = features.period_features(frame, cdm)
    assert {r["mode"]: r["number_drugs"] for r in made.collect()}["b"] == 8
    planned = made._jdf.queryExecution().optimizedPlan().toString()
    # Once for each kind; of the running counts, only those at bounds go on to the join.
    assert planned.count("lead(start_date") == 2
    assert len(re.findall(r"Filter .*turn#\d+ = 1", planned)) == 2
