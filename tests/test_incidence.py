import datetime as dt
import os
import random
import subprocess
import sys
from collections import defaultdict

import pytest
from tables import day, rows_of
from pyspark import cloudpickle
from pyspark.sql import functions as F

from spanwise.functions import poisson
from spanwise.functions.poisson import poisson_limits
from spanwise.operators import cohorts
from spanwise.operators import incidence as incidence_operator
from spanwise.operators.incidence import incidence, with_rates

FOLLOW = "mode string, person_id long, sex string, age_group string, start_date date, end_date date"
OUTCOME = "outcome string, person_id long, start_date date, end_date date"


@pytest.mark.parametrize(
    ("n", "lower", "upper"),
    [
        (0, 0, 3.68888),
        (1, 0.02532, 5.57164),
        (2, 0.24221, 7.22469),
        (5, 1.62349, 11.66833),
        (10, 4.79539, 18.39036),
        (50, 37.11096, 65.91877),
    ],
)
def test_exact_limits(n, lower, upper):
    assert poisson_limits(n) == pytest.approx((lower, upper), abs=1e-5)


def test_limits_of_large_counts():
    lower, upper = poisson_limits(1_000_000)
    assert (1_000_000 - lower) == pytest.approx(1959.0, abs=1)
    assert (upper - 1_000_000) == pytest.approx(1961.9, abs=1)


def at_risk_days(events, washout, repeated, span):
    """Days at risk and events inside ``span``, day by day."""
    days, happened = 0, 0
    eras = []
    for start, end in sorted(events):
        if eras and start <= eras[-1][1] + dt.timedelta(washout):
            eras[-1][1] = max(eras[-1][1], end)
        else:
            eras.append([start, end])
    current = span[0]
    while current <= span[1]:
        if repeated:
            resting = any(a < current <= b + dt.timedelta(washout) for a, b in eras)
        else:
            resting = bool(eras) and current > eras[0][0]
        starts = [a for a, _ in (eras if repeated else eras[:1])]
        days += not resting
        happened += not resting and current in starts
        current += dt.timedelta(1)
    return days, happened


@pytest.mark.parametrize(("washout", "repeated"), [(30, True), (0, True), (30, False)])
def test_against_every_single_day(spark, washout, repeated):
    rng = random.Random(washout + repeated)
    origin = dt.date(2011, 6, 1)
    follow, outcomes = [], []
    for person in range(25):
        sex = rng.choice(["Male", "Female", "None"])
        start = origin
        for _ in range(rng.randint(1, 3)):
            start += dt.timedelta(rng.randint(1, 200))
            end = start + dt.timedelta(rng.randint(0, 400))
            for mode in rng.sample(["x", "y"], rng.randint(1, 2)):
                follow.append((mode, person, sex, "0 to 150", start, end))
            start = end
        for name in ("one", "two"):
            for _ in range(rng.choice([0, 0, 1, 4])):
                begun = origin + dt.timedelta(rng.randint(-100, 900))
                outcomes.append((name, person, begun, begun + dt.timedelta(rng.randint(0, 40))))
    events = defaultdict(list)
    for name, person, a, b in outcomes:
        events[name, person].append((a, b))
    wanted = defaultdict(lambda: [set(), 0, 0])
    for mode, person, sex, _, a, b in follow:
        for name in ("one", "two", "three"):
            for year in [None, *range(a.year, b.year + 1)]:
                span = (a, b) if year is None else (max(a, dt.date(year, 1, 1)), min(b, dt.date(year, 12, 31)))
                days, happened = at_risk_days(events[name, person], washout, repeated, span)
                for group in {"Both", sex} - {"None"}:
                    cell = wanted[mode, name, group, year]
                    cell[0] |= {person} if days else set()
                    cell[1] += days
                    cell[2] += happened
    table = incidence(
        spark.createDataFrame(follow, FOLLOW),
        spark.createDataFrame(outcomes, OUTCOME),
        ["one", "two", "three"],
        washout=washout,
        repeated=repeated,
    )
    found = {
        (r["mode"], r["outcome"], r["sex"], r["year"]): (r["denominator_count"], r["person_days"], r["outcome_count"])
        for r in table.collect()
    }
    assert found == {k: (len(v[0]), v[1], v[2]) for k, v in wanted.items()}


def test_washout_edge(spark):
    follow = spark.createDataFrame([("x", 1, "Male", "0 to 150", day("2012-01-01"), day("2012-12-31"))], FOLLOW)
    for next_start, wanted in (("2012-03-01", 1), ("2012-03-02", 2)):
        rows = [("one", 1, day("2012-01-20"), day("2012-01-31")), ("one", 1, day(next_start), day(next_start))]
        table = incidence(follow, spark.createDataFrame(rows, OUTCOME), ["one"], intervals=["overall"])
        # 31 January plus 30 days is 1 March in a leap year.
        assert {r["outcome_count"] for r in table.collect()} == {wanted}


def test_complete_years(spark):
    rows = [("x", 1, "Male", "0 to 150", day("2012-03-01"), day("2014-12-31"))]
    none = spark.createDataFrame([], OUTCOME)
    table = incidence(spark.createDataFrame(rows, FOLLOW), none, ["one"], intervals=["years"], complete_intervals=True)
    assert {r["year"] for r in table.collect()} == {2013, 2014}


def test_rate_and_limits(spark):
    table = spark.createDataFrame([(2, 1000.0), (0, 0.0)], "outcome_count long, person_years double")
    rows = with_rates(table).orderBy(F.desc("outcome_count")).collect()
    assert rows[0]["incidence_100000_pys"] == pytest.approx(200)
    assert rows[0]["incidence_100000_pys_95CI_lower"] == pytest.approx(24.2209, abs=1e-3)
    assert rows[1]["incidence_100000_pys"] is None


def test_denominator(spark, make_cdm):
    cdm = make_cdm(person=[(1, 8532, 2000, 6, 15), (2, 1, 1990, None, None), (3, 8507, None, None, None)])
    periods = spark.createDataFrame(
        [("m", p, day("2019-01-01"), day("2020-12-31"), None) for p in (1, 2, 3)],
        "mode string, person_id long, start_date date, end_date date, period_id long",
    )
    follow = cohorts.followed_bands(periods, cdm, [(0, 150), (0, 19), (20, 39)], study_start=day("2019-02-01"), days_prior=10)
    assert rows_of(follow, "person_id", "age_group", "start_date", "end_date") == [
        (1, "0 to 150", day("2019-02-01"), day("2020-12-31")),
        (1, "0 to 19", day("2019-02-01"), day("2020-06-14")),
        (1, "20 to 39", day("2020-06-15"), day("2020-12-31")),
        (2, "0 to 150", day("2019-02-01"), day("2020-12-31")),
        (2, "20 to 39", day("2019-02-01"), day("2020-12-31")),
    ]
    each = cohorts.denominator_cohorts(follow, [(0, 150), (0, 19), (20, 39)])
    found = rows_of(each.filter("age_group = '0 to 150'"), "subject_id", "sex", "cohort_definition_id")
    assert found == [(1, "Both", 1), (1, "Female", 2), (2, "Both", 1)]


def test_outcomes_start_in_an_original_period(make_cdm):
    cdm = make_cdm(
        concept=[(9, "Amoxy", "Ingredient"), (8, "Amoxy", "Clinical Drug")],
        concept_ancestor=[(9, 9), (9, 11), (8, 12)],
        drug_exposure=[
            (1, 11, day("2000-01-01"), day("2000-01-05")),
            (1, 9, day("2000-01-06"), None),
            (1, 11, day("2000-01-08"), day("2000-01-01")),
            (1, 11, day("2001-01-08"), day("2001-01-09")),
            (1, 12, day("2000-05-01"), None),
        ],
        observation_period=[(1, 1, day("2000-01-01"), day("2000-12-31"), 0)],
    )
    codes = cohorts.ingredient_codelist(cdm, ["amoxy"])
    # The codelist has the name it was asked for by.
    assert rows_of(codes) == [("amoxy", 11), ("amoxy", 9)]
    eras = cohorts.drug_outcomes(cdm, codes, gap_era=1)
    assert rows_of(eras, "outcome", "start_date", "end_date") == [
        ("amoxy", day("2000-01-01"), day("2000-01-06")),
        ("amoxy", day("2000-01-08"), day("2000-01-08")),
    ]
    spark = eras.sparkSession
    follow = spark.createDataFrame([("m", 1, "Male", "0 to 150", day("2000-01-01"), day("2000-12-31"))], FOLLOW)
    table = incidence(follow, eras, ["amoxy"], washout=0, intervals=["overall"])
    both = table.filter("sex = 'Both'").first()
    assert (both["outcome_count"], both["person_days"], both["year"]) == (2, 366 - 5, None)
    with pytest.raises(Exception, match="not asked for"):
        incidence(follow, eras, ["Amoxy"], washout=0).collect()


def test_exposures_of_a_person_with_many_periods(make_cdm):
    """Nested, inverted and open-ended periods; an exposure needs one that holds it."""
    first = day("2000-01-01")
    spans = [(i, 1, first + dt.timedelta(i), first + dt.timedelta(i + 1), 0) for i in range(0, 2000, 4)]
    spans += [(9000, 1, day("2010-01-01"), day("2009-01-01"), 0), (9001, 1, day("2011-01-01"), None, 0)]
    drugs = [(1, 9, first + dt.timedelta(i), None) for i in range(0, 2000)]
    drugs += [(1, 9, day("2009-06-01"), None), (1, 9, day("2011-02-01"), None)]
    cdm = make_cdm(
        concept=[(9, "Amoxy", "Ingredient")],
        concept_ancestor=[(9, 9)],
        drug_exposure=drugs,
        observation_period=spans,
    )
    eras = cohorts.drug_outcomes(cdm, cohorts.ingredient_codelist(cdm, ["Amoxy"]), gap_era=0)
    # Two days of each four are covered; eras that share no day stay apart.
    wanted = [first + dt.timedelta(i + k) for i in range(0, 2000, 4) for k in (0, 1)]
    assert sorted(r[0] for r in rows_of(eras, "start_date")) == wanted


def test_incidence_of_a_person_with_very_many_periods(spark):
    """Rows grow with periods plus events, not with their product."""
    first = dt.date(1990, 1, 1)
    follow = [
        ("m", 1, "Male", "0 to 150", first + dt.timedelta(i % 5000), first + dt.timedelta(i % 5000 + 20))
        for i in range(10_000)
    ]
    events = [("one", 1, first + dt.timedelta(5 * i), first + dt.timedelta(5 * i)) for i in range(1_000)]
    periods, outcomes = spark.createDataFrame(follow, FOLLOW), spark.createDataFrame(events, OUTCOME)
    table = incidence(periods, outcomes, ["one"], washout=1, intervals=["overall"])
    row = table.filter("sex = 'Both'").first()
    days = {dt.timedelta(5 * i + 1) + first for i in range(1_000)}
    wanted_days = sum(
        sum((a + dt.timedelta(k)) not in days for k in range(21)) for *_, a, _ in follow
    )
    starts = {dt.timedelta(5 * i) + first for i in range(1_000)}
    wanted_events = sum(sum((a + dt.timedelta(k)) in starts for k in range(21)) for *_, a, _ in follow)
    assert (row["person_days"], row["outcome_count"]) == (wanted_days, wanted_events)
    knots = incidence_operator._knots(incidence_operator.events_and_rest(outcomes, 1), ["one"])
    # A person has a state a day at most, however many periods read it.
    states = incidence_operator._states(periods, knots, 1, by_year=False)
    assert knots.count() <= 2_000 and states.count() <= 5_021
    assert states.select("person_id", "day").distinct().count() == states.count()
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_limits_travel_without_the_package(tmp_path):
    """Executors need not have the package: the function is pickled whole."""
    target = tmp_path / "function"
    target.write_bytes(cloudpickle.dumps(poisson._limits.func))
    code = (
        "import pickle, sys, pandas as pd;"
        "f = pickle.load(open(sys.argv[1], 'rb'));"
        "print(f(pd.Series([0, 5]))['upper'].round(5).tolist())"
    )
    run = subprocess.run(
        [sys.executable, "-c", code, str(target)],
        cwd=tmp_path,
        env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"},
        capture_output=True,
        text=True,
        check=False,
    )
    assert run.stdout.strip() == "[3.68888, 11.66833]", run.stderr


def test_states_of_persons_are_never_sent_to_the_driver(spark):
    follow_up = spark.createDataFrame(
        [("a", p, "Male", "all", dt.date(2012, 1, 1), dt.date(2013, 5, 1)) for p in range(5)], FOLLOW
    )
    outcomes = spark.createDataFrame([("x", 1, dt.date(2012, 3, 1), dt.date(2012, 3, 2))], OUTCOME)
    knots = incidence_operator._knots(incidence_operator.events_and_rest(outcomes, 30), ["x"])
    followed = incidence_operator._followed(follow_up, knots, 1, ("years", "overall"))
    assert followed.count() == 15
    followed.collect()
    plan = followed._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") >= 2
    assert "BroadcastHashJoin" not in plan
