"""Shapes of the plans that have to hold on large data."""

import re

import pytest

from checks.queries import QUERIES, all_periods
from spanwise.operators.incidence import incidence
from spanwise.operators.periods import record_eras
from spanwise.operators.records import record_days, record_sets, records
from spanwise.operators.cohorts import study_follow_up
from spanwise.plans.study import outcome_cohorts
from spanwise.sources.fixtures import STUDY, fixture_cdm

SMALL = "/root/testdata/sf0.001"


@pytest.fixture
def large_plans(spark):
    """Plans as for tables too large to broadcast."""
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, "-1")
    yield
    spark.conf.set(threshold, before)


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def exchanges(plan):
    return re.findall(r"Exchange (\w+)(?:\(([^)]*)\))?", re.sub(r"#\d+L?", "", plan))


@pytest.mark.parametrize(
    "name",
    [
        "visit_eras",
        "all_definitions",
        "period_features",
        "denominator_cohorts",
        "drug_outcome_eras",
        "periods_per_person",
    ],
)
def test_no_single_task_and_no_pairing_of_everything(spark, large_plans, name):
    plan = plan_of(QUERIES[name](spark, SMALL))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    assert "SinglePartition" not in plan


def test_definitions_read_and_shuffle_the_records_once(spark, large_plans):
    plan = plan_of(QUERIES["all_definitions"](spark, SMALL))
    # All records once, as sets of days; the stays once.
    assert len([k for _, k in exchanges(plan) if k.startswith("person_id, opens")]) == 1
    assert len([k for _, k in exchanges(plan) if k.startswith("person_id, start_date")]) == 1
    assert plan.count("lineitem.parquet") == 1
    # Nothing after the merge is shuffled by the person and the mode.
    assert not [k for _, k in exchanges(plan) if "mode" in k]


def test_merging_pre_aggregates_before_the_first_shuffle(spark, large_plans):
    plan = plan_of(record_eras(fixture_cdm(spark, SMALL)))
    assert re.search(r"Exchange hashpartitioning\(person_id#\d+L, opens#\d+.*\n.*partial_bit_or", plan)


def test_eras_shuffle_fewer_rows_than_person_days(spark):
    cdm = fixture_cdm(spark, SMALL)
    everything = records(cdm)
    assert record_sets(everything).count() < 0.7 * record_days(everything).count()


def test_split_follow_up_is_added_up_before_it_is_shuffled(spark, large_plans):
    cdm, spans = all_periods(spark, SMALL)
    table = incidence(study_follow_up(spans, cdm, STUDY), outcome_cohorts(cdm, STUDY), STUDY.ingredients)
    plan = plan_of(table)
    # Periods look states up by person and day, so those of one person are spread over its days.
    lookups = {k.split(", ")[1] for _, k in exchanges(plan) if re.match("person_id, (before|until)", k)}
    assert lookups == {"before", "until"}
    # The only window by person is over its distinct days, which are made out before they are shuffled.
    assert re.search(r"Exchange hashpartitioning\(person_id#\d+L, day.*\n.*HashAggregate\(keys=\[person_id", plan)
    windows = [line for line in plan.split("\n") if "Window" in line and "slope_0" in line]
    assert windows and all("mode" not in w and "age_group" not in w for w in windows)


def test_records_are_read_once_for_all_features(spark, large_plans):
    from spanwise.operators.features import daily_counts

    plan = plan_of(daily_counts(fixture_cdm(spark, SMALL)))
    assert plan.count("lineitem.parquet") == 1
    # The periods' features start from that table, written once; no record table is read again.
    assert "lineitem.parquet" not in plan_of(QUERIES["period_features"](spark, SMALL))


def test_bounds_of_derived_periods_are_not_shuffled(spark, large_plans):
    from spanwise.operators import features

    cdm, spans = all_periods(spark, SMALL)
    daily = features.materialise(features.daily_counts(cdm), "daily_counts")
    counted = features._count_along_bounds(features._next_in_order(spans.filter("period_id IS NULL")), daily)
    # Periods and days once each, and nothing above the bounds.
    keys = [k for _, k in exchanges(plan_of(counted))]
    assert len(keys) == 2 and all(k.startswith("person_id, ") and "mode" not in k for k in keys)
    assert "Exchange" not in plan_of(counted).split("Union")[0]


def test_exposures_are_not_joined_with_periods(spark, large_plans):
    plan = plan_of(QUERIES["drug_outcome_eras"](spark, SMALL))
    assert "observed_from" not in plan and "LeftSemi" not in plan


def test_scans_read_only_needed_columns(spark):
    plan = plan_of(QUERIES["period_inpatient"](spark, SMALL))
    assert "o_totalprice" not in plan
