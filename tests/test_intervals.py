import datetime as dt
import random

import pytest
from tables import day, rows_of
from pyspark.sql import functions as F

from spanwise.operators.intervals import merge_by_gaps, merge_intervals, split_by_year
from spanwise.operators.records import record_runs, repair_ends


def naive(spans, gap):
    """Merge one person's spans one after the other."""
    merged = []
    for start, end in sorted(spans):
        if merged and gap is None:
            merged[-1][1] = max(merged[-1][1], end)
        elif merged and (start - merged[-1][1]).days <= gap:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end])
    return [tuple(m) for m in merged]


@pytest.mark.parametrize(
    ("gap", "given", "wanted"),
    [
        (0, [("2020-01-01", "2020-01-05"), ("2020-01-05", "2020-01-09")], 1),
        (0, [("2020-01-01", "2020-01-05"), ("2020-01-06", "2020-01-09")], 2),
        (1, [("2020-01-01", "2020-01-05"), ("2020-01-06", "2020-01-09")], 1),
        (180, [("2020-01-01", "2020-01-10"), ("2020-07-08", "2020-07-09")], 1),
        (180, [("2020-01-01", "2020-01-10"), ("2020-07-09", "2020-07-09")], 2),
    ],
)
def test_boundaries(spans, gap, given, wanted):
    assert merge_intervals(spans(*[(1, *g) for g in given]), ["person_id"], gap).count() == wanted


def test_nested_spans_reach_as_far_as_the_longest(spans):
    given = [("2020-01-01", "2020-01-31"), ("2020-01-03", "2020-01-04"), ("2020-01-20", "2020-02-02")]
    merged = merge_intervals(spans(*[(1, *g) for g in given]), ["person_id"])
    assert rows_of(merged) == [(1, day("2020-01-01"), day("2020-02-02"))]


def test_missing_starts_are_left_out(spans):
    merged = merge_intervals(spans((1, None, "2020-01-01"), (2, "2020-01-01", "2020-01-01")), ["person_id"])
    assert [r[0] for r in rows_of(merged)] == [2]


def test_random_spans_merge_like_one_by_one(spark):
    rng = random.Random(5)
    origin = dt.date(2000, 1, 1)
    people = {}
    for person in range(120):
        for _ in range(rng.randint(1, 30)):
            start = origin + dt.timedelta(rng.randint(0, 1500))
            people.setdefault(person, []).append((start, start + dt.timedelta(rng.randint(0, 90))))
    data = [(p, a, b) for p, given in people.items() for a, b in given]
    frame = spark.createDataFrame(data, "person_id long, start_date date, end_date date")
    gaps = [0, 1, 30, 180, None]
    merged = merge_by_gaps(frame, ["person_id"], gaps)
    wanted = [
        (p, gap, a, b)
        for p, given in people.items()
        for gap in gaps
        for a, b in naive(given, gap)
    ]
    assert rows_of(merged) == sorted(wanted, key=repr)

    single = {g: merge_intervals(frame, ["person_id"], g) for g in (0, 30)}
    again = merge_intervals(single[30], ["person_id"], 30)
    assert rows_of(again) == rows_of(single[30])
    assert single[30].count() <= single[0].count()


def test_extending_first_gives_the_same_eras(spark, spans):
    rng = random.Random(6)
    origin = dt.date(2000, 1, 1)
    data = []
    for person in range(60):
        for _ in range(12):
            start = origin + dt.timedelta(rng.randint(0, 2000))
            data.append((person, start, start + dt.timedelta(rng.randint(0, 20))))
    frame = spark.createDataFrame(data, "person_id long, start_date date, end_date date")
    extended = frame.withColumn("end_date", F.date_add("end_date", 100))
    ours = merge_intervals(frame, ["person_id"], 100).withColumn("end_date", F.date_add("end_date", 100))
    assert rows_of(ours) == rows_of(merge_intervals(extended, ["person_id"], 0))


def test_repair(spans):
    repaired = repair_ends(spans((1, "2020-02-01", None), (2, "2020-02-01", "2020-01-01"), (3, "2020-02-01", "2020-02-03")))
    assert [r[2] for r in rows_of(repaired)] == [day("2020-02-01"), day("2020-02-01"), day("2020-02-03")]


def test_split_by_year(spans):
    parts = split_by_year(spans((1, "2019-12-30", "2021-01-02")))
    assert rows_of(parts, "year", "start_date", "end_date") == [
        (2019, day("2019-12-30"), day("2019-12-31")),
        (2020, day("2020-01-01"), day("2020-12-31")),
        (2021, day("2021-01-01"), day("2021-01-02")),
    ]


def test_one_person_with_most_rows(spark):
    """The rows of a heavy person shrink to their days before any window."""
    frame = spark.range(0, 60_000, numPartitions=4).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).alias("person_id"),
        F.date_add(F.lit(dt.date(2000, 1, 1)), (F.col("id") % 500).cast("int") * 3).alias("start_date"),
    ).withColumn("end_date", F.col("start_date"))
    merged = merge_by_gaps(frame, ["person_id"], [0, 2, 3])
    counts = {r["gap"]: r["n"] for r in merged.filter("person_id = 0").groupBy("gap").agg(F.count("*").alias("n")).collect()}
    assert counts == {0: 500, 2: 500, 3: 1}


@pytest.mark.parametrize("longest", [2, 25, 70, 500])
def test_sets_of_days_merge_like_the_records(spark, longest):
    """Records of any length around 1970 and over window ends, missing and inverted ends, in many tasks."""
    rng = random.Random(longest)
    origin = dt.date(1969, 6, 1)
    rows, people = [], {}
    for person in range(60):
        for _ in range(rng.randint(1, 40)):
            start = origin + dt.timedelta(rng.randint(0, 400))
            end = start + dt.timedelta(rng.randint(-1, longest))
            end = None if rng.random() < 0.1 else end
            rows.append((person, start, end))
            people.setdefault(person, []).append((start, start if end is None or end < start else end))
    rows.append((0, None, origin))
    frame = spark.createDataFrame(rows, "person_id long, start_date date, end_date date").repartition(7)
    runs = record_runs(frame)
    assert runs.select("person_id", "start_date").distinct().count() == runs.count()
    known = {}
    for person, _, end in rows[:-1]:
        known[person] = max((d for d in (known.get(person), end) if d), default=None)
    assert dict(rows_of(runs.groupBy("person_id").agg(F.max("raw_end")))) == known
    gaps = [0, 1, 29, 59, 60, 61, None]
    merged = merge_by_gaps(runs, ["person_id"], gaps, starts_unique=True)
    wanted = [
        (person, gap, *era) for person, given in people.items() for gap in gaps for era in naive(given, gap)
    ]
    assert rows_of(merged, "person_id", "gap", "start_date", "end_date") == sorted(wanted, key=repr)
