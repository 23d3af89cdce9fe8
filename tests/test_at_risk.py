"""Time at risk counted from rows that come person by person."""

import datetime as dt
import random
from collections import defaultdict

import pyarrow as pa
import pytest

from spanwise.operators import at_risk, incidence

FIELDS = ["person_id", "turn", "place", "first", "last"]
FOLLOW = "mode string, person_id long, sex string, age_group string, start_date date, end_date date"
EVENT = "outcome string, person_id long, start_date date, rest_end date"


def day_number(year, month, day):
    return (dt.date(year, month, day) - dt.date(1970, 1, 1)).days


def batches(rows, size):
    for i in range(0, len(rows), size):
        columns = zip(*rows[i : i + size], strict=True)
        types = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], FIELDS)


def added_up(parts, names):
    found = defaultdict(lambda: [None, None, 0, *[0] * 3 * names])
    for part in parts:
        for row in zip(*part.to_pydict().values(), strict=True):
            sums = found[row[:2]]
            sums[0] = min(sums[0] or row[2], row[2])
            sums[1] = max(sums[1] or row[3], row[3])
            sums[2:] = [a + b for a, b in zip(sums[2:], row[4:], strict=True)]
    return dict(found)


def person_day_by_day(rows, names):
    """The same from single days: persons without a free day in a cell are not counted."""
    cells = defaultdict(lambda: [None, None, 0, *[0] * 2 * names, *[set() for _ in range(names)]])
    for person, turn, place, first, last in rows:
        if turn == 0:
            continue
        rests = [[] for _ in range(names)]
        starts = [[] for _ in range(names)]
        for p, t, slot, a, b in rows:
            if (p, t) == (person, 0):
                starts[slot].append(a)
                rests[slot].append((a, 10**6 if b is None else b))
        for number in range(first, last + 1):
            date = dt.date(1970, 1, 1) + dt.timedelta(number)
            for year in (None, date.year):
                cell = cells[place, year]
                cell[0] = min(cell[0] or date, date)
                cell[1] = max(cell[1] or date, date)
                cell[2] += 1
                for i in range(names):
                    off = any(a < number <= b for a, b in rests[i])
                    cell[3 + i] += off
                    cell[3 + names + i] += number in starts[i]
                    if not off:
                        cell[3 + 2 * names + i].add(person)
    return {k: [*v[: 3 + 2 * names], *map(len, v[3 + 2 * names :])] for k, v in cells.items()}


@pytest.mark.parametrize(("gathered", "pieces", "size"), [(100_000, 500_000, 10_000), (7, 5, 3), (1, 1, 1), (40, 3, 11)])
def test_slices_may_cut_persons_anywhere(monkeypatch, gathered, pieces, size):
    draw = random.Random(4)
    rows = []
    for person in (-3, 5, 6, 2**40):
        for slot in range(2):
            at = day_number(2001, 6, 1)
            for _ in range(draw.randrange(4)):
                at += draw.randrange(1, 200)
                stay = draw.randrange(500)
                rows.append((person, 0, slot, at, None if draw.random() < 0.2 else at + stay))
                if rows[-1][-1] is None:
                    break
                at += stay
        for _ in range(draw.randrange(1, 12)):
            first = day_number(2001, 1, 1) + draw.randrange(1200)
            rows.append((person, 1, draw.choice((-(2**62), 8)), first, first + draw.randrange(700)))
    rows.sort(key=lambda r: r[:2])
    monkeypatch.setattr(at_risk, "ROWS", gathered)
    monkeypatch.setattr(at_risk, "PIECES", pieces)
    found = added_up(at_risk.counter(2, True, True)(batches(rows, size)), 2)
    assert found == person_day_by_day(rows, 2)


def test_follow_up_is_shuffled_once_before_it_is_split(spark):
    follow_up = spark.createDataFrame([("a", 1, "Male", "all", dt.date(2012, 1, 1), dt.date(2013, 5, 1))], FOLLOW)
    events = spark.createDataFrame([("x", 1, dt.date(2012, 3, 1), dt.date(2012, 3, 2))], EVENT)
    counted = incidence._in_order(follow_up, events, ["x"], ("years", "overall"))
    plan = counted._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Join" not in plan and "Window" not in plan


@pytest.mark.parametrize("piled", [(), ("m",), ("n", "m")])
def test_both_ways_give_the_same(spark, piled):
    draw = random.Random(7)
    first = dt.date(2010, 1, 1)
    follow, outcomes = [], []
    for person in [*range(30), None]:
        for _ in range(draw.randrange(6)):
            begin = first + dt.timedelta(draw.randrange(1500))
            row = (draw.choice("mn"), person, draw.choice(("Male", "None")), "all")
            follow.append((*row, begin, begin + dt.timedelta(draw.randrange(-5, 900))))
        for _ in range(draw.randrange(5)):
            begin = first + dt.timedelta(draw.randrange(1800))
            outcomes.append((draw.choice("xy"), person, begin, begin + dt.timedelta(draw.randrange(60))))
    rows = spark.createDataFrame(follow, FOLLOW)
    events = spark.createDataFrame(outcomes, EVENT.replace("rest_end", "end_date"))

    def table(**more):
        return sorted(map(tuple, incidence.incidence(rows, events, ["x", "y"], **more).collect()), key=repr)

    assert table(piled=piled) == table(piled=("m", "n"))
