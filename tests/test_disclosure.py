"""What is left after suppression, attacked with everything that totals tell."""

import itertools
from collections import defaultdict

import numpy as np
import pytest

from checks import queries as Q
from spanwise.results import disclosure as D

SMALL = "/root/testdata/sf0.001"
LEAST = 5


def with_totals(inner):
    """A table with a total in front in every dimension."""
    for axis in range(inner.ndim):
        inner = np.concatenate([inner.sum(axis, keepdims=True), inner], axis)
    return inner


def lines(shape):
    """Cells of each total with its parts, and their signs."""
    for axis in range(len(shape)):
        for rest in itertools.product(*[range(n) for d, n in enumerate(shape) if d != axis]):
            cells = [(*rest[:axis], i, *rest[axis:]) for i in range(shape[axis])]
            yield cells, [-1] + [1] * (shape[axis] - 1)


def solved(hidden, equations):
    """Hidden cells that the equations determine, whatever their values."""
    place = {c: i for i, c in enumerate(sorted(hidden))}
    rows = []
    for cells, signs in equations:
        row = np.zeros(len(place))
        for c, s in zip(cells, signs, strict=True):
            if c in place:
                row[place[c]] = s
        if row.any():
            rows.append(row)
    if not rows:
        return set()
    _, size, right = np.linalg.svd(np.array(rows))
    free = right[(size > 1e-9).sum() :]
    return {c for c, i in place.items() if not len(free) or np.abs(free[:, i]).max() < 1e-9}


@pytest.mark.parametrize("shape", [(2, 3), (3, 6), (2, 3, 3), (2, 5, 6)])
def test_no_small_count_is_solved(shape):
    rng = np.random.default_rng(len(shape))
    for _ in range(60):
        inner = rng.poisson(rng.choice([0.5, 3, 10]), size=shape) * (rng.random(shape) < rng.choice([0.5, 0.9, 1]))
        values = with_totals(inner).astype(float)
        small = (values > 0) & (values < LEAST)
        hidden = D.boxes(values, small, np.zeros(values.shape, bool), (True,) * len(shape))
        assert np.all(hidden[small]) and np.all(values[hidden] > 0)
        cells = set(map(tuple, np.argwhere(hidden).tolist()))
        assert solved(cells, lines(values.shape)) == set()


def test_no_small_count_is_the_only_possible_one():
    """All tables of positive hidden counts that agree with what is shown, listed."""
    for inner in itertools.product(range(3), repeat=4):
        values = with_totals(np.array(inner).reshape(2, 2)).astype(float)
        small = (values > 0) & (values < 3)
        hidden = D.boxes(values, small, np.zeros(values.shape, bool), (True, True))
        possible = defaultdict(set)
        # Inner cells decide all; a shown total limits them, a hidden one leaves them free up to a bound.
        for other in itertools.product(range(6), repeat=4):
            told = with_totals(np.array(other).reshape(2, 2))
            if np.array_equal(told[~hidden], values[~hidden]) and np.all(told[hidden] > 0):
                for cell in map(tuple, np.argwhere(small)):
                    possible[cell].add(told[cell])
        for cell in map(tuple, np.argwhere(small)):
            assert len(possible[cell]) > 1, (inner, cell)


def test_parts_without_their_total():
    values = np.array([1.0, 1.0, 2.0, 50.0])
    small = values < LEAST
    nothing = np.zeros(4, bool)
    assert D.boxes(values, small, nothing, (False,)).tolist() == [True, True, True, False]
    assert D.boxes(np.array([3.0, 9.0, 7.0]), np.array([True, False, False]), nothing[:3], (False,)).tolist() == [
        True,
        False,
        True,
    ]
    # Two ones alone could only be ones.
    ones = np.array([1.0, 1.0, 7.0])
    assert D.boxes(ones, ones < LEAST, nothing[:3], (False,)).tolist() == [True, True, True]


def counts_of(result, name, estimate):
    rows = D.with_places(result.rows, result.settings)
    rows = rows.filter(f"variable_name = '{name}' AND estimate_name = '{estimate}'")
    found = defaultdict(dict)
    for r in rows.collect():
        found[r.family, r.layer][r.x, r.y, r.z] = r.estimate_value
    return found


def attack(table, dims):
    """Hidden cells of one table that follow from its totals."""
    hidden = {c for c, v in table.items() if v is None}
    equations = []
    for d in range(dims):
        whole = defaultdict(list)
        for c in table:
            if c[d] != D.TOTAL:
                whole[(*c[:d], D.TOTAL, *c[d + 1 :])].append(c)
        equations += [([t, *parts], [-1] + [1] * len(parts)) for t, parts in whole.items() if t in table]
    return solved(hidden, equations) if hidden else set()


def test_study_gives_no_count_away(spark):
    """The exported study, attacked along sexes, ages and years."""
    result = Q.imported(spark, SMALL)
    observed = counts_of(result, "Number records in observation", "count")
    hidden_years = defaultdict(int)
    some = 0
    for (family, _), table in observed.items():
        assert attack(table, 2) == set()
        some += sum(v is None for v in table.values())
        hidden_years[family] += table["", "", ""] is None
    assert some and 1 not in hidden_years.values()
    for table in counts_of(result, "Denominator", "denominator_count").values():
        # Persons add up over sexes only, their days over ages and years as well.
        assert attack(table, 1) == set()
        assert attack(table, 3) == set()
    described = result.filter_settings(Q.F.col("result_type") == D.DESCRIBED)
    for variable in ("sex", "age_group_start", "age_group_end"):
        for table in counts_of(described, variable, "count").values():
            assert sum(v is None for v in table.values()) != 1


def test_hidden_outcomes_do_not_follow(spark):
    result = Q.imported(spark, SMALL)
    real = counts_of(Q.unsuppressed(spark, SMALL), "Outcome", "outcome_count")
    for key, table in counts_of(result, "Outcome", "outcome_count").items():
        positive = {c: v for c, v in table.items() if float(real[key][c]) > 0 or v is not None}
        assert attack(positive, 3) == set()
        assert all(v is None or not 0 < float(v) < LEAST for v in table.values())
