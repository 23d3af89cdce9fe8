"""Complementary suppression: which further counts go so that no small one follows from totals."""

from __future__ import annotations

import sys
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwise.config import DENOMINATOR_BANDS, DENOMINATOR_SEXES
from spanwise.functions.dates import band_label

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Where a count stands: tables that share totals, one of these tables, and its coordinates in it.
PLACE = ("kind", "family", "layer", "x", "y", "z")
# The coordinate of a total.
TOTAL = ""
OBSERVED, FOLLOWED, DESCRIBED = "summarise_in_observation", "incidence", "summarise_table"
HIDDEN = "kind string, family string, layer string, x string, y string, z string, whole boolean"


def _part(pair: str, name: str) -> Column:
    """The level of one of the columns that a name and level pair was united from."""
    separator = F.lit(" &&& ")
    told = F.map_from_arrays(F.split(f"{pair}_name", separator), F.split(f"{pair}_level", separator))
    return F.try_element_at(told, F.lit(name))


def with_places(rows: DataFrame, settings: DataFrame) -> DataFrame:
    """Long rows with the columns of ``PLACE``, null where a row has no part in any total.

    Totals are: records and person-days over sexes and ages, in each year; counts and
    person-days at risk over sexes, ages and years; records over the levels of a
    variable.
    """
    wanted = ("result_type", "mode", "denominator_sex", "denominator_age_group")
    none = F.lit(None).cast("string")
    told = settings.select(
        "result_id", *[(F.col(c) if c in settings.columns else none).alias(f"set_{c}") for c in wanted]
    )
    rows = rows.join(F.broadcast(told), "result_id", "left")
    kind = F.col("set_result_type")
    interval = F.when(_part("additional", "analysis_interval").isNotNull(), _part("additional", "incidence_start_date"))
    sex = F.nullif("set_denominator_sex", F.lit(DENOMINATOR_SEXES[0]))
    age = F.nullif("set_denominator_age_group", F.lit(band_label(DENOMINATOR_BANDS[0])))
    followed = (kind == FOLLOWED) & F.col("set_denominator_sex").isNotNull() & _part("group", "outcome_cohort_name").isNotNull()
    described = (kind == DESCRIBED) & F.col("variable_level").isNotNull()

    def each(observed: Column, at_risk: Column, level: Column) -> Column:
        return F.when(kind == OBSERVED, observed).when(followed, at_risk).when(described, level)

    def joined(*parts: str) -> Column:
        return F.to_json(F.array(*[F.col(p).cast("string") for p in parts]))

    nothing = F.lit(TOTAL)
    stratum = ("result_id", "cdm_name", "group_level", "strata_level", "additional_level")
    return rows.withColumns(
        {
            "kind": each(kind, kind, kind),
            "family": each(
                joined("result_id", "cdm_name", "group_level"), joined("cdm_name", "set_mode"), joined(*stratum)
            ),
            "layer": each(F.col("additional_level"), _part("group", "outcome_cohort_name"), F.col("variable_name")),
            "x": each(
                F.coalesce(_part("strata", "sex"), nothing), F.coalesce(sex, nothing), F.col("variable_level")
            ),
            "y": each(F.coalesce(_part("strata", "age_group"), nothing), F.coalesce(age, nothing), nothing),
            "z": each(nothing, F.coalesce(interval, nothing), nothing),
        }
    ).drop(*[f"set_{c}" for c in wanted])


def boxes(
    values: np.ndarray, seeds: np.ndarray, hidden: np.ndarray, totals: tuple[bool, ...]
) -> np.ndarray:
    """What to hide beside ``seeds`` and ``hidden``, so that no seed follows from the totals.

    ``values`` are counts, nan where there is none; along dimension d the first of them
    is the sum of the others if ``totals[d]``. Each seed becomes a corner of a box: with
    one other coordinate in every dimension, all corners are hidden. Counts along a box
    can go up and down by one, in turn, without a change to anything that is shown; that
    is so for one of both directions at least with all counts staying positive. So
    whatever else is hidden, the seed stays open. Of all such boxes the one that hides
    the least is taken (ties: the first coordinates); the box of totals always is one.
    Dimensions in which a seed has no partner are left out.
    """
    known = np.nan_to_num(values)
    cost = np.where(seeds | hidden, 0.0, known)
    cost[known <= 0] = np.inf
    dims = [d for d in range(values.ndim) if values.shape[d] > 1]
    result = seeds | hidden
    for seed in map(tuple, np.argwhere(seeds)):
        for used in (c for n in range(len(dims), 0, -1) for c in combinations(dims, n)):
            found = _cheapest(known, cost, seed, used, totals)
            if found is not None:
                for corner in product(*[(seed[d], found[d]) if d in used else (seed[d],) for d in range(values.ndim)]):
                    result[corner] = True
                break
    return result


def _cheapest(known: np.ndarray, cost: np.ndarray, seed: tuple, used: tuple, totals: tuple) -> dict[int, int] | None:
    shape = tuple(known.shape[d] for d in used)
    total = np.zeros(shape)
    least = {1: np.full(shape, known[seed]), -1: np.full(shape, np.inf)}
    signs = []
    for axis, d in enumerate(used):
        along = [1] * len(used)
        along[axis] = -1
        places = np.arange(known.shape[d])
        total += np.where(places == seed[d], np.inf, 0.0).reshape(along)
        # A total moves with its part, two parts of a total move against each other.
        with_part = totals[d] & ((places == 0) | (seed[d] == 0))
        signs.append(np.where(with_part, 1, -1).reshape(along))
    for moved in (c for n in range(1, len(used) + 1) for c in combinations(range(len(used)), n)):
        index = list(seed)
        along = [1] * len(used)
        sign = np.ones([1] * len(used), int)
        for axis in moved:
            index[used[axis]] = slice(None)
            along[axis] = shape[axis]
            sign = sign * signs[axis]
        total = total + cost[tuple(index)].reshape(along)
        corner = known[tuple(index)].reshape(along)
        for side in (1, -1):
            least[side] = np.where(sign == side, np.minimum(least[side], corner), least[side])
    total[np.maximum(least[1], least[-1]) < 2] = np.inf
    best = int(np.argmin(total))
    if not np.isfinite(total.flat[best]):
        return None
    return dict(zip(used, map(int, np.unravel_index(best, shape)), strict=True))


def _hide(counts_of_family: pa.Table) -> pa.Table:
    """The places to hide among the counts of one family; ``whole`` with all of their stratum."""
    frame = counts_of_family.to_pydict()
    kind = frame["kind"][0]
    layers, *axes = (sorted(set(frame[c])) for c in ("layer", "x", "y", "z"))
    totals = tuple(a[0] == TOTAL for a in axes) if kind != DESCRIBED else (False, False, False)
    shape = (2, len(layers), *(len(a) for a in axes))
    values, small = np.full(shape, np.nan), np.zeros(shape, bool)
    number = [{v: i for i, v in enumerate(a)} for a in (layers, *axes)]
    places = [[n[v] for v in frame[c]] for c, n in zip(("layer", "x", "y", "z"), number, strict=True)]
    values[(frame["measure"], *places)] = frame["value"]
    small[(frame["measure"], *places)] = frame["small"]
    nothing = np.zeros(shape[1:], bool)
    whole, cell = nothing.copy(), nothing.copy()
    if kind == OBSERVED:
        for i in range(len(layers)):
            whole[i] = boxes(values[0, i], small[0, i], nothing[i], totals)
        if totals[0] and totals[1]:
            # Percentages of person-days tell their sum over all years, so one hidden year needs another.
            top = values[0, :, 0, 0, 0]
            shown = [i for i in range(len(layers)) if not whole[i, 0, 0, 0] and top[i] > 0]
            if whole[:, 0, 0, 0].sum() == 1 and shown:
                other = min(shown, key=lambda i: (top[i], i))
                seeds = small[0, other].copy()
                seeds[0, 0, 0] = True
                whole[other] = boxes(values[0, other], seeds, nothing[other], totals)
    else:
        if kind == FOLLOWED:
            # The persons at risk of different outcomes are nearly the same ones, so they go together.
            fewest = np.where(values[0] > 0, values[0], np.inf).min(axis=0)
            whole[:] = boxes(np.where(np.isfinite(fewest), fewest, np.nan), small[0].any(axis=0), nothing[0], totals)
        for i in range(len(layers)):
            counts = values[1, i]
            cell[i] = boxes(counts, (small[1, i] | whole[i]) & (counts > 0), whole[i], totals)
    hit = np.argwhere((whole | cell) & ~np.isnan(values).all(axis=0))
    named = [[a[i] for i in hit[:, d].tolist()] for d, a in enumerate((layers, *axes))]
    same = [[v] * len(hit) for v in (kind, frame["family"][0])]
    arrays = [pa.array(c, pa.string()) for c in (*same, *named)]
    return pa.table([*arrays, pa.array([bool(whole[tuple(h)]) for h in hit], pa.bool_())], [*PLACE, "whole"])


def hidden_places(rows: DataFrame, least: int) -> DataFrame:
    """``PLACE`` and ``whole`` of all that is to be hidden, small counts included.

    ``rows`` are those of :func:`with_places`. A family holds the strata and years of
    one definition, which do not grow with the data.
    """
    measure = (
        F.when((F.col("kind") == OBSERVED) & (F.col("variable_name") == "Number records in observation"), 0)
        .when((F.col("kind") == FOLLOWED) & (F.col("variable_name") == "Denominator"), 0)
        .when((F.col("kind") == FOLLOWED) & (F.col("variable_name") == "Outcome"), 1)
        .when(F.col("kind") == DESCRIBED, 1)
    )
    value = F.col("estimate_value").try_cast("double")
    counts = rows.filter(F.col("estimate_name").endswith("count")).select(
        *PLACE,
        measure.alias("measure"),
        value.alias("value"),
        ((value > 0) & (value < least)).alias("small"),
    )
    counts = counts.filter("measure IS NOT NULL AND value IS NOT NULL")
    return counts.groupBy("kind", "family").applyInArrow(_hide, HIDDEN)
