"""Time at risk of persons whose rows stand together in a task."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Pieces of follow-up that are worked on at a time; a stretch has one for each year.
PIECES = 500_000
# Rows that are gathered from small batches first.
ROWS = 100_000
# Days fit into so many bits, and are not negative with this added.
DAY_BITS, DAY_ZERO = 33, 1 << 31
# The end of a rest from which nobody returns.
NEVER = DAY_ZERO - 1


def columns_of(names: int) -> str:
    """What :func:`counter` returns; ``names`` is the number of outcomes."""
    each = [f"{what}_{i} long" for what in ("lost", "started", "persons") for i in range(names)]
    return ", ".join(["stratum long", "year int", "first_day date", "last_day date", "days long", *each])


def _years(days: np.ndarray) -> np.ndarray:
    return days.astype("datetime64[D]").astype("datetime64[Y]").astype(np.int64) + 1970


def _first_days(years: np.ndarray) -> np.ndarray:
    return (years - 1970).astype("datetime64[Y]").astype("datetime64[D]").astype(np.int64)


class Events:
    """Events of one outcome by person and day, and the days they cost.

    Up to a day d, the days off risk are ``slope * d - offset`` with the sums of both up
    to d. An event takes effect from its day on and a rest ends on its last day.
    """

    def __init__(self, person: np.ndarray, start: np.ndarray, rest_end: np.ndarray) -> None:
        back = rest_end != NEVER
        day = np.concatenate([start, rest_end[back]])
        slope = np.repeat([1, -1], [len(start), int(back.sum())])
        self.person = np.concatenate([person, person[back]])
        order = np.lexsort((day, self.person))
        self.person, day, slope = self.person[order], day[order], slope[order]
        self.places = _places(self.person, day)
        # The sums run over all persons; that up to a person's first mark is taken off.
        self.sums = [np.append(0, np.cumsum(x)) for x in (slope, slope * day, slope > 0)]

    def until(self, person: np.ndarray, day: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Days off risk up to each day, and the number of events."""
        at = np.searchsorted(self.places, _places(person, day), "right")
        begin = np.searchsorted(self.person, person)
        slope, offset, events = (x[at] - x[begin] for x in self.sums)
        return slope * day - offset, events


def _places(person: np.ndarray, day: np.ndarray) -> np.ndarray:
    return (person << DAY_BITS) + day + DAY_ZERO


def counter(names: int, by_year: bool, whole: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function of batches ``person_id, turn, place, first, last`` in the order of the first two columns.

    Turn 0 are events of the outcome number ``place``, from their day to the end of the
    rest (null: never); turn 1 are stretches of follow-up of the stratum ``place``. It
    returns sums per stratum and year, and how many persons have a day at risk there.
    The events of one person are held, and of its stretches so many years at a time.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting, size = np.empty((4, 0), np.int64), [], 0
        seen = Seen(names)

        def work() -> Iterator[pa.RecordBatch]:
            nonlocal held
            columns = [np.concatenate(x) for x in zip(*waiting, strict=True)]
            followed, rows = columns[1] == 1, np.stack([columns[0], *columns[2:]])
            held = np.concatenate([held, rows[:, ~followed]], axis=1)
            # Persons come in order, each with its events first.
            last, rows = rows[0, -1], rows[:, followed]
            if rows.shape[1]:
                pieces = 1 + (_years(rows[3]) - _years(rows[2]) if by_year else 0)
                turn = np.cumsum(pieces) // PIECES
                for part in np.split(rows, np.flatnonzero(np.diff(turn)) + 1, axis=1):
                    yield _summed(held, part, names, by_year, whole, seen)
            held = held[:, held[0] >= last]

        for batch in batches:
            if batch.num_rows:
                waiting.append([c.fill_null(NEVER).to_numpy().astype(np.int64) for c in batch.columns])
                size += batch.num_rows
            if size >= ROWS:
                yield from work()
                waiting, size = [], 0
        if waiting:
            yield from work()

    return count


class Seen:
    """Where the last person has been counted, for its rows that come in the next slice."""

    def __init__(self, names: int) -> None:
        self.person: int | None = None
        self.cells: list[set] = [set() for _ in range(names)]

    def first_times(self, slot: int, ids: np.ndarray, who: np.ndarray, cells: list[tuple]) -> np.ndarray:
        """Which of the pairs of a person's number and a cell are new; keeps those of the last person."""
        told = self.cells[slot] if self.person == ids[0] else set()
        new = np.ones(len(who), bool)
        for i in np.flatnonzero(who == 0) if told else ():
            new[i] = cells[i] not in told
        kept = {cells[i] for i in np.flatnonzero(who == len(ids) - 1)}
        self.cells[slot] = kept | told if len(ids) == 1 else kept
        return new


def _summed(events: np.ndarray, rows: np.ndarray, names: int, by_year: bool, whole: bool, seen: Seen) -> pa.RecordBatch:
    """Sums of some rows; ``seen`` keeps where the last person has been counted already."""
    ids, person = np.unique(rows[0], return_inverse=True)
    strata, stratum = np.unique(rows[1], return_inverse=True)
    own = np.isin(events[0], ids)
    number = np.searchsorted(ids, events[0, own])
    _, slot, start, rest_end = events[:, own]
    found = [Events(number[slot == i], start[slot == i], rest_end[slot == i]) for i in range(names)]
    first, last = rows[2], rows[3]
    begins, ends = _years(first), _years(last)
    lowest = int(begins.min())
    # The place of no year is 0.
    width = int(ends.max()) - lowest + 2
    person_of, place, opened, closed = [], [], [], []
    if whole:
        person_of, place, opened, closed = [person], [stratum * width], [first], [last]
    if by_year:
        times = ends - begins + 1
        row = np.repeat(np.arange(len(first)), times)
        year = begins[row] + np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
        person_of.append(person[row])
        place.append(stratum[row] * width + year - lowest + 1)
        opened.append(np.maximum(first[row], _first_days(year)))
        closed.append(np.minimum(last[row], _first_days(year + 1) - 1))
    person, place, opened, closed = (np.concatenate(x) for x in (person_of, place, opened, closed))
    used, cell = np.unique(place, return_inverse=True)
    cells = len(used)
    length = closed - opened + 1

    def total(values: np.ndarray) -> np.ndarray:
        return np.bincount(cell, values, cells).astype(np.int64)

    low, high = np.full(cells, DAY_ZERO), np.full(cells, -DAY_ZERO)
    np.minimum.at(low, cell, opened)
    np.maximum.at(high, cell, closed)
    stratum_of, year_of = strata[used // width], used % width
    years = [None if y == 0 else int(y) + lowest - 1 for y in year_of]
    names_of = list(zip(stratum_of.tolist(), years, strict=True))
    lost, started, persons = [], [], []
    for slot_number, events_of in enumerate(found):
        before, until = events_of.until(person, opened - 1), events_of.until(person, closed)
        off = until[0] - before[0]
        lost.append(total(off))
        started.append(total(until[1] - before[1]))
        at_risk = length > off
        who, where = np.divmod(np.unique(person[at_risk] * cells + cell[at_risk]), cells)
        new = seen.first_times(slot_number, ids, who, [names_of[c] for c in where])
        persons.append(np.bincount(where[new], minlength=cells).astype(np.int64))
    seen.person = ids[-1]
    arrays = [
        pa.array(stratum_of, pa.int64()),
        pa.array(years, pa.int32()),
        *(pa.array(x.astype(np.int32), pa.int32()).cast(pa.date32()) for x in (low, high)),
        *(pa.array(x, pa.int64()) for x in (total(length), *lost, *started, *persons)),
    ]
    return pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in columns_of(names).split(", ")])
