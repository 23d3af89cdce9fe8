"""Near-duplicate vectors by hashing to cells of the lattice E8."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwise.llm.components import components
from spanwise.llm.words import STEP, U, mix
from spanwise.session import materialise

LEAST_COSINE = 0.93
# Tables, lattice points side by side in the key of a cell, the width of a cell, and neighbouring cells probed.
TABLES = 8
POINTS = 2
WIDTH = 2.0
PROBES = 4
SEED = 20_240_811
# Vectors of a cell that are compared at a time; a fuller cell is dealt into parts that meet in pairs.
BLOCK = 4096
ROWS = 64
SIGNED_AT_ONCE = 2048

SIGNED = "rep long, keys array<bigint>"
FOUND = "a long, b long, links long"


def _neighbours() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    found = []
    for i, j in combinations(range(8), 2):
        for s, t in product((1, -1), repeat=2):
            vector = [0.0] * 8
            vector[i], vector[j] = s, t
            found.append(vector)
    halves = product((0.5, -0.5), repeat=8)
    return np.array(found + [list(h) for h in halves if sum(x < 0 for x in h) % 2 == 0])


NEIGHBOURS = _neighbours()


def _nearest_even(points: np.ndarray) -> np.ndarray:
    """The nearest point with whole coordinates of even sum: the worst rounded one goes the other way if need be."""
    whole = np.rint(points)
    off = points - whole
    worst = np.abs(off).argmax(-1)[..., None]
    other = np.where(np.take_along_axis(off, worst, -1) >= 0, 1.0, -1.0)
    odd = (whole.sum(-1, keepdims=True) % 2) != 0
    np.put_along_axis(whole, worst, np.take_along_axis(whole, worst, -1) + np.where(odd, other, 0.0), -1)
    return whole


def nearest(points: np.ndarray) -> np.ndarray:
    """The nearest point of E8 (last axis of 8): all coordinates whole, or all halves, of even sum."""
    whole = _nearest_even(points)
    halves = _nearest_even(points - 0.5) + 0.5
    nearer = ((points - halves) ** 2).sum(-1) < ((points - whole) ** 2).sum(-1)
    return np.where(nearer[..., None], halves, whole)


class Tables:
    """The projections of all tables for vectors of one length."""

    def __init__(self, size: int, tables: int, points: int, width: float, probes: int) -> None:
        rng = np.random.default_rng([SEED, size])
        self.tables, self.points, self.probes = tables, points, probes
        self.shape = (tables, points, 8)
        self.projection = rng.normal(size=(size, tables * points * 8)) / width
        # Where the cells lie is drawn as well; doubled points of E8 repeat every 4 in each direction.
        self.offset = rng.uniform(0, 4, size=tables * points * 8)
        self.mixer = rng.integers(0, 1 << 64, size=(points * 8), dtype=np.uint64) | U(1)

    def keys(self, units: np.ndarray, label: np.ndarray) -> np.ndarray:
        """Per vector and table, the key of its cell and of the ``probes`` nearest cells round it."""
        rows = len(units)
        at = (units @ self.projection + self.offset).reshape(rows, *self.shape)
        home = nearest(at)
        # How much farther each neighbour is than the home point, over all points of the key.
        farther = (1.0 - (at - home) @ NEIGHBOURS.T).reshape(rows, self.tables, -1)
        chosen = np.argsort(farther, axis=-1, kind="stable")[..., : self.probes]
        cells = np.repeat((2 * home)[:, :, None], self.probes + 1, axis=2).astype(np.int64)
        which, step = np.divmod(chosen, len(NEIGHBOURS))
        r, t, p = np.ogrid[:rows, : self.tables, : self.probes]
        cells[r, t, p + 1, which] += (2 * NEIGHBOURS[step]).astype(np.int64)
        flat = cells.reshape(rows, self.tables, self.probes + 1, -1).astype(np.uint64)
        table = np.arange(1, self.tables + 1, dtype=U) * STEP
        start = mix(label.astype(np.int64).view(U) ^ U(units.shape[1]))[:, None, None] + table[None, :, None]
        return mix(mix(start) + (mix(flat + STEP) * self.mixer).sum(-1, dtype=U)).view(np.int64)


def _matrix(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rows of a list column by length: their places, and their values in double precision."""
    offsets = np.asarray(column.offsets)
    values = column.values.cast(pa.float64()).to_numpy(zero_copy_only=False)
    sizes = np.diff(offsets)
    found = []
    for size in np.unique(sizes).tolist():
        places = np.flatnonzero(sizes == size)
        found.append((places, values[offsets[places][:, None] + np.arange(size)]))
    return found


def scaled(vectors: np.ndarray) -> np.ndarray:
    """``vectors`` by powers of two, so that squares neither overflow nor vanish; angles stay as they are."""
    exponent = np.frexp(np.abs(vectors).max(axis=1))[1]
    return np.ldexp(vectors, -exponent[:, None])


def _signing(tables: int, points: int, width: float, probes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_size: dict[int, Tables] = {}
        for batch in batches:
            rep, label = (batch.column(i).to_numpy() for i in (0, 1))
            for places, vectors in _matrix(batch.column(2)):
                size = vectors.shape[1]
                table = of_size.setdefault(size, Tables(size, tables, points, width, probes))
                for begin in range(0, len(places), SIGNED_AT_ONCE):
                    some = places[begin : begin + SIGNED_AT_ONCE]
                    units = scaled(vectors[begin : begin + SIGNED_AT_ONCE])
                    units /= np.sqrt((units**2).sum(1))[:, None]
                    keys = table.keys(units, label[some]).reshape(len(some), -1)
                    offsets = np.arange(0, keys.size + 1, keys.shape[1], dtype=np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array(rep[some]), lists], ["rep", "keys"])

    return run


class Meeting:
    """The vectors that are compared with each other in one cell, or in two parts of it."""

    def __init__(self, cell: int, table: int, parts: np.ndarray, home: np.ndarray, rep: np.ndarray, count: np.ndarray,
                 keys: np.ndarray, vectors: np.ndarray, least: float) -> None:
        order = np.lexsort((rep, parts))
        self.cell, self.table, self.least = cell, table, least
        self.part, self.home, self.rep, self.count = parts[order], home[order], rep[order], count[order]
        self.keys, self.vectors = keys[order], scaled(vectors[order])
        self.norm = np.sqrt((self.vectors**2).sum(1))

    def pairs(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Linked pairs of ``rows`` with others that this meeting is to find."""
        cosine = self.vectors[rows] @ self.vectors.T / self.norm[rows][:, None] / self.norm[None, :]
        # Each pair once: in a meeting of two parts across them only, else in order of ids.
        apart = self.part[rows][:, None] != self.part[None, :]
        once = apart if self.part[0] != self.part[-1] else ~apart
        once &= np.arange(len(self.rep))[None, :] > rows[:, None]
        once &= self.home[rows][:, None] | self.home[None, :]
        i, j = np.nonzero(once & (cosine >= self.least))
        return self._first_here(rows[i], j)

    def _first_here(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs that meet in no earlier table, nor in the other cell of this one if that comes first."""
        for table in range(self.table):
            if not len(i):
                return i, j
            together = self.keys[i, table, 0] == self.keys[j, table, 0]
            i, j = i[~together], j[~together]
            together = self._reaches(i, j, table) | self._reaches(j, i, table)
            i, j = i[~together], j[~together]
        swap = self.rep[i] > self.rep[j]
        low, high = np.where(swap, j, i), np.where(swap, i, j)
        at_low = self.keys[low, self.table, 0] == self.cell
        keep = at_low | ~self._reaches(high, low, self.table)
        return i[keep], j[keep]

    def _reaches(self, a: np.ndarray, b: np.ndarray, table: int) -> np.ndarray:
        return (self.keys[a, table] == self.keys[b, table, :1]).any(axis=1)

    def links(self) -> tuple[np.ndarray, list[tuple[int, int]]]:
        """For each vector how many it links with here, and links enough to connect what is connected."""
        total = np.zeros(len(self.rep))
        root = np.arange(len(self.rep))
        edges: list[tuple[int, int]] = []

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return int(x)

        for begin in range(0, len(self.rep), ROWS):
            i, j = self.pairs(np.arange(begin, min(begin + ROWS, len(self.rep))))
            if not len(i):
                continue
            total += np.bincount(i, self.count[j], len(total)) + np.bincount(j, self.count[i], len(total))
            # A link (i, j) follows from those of j and of i with the first row that links with j.
            first = np.full(len(total), len(total))
            np.minimum.at(first, j, i)
            seen = np.flatnonzero(first < len(total))
            tied = np.unique(np.stack([i, first[j]], 1)[i != first[j]], axis=0)
            for a, b in np.concatenate([np.stack([first[seen], seen], 1), tied]).tolist():
                x, y = find(a), find(b)
                if x != y:
                    root[max(x, y)] = min(x, y)
                    edges.append((int(self.rep[a]), int(self.rep[b])))
            # Flat again, so that the next rows find their roots at once.
            for _ in range(len(root).bit_length()):
                root = root[root]
        return total.astype(np.int64), edges


def _comparing(least: float, tables: int):
    def result(meeting: tuple, rows: list[tuple]) -> pa.RecordBatch:
        _, cell, table, size = meeting
        part, home, rep, count, keys, vectors = (np.concatenate(c) for c in zip(*rows, strict=True))
        shaped = keys.reshape(len(rep), tables, -1)
        met = Meeting(cell, table, part, home, rep, count, shaped, vectors.reshape(len(rep), size), least)
        total, edges = met.links()
        some = np.flatnonzero(total)
        a = [*met.rep[some].tolist(), *(x for x, _ in edges)]
        b = [*[None] * len(some), *(y for _, y in edges)]
        n = [*total[some].tolist(), *[None] * len(edges)]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (a, b, n)], ["a", "b", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, rows = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            meeting, cell, table, size, part, home, rep, count = (
                batch.column(i).to_numpy(zero_copy_only=False) for i in range(8)
            )
            keys, key_ends = batch.column(8).values.to_numpy(), np.asarray(batch.column(8).offsets)
            values, ends = batch.column(9).values, np.asarray(batch.column(9).offsets)
            change = np.flatnonzero((np.diff(meeting) != 0) | (np.diff(cell) != 0) | (np.diff(size) != 0)) + 1
            for a, b in zip([0, *change.tolist()], [*change.tolist(), len(meeting)], strict=True):
                known = (int(meeting[a]), int(cell[a]), int(table[a]), int(size[a]))
                if known != current:
                    if len(rows) and sum(len(r[2]) for r in rows) > 1:
                        yield result(current, rows)
                    current, rows = known, []
                vectors = values.slice(ends[a], ends[b] - ends[a]).cast(pa.float64()).to_numpy(zero_copy_only=False)
                rows.append((part[a:b], home[a:b], rep[a:b], count[a:b], keys[key_ends[a] : key_ends[b]], vectors))
        if len(rows) and sum(len(r[2]) for r in rows) > 1:
            yield result(current, rows)

    return run


def links(
    classes: DataFrame,
    least: float = LEAST_COSINE,
    tables: int = TABLES,
    points: int = POINTS,
    width: float = WIDTH,
    probes: int = PROBES,
    block: int = BLOCK,
) -> DataFrame:
    """Links of ``classes`` (rep, count, label, embedding), whose vectors are distinct.

    Rows (a, null, links) say how many vectors (by ``count``) a links with as far as
    found in one meeting; rows (a, b, null) are links that connect what all links do.
    Each vector lies in a cell of each table and probes the nearest cells round it; a
    pair meets where one of them lies. It is compared exactly, and counted in the first
    of its meetings. A cell with more than ``block`` vectors is dealt into parts, every
    two of which meet, so nothing is left out and no task holds more than two parts.
    """
    signing = _signing(tables, points, width, probes)
    labelled = classes.select("rep", F.xxhash64("label").alias("label"), "embedding")
    signed = materialise(labelled.mapInArrow(signing, SIGNED), "signed-vectors")
    place = F.posexplode("keys").alias("place", "cell")
    entries = signed.select("rep", place).select(
        "rep",
        "cell",
        F.floor(F.col("place") / (probes + 1)).cast("int").alias("table"),
        (F.col("place") % (probes + 1) == 0).alias("home"),
    )
    cells = entries.groupBy("cell").agg(F.count(F.lit(1)).alias("size"), F.count_if("home").alias("homes"))
    shared = cells.filter("size > 1 AND homes > 0").select(
        "cell", F.ceil(F.col("size") / block).cast("int").alias("parts")
    )
    own = F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")
    dealt = entries.join(shared, "cell").withColumn("part", own)
    meetings = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        F.xxhash64("cell", F.least("part", "other"), F.greatest("part", "other")).alias("meeting"),
        "cell",
        "table",
        "part",
        "home",
        "rep",
    )
    carried = classes.select("rep", "count", "embedding").join(signed, "rep")
    compared = (
        meetings.join(carried, "rep")
        .select(
            "meeting", "cell", "table", F.size("embedding").alias("size"),
            "part", "home", "rep", "count", "keys", "embedding",
        )
        .repartition("meeting")
        .sortWithinPartitions("meeting", "cell", "size")
    )
    return compared.mapInArrow(_comparing(least, tables), FOUND)


def near_duplicates(vectors: DataFrame, least: float = LEAST_COSINE, **parameters: float) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each row of ``vectors`` (vec_id, embedding, label).

    Vectors of one label and length link when their cosine in double precision is at
    least ``least``, as far as the lattice finds them: 0.99 of pairs at 0.93, nearly all
    above 0.95, never one below ``least``. ``n_links`` counts the other rows linked with;
    ``component_id`` is the smallest ``vec_id`` reachable, itself included; ``kept`` marks
    it. Null labels, and vectors that are null, empty, zero or hold a null or non-finite
    component, link with nothing. Rows that repeat are vectors of their own with the
    same id; a row without ``vec_id`` links with nothing and is kept. An empty table
    gives no rows; other columns are not read.

    Equal vectors of a label are one class and go on as one, with their number.
    """
    rows = vectors.select(F.col("vec_id").cast("long"), "embedding", "label")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    turned = F.exists("embedding", lambda x: x != 0)
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite & turned
    named = rows.select(
        "vec_id",
        "label",
        F.coalesce(sound, F.lit(False)).alias("sound"),
        F.xxhash64(F.lit(1), "embedding").alias("h1"),
        F.xxhash64(F.lit(2), "embedding").alias("h2"),
        "embedding",
    )
    same = ["label", "h1", "h2"]
    grouped = named.filter("sound").groupBy(*same).agg(
        F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("count"), F.first("embedding").alias("embedding")
    )
    # Numbered anew, as one id may stand at several vectors; the numbers are fixed by being written.
    classes = materialise(grouped.select(F.monotonically_increasing_id().alias("class"), "*"), "vector-classes")
    compared = links(classes.select(F.col("class").alias("rep"), "count", "label", "embedding"), least, **parameters)
    found = materialise(compared, "vector-links")
    counts = found.filter("b IS NULL").groupBy(F.col("a").alias("class")).agg(F.sum("links").alias("links"))
    roots = components(found.filter("b IS NOT NULL").select("a", "b")).select(F.col("node").alias("class"), "root")
    placed = classes.select("class", *same, "rep", "count").join(roots, "class", "left").join(counts, "class", "left")
    placed = placed.withColumn("root", F.coalesce("root", "class"))
    smallest = placed.groupBy("root").agg(F.min("rep").alias("component"))
    known = placed.join(smallest, "root").select(
        *same, (F.col("count") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component"
    )
    keyed = named.select("vec_id", "sound", *[F.when(F.col("sound"), F.col(c)).alias(c) for c in same])
    return keyed.join(known, same, "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component", "vec_id"), F.lit(True)).alias("kept"),
    )
