import itertools

import numpy as np
import pytest

from spanwise.llm import lattice as L

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, least=0.93):
    """(n_links, component) per row by comparing all pairs."""
    sound = {}
    for place, (vec, values, label) in enumerate(rows):
        if vec is None or label is None or not values or any(x is None or not np.isfinite(x) for x in values):
            continue
        v = np.array(values, np.float32).astype(float)
        if v.any():
            sound[place] = v / np.linalg.norm(v)
    links = {p: 0 for p in range(len(rows))}
    up = {p: p for p in range(len(rows))}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(sound, 2):
        same = rows[a][2] == rows[b][2] and len(sound[a]) == len(sound[b])
        if same and sound[a] @ sound[b] >= least:
            links[a] += 1
            links[b] += 1
            up[root(a)] = root(b)
    smallest = {}
    for p in links:
        smallest.setdefault(root(p), []).append(rows[p][0])
    return sorted(((rows[p][0], links[p], _least(smallest[root(p)])) for p in links), key=repr)


def _least(ids):
    return None if ids[0] is None else min(ids)


def result(spark, rows, **parameters):
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS rep", "'x' AS count", "2 AS cell")
    found = L.near_duplicates(frame, **parameters).collect()
    assert all(r.kept == (r.vec_id == r.component_id or r.vec_id is None) for r in found)
    return sorted(((r.vec_id, r.n_links, r.component_id) for r in found), key=repr)


def clusters(seed, groups, size, dims, spread):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        middle = rng.normal(size=dims)
        for _ in range(size):
            rows.append((len(rows), (middle + spread * rng.normal(size=dims)).tolist(), g % 3))
    return rows


@pytest.mark.parametrize("dims", [8, 24, 64])
def test_against_all_pairs(spark, dims):
    rows = clusters(dims, 12, 25, dims, 0.12)
    assert result(spark, rows) == brute(rows)


def test_full_cells_meet_in_parts(spark):
    """Cells dealt into parts of ten give the same links as whole ones, each counted once."""
    rows = clusters(5, 4, 60, 16, 0.1)
    assert result(spark, rows, block=10) == result(spark, rows) == brute(rows)


def test_recall_at_the_least_cosine(spark):
    rng = np.random.default_rng(11)
    rows = []
    for i in range(600):
        x, z = rng.normal(size=(2, 64))
        x /= np.linalg.norm(x)
        z -= (z @ x) * x
        z /= np.linalg.norm(z)
        for v in (x, 0.9305 * x + np.sqrt(1 - 0.9305**2) * z):
            rows.append((len(rows), v.tolist(), 0))
    linked = sum(n for _, n, _ in result(spark, rows))
    assert linked >= 0.97 * sum(n for _, n, _ in brute(rows))


def test_odd_rows(spark):
    one = [0.5, -0.25, 1.0]
    rows = [
        (None, one, 1),
        (1, None, 1),
        (2, [], 1),
        (3, [0.0, -0.0, 0.0], 1),
        (4, [1.0, None, 2.0], 1),
        (5, [1.0, float("nan"), 2.0], 1),
        (6, [float("inf"), 1.0, 1.0], 1),
        (7, one, None),
        (8, one, 2),
        (9, one, 1),
        (9, one, 1),
        (10, [1.0, -0.5, 2.0], 1),
        (11, [1e-38, -5e-39, 2e-38], 1),
        (12, [1e38, -5e37, 2e38], 1),
        (13, [0.5, -0.25, 1.0, 0.0], 1),
        (14, [-0.5, 0.25, -1.0], 1),
        (15, [1.0], 1),
        (16, [3.0], 1),
        (17, [0.5, -0.25, 1.0], 1),
        (17, [-0.5, 0.25, -1.0], 1),
    ]
    found, expected = result(spark, rows), brute(rows)
    # Id 17 stands at two vectors, which are rows of their own.
    assert found == expected


def test_no_vectors(spark):
    assert result(spark, []) == []


def test_decoder_against_search():
    """No point of the lattice round the decoded one is nearer."""
    rng = np.random.default_rng(3)
    points = rng.normal(scale=3, size=(500, 8))
    found = L.nearest(points)
    assert np.all((found * 2) % 1 == 0)
    assert np.all((found.sum(1) % 2) == 0)
    assert np.all(np.isin((found % 1).sum(1), (0, 4)))
    home = ((points - found) ** 2).sum(1)
    for v in L.NEIGHBOURS:
        assert np.all(home <= ((points - found - v) ** 2).sum(1) + 1e-9)
    assert len(L.NEIGHBOURS) == 240 and np.allclose((L.NEIGHBOURS**2).sum(1), 2)
