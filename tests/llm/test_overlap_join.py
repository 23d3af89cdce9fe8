import random
import time
import tracemalloc
import re

import numpy as np
import pytest

from spanwise.llm import overlap_join as O
from spanwise.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingles_of(text, n):
    words = WORD.findall(low(text or ""))
    if len(words) < n:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def brute(docs, n, per_cent):
    """doc_id to (size, smallest reachable id), by comparing all pairs that share a shingle."""
    sets = {d: shingles_of(t, n) for d, t in docs}
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= per_cent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {d: (len(sets[d]), root(d)) for d in ids}


def variants(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    docs = []
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([2, 4, 9, 12, 25, 60, 150]))]
        for _ in range(rng.randint(1, 9)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            docs.append((len(docs), " ".join(copy)))
    return docs


@pytest.mark.parametrize(("n", "per_cent", "block"), [(3, 90, 512), (3, 90, 4), (5, 80, 4)])
def test_against_all_pairs(spark, n, per_cent, block):
    docs = variants(n + block)
    # A chain in which only neighbours link, to be found across the parts of a split group.
    chain = [f"c{i}" for i in range(100)]
    docs += [(1000 + k, " ".join([f"d{j}" for j in range(k)] + chain[k:])) for k in range(24)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    found = O.link_classes(frame, O.Rule(n, per_cent), block=block).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == brute(docs, n, per_cent)


def test_odd_rows(odd_docs, no_docs):
    found = [tuple(r) for r in O.link_classes(odd_docs, O.Rule(3, 90)).collect()]
    assert len(found) == odd_docs.count()
    by_id = {d: (n, c) for d, n, c in found}
    assert by_id[1] == (0, 1) and by_id[2] == (0, 2) and by_id[3] == (0, 3)
    assert by_id[4] == (1, 4) and by_id[5] == (1, 5)
    assert by_id[6] == by_id[7] == (4, 6) and found.count((6, 4, 6)) == 2
    assert O.link_classes(no_docs, O.Rule(3, 90)).collect() == []


@pytest.mark.parametrize("rule", [O.Rule(3, 90), O.Rule(5, 80)])
def test_linked_sets_share_a_key(rule):
    rng = np.random.default_rng(5)
    maker = O.Signatures(rule)
    linked = 0
    for size in [1, 2, 3, 7, 8, 9, 10, 11, 19, 20, 33, 70, 150, 700] * 40:
        a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
        kept = a[rng.random(len(a)) > rng.choice([0, 0.03, 0.06, 0.1])]
        b = np.unique(np.concatenate([kept, rng.integers(0, 1 << 63, rng.integers(0, 1 + size // 12), dtype=np.uint64)]))
        both = len(np.intersect1d(a, b))
        if len(b) and 100 * both >= rule.per_cent * (len(a) + len(b) - both):
            linked += 1
            assert set(maker.keys(a).tolist()) & set(maker.keys(b).tolist())
    assert linked > 100


def test_components_of_paths_stars_and_loops(spark):
    rng = random.Random(2)
    path = list(range(300))
    rng.shuffle(path)
    edges = list(zip(path, path[1:], strict=False)) + [(1000, 1000 + i) for i in range(1, 200)] + [(5000, 5000), (7, 7)]
    found = components(spark.createDataFrame(edges, "a long, b long")).collect()
    roots = {r["node"]: r["root"] for r in found}
    assert len(found) == len(roots) == 500
    assert all(roots[i] == 0 for i in range(300)) and all(roots[1000 + i] == 1000 for i in range(200))
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_many_sets_that_share_much_without_linking_are_searched_quickly():
    rng = np.random.default_rng(7)
    common = rng.integers(0, 1 << 63, 180, dtype=np.uint64)
    rows = []
    for i in range(1500):
        own = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
        rows.append((i, i, np.unique(np.concatenate([rng.permutation(common)[:150], own])), True))
    rows.append((1500, 1500, np.sort(rows[3][2])[:-1], True))
    began = time.process_time()
    assert O.links_of_part(rows, O.Rule(3, 90)) == [(1500, 3)]
    assert time.process_time() - began < 12


def test_parts_of_sizes_that_cannot_link_do_not_meet(spark, monkeypatch):
    """A large group of texts of many sizes; the rows that its parts exchange are counted."""
    docs = [(k, " ".join(f"w{j}" for j in range(4 + k // 2))) for k in range(400)]
    rows = []
    search = O._search_parts
    monkeypatch.setattr(O, "_search_parts", lambda members, *more: (rows.append(members.count()), search(members, *more))[1])
    frame = spark.createDataFrame([*docs, (1000, "w0 x0 x1 x2 x3 x4 x5")], "doc_id long, text string")
    found = O.link_classes(frame, O.Rule(1, 90), block=10).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == brute([(r["doc_id"], r["text"]) for r in frame.collect()], 1, 90)
    assert len(rows) == 1 or rows[1] < 400 * 12


def test_parts_of_large_documents_hold_few_of_them(spark, monkeypatch):
    """A part is bounded by its shingles too, not by the number of its documents alone."""
    monkeypatch.setattr(O, "PLACE_SHINGLES", 10, raising=False)
    monkeypatch.setattr(O, "PIVOTS", 1)
    docs = [(k, " ".join([f"c{j}" for j in range(60)] + [f"k{k}x{j}" for j in range(k % 20)])) for k in range(60)]
    parts = []
    search = O._search_parts
    monkeypatch.setattr(
        O, "_search_parts", lambda members, *more: (parts.append(members.select("part").distinct().count()), search(members, *more))[1]
    )
    found = O.link_classes(spark.createDataFrame(docs, "doc_id long, text string"), O.Rule(1, 80), block=10).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == brute(docs, 1, 80)
    # 60 documents of 60 to 79 shingles, 100 shingles to a part.
    assert parts[0] > 20


def test_the_index_of_a_part_takes_little_beside_the_sets(monkeypatch):
    monkeypatch.setattr(O, "SORTED", 100_000, raising=False)
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 1 << 63, 300_000, dtype=np.uint64)
    sets = [np.unique(pool[at : at + 5000]) for at in rng.integers(0, len(pool) - 5000, 200)]
    tracemalloc.start()
    made = O.Search(O.Rule(5, 80), sets)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 28 * sum(map(len, sets))
    held = {g: [i for i, s in enumerate(sets) if g in s] for g in sets[0][:5]}
    for gram, owners in held.items():
        at = int(np.searchsorted(made.known, gram))
        if len(owners) > 1:
            end = made.begin[at + 1] if at + 1 < len(made.begin) else len(made.owners)
            assert made.known[at] == gram and made.owners[made.begin[at] : end].tolist() == owners
        else:
            assert at == len(made.known) or made.known[at] != gram
