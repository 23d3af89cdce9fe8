import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from spanwise.llm import trie as T

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string"


def ordered(rows):
    found = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            found[conv].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [t[2:] for t in sorted(turns)] for c, turns in found.items()}


def rebuilt(convs):
    found = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        found[c] = convs.get(c - c % 20, [])[:h] + turns[h:]
    return found


def brute(convs):
    """Every node by a dictionary of beginnings."""
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    result = set()
    for key, ids in members.items():
        children = {k for k in members if len(k) == len(key) + 1 and k[: len(key)] == key}
        below = [k for k in members if k[: len(key)] == key]
        leaves = [k for k in below if not any(len(o) == len(k) + 1 and o[: len(k)] == k for o in members)]
        saved = sum((len(members[k]) - 1) * (len(WORDS.findall(k[-1][1])) if k else 0) for k in below)
        ends = ",".join(str(c) for c in sorted(ids) if len(convs[c]) == len(key))
        parent = min(members[key[:-1]]) if key else None
        digest = hashlib.sha256(ends.encode()).hexdigest()
        result.add((min(ids), len(key), parent, len(ids), len(children), len(leaves), saved, digest))
    return result


def conversations(seed, n, longest):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for turn in range(rng.randint(1, longest)):
            rows.append((c, turn, rng.choice(["user", "assistant"]), rng.choice(["a", "a b", "c  d\te", ""])))
    return rows


def nodes_of(frame):
    rows = frame.select(*COLUMNS).collect()
    assert len(set(rows)) == len(rows)
    return {tuple(r) for r in rows}


@pytest.mark.parametrize("height", [2, 50])
def test_against_dictionary(spark, height):
    rows = conversations(height, 60, 9)
    numbered = T.number_turns(spark.createDataFrame(rows, SCHEMA))
    assert nodes_of(T.trie(*T.as_they_are(numbered), height=height)) == brute(ordered(rows))
    assert nodes_of(T.trie(*T.with_shared_heads(numbered), height=height)) == brute(rebuilt(ordered(rows)))


def test_long_conversation_over_many_ranges(spark):
    """One conversation with nearly all rows: ranges cut it, and bands of four need five levels."""
    long = [(20, t, "user", f"w{t % 7} x") for t in range(600)]
    rows = long + [(21, t, r, x) for _, t, r, x in long[:300]] + [(23, 0, "user", "other")]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(7)
    # Small ranges would be put together again.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        numbered = T.number_turns(frame)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert numbered.filter("conv_id = 20").select("part").distinct().count() > 1
    found = T.trie(*T.as_they_are(numbered)).select("conv_id", "depth", "n_convs", "n_leaves", "saved_tokens").collect()
    by_node = {(r.conv_id, r.depth): tuple(r[2:]) for r in found}
    assert len(by_node) == 602
    assert by_node[20, 0] == (3, 2, 600)
    assert by_node[20, 300] == (2, 1, 2)
    assert by_node[20, 301] == (1, 1, 0)


def test_odd_rows(spark):
    rows = [
        (None, 1, "user", "no conversation"),
        (1, None, None, None),
        (1, 2, "user", "x" * 200 + " b"),
        (1, 2, "user", "x" * 200 + " a"),
        (1, 2, "u" * 100, "y"),
        (1, 2, "u" * 100 + "v", "a"),
        (2, 5, "user", "same"),
        (2, 5, "user", "same"),
        (3, 1, "user", "same"),
        (3, 2, "user", "same"),
        (-7, 1, "user", "word " * 50_000),
        (40, 1, "user", "only"),
        (41, 1, "user", "only"),
    ]
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS depth", "'x' AS words", "text AS owner")
    numbered = T.number_turns(frame)
    assert nodes_of(T.trie(*T.as_they_are(numbered))) == brute(ordered(rows))
    # Python's remainder of a negative id differs from SQL's, so it stays out here.
    positive = [r for r in rows if r[0] is None or r[0] > 0]
    numbered = T.number_turns(spark.createDataFrame(positive, SCHEMA))
    assert nodes_of(T.trie(*T.with_shared_heads(numbered))) == brute(rebuilt(ordered(positive)))


def test_turnless_conversations_are_at_the_root(spark):
    # Of three shared turns none exist, and none of their own follow.
    convs = [c for c in range(1, 200) if zlib.crc32(str(c).encode()) % 4 == 3 and c % 20][:3]
    rows = [(c, 0, "user", "hello there") for c in convs]
    found = T.trie(*T.with_shared_heads(T.number_turns(spark.createDataFrame(rows, SCHEMA)))).collect()
    assert [(r.conv_id, r.depth, r.n_convs, r.n_leaves) for r in found] == [(min(convs), 0, 3, 1)]
    assert found[0].ends_sha256 == hashlib.sha256(",".join(map(str, convs)).encode()).hexdigest()


def test_no_conversations(spark):
    numbered = T.number_turns(spark.createDataFrame([], SCHEMA))
    assert T.trie(*T.with_shared_heads(numbered)).count() == 0


def test_last_turns(spark):
    rows = conversations(3, 12, 5)
    frame = spark.createDataFrame(rows, SCHEMA)
    nodes = T.trie(*T.as_they_are(T.number_turns(frame)))
    convs = ordered(rows)
    for r in T.last_turns(nodes, frame).collect():
        expected = convs[r.conv_id][r.depth - 1] if r.depth else (None, None)
        assert (r.role, r.text) == expected


def test_digest_of_many_ids(spark):
    members = spark.range(5000).selectExpr("id % 2 AS conv_id", "7L AS depth", "id - 100 AS id").repartition(5)
    found = {r.conv_id: r.ends_sha256 for r in T.id_digests(members).collect()}
    for node in (0, 1):
        ids = ",".join(str(i - 100) for i in range(node, 5000, 2))
        assert found[node] == hashlib.sha256(ids.encode()).hexdigest()
