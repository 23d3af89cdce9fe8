"""Prefix trie of conversations, its subtree figures rolled up in depth bands."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanwise.session import materialise

# Depths in a band. A node goes to at most so many ancestors, and the levels of bands grow with the
# logarithm to this base of the deepest node.
HEIGHT = 4
WORD = r"[^\x20\x09-\x0D]+"
# Conversations whose first turns others start with, and how many turns those take at most.
SHARED_EVERY = 20
MOST_SHARED = 3
# Ids written out together on the way to a digest.
IDS_IN_BLOCK = 512

LOW = 0xFFFFFFFF
SUMS = ("s0", "s1", "s2", "s3")


def _ordered(conversations: DataFrame) -> DataFrame:
    """Turns with ``place``: rows of one conversation follow each other by turn (null first), role and text.

    Places are consecutive inside a range of the whole order, whose number is their
    upper part, so a conversation of any length is spread over ranges.
    """
    rows = conversations.select(
        F.col("conv_id").cast("long"),
        F.col("turn").cast("long"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).filter("conv_id IS NOT NULL")
    first = F.asc_nulls_first("turn")
    # Beginnings order rows as the whole columns do, and keep the bounds of ranges small. Rows that share
    # them are in one partition, which is sorted by the whole.
    long_role = F.length("role") > 64
    begins = F.when(~long_role, F.substring("text", 1, 64))
    ranged = rows.repartitionByRange("conv_id", first, F.substring("role", 1, 64), long_role, begins)
    return ranged.sortWithinPartitions("conv_id", first, "role", "text").withColumn(
        "place", F.monotonically_increasing_id()
    )


def _numbered(placed: DataFrame, *columns: str) -> DataFrame:
    """``conv_id``, ``part``, ``number`` from 0 inside the conversation, and ``columns`` of ``placed``.

    ``part`` is the range; a conversation has one row per range in what is scanned.
    """
    part = F.shiftrightunsigned("place", 33).alias("part")
    parts = placed.groupBy("conv_id", part).agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("rows"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begins = parts.select(
        "conv_id", "part", "first", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("before")
    )
    return (
        placed.select("conv_id", part, "place", *columns)
        .join(begins, ["conv_id", "part"])
        .select("conv_id", "part", (F.col("place") - F.col("first") + F.col("before")).alias("number"), *columns)
    )


def number_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, part, number, t1, t2, words`` of each turn: two hashes of role and text, and the text's words.

    Turns are ordered by ``turn``, null first, then role and text; null roles and texts
    are empty; rows that repeat are turns of their own; rows without ``conv_id`` belong
    to no conversation; other columns are not read.
    """
    placed = _ordered(conversations).select(
        "conv_id",
        "place",
        F.xxhash64(F.lit(1), "role", "text").alias("t1"),
        F.xxhash64(F.lit(2), "role", "text").alias("t2"),
        F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"),
    )
    placed = materialise(placed, "placed-turns")
    return materialise(_numbered(placed, "t1", "t2", "words"), "numbered-turns")


def as_they_are(numbered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The items and lengths of unchanged conversations, for :func:`trie`."""
    items = numbered.select(
        "conv_id",
        "part",
        (F.col("number") + 1).alias("depth"),
        F.col("conv_id").alias("from_conv_id"),
        F.col("number").alias("from_number"),
        "t1",
        "t2",
        "words",
    )
    return items, numbered.groupBy("conv_id").agg(F.count(F.lit(1)).alias("length"))


def with_shared_heads(
    numbered: DataFrame, every: int = SHARED_EVERY, most: int = MOST_SHARED
) -> tuple[DataFrame, DataFrame]:
    """Items and lengths of conversations that begin like the last one whose id ``every`` divides.

    Of conversation c, the first h turns are those of c - c % ``every`` (all, if it has
    fewer; none, if there is none); its own follow after its first h. h is the checksum
    of the decimal id modulo ``most`` + 1.
    """
    numbers = numbered.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("rows"))
    heads = (
        numbered.filter((F.col("conv_id") % every == 0) & (F.col("number") < most))
        .groupBy(F.col("conv_id").alias("base"))
        .agg(F.array_sort(F.collect_list(F.struct("number", "t1", "t2", "words"))).alias("head"))
    )
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)).cast("int")
    convs = numbers.groupBy("conv_id").agg(F.sum("rows").alias("rows")).select(
        "conv_id", "rows", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % every).alias("base")
    )
    no_head = F.array().cast("array<struct<number:bigint,t1:bigint,t2:bigint,words:bigint>>")
    convs = convs.join(heads, "base", "left").withColumn("head", F.slice(F.coalesce("head", no_head), F.lit(1), F.col("h")))
    convs = convs.withColumn("shared", F.size("head"))
    length = F.col("shared") + F.greatest(F.col("rows") - F.col("h"), F.lit(0))
    convs = materialise(convs.withColumn("length", length), "rebuilt")
    # By part as well, so that a long conversation does not meet its one row in one task.
    shifts = numbers.drop("rows").join(convs.select("conv_id", "h", "shared"), "conv_id")
    own = (
        numbered.join(shifts, ["conv_id", "part"])
        .filter("number >= h")
        .select(
            "conv_id",
            "part",
            (F.col("number") - F.col("h") + F.col("shared") + 1).alias("depth"),
            F.col("conv_id").alias("from_conv_id"),
            F.col("number").alias("from_number"),
            "t1",
            "t2",
            "words",
        )
    )
    taken = convs.select("conv_id", "base", F.explode("head").alias("turn")).select(
        "conv_id",
        F.lit(-1).cast("long").alias("part"),
        (F.col("turn.number") + 1).alias("depth"),
        F.col("base").alias("from_conv_id"),
        F.col("turn.number").alias("from_number"),
        "turn.t1",
        "turn.t2",
        "turn.words",
    )
    return own.unionByName(taken), convs.select("conv_id", "length")


def _paths(items: DataFrame) -> DataFrame:
    """``items`` with ``k1`` and ``k2``, which name the sequence of turns up to each of them.

    The name is made of sums over the turns of hashes that their depth goes into. Sums
    are taken inside parts and shifted by those of earlier parts, so no task sees a
    whole conversation.
    """
    x, y = F.xxhash64("t1", "t2", "depth"), F.xxhash64("depth", "t2", "t1")
    # Halves of 32 bits, whose sums cannot overflow.
    terms = (F.shiftrightunsigned(x, 32), x.bitwiseAND(LOW), F.shiftrightunsigned(y, 32), y.bitwiseAND(LOW))
    rows = items.select("*", *[t.alias(s) for t, s in zip(terms, SUMS, strict=True)])
    totals = rows.groupBy("conv_id", "part").agg(*[F.sum(s).alias(f"{s}_all") for s in SUMS])
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = totals.select(
        "conv_id", "part", *[F.coalesce(F.sum(f"{s}_all").over(earlier), F.lit(0)).alias(f"{s}_before") for s in SUMS]
    )
    so_far = Window.partitionBy("conv_id", "part").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    # All sums share the window, then the join; the names are hashed from the 256 bits.
    summed = rows.select("*", *[F.sum(s).over(so_far).alias(f"{s}_here") for s in SUMS])
    whole = [F.col(f"{s}_here") + F.col(f"{s}_before") for s in SUMS]
    return summed.join(shifts, ["conv_id", "part"]).select(
        "conv_id",
        "depth",
        "from_conv_id",
        "from_number",
        "words",
        F.xxhash64(F.lit(1), *whole).alias("k1"),
        F.xxhash64(F.lit(2), *whole).alias("k2"),
    )


def trie(items: DataFrame, lengths: DataFrame, height: int = HEIGHT) -> DataFrame:
    """A row for each distinct beginning of conversations, the textless root included.

    ``items`` (conv_id, part, depth, from_conv_id, from_number, t1, t2, words) are the
    turns, depths from 1; ``lengths`` (conv_id, length) also names conversations without
    any. A node is known by ``conv_id``, its smallest member, and ``depth``. Columns:
    ``parent_conv_id`` (root: null), ``from_conv_id`` and ``from_number`` (where its
    last turn stands), ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens`` and
    ``ends_sha256``, the digest of the ids that end there. No conversations, no nodes.

    Conversation by conversation, the owners (smallest members) of the nodes passed are
    written; each later step joins nodes with the path of their owner. A common
    beginning is counted in partial aggregates.
    """
    paths = materialise(_paths(items), "paths")
    keys = ["depth", "k1", "k2"]
    found = paths.groupBy(*keys).agg(F.min("conv_id").alias("owner"), F.count(F.lit(1)).alias("n_convs"))
    smallest, convs, deepest = lengths.agg(F.min("conv_id"), F.count(F.lit(1)), F.max("length")).first()
    top = lengths.select(
        "conv_id",
        F.lit(0).cast("long").alias("depth"),
        F.lit(None).cast("long").alias("from_conv_id"),
        F.lit(None).cast("long").alias("from_number"),
        F.lit(0).cast("long").alias("words"),
        F.lit(smallest).cast("long").alias("owner"),
        F.lit(convs).cast("long").alias("n_convs"),
    )
    owned = materialise(paths.join(found, keys).select(*top.columns).unionByName(top), "owned")
    passed = owned.select("conv_id", "depth", "owner")
    above = passed.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("owner").alias("parent_conv_id"))
    nodes = owned.filter("conv_id = owner").join(above, ["conv_id", "depth"], "left").drop("owner")
    nodes = materialise(nodes, "nodes")
    children = (
        nodes.filter("depth > 0")
        .groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth"))
        .agg(F.count(F.lit(1)).alias("n_children"))
    )
    counted = nodes.join(children, ["conv_id", "depth"], "left").withColumn(
        "n_children", F.coalesce("n_children", F.lit(0))
    )
    figures = counted.select(
        "conv_id",
        "depth",
        F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"),
    )
    totals = rollup(figures, passed, deepest or 0, height)
    ends = lengths.select("conv_id", F.col("length").alias("depth")).join(passed, ["conv_id", "depth"])
    digests = id_digests(ends.select(F.col("owner").alias("conv_id"), "depth", F.col("conv_id").alias("id")))
    return (
        counted.drop("words")
        .join(totals, ["conv_id", "depth"])
        .join(digests, ["conv_id", "depth"], "left")
        .withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())))
    )


def rollup(values: DataFrame, passed: DataFrame, deepest: int, height: int = HEIGHT, unit: int = 1) -> DataFrame:
    """Sums of ``values`` (conv_id, depth, figures ...) over the subtree of each node.

    ``passed`` (conv_id, depth, owner) are the paths. Nodes go to their ancestors
    inside their band of ``height`` depths only, so a row becomes ``height`` rows at
    most. The sums at the tops of bands form a tree that is ``height`` times as flat,
    which is rolled up in the same way; its totals then go to the ancestors in the band
    above. The levels are as many as ``deepest`` has digits to the base ``height``.
    """
    figures = [c for c in values.columns if c not in ("conv_id", "depth")]
    span = unit * height

    def band(depth: str) -> Column:
        return F.floor(F.col(depth) / span).cast("long")

    def to_ancestors(rows: DataFrame, above: int) -> DataFrame:
        steps = passed.select("conv_id", F.col("depth").alias("step"), "owner", (band("depth") + above).alias("band"))
        met = rows.withColumn("band", band("depth")).join(steps, ["conv_id", "band"])
        return met.filter("step <= depth").select(F.col("owner").alias("conv_id"), F.col("step").alias("depth"), *figures)

    def added(rows: DataFrame) -> DataFrame:
        return rows.groupBy("conv_id", "depth").agg(*[F.sum(c).alias(c) for c in figures])

    inside = materialise(added(to_ancestors(values, 0)), "band-sums")
    if deepest < span:
        return inside
    is_top = F.col("depth") % span == 0
    tops = rollup(inside.filter(is_top), passed.filter(is_top), deepest, height, span)
    carried = to_ancestors(tops.filter("depth > 0"), 1)
    return materialise(added(inside.filter(~is_top).unionByName(carried.filter(~is_top)).unionByName(tops)), "totals")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (conv_id, depth, id) to comma-joined ids of stretches of one node."""
    for batch in batches:
        owner, depth, ids = (c.to_numpy() for c in batch.columns)
        if not len(ids):
            continue
        new = np.flatnonzero((np.diff(owner) != 0) | (np.diff(depth) != 0)) + 1
        starts = np.union1d(np.concatenate([[0], new]), np.arange(0, len(ids), IDS_IN_BLOCK))
        stops = [*starts[1:].tolist(), len(ids)]
        texts = [",".join(map(str, ids[a:b].tolist())) for a, b in zip(starts.tolist(), stops, strict=True)]
        columns = [pa.array(c[starts]) for c in (owner, depth, ids)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string())], ["conv_id", "depth", "first", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of each node in order to its digest; one block at a time is held."""
    node, state = None, None

    def result(done: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array([r[i] for r in done], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))]
        return pa.RecordBatch.from_arrays(columns, ["conv_id", "depth", "ends_sha256"])

    for batch in batches:
        done = []
        for owner, depth, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3)), strict=True):
            if (owner, depth) != node:
                if state is not None:
                    done.append((*node, state.hexdigest()))
                node, state = (owner, depth), hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield result(done)
    if state is not None:
        yield result([(*node, state.hexdigest())])


def id_digests(members: DataFrame) -> DataFrame:
    """``conv_id, depth, ends_sha256``: digest of each node's ascending, comma-joined ids.

    ``members`` has conv_id, depth and id. Ids are sorted and written out in ranges of
    the whole order, so that a node with very many only passes blocks of text, one after
    the other, through the task that digests it.
    """
    order = ["conv_id", "depth", "id"]
    blocks = members.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    blocks = blocks.mapInArrow(_blocks, "conv_id long, depth long, first long, ids string")
    return (
        blocks.repartition("conv_id", "depth")
        .sortWithinPartitions("conv_id", "depth", "first")
        .mapInArrow(_digests, "conv_id long, depth long, ends_sha256 string")
    )


def last_turns(nodes: DataFrame, conversations: DataFrame) -> DataFrame:
    """``nodes`` with ``role`` and ``text`` of their last turn (root: null)."""
    turns = _numbered(_ordered(conversations), "role", "text").select(
        F.col("conv_id").alias("from_conv_id"), F.col("number").alias("from_number"), "role", "text"
    )
    return nodes.join(turns, ["from_conv_id", "from_number"], "left")
