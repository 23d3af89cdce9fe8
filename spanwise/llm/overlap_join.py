"""Exact Jaccard similarity join on word shingles by T-occurrence search."""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from math import exp, log2, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanwise.llm.components import components
from spanwise.llm.tokens import process_memory, slices
from spanwise.llm.words import SPACES, STEP, U, mix, shingles, words
from spanwise.session import materialise

# Documents that one search indexes, and of how many a split group shares the same ones in every part.
BLOCK = 4096
PIVOTS = 12
# A document of more shingles takes the place of several in a part; so that is the mean size in a full part at most.
PLACE_SHINGLES = 1024
# A search sorts about so many shingles at a time.
SORTED = 1_000_000
# Cost of a binary probe of a long list against a step of the merge.
PROBE = 0.0085
# Costs of looking a document up in long lists, and in each of them, against counting a posting.
PROBES, PROBED = 5_000, 50
COUNTED = 1_000_000
ODD = U(0xD1342543DE82EF95)
# How far a span of sizes reaches above its lower end. Spans overlap the less the farther they reach, and their
# ranges hold the fewer shingles; this is near the least number of keys.
REACH = 1.6
# The pairs of a block, and the keys a task holds before it hands them on.
BLOCK_KEYS = 4096
HELD_KEYS = 1_000_000

SIGNED = "doc_id long, n long, d1 long, d2 long"
KEYED = "keys array<bigint>, docs array<bigint>"


class Rule:
    """Two sets link when ``per_cent`` of their union is at most 100 times the intersection."""

    def __init__(self, words_in_shingle: int, per_cent: int) -> None:
        self.n, self.per_cent = words_in_shingle, per_cent

    def overlap(self, a: int, b: int) -> int:
        """The least intersection of linked sets of these sizes."""
        return -(-self.per_cent * (a + b) // (100 + self.per_cent))

    def least(self, a: int) -> int:
        """The least intersection of a set of this size with any set it links with."""
        return -(-self.per_cent * a // 100)

    def largest(self, a: int) -> int:
        """The size of the largest set a set of this size links with."""
        return 100 * a // self.per_cent

    def differences(self, a: int, b: int) -> int:
        return a + b - 2 * self.overlap(a, b)


def shingle_set(hashes: np.ndarray, n: int) -> np.ndarray:
    """The distinct shingles, sorted; all words as one if there are fewer; empty without words."""
    if not len(hashes):
        return hashes
    return np.unique(shingles(hashes, min(n, len(hashes))))


class Signatures:
    """Keys of which linked sets share at least one.

    Sizes fall into overlapping spans, so that any two sizes that can link share a
    span. In a span the hash space is cut into more ranges than linked sets can have
    differences, by one and a reserve: so they hold the same shingles in more ranges than
    the reserve counts, and one of these is not empty unless both sets have more empty
    ranges than the reserve. Such sets, for which the reserve is far too large by chance,
    get a key in common. A key stands for the span, the range and all shingles in it.
    """

    def __init__(self, rule: Rule) -> None:
        self.rule = rule
        self.spans: list[tuple[int, int, int, int]] = []
        self._extend(64)

    def _extend(self, size: int) -> None:
        low = 1 if not self.spans else self.spans[-1][0]
        while not self.spans or self.spans[-1][0] <= size:
            if self.spans:
                # The next span begins where partners of its smallest sets are still in the one before.
                low, high, *_ = self.spans[-1]
                low = next(a for a in range(low + 1, high + 2) if self.rule.largest(a) > high)
            high = max(int(low * REACH), self.rule.largest(low) + 1)
            most = max(self.rule.differences(high, high), self.rule.differences(high, high - 1))
            reserve = self._reserve(low, most)
            self.spans.append((low, high, most + 1 + reserve, reserve))

    @staticmethod
    def _reserve(low: int, most: int) -> int:
        """Empty ranges that the smallest sets of a span hardly ever exceed, four deviations above their mean.

        More ranges than shingles would be of no use, which bounds the reserve of small sets.
        """
        reserve = 1
        while most + 1 + reserve < low:
            mean = (most + 1 + reserve) * exp(-low / (most + 1 + reserve))
            if reserve >= mean + 4 * sqrt(mean):
                break
            reserve += 1
        return reserve

    def keys(self, grams: np.ndarray) -> np.ndarray:
        size = len(grams)
        if self.spans[-1][0] <= size:
            self._extend(size)
        found = []
        sums = np.concatenate([np.zeros(1, U), np.cumsum(mix(grams), dtype=U)])
        for number, (low, high, ranges, reserve) in enumerate(self.spans):
            if low > size:
                break
            if size > high:
                continue
            place = ((grams >> U(32)) * U(ranges)) >> U(32)
            bounds = np.searchsorted(place, np.arange(ranges + 1, dtype=U))
            full = np.flatnonzero(np.diff(bounds))
            own = U((number + 1) * int(STEP) % (1 << 64))
            found.append(mix(sums[bounds[full + 1]] - sums[bounds[full]] + (full.astype(U) + U(1)) * ODD + own))
            if ranges - len(full) > reserve:
                found.append(mix(np.array([own], U)))
        return np.concatenate(found) if found else np.empty(0, U)


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.length(text).alias("size"))


def _sets(batch: pa.RecordBatch, rule: Rule) -> Iterator[tuple[int | None, np.ndarray]]:
    """Each ``doc_id`` of a batch of ``_texts`` with its set."""
    for part in slices(batch.column(2).to_pylist()):
        hashes, _, ends = words(batch.column(1)[part], SPACES)
        begin = 0
        for doc, end in zip(batch.column(0)[part].to_pylist(), ends.tolist(), strict=True):
            yield doc, shingle_set(hashes[begin:end], rule.n)
            begin = end


def sign(docs: DataFrame, rule: Rule) -> DataFrame:
    """Per row: ``doc_id``, the size ``n`` of its set, and a 128-bit digest of the set."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        process_memory("overlap_join")
        for batch in batches:
            rows = []
            for doc, grams in _sets(batch, rule):
                digest = (mix(grams).sum(dtype=U), mix(grams ^ STEP).sum(dtype=U))
                rows.append((doc, len(grams), *(int(d.view(np.int64)) for d in digest)))
            columns = zip(*rows, strict=True) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "n", "d1", "d2"])

    return _texts(docs).mapInArrow(compute, SIGNED)


def keyed(docs: DataFrame, rule: Rule) -> DataFrame:
    """Blocks of pairs of a key and a document that has it.

    What shares a key within a task is brought together there: the least document goes
    on with the key, and the others share one more key with it, however many they have
    in common. So the pairs of a key number no more than the tasks, however many
    documents have it.
    """

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        process_memory("overlap_join")
        maker = Signatures(rule)
        held: list[tuple[int, np.ndarray]] = []
        size = 0
        for batch in batches:
            for doc, grams in _sets(batch, rule):
                if doc is not None and len(grams):
                    held.append((doc, maker.keys(grams).view(np.int64)))
                    size += len(held[-1][1])
                if size >= HELD_KEYS:
                    yield from _blocks(held)
                    held, size = [], 0
        yield from _blocks(held)

    return _texts(docs).mapInArrow(compute, KEYED)


def _blocks(held: list[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Each key with the least of its documents, and that one with the others under a key of its own."""
    if not held:
        return
    keys = np.concatenate([k for _, k in held])
    docs = np.repeat(np.array([d for d, _ in held], np.int64), [len(k) for _, k in held])
    order = np.lexsort((docs, keys))
    keys, docs = keys[order], docs[order]
    new = np.concatenate([[True], keys[1:] != keys[:-1]])
    least = docs[np.flatnonzero(new)[np.cumsum(new) - 1]]
    other, center = np.unique(np.stack([docs, least])[:, docs != least], axis=1)
    both = np.concatenate([center, np.unique(center)])
    first = np.concatenate([keys[new], mix(both.view(U) ^ ODD).view(np.int64)])
    second = np.concatenate([docs[new], other, np.unique(center)])
    for i in range(0, len(first), BLOCK_KEYS):
        lists = [pa.array([x[i : i + BLOCK_KEYS]], pa.list_(pa.int64())) for x in (first, second)]
        yield pa.RecordBatch.from_arrays(lists, ["keys", "docs"])


class Search:
    """T-occurrence search in inverted lists, kept as one sorted array of (shingle, document).

    The sets are sorted; the lists are made range by range of the hash space.
    """

    def __init__(self, rule: Rule, sets: list[np.ndarray]) -> None:
        self.rule = rule
        self.sizes = np.array([len(s) for s in sets], np.int64)
        self.count = max(1, len(sets))
        ranges = 1 + int(self.sizes.sum()) // SORTED
        inner = np.arange(1, ranges, dtype=U) * U((1 << 64) // ranges) if ranges > 1 else np.empty(0, U)
        cuts = np.zeros((len(sets), ranges + 1), np.int64)
        for i, grams in enumerate(sets):
            cuts[i, 1:-1], cuts[i, -1] = np.searchsorted(grams, inner), len(grams)
        made = [self._lists([s[a:b] for s, a, b in zip(sets, *c, strict=True)]) for c in zip(cuts.T[:-1], cuts.T[1:], strict=True)]
        self.known, held, self.owners = (np.concatenate(x) for x in zip(*made, strict=True))
        del made
        self.begin = np.cumsum(held) - held
        # Rises with the shingle and within it with the document.
        self.places = np.repeat(np.arange(len(held)) * self.count, held)
        self.places += self.owners

    @staticmethod
    def _lists(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The shingles that several sets hold, how many do, and which ones."""
        grams = np.concatenate([*sets, np.empty(0, U)])
        owners = np.repeat(np.arange(len(sets), dtype=np.int32), [len(s) for s in sets])
        order = np.argsort(grams, kind="stable")  # owners rise within a shingle
        grams, owners = grams[order], owners[order]
        # A shingle of one document is in nobody else's list.
        with_next = np.append(grams[1:] == grams[:-1], False)[: len(grams)]
        shared = with_next.copy()
        shared[1:] |= with_next[:-1]
        grams, owners = grams[shared], owners[shared]
        begin = np.flatnonzero(np.append(True, grams[1:] != grams[:-1])[: len(grams)])
        return grams[begin], np.diff(begin, append=len(grams)), owners

    def linked(self, grams: np.ndarray, limit: int, skip) -> list[int]:
        """Documents below ``limit`` that link with the set, but for those that ``skip`` knows.

        The longest lists are set aside, as many as a set can lack and still reach the
        overlap; the short ones are merged by counting their documents. What remains is
        probed in the long lists, or counted there too where it is the larger part of them.
        """
        size, rule = len(grams), self.rule
        needed = rule.least(size)
        if len(self.known) < needed:
            return []
        at = np.minimum(np.searchsorted(self.known, grams), len(self.known) - 1)
        at = at[self.known[at] == grams]
        begin = self.begin[at]
        end = np.searchsorted(self.places, at * self.count + limit)
        held = end > begin
        if held.sum() < needed:
            return []
        order = np.argsort((end - begin)[held], kind="stable")
        at, begin, end = at[held][order], begin[held][order], end[held][order]
        aside = min(needed - 1, int(needed / (PROBE * log2(max(2, int(end[-1] - begin[-1]))) + 1)))
        cut = len(at) - aside
        counts = self._counted(begin[:cut], end[:cut], limit)
        near = np.flatnonzero(counts >= needed - aside)
        if aside and len(near) * (PROBES + PROBED * aside) > int((end - begin)[cut:].sum()):
            shared = (counts + self._counted(begin[cut:], end[cut:], limit))[near]
        else:
            shared = counts[near] + [self._held(at[cut:] * self.count + document) for document in near]
        near = near[shared >= rule.overlap(size, self.sizes[near])]
        return [document for document in near.tolist() if not skip(document)]

    def _counted(self, begin: np.ndarray, end: np.ndarray, limit: int) -> np.ndarray:
        """In how many of the lists each document below ``limit`` is; so many postings are counted at a time."""
        counts = np.zeros(limit, np.int64)
        turn = np.cumsum(end - begin) // COUNTED
        for first, last in _runs(turn):
            lists = [self.owners[a:b] for a, b in zip(begin[first:last].tolist(), end[first:last].tolist(), strict=True)]
            counts += np.bincount(np.concatenate(lists), minlength=limit)
        return counts

    def _held(self, places: np.ndarray) -> int:
        near = np.minimum(np.searchsorted(self.places, places), len(self.places) - 1)
        return int((self.places[near] == places).sum())


def _runs(turn: np.ndarray) -> Iterator[tuple[int, int]]:
    """Where each stretch of equal numbers begins and ends."""
    ends = np.append(np.flatnonzero(turn[1:] != turn[:-1]) + 1, len(turn))[: len(turn)].tolist()
    yield from zip([0, *ends[:-1]], ends, strict=False)


class Forest:
    """Union of numbers, each class under its smallest."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (y := self.up.setdefault(x, x)) != x:
            self.up[x] = x = self.up[y]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)


def links_of_part(rows: list[tuple[int, int, np.ndarray, bool]], rule: Rule) -> list[tuple[int, int]]:
    """Edges that hold the linked documents of one part together, from each to the least of its class.

    A row is a document, the class it is known to be in, its set, and whether it asks
    or is only asked about. First each asking document is held against the newest of the
    two largest classes, which finds what is linked with most. Then every asking document
    searches among those only asked about, and among the asking ones of larger classes:
    so documents of one class are not searched for among each other, however many they are.
    """
    classes, linked = Forest(), Forest()
    newest: dict[int, tuple[int, np.ndarray]] = {}
    sizes: Counter = Counter()

    def meet(doc: int, mine: int, other_doc: int, other: int) -> int:
        linked.join(doc, other_doc)
        classes.join(mine, other)
        root, total = classes.root(mine), sizes.pop(mine, 0) + sizes.pop(other, 0)
        sizes[root] = total
        kept = newest.pop(other, None) or newest.pop(mine, None)
        newest.pop(mine, None)
        if kept:
            newest[root] = kept
        return root

    for doc, known, grams, asks in sorted(rows, key=lambda r: (r[3], len(r[2]), r[0])):
        mine = classes.root(known)
        for other, _ in heapq.nlargest(2, sizes.items(), key=lambda x: x[1]) if asks else ():
            if other != mine and other in newest:
                near_doc, near = newest[other]
                if len(np.intersect1d(grams, near, assume_unique=True)) >= rule.overlap(len(grams), len(near)):
                    mine = meet(doc, mine, near_doc, other)
        sizes[mine] += 1
        newest[mine] = (doc, grams)
    of_size = {c: n for c, n in sizes.items()}
    roots = [classes.root(r[1]) for r in rows]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][3], -of_size[roots[i]], roots[i], rows[i][0]))
    search = Search(rule, [rows[i][2] for i in order])
    begin_of: dict[int, int] = {}
    for place, i in enumerate(order):
        doc, known, grams, asks = rows[i]
        if not asks:
            continue
        limit = begin_of.setdefault(roots[i], place)
        mine = classes.root(known)
        for number in search.linked(grams, limit, lambda n: classes.root(rows[order[n]][1]) == mine):  # noqa: B023
            other = rows[order[number]]
            if classes.root(other[1]) != mine:
                mine = meet(doc, mine, other[0], classes.root(other[1]))
    return [(doc, linked.root(doc)) for doc in sorted(linked.up) if linked.root(doc) != doc]


def _search_parts(members: DataFrame, texts: DataFrame, rule: Rule) -> DataFrame:
    """Links (a, b) inside each part of ``members`` (part, doc_id, known, asks)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        process_memory("overlap_join")
        current, rows = None, []

        def close() -> pa.RecordBatch:
            edges = links_of_part(rows, rule) if len(rows) > 1 else []
            columns = zip(*edges, strict=True) if edges else [[], []]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b"])

        for batch in batches:
            for span in slices(batch.column(5).to_pylist()):
                hashes, _, ends = words(batch.column(4)[span], SPACES)
                begin = 0
                fields = [c[span].to_pylist() for c in batch.columns[:4]]
                for part, doc, known, asks, end in zip(*fields, ends.tolist(), strict=True):
                    if part != current:
                        yield close()
                        current, rows = part, []
                    grams = shingle_set(hashes[begin:end], rule.n)
                    begin = end
                    last = rows[-1] if rows else None
                    if last is None or last[0] != doc or last[3] != asks or not np.array_equal(last[2], grams):
                        rows.append((doc, known, grams, asks))
        yield close()

    return (
        members.join(texts, "doc_id")
        .select("part", "doc_id", "known", "asks", "text", F.length("text").alias("size"))
        .repartition("part")
        .sortWithinPartitions("part", "doc_id", "asks", "size")
        .mapInArrow(run, "a long, b long")
    )


def link_classes(docs: DataFrame, rule: Rule, block: int = BLOCK) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_shingles`` and ``component_id``.

    Documents link when their shingle sets are similar by ``rule``; ``component_id`` is
    the smallest ``doc_id`` reachable by links. Documents without words have no
    shingles and link with nothing; null texts are empty; equal rows give equal rows;
    an empty table gives no rows; other columns are not read. ``doc_id`` identifies a
    document: rows with the same one are linked; a row without one stands alone.

    1. Each document is signed once; equal sets are one class and go on as one.
    2. Documents that share a key fall into one group. Linked ones always do. Only the
       first of each class is searched for.
    3. Each group is searched. A group of more than ``block`` documents, or of fewer large
       ones, is dealt by the sizes of the sets into parts of bounded numbers of documents and
       shingles, and a few of its documents are put into every part, which
       joins what belongs together across them. Where more than one class is left of a
       group, any two of its parts meet that hold sizes which can link, and what is not
       in the largest class asks about the rest.
    """
    signed = materialise(sign(docs, rule), "signed")
    classes = signed.filter("n > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("doc_id"))
    pairs = keyed(docs, rule).select(F.explode(F.arrays_zip("keys", "docs")).alias("pair")).select("pair.keys", "pair.docs")
    in_order = Window.partitionBy("keys").orderBy("docs").rowsBetween(Window.unboundedPreceding, 0)
    near = pairs.select(F.col("docs").alias("a"), F.first("docs").over(in_order).alias("b"))
    firsts = classes.select(F.col("doc_id").alias("node")).distinct()
    # Equal sets have all keys in common, so the first of them is in the group of the others.
    groups = materialise(components(near).join(firsts, "node", "left_semi"), "groups")
    # Rows with one id may have sets of several sizes.
    sized = signed.filter("n > 0").groupBy(F.col("doc_id").alias("node")).agg(F.min("n").alias("low"), F.max("n").alias("high"))
    members = groups.join(sized, "node")
    whole = Window.partitionBy("root")
    smaller = whole.orderBy("low").rowsBetween(Window.unboundedPreceding, -1)
    # A row for each size in a group, not for each document.
    taken = F.col("same") * F.col("each")
    spread = (
        members.groupBy("root", "low")
        .agg(F.count(F.lit(1)).alias("same"))
        .withColumn("each", F.greatest("low", F.lit(PLACE_SHINGLES)).cast("long"))
        .select(
            "root",
            "low",
            "same",
            "each",
            F.coalesce(F.sum(taken).over(smaller), F.lit(0)).alias("before"),
            F.sum(taken).over(whole).alias("room"),
            F.sum("same").over(whole).alias("size"),
        )
    )
    hashed, full = F.xxhash64("node"), block * PLACE_SHINGLES
    dealt = members.join(spread.filter("size > 1"), ["root", "low"]).select(
        F.col("node").alias("doc_id"),
        "root",
        "low",
        "high",
        F.ceil(F.col("room") / full).cast("long").alias("parts"),
        F.floor((F.col("before") + F.pmod(hashed, F.col("same")) * F.col("each")) / full).cast("long").alias("row"),
        (F.pmod(hashed, F.col("size")) < PIVOTS).alias("pivot"),
    )
    # Parts of a group that fits in one are numbered 0; pivots go to all.
    parts = dealt.select(
        "doc_id",
        "root",
        F.explode(
            F.when(F.col("pivot"), F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).otherwise(F.array("row"))
        ).alias("part"),
    ).select(F.xxhash64("root", "part").alias("part"), "doc_id", F.col("doc_id").alias("known"), F.lit(True).alias("asks"))
    # Both sides are always shuffled, so that the plan is the same at every size.
    texts = materialise(
        docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("text")).join(
            dealt.select("doc_id").distinct().hint("merge"), "doc_id", "left_semi"
        ),
        "group-texts",
    )
    links = materialise(_search_parts(parts, texts, rule), "links")
    split = dealt.filter("parts > 1")
    if split.take(1):
        links = materialise(links.unionByName(_across(split, links, texts, rule)), "links")
    roots = components(links).select(F.col("node").alias("doc_id"), "root")
    known = classes.join(roots, "doc_id", "left").select("d1", "d2", F.coalesce("root", "doc_id").alias("root"))
    return signed.join(known, ["d1", "d2"], "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("root")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def _across(split: DataFrame, links: DataFrame, texts: DataFrame, rule: Rule) -> DataFrame:
    """Links between different parts of the groups of ``split`` that the first search left open."""
    roots = components(links).select(F.col("node").alias("doc_id"), F.col("root").alias("known"))
    members = split.join(roots, "doc_id", "left").withColumn("known", F.coalesce("known", "doc_id"))
    counts = members.groupBy("root", "known").agg(F.count(F.lit(1)).alias("n"))
    largest = counts.groupBy("root").agg(F.max_by("known", F.struct("n", F.negative("known"))).alias("largest"))
    members = members.join(largest, "root")
    open_groups = members.filter("known <> largest").select("root").distinct()
    members = members.join(open_groups, "root", "left_semi")
    # A row for each part of a split group. A document goes to the meetings of its part with every other one that
    # holds sizes it can link with; whoever is not in the largest class asks.
    bounds = members.groupBy("root", F.col("row").alias("other")).agg(F.min("low").alias("lowest"), F.max("high").alias("highest"))
    fits = (100 * F.col("high") >= rule.per_cent * F.col("lowest")) & (100 * F.col("highest") >= rule.per_cent * F.col("low"))
    meetings = (
        members.join(F.broadcast(bounds), "root")
        .filter((F.col("row") != F.col("other")) & fits)
        .select("doc_id", "root", "known", "row", (F.col("known") != F.col("largest")).alias("asks"), "other")
    )
    number = F.xxhash64("root", F.least("row", "other"), F.greatest("row", "other")).alias("part")
    return _search_parts(meetings.select(number, "doc_id", "known", "asks"), texts, rule)
