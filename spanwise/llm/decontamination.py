"""Benchmark passages in documents, found by SimHash windows and verified by weighted shingles."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwise.llm.tokens import process_memory, slices
from spanwise.llm.words import NOT_ALNUM, U, mix, shingles, words

SHINGLE = 5
SIMILARITY = 0.8
# Bits of a fingerprint. Texts as similar as SIMILARITY differ in about 19 of them, in more than RADIUS about
# once in seven hundred; texts that have nothing in common differ in 64, in RADIUS or fewer once in a hundred millions.
BITS = 128
RADIUS = 31
# An index of blocks of 16 bits. Items are listed under all block values that differ in at most RADIUS // 8 bits.
BLOCK_BITS = 16
BLOCKS = BITS // BLOCK_BITS
# Items whose index is held in memory at a time (about 22 kB each); more are searched for in further passes.
ITEMS = 4_000
# Shingles whose bits are summed at a time.
PIECE = 8_192

FOUND = "doc_id long, item_id long, similarity double, start_word long, n_words int"


def bit_sums(grams: np.ndarray) -> np.ndarray:
    """How many of the shingles before each place have each of BITS bits."""
    both = np.stack([grams, mix(grams ^ U(0x5851F42D4C957F2D))], axis=1)
    sums = np.zeros((len(grams) + 1, BITS), np.int32)
    np.cumsum(np.unpackbits(both.view(np.uint8), axis=1, bitorder="little"), axis=0, dtype=np.int32, out=sums[1:])
    return sums


def fingerprints(sums: np.ndarray, starts: np.ndarray, count) -> np.ndarray:
    """SimHash, two words each, of the ``count`` shingles from each of ``starts`` on."""
    on = 2 * (sums[starts + count] - sums[starts]) > np.reshape(count, (-1, 1))
    return np.packbits(on, axis=1, bitorder="little").view(U)


class HammingIndex:
    """All items of a kind within RADIUS of a fingerprint.

    Two fingerprints that differ in at most RADIUS bits differ in at most
    RADIUS // BLOCKS bits in one block; each item is listed under all block values
    that near, so that the lists of a fingerprint's own block values hold it. Lists
    are kept by block value and kind together; a list may hold items of others, which
    are told apart by their kind and whole fingerprint.
    """

    def __init__(self, prints: np.ndarray, kinds: np.ndarray) -> None:
        self.prints, self.kinds = prints, kinds
        near = range(RADIUS // BLOCKS + 1)
        flips = np.array([sum(1 << b for b in some) for k in near for some in combinations(range(BLOCK_BITS), k)])
        self.slots = 1 << int(np.clip(len(prints) * len(flips), 1 << 16, 1 << 21) - 1).bit_length()
        self.lists = []
        for block in range(BLOCKS):
            slots = self._slots(self._blocks(prints)[:, block][:, None] ^ flips, kinds[:, None]).ravel()
            order = np.argsort(slots, kind="stable")
            bounds = np.searchsorted(slots[order], np.arange(self.slots + 1)).astype(np.int32)
            self.lists.append((bounds, (order // len(flips)).astype(np.int32)))

    @staticmethod
    def _blocks(prints: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(prints).view(np.uint16).astype(np.int64)

    def _slots(self, values: np.ndarray, kinds) -> np.ndarray:
        return (values + kinds * 0x9E3779B1) & (self.slots - 1)

    def listed(self, prints: np.ndarray, kind: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of places in ``prints`` and of items of the kind that share a list, repeated for each shared list."""
        blocks, places, items = self._blocks(prints), [], []
        for block, (bounds, listed) in enumerate(self.lists):
            slot = self._slots(blocks[:, block], kind)
            begins, sizes = bounds[slot], bounds[slot + 1] - bounds[slot]
            some = np.flatnonzero(sizes)
            begins, sizes = begins[some], sizes[some]
            item = listed[np.arange(int(sizes.sum())) + np.repeat(begins - (np.cumsum(sizes) - sizes), sizes)]
            own = self.kinds[item] == kind
            places.append(np.repeat(some, sizes)[own])
            items.append(item[own])
        return np.concatenate(places), np.concatenate(items).astype(np.int64)

    def near(self, prints: np.ndarray, kind: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of places in ``prints`` and of items of the kind within the radius."""
        place, item = self.listed(prints, kind)
        close = np.bitwise_count(prints[place] ^ self.prints[item]).sum(axis=1) <= RADIUS
        both = np.unique(place[close] * len(self.prints) + item[close])
        return both // len(self.prints), both % len(self.prints)


def weights(grams: np.ndarray, sizes: np.ndarray) -> Counter:
    """Shingles with their letters (bytes), added up over repetitions."""
    total: Counter = Counter()
    for gram, size in zip(grams.tolist(), sizes.tolist(), strict=True):
        total[gram] += size
    return total


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard similarity of two bags of shingles."""
    shared = sum(min(w, b[g]) for g, w in a.items() if g in b)
    whole = sum(a.values()) + sum(b.values()) - shared
    return shared / whole if whole else 0.0


class Benchmark:
    """Items of one pass, and the index of their fingerprints by number of words."""

    def __init__(self, ids: list[int], texts: list[str]) -> None:
        hashes, sizes, ends = words(pa.array(texts, pa.string()), NOT_ALNUM)
        self.items: list[tuple[int, Counter]] = []
        self.least: dict[int, int] = {}
        kinds, prints = [], []
        known: dict[int, list[np.ndarray]] = {}
        for i, (begin, end) in enumerate(zip([0, *ends.tolist()], ends.tolist(), strict=False)):
            if end > begin:
                size, n = end - begin, min(SHINGLE, end - begin)
                grams = shingles(hashes[begin:end], n)
                bag = weights(grams, _letters(sizes[begin:end], n))
                self.items.append((ids[i], bag))
                self.least[size] = min(self.least.get(size, bag.total()), bag.total())
                kinds.append(size)
                prints.append(fingerprints(bit_sums(grams), np.zeros(1, np.int64), len(grams)))
                known.setdefault(n, []).append(grams)
        self.index = HammingIndex(np.concatenate([np.empty((0, BITS // 64), U), *prints]), np.array(kinds, np.int64))
        self.known = {n: np.unique(np.concatenate(g)) for n, g in known.items()}
        self.filters = {n: np.bincount((g & U(0xFFFFF)).astype(np.int64), minlength=1 << 20) > 0 for n, g in self.known.items()}

    def hits(self, grams: np.ndarray, n: int) -> np.ndarray:
        """Places of shingles that occur in some item."""
        maybe = np.flatnonzero(self.filters[n][(grams & U(0xFFFFF)).astype(np.int64)])
        known = self.known[n]
        at = np.minimum(np.searchsorted(known, grams[maybe]), len(known) - 1)
        return maybe[known[at] == grams[maybe]]

    def search(self, hashes: np.ndarray, sizes: np.ndarray, ends: np.ndarray) -> dict[tuple[int, int], tuple]:
        """Best (similarity, first word, number of words) of each document and item among many documents.

        Only windows that hold some shingle of an item are fingerprinted: the others
        have a similarity of zero to all. A document shorter than an item is one window,
        if it has letters enough to be similar.
        """
        best: dict[tuple[int, int], tuple] = {}
        begins = np.concatenate([[0], ends[:-1]])
        for n in self.known:
            grams, letters = shingles(hashes, n), _letters(sizes, n)
            hits = self.hits(grams, n)
            docs = np.searchsorted(ends, hits, side="right")
            # Shingles that run into the next text are no hits of either.
            hits, docs = hits[hits + n <= ends[docs]], docs[hits + n <= ends[docs]]
            if not len(hits):
                continue
            lists = {s: _starts(hits, begins[docs], ends[docs], s, n) for s in self.least if min(SHINGLE, s) == n}
            touched = np.unique(docs)
            total = np.concatenate([[0], np.cumsum(letters)])
            whole = total[ends[touched] - n + 1] - total[begins[touched]]
            spans = {s: [(starts, np.full(len(starts), s))] for s, starts in lists.items()}
            for s in spans:
                short = touched[(ends[touched] - begins[touched] < s) & (whole / self.least[s] >= SIMILARITY)]
                spans[s].append((begins[short], ends[short] - begins[short]))
            for s, (full, short) in spans.items():
                spans[s] = tuple(np.concatenate(pair) for pair in zip(full, short, strict=True))
            for place, size, item in self._near(grams, n, spans):
                count = size - n + 1
                name, bag = self.items[item]
                same = similarity(weights(grams[place : place + count], letters[place : place + count]), bag)
                if same >= SIMILARITY:
                    d = int(np.searchsorted(ends, place, side="right"))
                    first = place - int(begins[d])
                    held = best.get((d, name), (0, 0, 0))
                    if (same, -first) > (held[0], -held[1]):
                        best[d, name] = (same, first, size)
        return best

    def _near(self, grams: np.ndarray, n: int, spans: dict[int, tuple]) -> Iterator[tuple[int, int, int]]:
        """First word, words and item of each window whose fingerprint lies near the item's.

        Bits are summed over the shingles of windows only, a bounded piece of them at a time.
        """
        marks = np.zeros(len(grams) + 1, np.int32)
        for starts, lengths in spans.values():
            np.add.at(marks, starts, 1)
            np.add.at(marks, starts + lengths - n + 1, -1)
        used = np.flatnonzero(np.cumsum(marks[:-1]) > 0)
        ordered = []
        for kind, (starts, lengths) in spans.items():
            order = np.argsort(starts, kind="stable")
            ordered.append((kind, starts[order], lengths[order], np.searchsorted(used, starts[order])))
        longest = max((int(lengths.max()) for _, _, lengths, _ in ordered if len(lengths)), default=0)
        for lo in range(0, len(used), PIECE):
            sums = bit_sums(grams[used[lo : lo + PIECE + longest]])
            for kind, starts, lengths, places in ordered:
                part = slice(*np.searchsorted(places, (lo, lo + PIECE)).tolist())
                if part.stop > part.start:
                    prints = fingerprints(sums, places[part] - lo, lengths[part] - n + 1)
                    window, item = self.index.near(prints, kind)
                    yield from zip(starts[part][window].tolist(), lengths[part][window].tolist(), item.tolist(), strict=True)


def _starts(hits: np.ndarray, begins: np.ndarray, ends: np.ndarray, size: int, n: int) -> np.ndarray:
    """First words of all windows of ``size`` words that hold a hit and lie in the hit's document."""
    first = np.maximum(hits - (size - n), begins)
    last = np.minimum(hits, ends - size)
    # Hits ascend, so a window that an earlier hit has too begins no later than that one's last.
    first = np.maximum(first, np.maximum.accumulate(np.concatenate([[-1], last[:-1]])) + 1)
    many = np.maximum(last - first + 1, 0)
    return np.arange(int(many.sum())) + np.repeat(first - (np.cumsum(many) - many), many)


def _letters(sizes: np.ndarray, n: int) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(sizes)])
    return total[n:] - total[:-n]


def find(docs: DataFrame, benchmark: DataFrame, items: int = ITEMS) -> DataFrame:
    """A row for each document and benchmark item that share a passage.

    Words are runs of letters and digits in lower case. A window has as many words as
    the item, or is the whole document if that has fewer; it matches if its fingerprint lies within RADIUS of the item's and the
    weighted Jaccard similarity of their five-word shingles (whole text if shorter) is
    at least SIMILARITY; the best window is returned. The items are a query set: they
    go to every task in passes of about ``items``, over all documents each. Null and
    empty texts match nothing; rows with a null ``doc_id`` or ``item_id`` are kept as
    they are; equal rows give equal rows; empty tables give no rows; other columns are not read.
    """
    spark = docs.sparkSession
    text = F.lower(F.coalesce(F.col("text"), F.lit("")))
    plain = docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.length(text).alias("n"))
    queries = benchmark.select(F.col("item_id").cast("long"), text.alias("text"))
    passes = max(1, -(-queries.count() // items))
    results = []
    for number in range(passes):
        part = queries.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == number).distinct().collect()
        index = spark.sparkContext.broadcast(Benchmark([r["item_id"] for r in part], [r["text"] for r in part]))

        def search(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            process_memory("decontamination")
            items = index.value
            for batch in batches:
                for part in slices(batch.column(2).to_pylist()):
                    ids = batch.column(0)[part]
                    found = items.search(*words(batch.column(1)[part], NOT_ALNUM))
                    rows = [(ids[d].as_py(), item, *best) for (d, item), best in found.items()]
                    columns = zip(*rows, strict=True) if rows else [[]] * 5
                    types = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int32())
                    arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
                    yield pa.RecordBatch.from_arrays(arrays, [f.split()[0] for f in FOUND.split(", ")])

        results.append(plain.mapInArrow(search, FOUND))
    found = results[0]
    for more in results[1:]:
        found = found.unionByName(more)
    return found
