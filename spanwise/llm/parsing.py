"""Document fingerprints by locally consistent parsing."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwise.llm.ranges import bucketed
from spanwise.llm.tokens import process_memory
from spanwise.llm.words import STEP, U, mix

# Rounds of coin tossing: names of 64 bits come down to labels below 8.
ROUNDS = 3
# Entries of a fingerprint: each holds a rank of 16 bits and a name of 32 bits.
ENTRIES = 32
# Phrases of the first level are short and common; they only count in texts without longer ones.
FIRST_LEVEL = 2
SLICE_CHARS = 400_000
ODD = U(0xD1342543DE82EF95)

PAIRS = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string,"
    " near_edited double, near_next double"
)


def _labels(names: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels below 8 that differ between neighbours, from names that do.

    One round replaces a name by twice the place of the lowest bit in which it differs
    from its left neighbour, plus that bit. ``first`` marks names without a left
    neighbour; they are compared with the complement of their own.
    """
    labels = names
    for _ in range(ROUNDS):
        left = np.empty_like(labels)
        left[1:] = labels[:-1]
        left[first] = ~labels[first]
        differing = labels ^ left
        lowest = differing & (~differing + labels.dtype.type(1))
        place = np.bitwise_count(lowest - labels.dtype.type(1))
        labels = 2 * place + ((labels & lowest) != 0).astype(np.uint8)
    return labels


class Powers:
    """Powers of an odd number modulo 2^64, and of its inverse, as far as they were needed yet."""

    def __init__(self) -> None:
        self.up = self.down = np.empty(0, U)

    def reach(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        if size > len(self.up):
            inverse = U(pow(int(ODD), -1, 1 << 64))
            self.up, self.down = (np.cumprod(np.full(2 * size, x, U)) for x in (ODD, inverse))
        return self.up, self.down


def _coded(names: np.ndarray) -> np.ndarray:
    """Symbols of 32 bits, most of them below 2^16, or names of 64 bits, as multipliers."""
    if names.dtype == np.uint32 and int(names.max()) < 1 << 16:
        kept = process_memory("parsing")
        if "characters" not in kept:
            kept["characters"] = mix(np.arange(1 << 16, dtype=U) + STEP)
        return kept["characters"][names]
    return mix(names.astype(U) + STEP)


def parse(names: np.ndarray, begins: np.ndarray, ends: np.ndarray, fresh: np.ndarray, powers: Powers):
    """The phrases of one level as (names, begins, ends, fresh), from those of the level below.

    ``begins`` and ``ends`` are places in the characters of all texts together; ``fresh``
    marks the first of each text. Repetitions of a name are first made one name. A
    phrase begins at a name whose label is larger than those of both neighbours, and at
    the begin of a text, so that whether it does depends on a few names to the left and
    one to the right only.
    """
    new = fresh.copy()
    new[1:] |= names[1:] != names[:-1]
    runs = np.flatnonzero(new)
    if len(runs) < len(names):
        lengths = np.diff(runs, append=len(names))
        ends = ends[runs + lengths - 1]
        begins, fresh, names = begins[runs], fresh[runs], names[runs].astype(U)
        many = lengths > 1
        names[many] = mix(names[many] * ODD + lengths[many].astype(U))
    labels = _labels(names, fresh)
    higher = labels[1:] > labels[:-1]
    peak = fresh.copy()
    peak[1:-1] |= higher[:-1] & (~higher[1:] | fresh[2:])
    if len(peak) > 1:
        peak[-1] |= higher[-1]
    starts = np.flatnonzero(peak)
    last = np.append(starts[1:], len(names)) - 1
    up, down = powers.reach(len(names))
    phrases = np.add.reduceat(_coded(names) * up[: len(names)], starts) * down[starts]
    phrases = mix(phrases + (last - starts).astype(U) * STEP)
    return phrases, begins[starts], ends[last], fresh[starts]


def fingerprints(texts: list[str]) -> list[str]:
    """The fingerprint of each text: its phrases of least rank, in hexadecimal; empty for an empty text.

    Phrases of all levels from the second on take part, up to the one that is the whole
    text. A phrase's rank is drawn from its name and divided by its size, so that every
    level has about the same share, and two fingerprints can be compared.
    """
    lengths = np.array([len(t) for t in texts], np.int64)
    stops = np.cumsum(lengths)
    names = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(names):
        return [""] * len(texts)
    begins = np.arange(len(names), dtype=np.int32)
    ends = begins + np.int32(1)
    fresh = np.zeros(len(names), bool)
    fresh[(stops - lengths)[lengths > 0]] = True
    kept = process_memory("parsing")
    powers = kept.setdefault("powers", Powers())
    level, held = 0, []
    while len(names):
        names, begins, ends, fresh = parse(names, begins, ends, fresh, powers)
        level += 1
        # A text that has come down to one phrase goes no further.
        alone = fresh & np.append(fresh[1:], True)
        take = slice(None) if level >= FIRST_LEVEL else alone
        held.append((names[take], begins[take], ends[take]))
        if alone.any():
            names, begins, ends, fresh = names[~alone], begins[~alone], ends[~alone], fresh[~alone]
    names, begins, ends = (np.concatenate(x) for x in zip(*held, strict=True))
    rows = np.searchsorted(stops, begins, side="right")
    drawn = ((mix(names) >> U(11)).astype(np.float64) + 1) / float(1 << 53)
    # Ranks spread over forty powers of two.
    rank = np.clip((np.log2(-np.log(drawn) / (ends - begins) + 1e-300) + 32) * 1638.4, 0, 65535).astype(U)
    value = (rank << U(32)) | (names & U(0xFFFFFFFF))
    order = np.lexsort((value, rows))
    value, rows = value[order], rows[order]
    unlike = np.append(True, (value[1:] != value[:-1]) | (rows[1:] != rows[:-1]))
    value, rows = value[unlike], rows[unlike]
    first = np.searchsorted(rows, np.arange(len(texts)))
    stop = np.minimum(np.searchsorted(rows, np.arange(len(texts)), side="right"), first + ENTRIES)
    kept = np.arange(len(value)) - first[rows] < ENTRIES
    coded = dict(zip(np.flatnonzero(kept).tolist(), value[kept].tolist(), strict=True))
    return ["".join([f"{coded[i]:012x}" for i in range(a, b)]) for a, b in zip(first.tolist(), stop.tolist(), strict=True)]


def likeness(a: str, b: str) -> float:
    """The share of common entries among the least of both fingerprints; 1 for two empty ones."""
    if a == b:
        return 1.0
    first = {a[i : i + 12] for i in range(0, len(a), 12)}
    second = {b[i : i + 12] for i in range(0, len(b), 12)}
    # Beyond the largest entry of a full fingerprint the other one's entries tell nothing.
    least = sorted(first | second)[:ENTRIES]
    return sum(e in first and e in second for e in least) / len(least) if least else 1.0


def edit(text: str, following: str) -> str:
    """``text`` with its last third replaced by as many characters from the begin of ``following``."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def with_next(docs: DataFrame) -> DataFrame:
    """Rows ``bucket, head, doc_id, text`` in which each document stands before the next one by falling id.

    Consecutive ids share a bucket; the first document of the bucket below is added at
    the end of each, marked as ``head``, and the very first one in the last. Rows without
    ``doc_id`` come last; rows of one ``doc_id`` follow each other by text.
    """
    text = F.coalesce(F.col("text"), F.lit("")).alias("text")
    placed = bucketed(docs.select(F.col("doc_id").cast("long"), text), "doc_id")
    # A row for each bucket; there are as many as shuffle partitions.
    largest = placed.groupBy("bucket").agg(F.max("doc_id").alias("doc_id")).orderBy(F.desc("bucket")).collect()
    following = largest[1:] + largest[:1]
    pairs = [(after["bucket"], after["doc_id"], here["bucket"]) for here, after in zip(largest, following, strict=True)]
    heads = docs.sparkSession.createDataFrame(pairs, "bucket int, first long, target int")
    copies = placed.join(F.broadcast(heads), "bucket").filter(F.col("doc_id").eqNullSafe(F.col("first")))
    copies = copies.select(F.col("target").alias("bucket"), F.lit(True).alias("head"), "doc_id", "text")
    rows = placed.select("bucket", F.lit(False).alias("head"), "doc_id", "text").unionByName(copies)
    order = ["bucket", "head", F.desc_nulls_last("doc_id"), "text"]
    return rows.repartition("bucket").sortWithinPartitions(*order)


def compare(docs: DataFrame) -> DataFrame:
    """Per row: fingerprints of the text and of its edited form, and their likeness, and that to the next text.

    The edited text has the last third replaced by the begin of the next document by
    falling ``doc_id``; the last is followed by the first, and a single document by
    itself. Null texts are empty; an empty table gives no rows; other columns are not
    read; texts of any length are parsed whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple] = []
        size = 0

        def flush(rows: list[tuple]) -> pa.RecordBatch:
            """``rows`` is (doc_id, text, next text)."""
            texts = [t for _, t, _ in rows]
            edited = [edit(t, n) for _, t, n in rows]
            following = [n for _, _, n in rows]
            made = fingerprints(texts + edited)
            own, changed = made[: len(rows)], made[len(rows) :]
            known = dict(zip(texts, own, strict=True))
            other = [n for n in following if n not in known]
            known.update(zip(other, fingerprints(other), strict=True))
            columns = [
                pa.array([d for d, _, _ in rows], pa.int64()),
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited]),
                pa.array(own, pa.string()),
                pa.array(changed, pa.string()),
                pa.array([likeness(a, b) for a, b in zip(own, changed, strict=True)], pa.float64()),
                pa.array([likeness(a, known[n]) for a, n in zip(own, following, strict=True)], pa.float64()),
            ]
            return pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in PAIRS.split(", ")])

        last = None
        for batch in batches:
            for bucket, head, doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if last is not None and last[0] == bucket:
                    waiting.append((last[1], last[2], text))
                    size += len(last[2])
                    if size >= SLICE_CHARS:
                        yield flush(waiting)
                        waiting, size = [], 0
                # A head ends its bucket; rows that share its id are not needed.
                last = None if head else (bucket, doc, text)
        if waiting:
            yield flush(waiting)

    return with_next(docs).mapInArrow(run, PAIRS)
