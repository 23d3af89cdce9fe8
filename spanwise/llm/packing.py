"""Best-fit packing of documents into sequences of bounded length."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwise.llm.tokens import slices, text_encoder

SIZE = 2048
END = 0
# Pieces that one task packs; the number of shards follows the number of documents.
SHARD = 32_768

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class SumOfSquares:
    """Open bins by residual gap; each item goes where the squared counts sum to least.

    Moving a bin from gap g to gap h changes the sum by 2 (n[h] - n[g]) + 2; a bin that
    is filled leaves the count, a new one enters it. Among equal changes the smallest
    gap that fits is taken, and a new bin last.
    """

    def __init__(self, size: int) -> None:
        self.size = size
        self.counts = np.zeros(size + 1, np.int64)
        self.open: list[list[int]] = [[] for _ in range(size + 1)]
        self.used = 0

    def place(self, length: int) -> tuple[int, int]:
        """The bin and the offset in it of an item of ``length`` (1 to size)."""
        counts, size = self.counts, self.size
        gaps = counts[length:size]
        change = 2 * (counts[: size - length] - gaps) + 2
        if len(change):
            # A filled bin has no gap to be counted under.
            change[0] = 1 - 2 * gaps[0]
            change[gaps == 0] = np.iinfo(np.int64).max
            best = int(change.argmin())
        fresh = 2 * int(counts[size - length]) + 1 if length < size else 0
        if len(change) and gaps[best] and change[best] <= fresh:
            gap = best + length
            chosen = self.open[gap].pop()
            counts[gap] -= 1
        else:
            gap, chosen = size, self.used
            self.used += 1
        if gap > length:
            self.open[gap - length].append(chosen)
            counts[gap - length] += 1
        return chosen, size - gap


def pieces(docs: DataFrame, tokenizer: str, size: int = SIZE, end: int = END) -> DataFrame:
    """The pieces of each document: its ids and the ``end`` id, cut every ``size`` ids.

    A null text counts as empty and yields the end id alone. Repeated rows yield
    repeated pieces. Columns other than ``doc_id`` and ``text`` are not read.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = text_encoder(tokenizer)
        for batch in batches:
            texts = batch.column(1)
            for part in slices(batch.column(2).to_pylist()):
                ids, ends = encoder.encode(texts[part])
                ids = ids.astype("<u4")
                last = np.array([end], "<u4").tobytes()
                rows: list[tuple] = []
                begin = 0
                for doc, stop in zip(batch.column(0)[part].to_pylist(), ends.tolist(), strict=True):
                    whole = memoryview(ids[begin:stop].tobytes() + last)
                    total = stop - begin + 1
                    for number, at in enumerate(range(0, total, size)):
                        cut_to = min(at + size, total)
                        rows.append((doc, number, at, cut_to - at, zlib.crc32(whole[4 * at : 4 * cut_to])))
                    begin = stop
                names = ("doc_id", "piece", "start", "length", "ids_crc32")
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                columns = zip(zip(*rows, strict=True), types, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], names)

    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.length(text).alias("n")).mapInArrow(
        cut, PIECES
    )


def pack(docs: DataFrame, tokenizer: str, size: int = SIZE, end: int = END, shard: int = SHARD) -> DataFrame:
    """Place every piece of every document in a sequence of at most ``size`` ids.

    Documents are dealt by a hash into shards of about ``shard`` pieces, so that no
    task packs more whatever the size of the corpus; a full piece is a sequence of its
    own and takes no room in the shard's memory. Within a shard long pieces go first,
    then by ``doc_id``, so a task that runs again gives the same sequences. An empty
    table gives no rows; documents without text hold the end id; equal rows are packed
    once each.
    """
    shards = max(1, -(-docs.count() // shard))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, bins, whole = None, SumOfSquares(size), 0
        for batch in batches:
            numbers, offsets = [], []
            for group, length in zip(batch.column(5).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if group != current:
                    current, bins, whole = group, SumOfSquares(size), 0
                if length == size:
                    # Full pieces count downwards from the end of the shard's numbers.
                    whole += 1
                    number, offset = (1 << 40) - whole, 0
                else:
                    number, offset = bins.place(length)
                numbers.append((group << 40) + number)
                offsets.append(offset)
            columns = [*batch.columns[:5], pa.array(numbers, pa.int64()), pa.array(offsets, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:5], "sequence_id", "offset"])

    dealt = pieces(docs, tokenizer, size, end).withColumn(
        "shard", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards))
    )
    ordered = dealt.repartition("shard").sortWithinPartitions("shard", F.desc("length"), "doc_id", "piece")
    return ordered.mapInArrow(fill, f"{PIECES}, sequence_id long, offset long")


def sequences(docs: DataFrame, placed: DataFrame, tokenizer: str, end: int = END) -> DataFrame:
    """The packed sequences themselves: ``sequence_id`` and its ``ids`` in order.

    Only the ids of one sequence, of bounded length, meet in a group.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = text_encoder(tokenizer)
        for batch in batches:
            for part in slices(batch.column(2).to_pylist()):
                ids, ends = encoder.encode(batch.column(1)[part])
                lists = [[*x.tolist(), end] for x in np.split(ids, ends[:-1])]
                columns = [batch.column(0)[part], pa.array(lists, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "all_ids"])

    text = F.coalesce(F.col("text"), F.lit(""))
    encoded = docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.length(text).alias("n")).mapInArrow(
        encode, "doc_id long, all_ids array<int>"
    )
    cut = F.slice("all_ids", (F.col("start") + 1).cast("int"), F.col("length").cast("int"))
    own = placed.join(encoded.dropDuplicates(["doc_id"]), "doc_id").select(
        "sequence_id", F.struct("offset", cut.alias("ids")).alias("part")
    )
    parts = F.array_sort(F.collect_list("part"))
    return own.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
