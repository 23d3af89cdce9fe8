"""Token ids in binary files: frequency ranks in byte-aligned variable-length coding."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwise.llm.files import get, put
from spanwise.llm.ranges import bucketed
from spanwise.llm.tokens import slices, text_encoder
from spanwise.session import materialise, shared_folder

END = 0
# A file is closed once it holds so many ids.
FILE_IDS = 2_000_000
# Stands in the files for a document without ``doc_id``.
NO_ID = -(1 << 63)
MAGIC = b"SWIDS\x01\x00\x00"

# One file: MAGIC, five 64-bit counts (documents, ids, control bytes, data bytes, control bits per id), the
# documents' ids as 64-bit integers, their numbers of token ids as 64-bit integers, control bytes, data bytes.
# With one control bit an id's rank takes one or two bytes, with two bits one to four.
MANIFEST = "file string, first_doc long, last_doc long, docs long, ids long"
READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def control_bits(vocabulary: int) -> int:
    return 1 if vocabulary <= 1 << 16 else 2


def encode(ranks: np.ndarray, bits: int) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of ``ranks`` (below 2^16 with one bit, 2^32 with two)."""
    width = 4 if bits == 2 else 2
    ranks = ranks.astype(f"<u{width}")
    extra = (ranks > 0xFF).astype(np.uint8)
    if bits == 2:
        extra += (ranks > 0xFFFF).astype(np.uint8) + (ranks > 0xFFFFFF).astype(np.uint8)
    per = 8 // bits
    padded = np.zeros(-(-len(ranks) // per) * per, np.uint8)
    padded[: len(ranks)] = extra
    if bits == 1:
        control = np.packbits(padded, bitorder="little")
    else:
        control = (padded.reshape(-1, per) << (bits * np.arange(per, dtype=np.uint8))).sum(axis=1, dtype=np.uint8)
    kept = np.ones(len(ranks) * width, bool)
    for i in range(1, width):
        kept[i::width] = extra >= i
    return control.tobytes(), ranks.view(np.uint8)[kept].tobytes()


def decode(control: bytes, data: bytes, count: int, bits: int) -> np.ndarray:
    """The ``count`` ranks; widths come from a table with a row for each control byte."""
    if not count:
        return np.empty(0, np.uint16)
    per = 8 // bits
    table = ((np.arange(256)[:, None] >> (bits * np.arange(per))) & ((1 << bits) - 1)).astype(np.uint8)
    extra = table[np.frombuffer(control, np.uint8)].reshape(-1)[:count]
    ends = np.cumsum(extra + np.uint8(1), dtype=np.int64)
    width = 4 if bits == 2 else 2
    # At every byte a number that begins there, of which a rank's own bytes are kept.
    begun = np.ndarray(len(data) + 1, f"<u{width}", data + bytes(width), strides=(1,))
    own = np.array([(1 << 8 * (i + 1)) - 1 for i in range(width)], f"<u{width}")
    return begun[ends - 1 - extra] & own[extra]


def write(docs: DataFrame, tokenizer: str, vocabulary: int, folder: str, end: int = END) -> DataFrame:
    """Write the ids of all documents in ascending ``doc_id`` order; return the list of files.

    Each document's ids are followed by ``end``. Ids are ranked by their counts over
    the whole table (ties by id), so that the commonest take one byte. A null text is
    empty; rows with the same ``doc_id`` follow each other by text, those without one
    come first and are read back without one; an empty table gives no file. Other columns are not read.
    """
    spark = docs.sparkSession
    kind, bits = ("<u2" if vocabulary <= 1 << 16 else "<u4"), control_bits(vocabulary)

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = text_encoder(tokenizer)
        last = np.array([end], kind).tobytes()
        counts = np.zeros(vocabulary, np.int64)
        for batch in batches:
            for part in slices(batch.column(3).to_pylist()):
                ids, ends = encoder.encode(batch.column(2)[part])
                counts += np.bincount(ids, minlength=vocabulary)
                counts[end] += len(ends)
                content = [x.astype(kind).tobytes() + last for x in np.split(ids, ends[:-1])]
                columns = [batch.column(0)[part], batch.column(1)[part], pa.array(content, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["bucket", "doc_id", "ids"])
        # The task's counts, in a row of no bucket.
        columns = [pa.array([None], pa.int32()), pa.array([None], pa.int64()), pa.array([counts.tobytes()], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["bucket", "doc_id", "ids"])

    text = F.coalesce(F.col("text"), F.lit(""))
    plain = docs.select(F.col("doc_id").cast("long"), text.alias("text"))
    ordered = (
        bucketed(plain, "doc_id")
        .select("bucket", "doc_id", "text", F.length("text").alias("n"))
        .repartition(F.col("bucket"))
        .sortWithinPartitions("bucket", "doc_id", "text")
    )
    tokens = materialise(ordered.mapInArrow(tokenise, "bucket int, doc_id long, ids binary"), "token-ids", "zstd")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                counts = np.frombuffer(content.as_buffer(), np.int64)
                found = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(counts[found])], ["id", "count"])

    counted = tokens.filter("bucket is null").select("ids")
    totals = counted.mapInArrow(count, "id long, count long").groupBy("id").agg(F.sum("count"))
    counts = np.zeros(vocabulary, np.int64)
    for token, total in totals.toLocalIterator():  # as many rows as the vocabulary at most
        counts[token] = total
    by_rank = np.lexsort((np.arange(vocabulary), -counts)).astype("<u4")
    ranks = np.empty(vocabulary, np.uint32)
    ranks[by_rank] = np.arange(vocabulary, dtype=np.uint32)
    table = put(folder, "ranks", by_rank.tobytes())

    def close(rows: list[tuple[int, bytes]]) -> tuple:
        docs_of, contents = zip(*rows, strict=True)
        sizes = np.array([len(c) for c in contents], np.int64) // np.dtype(kind).itemsize
        ids = np.frombuffer(b"".join(contents), kind)
        control, data = encode(ranks[ids], bits)
        head = np.array([len(rows), len(ids), len(control), len(data), bits], "<i8")
        content = [MAGIC, head.tobytes(), np.array(docs_of, "<i8").tobytes(), sizes.astype("<i8").tobytes()]
        name = put(folder, f"ids-{docs_of[0] + (1 << 63):020d}", b"".join([*content, control, data]))
        return name, docs_of[0], docs_of[-1], len(rows), len(ids)

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        rows: list[tuple[int, bytes]] = []
        current, held = None, 0
        for batch in batches:
            for bucket, doc, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                doc = NO_ID if doc is None else doc
                # A new bucket, and a split that begins elsewhere, need not follow what came before.
                if rows and (bucket != current or doc < rows[-1][0] or held >= FILE_IDS):
                    done.append(close(rows))
                    rows, held = [], 0
                current = bucket
                rows.append((doc, ids))
                held += len(ids) // np.dtype(kind).itemsize
        if rows:
            done.append(close(rows))
        columns = zip(*done, strict=True) if done else [[]] * 5
        types = [pa.string(), *[pa.int64()] * 4]
        arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
        yield pa.RecordBatch.from_arrays(arrays, ["file", "first_doc", "last_doc", "docs", "ids"])

    # The written list, not the plan, is what readers start from: reading it again writes nothing.
    saved = materialise(tokens.filter("bucket is not null").mapInArrow(save, MANIFEST), "token-files")
    return saved.withColumn("ranks", F.lit(table))


def read(spark: SparkSession, manifest: DataFrame, folder: str) -> DataFrame:
    """Per document of the files: ``doc_id``, ``start``, ``n_tokens`` and the checksum of its ids."""
    # One row for each file of millions of ids.
    files = manifest.orderBy("first_doc", "last_doc", "file").collect()
    starts = np.cumsum([0, *(f["ids"] for f in files)]).tolist()
    rows = [(f["file"], f["ranks"], start) for f, start in zip(files, starts, strict=False)]

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, table, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                by_rank = np.frombuffer(get(folder, table), "<u4")
                docs, ids, ends = parse(get(folder, name), by_rank)
                begins = np.concatenate([[0], ends[:-1]])
                sums = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                columns = [start + begins, ends - begins, np.array(sums, np.int64)]
                arrays = [pa.array(docs, pa.int64(), mask=docs == NO_ID), *(pa.array(c, pa.int64()) for c in columns)]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "n_tokens", "ids_crc32"])

    listed = spark.createDataFrame(rows, "file string, ranks string, start long")
    return listed.repartition(max(1, len(rows)), "file").mapInArrow(load, READ)


def parse(content: bytes, by_rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The documents of a file, all their token ids as little-endian 32-bit integers, and where each ends."""
    if content[:8] != MAGIC:
        raise ValueError("not a file of token ids")
    docs, count, controls, data, bits = np.frombuffer(content, "<i8", 5, 8).tolist()
    doc_ids = np.frombuffer(content, "<i8", docs, 48)
    sizes = np.frombuffer(content, "<i8", docs, 48 + 8 * docs)
    at = 48 + 16 * docs
    ranks = decode(content[at : at + controls], content[at + controls : at + controls + data], count, bits)
    return doc_ids, by_rank[ranks], np.cumsum(sizes)


def token_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark).rstrip('/')}/token-files-{uuid.uuid4().hex}"
