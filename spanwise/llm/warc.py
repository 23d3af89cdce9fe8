"""Web archives: a writer with revisit records, and a data source that reads headers before payloads."""

from __future__ import annotations

import base64
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from spanwise.llm.files import get, place, put
from spanwise.session import materialise, shared_folder

# A file is closed once it holds so many bytes, and is then read by a task of its own.
FILE_BYTES = 64 << 20
DATE = "2020-01-01T00:00:00Z"
LEAST_BYTES = 0
LIST = "_files"

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

RECORD = "urn:page:"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
COLUMNS = (
    "page_id long, url string, record_type string, refers_to long, payload_digest string,"
    " payload_bytes long, payload binary"
)
BLANK = b"\r\n\r\n"
# A gzip header with one extra field "sl": the member's compressed and plain sizes.
MEMBER = "<4B4x2BH2sHII"
MEMBER_BYTES = struct.calcsize(MEMBER)
SIZES_FIELD = b"sl"


def member(content: bytes) -> bytes:
    """A gzip member that tells its own size, so that readers can step over it."""
    packer = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = packer.compress(content) + packer.flush()
    tail = struct.pack("<II", zlib.crc32(content), len(content) & 0xFFFFFFFF)
    size = MEMBER_BYTES + len(body) + len(tail)
    head = struct.pack(MEMBER, 0x1F, 0x8B, 8, 4, 0, 255, 12, SIZES_FIELD, 8, size & 0xFFFFFFFF, len(content) & 0xFFFFFFFF)
    return head + body + tail


def record(page_id, url, digest: str, refers_to, payload: bytes) -> bytes:
    """One WARC record: a response with its payload, or a revisit with the HTTP headers alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = http.encode() + (payload if refers_to is None else b"")
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<{RECORD}{'' if page_id is None else page_id}>"),
        ("WARC-Date", DATE),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if url is not None:
        # A header is one line; what would break it, and the percent sign itself, is written as percent codes.
        coded = "".join(f"%{ord(c):02X}" if c in "%\r\n" else c for c in url)
        fields.append(("WARC-Target-URI", coded))
    if refers_to is not None:
        fields += [("WARC-Refers-To", f"<{RECORD}{refers_to}>"), ("WARC-Profile", REVISIT)]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return member(head.encode() + block + BLANK)


def write(pages: DataFrame, folder: str, least_bytes: int = LEAST_BYTES) -> None:
    """Write a record for each row of ``pages`` and the list of the files.

    Of records with equal payloads of at least ``least_bytes``, that of the largest
    ``page_id`` is a response and the others revisit it; rows that share this id are all
    responses. A null html is an empty payload, a null url is left out, and a row
    without ``page_id`` is always a response. An empty table gives an empty list;
    other columns are not read.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long"), "url", html.alias("html")).withColumn("sha1", F.sha1("html"))
    large = rows.filter(F.octet_length("html") >= least_bytes).filter("page_id is not null")
    # Payloads that occur once need no partner, which leaves a small table to join with.
    kept = (
        large.groupBy("sha1")
        .agg(F.max("page_id").alias("kept"), F.min("page_id").alias("least"))
        .filter("least < kept")
        .select("sha1", "kept")
    )
    refers = F.when((F.octet_length("html") >= least_bytes) & (F.col("page_id") < F.col("kept")), F.col("kept"))
    placed = rows.join(kept, "sha1", "left").select("page_id", "url", "html", "sha1", refers.alias("refers_to"))

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, held, size, count = [], [], 0, 0

        def close() -> None:
            names.append(f"{put(folder, 'part', b''.join(held))}")
            held.clear()

        for batch in batches:
            for i in range(batch.num_rows):
                page, url, text, sha1, refers_to = (c[i].as_py() for c in batch.columns)
                digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                held.append(record(page, url, digest, refers_to, text.encode()))
                size += len(held[-1])
                count += 1
                if size >= FILE_BYTES:
                    close()
                    size = 0
        if held:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], ["file"])

    files = materialise(placed.mapInArrow(save, "file string"), "warc-files")
    # A name for each file of many megabytes.
    listed = sorted(r["file"] for r in files.collect())
    system, path = place(folder)
    system.create_dir(path, recursive=True)
    with system.open_output_stream(f"{path}/{LIST}") as out:
        out.write(json.dumps(listed).encode())


class Archive(InputPartition):
    def __init__(self, file: str) -> None:
        self.file = file


def headers(lines: bytes) -> dict[str, str]:
    pairs = (line.split(":", 1) for line in lines.decode().split("\r\n")[1:] if ":" in line)
    return {k.strip().lower(): v.strip() for k, v in pairs}


def page_of(text: str | None) -> int | None:
    number = (text or "").strip("<>").removeprefix(RECORD)
    return int(number) if number else None


class WarcReader(DataSourceReader):
    """Reads archives file by file; a record's headers decide whether its payload is decoded."""

    def __init__(self, options: dict) -> None:
        self.folder = options["path"]
        self.payload = options.get("payload", "false").lower() == "true"
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]):
        """Equality on what the WARC headers hold is checked here, anything else by Spark."""
        known = {("record_type",), ("page_id",), ("refers_to",), ("payload_digest",), ("url",)}
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute in known:
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                column = f.attribute[0]
                self.wanted[column] = self.wanted.get(column, values) & values
            else:
                yield f

    def partitions(self):
        return [Archive(name) for name in json.loads(get(self.folder, LIST))]

    def read(self, partition: Archive | None):
        if partition is None:  # a folder without files
            return
        content = memoryview(get(self.folder, partition.file))
        at = 0
        while at < len(content):
            size = self._size(content, at)
            # Enough for the headers of most records; more is decoded only where it is needed.
            unpacker, plain, used = zlib.decompressobj(-15), b"", at + MEMBER_BYTES
            while plain.count(BLANK) < 2 and used < at + size:
                step = content[used : min(at + size, used + 512)]
                plain += unpacker.decompress(step)
                used += len(step)
            head, _, rest = plain.partition(BLANK)
            row = self._row(headers(head))
            if all(row[k] in v for k, v in self.wanted.items()):
                http, _, body = rest.partition(BLANK)
                row["payload_bytes"] = int(headers(http)["content-length"])
                if self.payload and row["record_type"] == "response":
                    body += unpacker.decompress(content[used : at + size])
                    row["payload"] = body[: row["payload_bytes"]]
                yield tuple(row.values())
            at += size

    @staticmethod
    def _size(content: memoryview, at: int) -> int:
        fields = struct.unpack(MEMBER, content[at : at + MEMBER_BYTES])
        if fields[:4] != (0x1F, 0x8B, 8, 4) or fields[7] != SIZES_FIELD:
            raise ValueError("not a gzip member with its sizes")
        return fields[9]

    @staticmethod
    def _row(fields: dict[str, str]) -> dict:
        url = fields.get("warc-target-uri")
        for code, plain in (("%0D", "\r"), ("%0A", "\n"), ("%25", "%")):
            url = url.replace(code, plain) if url else url
        return {
            "page_id": page_of(fields.get("warc-record-id")),
            "url": url,
            "record_type": fields["warc-type"],
            "refers_to": page_of(fields.get("warc-refers-to")),
            "payload_digest": fields["warc-payload-digest"].removeprefix("sha1:"),
            "payload_bytes": None,
            "payload": None,
        }


class WarcSource(DataSource):
    """``spark.read.format("warc")``; the option ``payload`` asks for the responses' payloads."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options))


def read(spark: SparkSession, folder: str, payload: bool = False) -> DataFrame:
    """The records of a folder; filters on types and headers are pushed into the reader."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("payload", str(payload)).load(folder)


def base32(digits: Column) -> Column:
    """The 40 hexadecimal ``digits`` of a SHA-1 in base 32; a number of 60 bits has 15 of the one and 12 of the other."""

    def part(begin: int, size: int) -> Column:
        return F.lpad(F.conv(F.substring(digits, begin, size), 16, 32), size * 4 // 5, "0")

    return F.translate(F.concat(part(1, 15), part(16, 15), part(31, 10)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def verified(spark: SparkSession, folder: str) -> DataFrame:
    """The records of a folder, without payloads, after a check of every payload.

    The payloads of responses are read; their length and digest are taken from their
    bytes, and the job fails if a record's headers tell others. Revisits have no payload:
    what they tell is held against the response that they refer to, and a revisit that
    refers to no response, or to other bytes, fails the job too. Null ids stay null; an
    empty folder gives no rows.
    """
    read_back = read(spark, folder, payload=True).filter("record_type = 'response'")
    measured = read_back.select(
        "page_id",
        "url",
        "record_type",
        "refers_to",
        F.struct("payload_digest", "payload_bytes").alias("told"),
        F.struct(base32(F.sha1("payload")).alias("digest"), F.octet_length("payload").cast("long").alias("bytes")).alias("own"),
    )
    agrees = F.when(F.col("told") == F.col("own"), F.col("own")).otherwise(_refuse("payload of page ", "page_id"))
    responses = materialise(
        measured.withColumn("own", agrees).select(
            "page_id", "url", "record_type", "refers_to", "own.digest", "own.bytes"
        ),
        "warc-payloads",
    ).withColumnsRenamed({"digest": "payload_digest", "bytes": "payload_bytes"})
    revisits = read(spark, folder).filter("record_type = 'revisit'").drop("payload")
    # A response is met by its page, length and digest, so pages that share an id are told apart.
    targets = responses.select(
        F.col("page_id").alias("refers_to"), "payload_digest", "payload_bytes", F.lit(True).alias("found")
    ).distinct()
    held = revisits.join(targets, ["refers_to", "payload_digest", "payload_bytes"], "left").select(
        "page_id",
        "url",
        F.when(F.col("found"), F.col("record_type")).otherwise(_refuse("revisit of page ", "page_id")).alias("record_type"),
        "refers_to",
        "payload_digest",
        "payload_bytes",
    )
    return responses.unionByName(held)


def _refuse(what: str, column: str) -> Column:
    return F.raise_error(F.concat(F.lit(what), F.coalesce(F.col(column).cast("string"), F.lit("null")), F.lit(" does not agree with its headers")))


def archive_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
