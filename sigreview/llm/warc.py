"""WARC archives: written, normalised and read back.

``write_archives`` lets Spark's own writer compress whole files, so an archive
is one gzip stream through all its records.  ``normalise`` inflates each such stream once from
end to end, writes every record as a gzip member of its own and lists the members' places in a
sidecar index.  ``read_records`` opens members by that index.  Archives lie in a folder that
all executors share; all files go through Arrow's file systems, so the folder may be
in a store.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_checked, pin, scratch_path

#: What ends a record (two line ends), and its headers (one empty line).
END, BREAK = "\r\n\r\n", "\r\n\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_URN = "urn:page:"
DATE = "2024-01-01T00:00:00Z"

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def sha1_base32(hex_digest: Column) -> Column:
    """Bare base32 of a SHA-1 in hex: five hex digits are four base32 letters."""
    parts = []
    for i in range(0, 40, 5):
        number = F.conv(F.substring(hex_digest, i + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            parts.append(F.substring(F.lit(_BASE32), F.shiftright(number, shift).bitwiseAND(31) + 1, F.lit(1)))
    return F.concat(*parts)


def with_roles(pages: DataFrame, id_col: str, url_col: str, payload_col: str, min_bytes: int = 0) -> DataFrame:
    """_id, _url, _payload, _digest and _first: the page that a revisit refers to, null for a response.

    Of pages with equal payloads of at least ``min_bytes`` bytes the one with the largest id is the response.
    Only digests that occur again are joined, one row for each: while these are few they are sent to
    the pages, beyond that both sides shuffle and Spark splits what is skewed.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(url_col, F.lit("")).alias("_url"),
                        F.coalesce(payload_col, F.lit("")).alias("_payload"))
    rows = rows.withColumn("_sha", F.sha1("_payload"))
    groups = pin(rows.where(F.octet_length("_payload") >= min_bytes).groupBy("_sha").agg(
        F.max("_id").alias("_largest"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n"))
    joined = join_checked(rows, groups, ["_sha"], "left")
    first = F.when(F.col("_id").isNull() | (F.col("_id") < F.col("_largest")), F.col("_largest"))
    return joined.select("_id", "_url", "_payload", "_sha", first.alias("_first"))


def records(roles: DataFrame) -> DataFrame:
    """The text of one WARC record per page, without the line ends that close it.

    A revisit has the HTTP headers of its page, with the payload's length, and no payload."""
    revisit = F.col("_first").isNotNull()
    http = F.concat(F.lit(HTTP), F.octet_length("_payload").cast("string"), F.lit(BREAK))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("_payload")))
    name = lambda c: F.concat(F.lit(RECORD_URN), F.coalesce(c.cast("string"), F.lit("none")))
    uri = F.regexp_replace("_url", "[\\x00-\\x20\\x7F]", "%20")
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: <"), name(F.col("_id")), F.lit(f">\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: "), uri,
        F.lit("\r\nWARC-Payload-Digest: sha1:"), sha1_base32(F.col("_sha")),
        F.when(revisit, F.concat(F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: <"), name(F.col("_first")), F.lit(">"))).otherwise(""),
        F.lit("\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: "),
        F.octet_length(block).cast("string"), F.lit(BREAK))
    return roles.select(F.concat(head, block).alias("record"))


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url",
                   payload_col: str = "html", min_bytes: int = 0) -> None:
    """Write the records as gzip files, each one stream through all its records."""
    rows = records(with_roles(pages, id_col, url_col, payload_col, min_bytes))
    (rows.write.option("compression", "gzip").option("lineSep", END)
     .option("zlib.compress.level", "BEST_SPEED").text(folder))


# --- reading streams of records ---

def split_records(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records, in order, from inflated bytes in chunks of any size; memory is one record."""
    held = bytearray()
    length = None

    def heads() -> int | None:
        at = held.find(b"\r\n\r\n")
        if at < 0:
            return None
        for line in bytes(held[:at]).split(b"\r\n"):
            if line.lower().startswith(b"content-length:"):
                return at + 4 + int(line.split(b":", 1)[1]) + 4
        raise ValueError("a record without a length")
    for chunk in chunks:
        held += chunk
        while True:
            if length is None:
                length = heads()
            if length is None or len(held) < length:
                break
            yield bytes(held[:length])
            del held[:length]
            length = None
    if held.strip():
        raise ValueError("an archive that ends within a record")


def inflate(source, size: int = 1 << 20) -> Iterator[bytes]:
    """The inflated bytes of a gzip stream of one or many members."""
    machine = zlib.decompressobj(31)
    while data := source.read(size):
        while data:
            yield machine.decompress(data)
            data = machine.unused_data if machine.eof else b""
            if machine.eof:
                machine = zlib.decompressobj(31)


def headers(record: bytes) -> tuple[dict[str, str], bytes]:
    """A record's named fields and its block."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


def _file(path: str):
    """Arrow's file system and the path in it."""
    if path.startswith("file:"):
        path = path[len("file:"):]
        path = "/" + path.lstrip("/")
    if path.startswith("/"):
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri(path)


def _normaliser(folder: str, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, source = _file(path)
                target = folder.rstrip("/") + "/" + path.rsplit("/", 1)[1].removesuffix(".txt.gz") + ".warc.gz"
                _, place = _file(target)
                # Under a name of this attempt first: a task that runs twice writes the same file twice.
                part = f"{place}.{uuid.uuid4().hex}.part"
                names, starts, sizes, at = [], [], [], 0
                with store.open_input_stream(source, compression=None) as stream, store.open_output_stream(part, compression=None) as out:
                    for record in split_records(inflate(stream)):
                        member = gzip.compress(record, level, mtime=0)
                        out.write(member)
                        names.append(record_id(record))
                        starts.append(at)
                        sizes.append(len(member))
                        at += len(member)
                store.move(part, place)
                yield pa.record_batch([pa.array([target] * len(names), pa.string()), pa.array(names, pa.string()),
                                       pa.array(starts, pa.int64()), pa.array(sizes, pa.int64())],
                                      ["archive", "record_id", "start", "size"])
    return run


def record_id(record: bytes) -> str:
    """A record's id."""
    for line in record[: record.find(b"\r\n\r\n")].split(b"\r\n"):
        if line.startswith(b"WARC-Record-ID: "):
            return line[len(b"WARC-Record-ID: "):].decode()
    return ""


def normalise(docs: DataFrame, folder: str, level: int = 1) -> DataFrame:
    """Rewrite the archives named in ``docs`` (column path) with one gzip member per record.

    Returns the sidecar index (archive, record_id, start, size), which is written beside the archives.
    One archive is one task's work and is read as a stream, so it takes the memory of a record.
    """
    index = f"{folder.rstrip('/')}-index"
    store, place = _file(folder)
    store.create_dir(place, recursive=True)
    docs.select("path").mapInArrow(_normaliser(folder, level), "archive string, record_id string, start long, size long").write.parquet(index)
    return docs.sparkSession.read.parquet(index)


def read_records(index: DataFrame) -> DataFrame:
    """Per member that the index lists: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A response's digest and length are taken from its payload, and must agree with its headers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, source = None, None
        for batch in batches:
            ids, sizes, digests, kinds, firsts = [], [], [], [], []
            for archive, start, size in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if archive != name:
                    store, place = _file(archive)
                    name, source = archive, store.open_input_file(place)
                fields, block = headers(gzip.decompress(source.read_at(size, start)))
                http, _, payload = block.partition(b"\r\n\r\n")
                length = int(http.rsplit(b"Content-Length: ", 1)[1])
                digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                if fields["WARC-Type"] == "response":
                    if len(payload) != length or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                        raise ValueError(f"{fields['WARC-Record-ID']}: the payload is not what its headers say")
                number = lambda text: None if text is None or text.endswith("none>") else int(text[len(RECORD_URN) + 1:-1])
                ids.append(number(fields["WARC-Record-ID"]))
                sizes.append(length)
                digests.append(digest)
                kinds.append(fields["WARC-Type"])
                firsts.append(number(fields.get("WARC-Refers-To")))
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(digests, pa.string()),
                                   pa.array(kinds, pa.string()), pa.array(firsts, pa.int64())],
                                  ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
    return index.select("archive", "start", "size").mapInArrow(
        run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive_round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                       min_bytes: int = 0) -> DataFrame:
    """Write, normalise and read back: one row per page, from the archives.

    Null payloads and addresses are empty.  Among equal payloads the largest id is the response;
    rows that tie in it are all responses, rows without an id revisit it, or are responses where no row
    of the payload has one.  A payload is written and read whole, however long: memory is one record.  An
    empty table gives no archives and no rows.  Other columns are ignored.
    """
    spark = pages.sparkSession
    whole, members = scratch_path(spark, "warc-whole"), scratch_path(spark, "warc")
    write_archives(pages, whole, id_col, url_col, payload_col, min_bytes)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(whole).select("path")
    return read_records(normalise(files, members))
