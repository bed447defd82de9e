"""WARC archives: write records, index them, and read selected ones back by coalesced ranges of bytes."""

from __future__ import annotations

import base64
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialscope.llm.common import kept_table, small_batches, text_of

#: Fixed values of the format.
VERSION, LINE, BLANK = b"WARC/1.1", b"\r\n", b"\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads of at least so many bytes are written once and then revisited.
REVISIT_BYTES = 1000
#: Archive files are closed at about this size; ranges closer than GAP are read together, up to READ bytes.
FILE_BYTES, GAP, READ = 256 << 20, 64 << 10, 8 << 20
#: Bytes of archives that a task reads back, and tasks over which the rows of one payload are dealt.
TASK_BYTES, SALTS = 16 << 20, 16
INDEX = "file string, offset long, length long, page_id long, url string, digest string, record_type string"


def filesystem(path: str):
    """The store of a path, as pyarrow sees it, and the path in it: local or mounted files, hdfs, gs, and s3 (s3a is opened as s3)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", path))


def header_value(text: str | None) -> str:
    """A header's value on one line: white space at its ends and line breaks are percent-encoded."""
    return re.sub(r"[\x00-\x1f\x7f%]|^ | $", lambda m: f"%{ord(m[0]):02X}", text or "")


def record_bytes(page_id, url: str | None, payload: bytes, digest: bytes, length: int, refers_to) -> bytes:
    """One record; a revisit has no payload. The digest header is in base 32, as archives have it."""
    revisit = refers_to is not None
    body = b"" if revisit else payload
    head = [
        VERSION.decode(),
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {header_value(url)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}",
        f"X-Payload-Length: {length}",
        *([f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"] if revisit else []),
        "Content-Type: text/html",
        f"Content-Length: {len(body)}",
    ]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + BLANK + body + BLANK


def parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of a record."""
    head, _, rest = raw.partition(BLANK)
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if lines[0] != VERSION.decode():
        raise ValueError(f"not a record: {lines[0][:40]!r}")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    return headers, rest[: int(headers["Content-Length"])]


def with_digests(pages: DataFrame) -> DataFrame:
    """page_id, url, html (null: empty), digest and bytes of each row."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), text_of("html").alias("html"))
    return rows.withColumns({"digest": F.sha1(F.col("html").cast("binary")), "bytes": F.octet_length("html").cast("long")})


def write_archives(pages: DataFrame, folder: str, least: int = REVISIT_BYTES) -> DataFrame:
    """Write a record per row of pages into gzip archives (a member per record) and return their index.

    Index rows: file, offset, length (bytes of the member), page_id, url, digest, record_type. Tasks
    write to files of their own name; the index is kept as a table by Spark's commit protocol, so that
    only files of attempts that ended are in it, and a lost executor costs no more than its tasks.

    Of rows with equal payloads of at least `least` bytes, the one with the largest page_id is a
    response, the others are revisits of it; all other rows are responses. Groups are found with
    map-side combining on digests, and the rows of one payload are dealt over SALTS tasks, so that a
    payload that a third of all rows have is no large group; the html itself is shuffled by page_id.
    Payloads count as equal if their SHA-1 digests and sizes are; their bytes are not compared. Null html is an empty
    payload, null url an empty one; a null page_id is never revisited unless all of the group's are
    null, when each row is a response. Repeated rows of the largest page_id are each a response.
    """
    rows = with_digests(pages)
    groups = rows.where(F.col("bytes") >= least).groupBy("digest", "bytes").agg(F.max("page_id").alias("newest"), F.count(F.lit(1)).alias("n")).where("n > 1 and newest is not null")
    groups = groups.select("digest", "bytes", "newest", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salt = F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int").alias("salt")
    older = rows.where(F.col("bytes") >= least).select("page_id", "digest", "bytes", salt).join(groups, ["digest", "bytes", "salt"]).where(~F.col("page_id").eqNullSafe(F.col("newest"))).select(F.col("page_id").alias("_page"), F.col("digest").alias("_digest"), "newest").distinct()
    joined = rows.join(older, F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("digest") == F.col("_digest")), "left").select("page_id", "url", "html", "digest", "bytes", F.col("newest").alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = filesystem(folder)
        out, name, offset = None, "", 0
        try:
            for b in small_batches(batches, rows=500):
                found = []
                for page_id, url, html, digest, size, refers_to in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                    if out is None or offset >= FILE_BYTES:
                        if out is not None:
                            out.close()
                        name, offset = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{at}/{name}", compression=None)
                    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                    raw = record_bytes(page_id, url, html.encode("utf-8", "surrogatepass"), bytes.fromhex(digest), size, refers_to)
                    member = packer.compress(raw) + packer.flush()
                    out.write(member)
                    found.append((name, offset, len(member), page_id, url, digest, "response" if refers_to is None else "revisit"))
                    offset += len(member)
                if found:
                    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names=["file", "offset", "length", "page_id", "url", "digest", "record_type"])
        finally:
            if out is not None:
                out.close()

    spark = pages.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)
    index, _ = kept_table(joined.mapInArrow(write, INDEX), "warc-index")
    return index


def coalesced(offsets: list[int], lengths: list[int], gap: int = GAP, most: int = READ) -> list[tuple[int, int, list[int]]]:
    """(start, end, places) of the reads that cover sorted ranges: close ones together, up to `most` bytes."""
    out: list[tuple[int, int, list[int]]] = []
    for i, (offset, length) in enumerate(zip(offsets, lengths, strict=True)):
        if out and offset - out[-1][1] <= gap and offset + length - out[-1][0] <= most:
            start, end, places = out[-1]
            places.append(i)
            out[-1] = (start, max(end, offset + length), places)
        else:
            out.append((offset, offset + length, [i]))
    return out


def read_archives(selected: DataFrame, folder: str, segment: int = READ) -> DataFrame:
    """page_id, url, payload, headers of the selected rows of an index, read from the archives.

    Rows are dealt by file and segment of it (no task reads a whole large file) to a task per
    TASK_BYTES of archive, however small the index is, sorted by offset, and read in coalesced ranges;
    what is held is a range at a time. A record longer than a range is read alone, whole. Repeated
    rows of the index are read as often; an empty index gives an empty result.
    """
    total = selected.agg(F.sum("length")).first()[0] or 0
    dealt = selected.select("file", "offset", "length").withColumn("_part", F.floor(F.col("offset") / segment))
    ordered = dealt.repartition(-(-total // TASK_BYTES) or 1, "file", "_part").sortWithinPartitions("file", "offset")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, at = filesystem(folder)
        for b in batches:
            for name, g in b.groupby("file", sort=False):
                offsets, lengths = g["offset"].tolist(), g["length"].tolist()
                with store.open_input_file(f"{at}/{name}") as f:
                    for start, end, places in coalesced(offsets, lengths):
                        block = f.read_at(end - start, start)
                        out = []
                        for i in places:
                            headers, payload = parsed(zlib.decompress(block[offsets[i] - start : offsets[i] - start + lengths[i]], 31))
                            out.append((name, offsets[i], headers.get("WARC-Record-ID", "")[10:-1], headers["WARC-Type"], headers.get("WARC-Refers-To", "")[10:-1], headers["WARC-Payload-Digest"], int(headers["X-Payload-Length"]), headers["WARC-Target-URI"], payload))
                        yield pd.DataFrame(out, columns=["file", "offset", "page", "record_type", "refers", "digest_header", "payload_length", "url", "payload"])

    return ordered.mapInPandas(read, "file string, offset long, page string, record_type string, refers string, digest_header string, payload_length long, url string, payload binary")


def read_digests(selected: DataFrame, folder: str) -> DataFrame:
    """Per record read back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A response's digest and size are computed from the payload that was read and must be those of its
    headers; a revisit's are the headers'.
    """
    back = read_archives(selected, folder)
    own = F.sha1("payload")
    size = F.octet_length("payload").cast("long")
    header = hex_of_base32(F.substring("digest_header", 6, 32))
    right = (F.col("record_type") == "revisit") | ((own == header) & (size == F.col("payload_length")))
    return back.select(
        F.expr("try_cast(nullif(page, '') as bigint)").alias("page_id"),
        F.col("payload_length").alias("payload_bytes"),
        F.when(right, header).otherwise(F.raise_error(F.lit("a payload differs from its digest"))).alias("payload_digest"),
        "record_type",
        F.expr("try_cast(nullif(refers, '') as bigint)").alias("refers_to"),
    )


def hex_of_base32(col):
    """Lower-case hex of a base-32 text of 160 bits, eight letters (40 bits) at a time."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    digits = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
    plain = F.translate(col, letters, digits)
    return F.lower(F.concat(*(F.lpad(F.conv(F.substring(plain, 1 + 8 * i, 8), 32, 16), 10, "0") for i in range(4))))

