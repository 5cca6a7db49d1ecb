"""WARC archives, written as one gzip member per record and read back in splits.

Writing goes through Spark's text writer, so files are committed as any Spark output is and
land wherever Hadoop can write. Between two records stands an empty gzip member, which takes
the place of the line separator; the file is a plain multi-member gzip file.

Reading goes through Spark's text reader with the gzip magic as the line separator, on the
bytes as they lie in the file: a codec that never applies hides the one of ``.gz`` names, so
those files are split as well. A task scans its byte range for the magic and owns every piece
that starts inside. A piece opens a record only if it decodes to a WARC header and no member
is open; else it continues the open member, which is decompressed piece by piece. A range that
ends within a member (magic bytes inside compressed or stored data, a cut file) tells so, and
the pieces of such a file are read again in order, by one task per file.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plenum.llm.common import staged

MAGIC = b"\x1f\x8b\x08"
#: A gzip member that holds nothing.
EMPTY = bytes.fromhex("1f8b08000000000000ff" "0300" "0000000000000000")
LATIN = "ISO-8859-1"
RECORD = ("record_id string, record_type string, url string, payload_digest string, payload_bytes long, refers_to string, "
          "intact boolean, payload binary")
FOUND = f"{RECORD}, path string, unended boolean"
#: A codec list and a suffix for the text reader. A file name is looked up among the suffixes, read
#: backwards, by the last one in order before it. This one stands between ".gz" and every ".gz" name and ends no
#: name, so no codec is found and the reader splits the file as it is. Hadoop's shaded client has its own name of the key.
RAW_BYTES = {
    "io.compression.codecs": "org.apache.hadoop.io.compress.PassthroughCodec",
    "io.compress.passthrough.extension": ".raw!.gz",
    "org.apache.hadoop.shaded.io.compress.passthrough.extension": ".raw!.gz",
}


def digest32(text: Column) -> Column:
    """The bare base32 SHA-1 of a text in UTF-8: four groups of 40 bits as eight digits each."""
    hexed = F.sha1(text.cast("binary"))
    groups = [F.lpad(F.conv(F.substring(hexed, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def plan_records(pages: DataFrame, least: int = 0, *, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to).

    Of equal payloads of at least ``least`` bytes the one with the smallest page_id is the
    response (null last; of rows with the same id one), the others revisit it. A null html is
    the empty payload.
    """
    payload = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), payload.alias("payload"),
                        F.octet_length(payload).cast("long").alias("payload_bytes"), digest32(payload).alias("payload_digest"))
    firsts = rows.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(
        F.min("page_id").alias("first_id"), F.count("*").alias("copies")).where("copies > 1")
    joined = rows.join(firsts, "payload_digest", "left")
    # Only rows that share id and payload meet in this window.
    once = F.row_number().over(Window.partitionBy("payload_digest", "page_id", F.col("copies").isNull()).orderBy("url"))
    alone = F.col("copies").isNull() | (F.col("page_id").eqNullSafe(F.col("first_id")) & (F.col("nth") == 1))
    return joined.withColumn("nth", F.when(F.col("copies").isNotNull() & F.col("page_id").eqNullSafe(F.col("first_id")), once)).select(
        "page_id", "url", "payload", "payload_bytes", "payload_digest",
        F.when(alone, "response").otherwise("revisit").alias("record_type"),
        F.when(~alone, F.col("first_id")).alias("refers_to"),
    )


def _record(page_id: str, url: str | None, payload: str, digest: str, kind: str, refers_to: str) -> bytes:
    body = payload.encode("utf-8")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
    block = http + (body if kind == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\r\n]+", " ", url))
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    if kind == "revisit":
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head.append(f"Content-Length: {len(block)}")
    data = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(3, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def write_archives(records: DataFrame, folder: str) -> None:
    """Write what ``plan_records`` returns; a folder with the archives, one member per record."""

    @F.pandas_udf("binary")
    def member(page_id: pd.Series, url: pd.Series, payload: pd.Series, digest: pd.Series, kind: pd.Series, refers_to: pd.Series) -> pd.Series:
        return pd.Series([_record(*row) for row in zip(page_id, url, payload, digest, kind, refers_to, strict=True)])

    name = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    refers = F.coalesce(F.col("refers_to").cast("string"), F.lit(""))
    packed = records.select(member(name, "url", "payload", "payload_digest", "record_type", refers).cast("string").alias("value"))
    packed.write.option("lineSep", EMPTY.decode(LATIN)).option("encoding", LATIN).text(folder)


def _opens(member: bytes) -> bool:
    """May a record, or an empty member, start here? Yes too where the piece is too short to tell."""
    reader = zlib.decompressobj(31)
    try:
        start = reader.decompress(member, 16)
    except zlib.error:
        return False
    return b"WARC/".startswith(start[:5])


def _whole(text: str) -> int | None:
    return int(text) if text.isascii() and text.isdigit() else None


def parse_record(data: bytes) -> dict:
    """Headers and payload of an uncompressed record.

    The payload is the body of an HTTP message, the whole block of other content. ``intact``
    says that the block has its stated length and the payload its stated SHA-1, as far as they
    are stated. The digest and the size of a response or resource are those of the payload
    found; of other kinds, those in the headers.
    """
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    stated = _whole(fields.get("content-length", ""))
    block = rest[:stated]
    http, payload = b"", block
    if fields.get("content-type", "application/http").lower().startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
    kind, named = fields.get("warc-type"), fields.get("warc-payload-digest", "")
    algorithm, _, digest = named.rpartition(":")
    length = re.search(rb"(?im)^content-length:[ \t]*(\d+)", http)
    size, intact = int(length[1]) if length else len(payload), stated == len(block)
    if kind in ("response", "resource"):
        own = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        intact = intact and (algorithm.lower() != "sha1" or len(digest) != len(own) or digest.upper() == own)
        size, digest = len(payload), own
    return {
        "record_id": fields.get("warc-record-id"), "record_type": kind, "url": fields.get("warc-target-uri"), "payload_digest": digest,
        "payload_bytes": size, "refers_to": fields.get("warc-refers-to"), "intact": intact, "payload": payload,
    }


def parse_records(data: bytes) -> Iterator[dict]:
    """The records of one member: one, as the format has it, or all where a whole archive is one member."""
    start = 0
    while data.startswith(b"WARC/", start):
        head = data.find(b"\r\n\r\n", start)
        stated = re.search(rb"(?im)^content-length:[ \t]*(\d+)[ \t]*\r?$", data[start:head] if head >= 0 else b"")
        end = head + 4 + int(stated[1]) if stated else len(data)
        yield parse_record(data[start:end])
        start = end
        while data.startswith(b"\r\n", start):
            start += 2


class _Stitcher:
    """Turns the pieces between two magics, in order, into records.

    Every piece is decompressed once, but for those that a damaged member took: they are read
    again without it, so no record behind it is lost.
    """

    def __init__(self, keep_payload: bool):
        self.keep, self.records = keep_payload, []
        self._reset()

    def _reset(self) -> None:
        self.reader, self.pieces, self.content = None, [], []

    @property
    def open(self) -> bool:
        return self.reader is not None

    def add(self, piece: bytes) -> None:
        waiting = [MAGIC + piece]
        while waiting:
            member = waiting.pop()
            if not self.open:
                if not _opens(member):
                    continue
                self.reader = zlib.decompressobj(31)
            self.pieces.append(member)
            try:
                self.content.append(self.reader.decompress(member))
            except zlib.error:
                waiting += reversed(self.pieces[1:])
                self._reset()
                continue
            if self.reader.eof:
                data = b"".join(self.content)
                self._reset()
                self.records += [r if self.keep else r | {"payload": None} for r in parse_records(data)]

    def end_of_file(self) -> None:
        """What is still open never ends; the pieces behind its first one may hold records."""
        while self.open:
            behind = self.pieces[1:]
            self._reset()
            for member in behind:
                self.add(member[len(MAGIC):])

    def take(self) -> list[dict]:
        taken, self.records = self.records, []
        return taken


_ARROW = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
_SCHEMA = pa.schema([(name, _ARROW[kind]) for name, kind in (c.split() for c in FOUND.split(", "))])


def _scan(keep_payload: bool, in_order: bool):
    """A function over (piece, path, start): records of ranges, or of whole files whose pieces come in order."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, work = None, _Stitcher(keep_payload)

        def rows(last: bool) -> pa.RecordBatch:
            ends = []
            if last and in_order:
                work.end_of_file()
            elif last and work.open:
                ends = [{"path": at[0], "unended": True}]
                work._reset()
            return pa.RecordBatch.from_pylist([r | {"path": at[0], "unended": False} for r in work.take()] + ends, schema=_SCHEMA)

        for batch in batches:
            for piece, path, start in zip(*(batch.column(i) for i in range(3)), strict=True):
                here = (path.as_py(), 0 if in_order else start.as_py())
                if here != at:
                    if at:
                        yield rows(last=True)
                    at = here
                    if here[1] == 0:  # what stands before the first magic of a file is no member
                        continue
                work.add(piece.as_py())
            if at:
                yield rows(last=False)
        if at:
            yield rows(last=True)

    return scan


def read_archives(spark: SparkSession, folder: str, keep_payload: bool = True) -> DataFrame:
    """One row per record of the archives in ``folder``, whatever their names: see ``RECORD``.

    Empty members are skipped, as are members that never end (a cut file), members of other
    content and bytes that belong to no member. A member is held whole in memory. What the ranges hold is written once. The paths
    of files with an unended range come to the driver, a part of the listing that it holds for
    any scan; only those files are read again.
    """
    pieces = spark.read.options(**RAW_BYTES).option("lineSep", MAGIC.decode(LATIN)).option("encoding", LATIN).text(folder).select(
        F.col("value").cast("binary").alias("piece"), F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("start"))
    names = [c.split()[0] for c in RECORD.split(", ")]
    found = staged(pieces.mapInArrow(_scan(keep_payload, in_order=False), FOUND), "warc-records")
    again = [row["path"] for row in found.where("unended").select("path").distinct().collect()]
    if not again:
        return found.select(*names)
    ordered = (
        pieces.where(F.col("path").isin(again)).withColumn("position", F.monotonically_increasing_id())
        .repartition("path").sortWithinPartitions("path", "start", "position").select("piece", "path", "start")
    )
    whole = ordered.mapInArrow(_scan(keep_payload, in_order=True), FOUND)
    return found.where(~F.col("path").isin(again)).union(whole).select(*names)


def page_number(record_id: Column) -> Column:
    """The page_id inside a record id; null for a page without one."""
    return F.nullif(F.regexp_extract(F.coalesce(record_id, F.lit("")), "<urn:page:(-?[0-9]*)>", 1), F.lit("")).cast("long")
