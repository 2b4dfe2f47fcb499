"""WARC archives: a writer on Spark's own file committer, and a reader that splits files inside.

Writing. Each record is a gzip member of its own. Members are written by the text sink, whose line separator is set to one NUL
byte: a gzip member ends in its length's highest byte, which is NUL below 16 MB, so that byte is left to the separator. (A longer record
is followed by an empty member, which ends in NUL.) So task retries and lost executors are the committer's business, on any store.

Reading. A file's byte ranges are dealt to tasks. A task scans its range for gzip magic, decodes the head of each candidate and
accepts it if it starts a WARC record; it owns the records that start in its range, reads past the range's end to finish the last one, and
jumps from a record's end to the next. Payloads are hashed as they stream, in pieces of CHUNK bytes.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from displace.session import materialize

MAGIC = b"\x1f\x8b\x08"
CHUNK = 1 << 20
EMPTY_MEMBER = zlib.compressobj(9, zlib.DEFLATED, 31).flush()
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def plan_revisits(pages: DataFrame, payload: str = "html", id_col: str = "page_id", least: int = 1000) -> DataFrame:
    """The pages with payload (binary), digest (hex SHA-1) and refers_to: of records with equal payloads of at least `least` bytes the
    one with the largest id is the response (refers_to null), the others revisit it."""
    own = pages.drop("_last").withColumn("payload", F.coalesce(F.col(payload).cast("binary"), F.lit(b""))).withColumn("digest", F.sha1("payload"))
    # partial aggregation: one row per digest and task; only digests seen twice go on
    last = own.where(F.length("payload") >= least).groupBy("digest").agg(F.max(id_col).alias("_last"), F.count("*").alias("n")).where("n > 1").select("digest", "_last")
    joined = own.join(last, "digest", "left")
    return joined.withColumn("refers_to", F.when(F.col(id_col) < F.col("_last"), F.col("_last"))).drop("_last")


def _record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    revisit = refers_to is not None
    head = [
        b"WARC/1.1",
        b"WARC-Type: " + (b"revisit" if revisit else b"response"),
        b"WARC-Record-ID: <urn:page:%d>" % page_id,
        b"WARC-Target-URI: " + (url or "").replace("\r", "").replace("\n", "").encode(),
        b"WARC-Date: 1970-01-01T00:00:00Z",
        b"WARC-Payload-Digest: sha1:" + digest.encode(),
    ]
    if revisit:
        head += [b"WARC-Profile: " + PROFILE.encode(), b"WARC-Refers-To: <urn:page:%d>" % refers_to]
        payload = b""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    head += [b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % (len(http) + len(payload)), b"", b""]
    return b"\r\n".join(head) + http + payload + b"\r\n\r\n"


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url: str = "url", level: int = 1) -> None:
    """Write one record per row of what plan_revisits gives (integer ids; a null url is an empty one, a row with a null id is an error)."""

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                member = packer.compress(_record(*row)) + packer.flush()
                out.append((member if member[-1] == 0 else member + EMPTY_MEMBER)[:-1])
            yield pa.RecordBatch.from_pydict({"value": pa.array(out, pa.binary())})

    rows = pages.select(id_col, url, "payload", "digest", "refers_to").mapInArrow(members, "value binary")
    rows.select(F.col("value").cast("string")).write.option("lineSep", "\0").text(path)


class _Source:
    """A file read forwards in pieces from any place."""

    def __init__(self, uri: str):
        store, name = pafs.FileSystem.from_uri(uri)
        self.file = store.open_input_file(name)

    def read(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)


def _candidates(source: _Source, begin: int, end: int) -> Iterator[int]:
    """Places of gzip magic that start in [begin, end); send() the place to go on from."""
    at = begin
    while at < end:
        block = source.read(at, min(CHUNK, end - at) + len(MAGIC) - 1)
        i = block.find(MAGIC)
        if i < 0:
            at += max(1, len(block) - len(MAGIC) + 1)
            if len(block) < len(MAGIC):
                return
            continue
        if at + i >= end:
            return
        at = (yield at + i) or at + i + 1


def _headers(block: bytes) -> dict[str, str]:
    lines = block.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def _member(source: _Source, at: int):
    """(place after the member, headers, payload's pieces' length and SHA-1), or None if no WARC record starts here."""
    opener = zlib.decompressobj(31)
    head, place, hashed, length = b"", at, None, 0
    left = 0
    while not opener.eof:
        raw = opener.unconsumed_tail
        if not raw:
            raw = source.read(place, CHUNK)
            place += len(raw)
            if not raw:
                return None
        try:
            out = opener.decompress(raw, CHUNK)
        except zlib.error:
            return None
        if hashed is None:
            head += out
            if not b"WARC/".startswith(head[:5]) and head[:5] != b"WARC/":
                return None
            cut = head.find(b"\r\n\r\n")
            if cut < 0:
                continue
            fields = _headers(head[:cut])
            if not fields.get("content-length", "").isdigit() or "warc-type" not in fields:
                return None
            left, body, hashed = int(fields["content-length"]), head[cut + 4 :], hashlib.sha1()
            http = fields.get("content-type", "").startswith("application/http")
            waiting = b""
        else:
            body = out
        body, left = body[:left], left - min(left, len(body))
        if http:  # the payload follows the HTTP head
            waiting += body
            cut = waiting.find(b"\r\n\r\n")
            if cut < 0:
                continue
            body, http = waiting[cut + 4 :], False
        hashed.update(body)
        length += len(body)
    if hashed is None or left:
        return None
    return place - len(opener.unused_data), fields, length, hashed.hexdigest()


def records(uri: str, begin: int, end: int) -> Iterator[tuple]:
    """Records that start in [begin, end) of a file."""
    source = _Source(uri)
    found = _candidates(source, begin, end)
    at = next(found, None)
    while at is not None:
        got = _member(source, at)
        if got:
            yield (uri, at, *got[1:])
        at = _next(found, got[0] if got else at + 1)


def _next(found, at):
    try:
        return found.send(at)
    except StopIteration:
        return None


READ = "file string, start bigint, record_type string, record_id string, target_uri string, digest string, refers_to string, payload_bytes bigint, payload_sha1 string"


def read_warc(spark: SparkSession, path: str, split: int = 32 << 20) -> DataFrame:
    """One row per record of the archives below `path`: its place, type, ids, the digest its header states, and the payload's length
    and SHA-1 as read (a revisit holds no payload of its own). Files may be one member per record or hold foreign bytes between
    records, which are skipped; an empty folder gives an empty table. A record's head may be of any length and is held whole. Each range of
    `split` bytes is a task."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length").where("length > 0")
    ranges = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(split).cast("long"))).alias("begin"))
    ranges = ranges.select("path", "begin", F.least(F.col("begin") + split, "length").alias("end"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for uri, begin, end in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                for name, at, fields, length, digest in records(uri, begin, end):
                    rows.append((name, at, fields["warc-type"], fields.get("warc-record-id"), fields.get("warc-target-uri"), fields.get("warc-payload-digest"), fields.get("warc-refers-to"), length, digest))
                    if len(rows) == 4096:
                        yield _batch(rows)
                        rows = []
            yield _batch(rows)

    # a stated number is kept: ranges are a few bytes each, and would be merged into one task otherwise
    return ranges.repartition(max(1, ranges.count())).mapInArrow(scan, READ)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in READ.split(", ")]
    kinds = [pa.int64() if x.endswith("bigint") else pa.string() for x in READ.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def resolve_revisits(found: DataFrame) -> DataFrame:
    """Per page record: page_id, payload_bytes, payload_digest, record_type, refers_to. A revisit's payload is its response's (of several responses with that id the
    largest). Archives are read once, into a table of records; revisits alone are joined."""
    number = lambda c: F.regexp_extract(c, r"<urn:page:(-?\d+)>", 1)
    own = found.select(number("record_id").cast("long").alias("page_id"), "payload_bytes", "payload_sha1", "record_type", F.when(F.col("refers_to").isNotNull(), number("refers_to").cast("long")).alias("refers_to"))
    own = materialize(own, "records")
    plain = own.where("refers_to is null").select("page_id", "payload_bytes", F.col("payload_sha1").alias("payload_digest"), "record_type", "refers_to")
    full = own.where("record_type = 'response'").groupBy(F.col("page_id").alias("refers_to")).agg(F.max(F.struct("payload_bytes", "payload_sha1")).alias("full"))
    told = own.where("refers_to is not null").join(full, "refers_to", "left")
    return plain.unionByName(told.select("page_id", F.coalesce("full.payload_bytes", "payload_bytes").alias("payload_bytes"), F.coalesce("full.payload_sha1", "payload_sha1").alias("payload_digest"), "record_type", "refers_to"))
