"""WARC archives as seekable Zstandard bundles.

Records are grouped into independent Zstandard frames of about a MiB. A bundle is a
run of frames and ends with a seek table in a skippable frame, in the published
seekable format, so that any Zstandard reader can unpack a bundle and a seeking one
can read a frame alone. An index table maps each record to its bundle, frame and
offset within the frame.

Bundles get names of their own for every attempt of a task, and the index is written
by Spark's commit protocol: bundles of lost attempts are in no index and never read.

Defined results: a null html is an empty payload; a null url has no target header;
payloads under ``MIN_REVISIT`` bytes are all responses; rows that share the smallest
page_id of a payload are all responses; null page ids come last; empty tables give
an empty index.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import materialise, pick, scratch_path

MIN_REVISIT = 100
FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 64 << 20
LEVEL = 3
DATE = "2024-01-01T00:00:00Z"
#: Of the published seekable format: magic of the skippable frame and of its footer. Fixed values.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
INDEX = pa.schema([("page_id", pa.int64()), ("bundle", pa.string()), ("frame", pa.int32()), ("frame_start", pa.int64()), ("frame_bytes", pa.int64()), ("offset", pa.int64()), ("length", pa.int64())])
FRAME = ["bundle", "frame", "frame_start", "frame_bytes"]
READ = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string())])


def _opened(path: str):
    return pafs.FileSystem.from_uri(path)


def classify(pages: DataFrame, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """page_id, url, html, payload_bytes, payload_digest, record_type, refers_to.

    Only digests that occur twice or more are gathered, after counts on the map side;
    they are a written table, so that a payload with a third of the pages makes a join
    that adaptive execution splits.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pick(pages, "page_id", "url", "html").select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html", F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha2(payload, 256).alias("payload_digest"))
    same = rows.where(F.col("payload_bytes") >= min_bytes).groupBy(F.col("payload_digest").alias("_d")).agg(F.count(F.lit(1)).alias("_n"), F.min("page_id").alias("_first")).where("_n > 1 and _first is not null")
    same = materialise(same, "payloads")
    rows = rows.join(same, (rows["payload_digest"] == same["_d"]) & (rows["payload_bytes"] >= min_bytes), "left")
    again = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return rows.select("page_id", "url", "html", "payload_bytes", "payload_digest", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("_first")).alias("refers_to"))


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page:{page_id}')}>"


def build_record(page_id, url, html, size, digest, kind, refers) -> bytes:
    """A WARC/1.1 record; a revisit has the HTTP header but no payload."""
    body = HTTP + (html or "").encode() if kind == "response" else HTTP
    head = [b"WARC/1.1", f"WARC-Type: {kind}".encode(), f"WARC-Record-ID: {record_id(page_id)}".encode(), f"WARC-Date: {DATE}".encode()]
    if url is not None:
        head.append(b"WARC-Target-URI: " + quote(url, safe=":/?#[]@!$&'()*+,;=%~").encode())
    head += [f"WARC-Payload-Digest: sha256:{digest}".encode(), b"Content-Type: application/http; msgtype=response"]
    if kind == "revisit":
        head += [b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers)}".encode(), f"X-Refers-To-Page: {refers}".encode()]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}".encode())
    head += [f"X-Payload-Length: {size}".encode(), f"Content-Length: {len(body)}".encode()]
    return b"\r\n".join(head) + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Header fields of one record, lower case, and its ``payload``; raises ValueError where lengths or the digest disagree."""
    cut = data.index(b"\r\n\r\n")
    lines = data[:cut].decode().split("\r\n")
    head = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    body = data[cut + 4 : cut + 4 + int(head["content-length"])]
    if lines[0] != "WARC/1.1" or data[cut + 4 + len(body) :] != b"\r\n\r\n":
        raise ValueError("a record does not end where its header says")
    head["payload"] = body.partition(b"\r\n\r\n")[2]
    if head["warc-type"] == "response" and hashlib.sha256(head["payload"]).hexdigest() != head["warc-payload-digest"].removeprefix("sha256:"):
        raise ValueError(f"payload of {head['warc-record-id']} does not match its digest")
    return head


class Bundle:
    """Writes frames to one file and the seek table after them."""

    def __init__(self, folder: str):
        self.name = f"{folder}/{uuid.uuid4().hex}.warc.zst"
        fs, path = _opened(folder)
        fs.create_dir(path, recursive=True)
        self.out = fs.open_output_stream(f"{path}/{self.name.rpartition('/')[2]}", compression=None)
        self.zip, self.frames, self.at = zstandard.ZstdCompressor(level=LEVEL), [], 0

    def add(self, records: list[tuple[int | None, bytes]]) -> Iterator[tuple]:
        packed = self.zip.compress(b"".join(r for _, r in records))
        offset = 0
        for key, record in records:
            yield key, self.name, len(self.frames), self.at, len(packed), offset, len(record)
            offset += len(record)
        self.out.write(packed)
        self.frames.append((len(packed), offset))
        self.at += len(packed)

    def close(self) -> None:
        table = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table)
        self.out.close()


def seek_table(path: str) -> list[tuple[int, int, int]]:
    """(start, packed bytes, bytes) of each frame of a bundle, from its footer alone."""
    fs, name = _opened(path)
    with fs.open_input_file(name) as f:
        size = f.size()
        n, _, magic = struct.unpack("<IBI", f.read_at(9, size - 9))
        if magic != SEEKABLE_MAGIC:
            raise ValueError(f"{path} has no seek table")
        sizes = list(struct.iter_unpack("<II", f.read_at(8 * n, size - 9 - 8 * n)))
    out, at = [], 0
    for packed, plain in sizes:
        out.append((at, packed, plain))
        at += packed
    return out


def write_archives(records: DataFrame, folder: str, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Writes a record per row of ``classify`` into bundles in ``folder``; returns the committed index."""

    def write(batches):
        bundle, waiting, held, rows = None, [], 0, []
        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "payload_bytes", "payload_digest", "record_type", "refers_to")), strict=True):
                record = build_record(*r)
                bundle = bundle or Bundle(folder)
                waiting.append((r[0], record))
                held += len(record)
                if held >= frame_bytes:
                    rows += bundle.add(waiting)
                    waiting, held = [], 0
                    if bundle.at >= bundle_bytes:
                        bundle.close()
                        bundle = None
            if rows and bundle is None or len(rows) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), INDEX.types, strict=True)], schema=INDEX)
                rows = []
        if waiting:
            rows += bundle.add(waiting)
        if bundle:
            bundle.close()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), INDEX.types, strict=True)], schema=INDEX)

    return materialise(records.mapInArrow(write, "page_id long, bundle string, frame int, frame_start long, frame_bytes long, offset long, length long"), "warc-index")


def _records(frame: bytes) -> Iterator[tuple[int | None, int, int]]:
    """(page_id, offset, length) of each record of an unpacked frame, from the headers' lengths."""
    at = 0
    while at < len(frame):
        cut = frame.index(b"\r\n\r\n", at)
        head = dict(line.split(b": ", 1) for line in frame[at:cut].split(b"\r\n")[1:])
        length = cut + 4 + int(head[b"Content-Length"]) + 4 - at
        page = head.get(b"X-Page-ID")
        yield None if page is None else int(page), at, length
        at += length


def recovered_index(spark: SparkSession, folder: str) -> DataFrame:
    """The index of the bundles in a folder, made anew from their seek tables, for when it was lost.

    A bundle without a seek table is of an attempt that didn't end and is left out; one
    that a lost attempt did end is taken, so that its records stand twice. Frames are
    found from the footers, then dealt to tasks, each of which unpacks one at a time.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
    bundles = files.select(F.regexp_replace("path", "^file:/(?!/)", "file:///").alias("bundle"))

    def frames(batches):
        for batch in batches:
            rows = []
            for bundle in batch.column(0).to_pylist():
                try:
                    found = seek_table(bundle)
                except (ValueError, OSError, struct.error):  # cut off
                    continue
                rows += [(bundle, i, start, packed) for i, (start, packed, _) in enumerate(found)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], INDEX.field(n).type) for i, n in enumerate(FRAME)], names=FRAME)

    def records(batches):
        unzip = zstandard.ZstdDecompressor()
        for batch in batches:
            for bundle, frame, start, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fs, name = _opened(bundle)
                with fs.open_input_file(name) as f:
                    data = unzip.decompress(f.read_at(packed, start))
                rows = [(page, bundle, frame, start, packed, offset, length) for page, offset, length in _records(data)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), INDEX.types, strict=True)], schema=INDEX)

    found = bundles.mapInArrow(frames, "bundle string, frame int, frame_start long, frame_bytes long")
    return found.repartition("bundle", "frame").mapInArrow(records, "page_id long, bundle string, frame int, frame_start long, frame_bytes long, offset long, length long")


def read_archives(index: DataFrame) -> DataFrame:
    """Reads every record of the index: a frame is unpacked once, by the task that has its rows."""

    def read(batches):
        at, frame, unzip, opened = None, b"", zstandard.ZstdDecompressor(), {}
        for batch in batches:
            rows = []
            for _, bundle, _, start, packed, offset, length in zip(*(batch.column(n).to_pylist() for n in INDEX.names), strict=True):
                if at != (bundle, start):
                    if bundle not in opened:
                        fs, name = _opened(bundle)
                        opened = {bundle: fs.open_input_file(name)}
                    frame, at = unzip.decompress(opened[bundle].read_at(packed, start)), (bundle, start)
                r = parse_record(frame[offset : offset + length])
                page, refers = r.get("x-page-id"), r.get("x-refers-to-page")
                rows.append((None if page is None else int(page), int(r["x-payload-length"]), r["warc-payload-digest"].removeprefix("sha256:"), r["warc-type"], None if refers is None else int(refers), r.get("warc-target-uri")))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), READ.types, strict=True)], schema=READ)

    dealt = index.repartition("bundle", "frame").sortWithinPartitions("bundle", "frame", "offset")
    return dealt.mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")


def archive_round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes the pages as archives and returns what reading these back gives."""
    folder = folder or scratch_path(pages.sparkSession, "warc")
    return read_archives(write_archives(classify(pages), folder)).drop("url")
