"""Web archives as seekable Zstandard bundles.

Records are grouped into independent frames of about FRAME bytes, frames into bundles, and a bundle ends with a seek
table (a skippable frame: the sizes of all frames, their number and a closing mark), so that any Zstandard reader can
read it as one stream of records, and a reader that knows the table can read one frame. A table of Parquet maps every
record's identifier to its bundle, frame and place in the frame.

Each task writes bundles under names of its own and tells them to the index, whose commit makes them part of the
archive: bundles of tasks that were lost or run twice are in no index and are not read.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import re
import struct
import uuid
from collections.abc import Iterator
from datetime import datetime, timezone
from typing import NamedTuple
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapfold.llm.common import cut, partitions, register, shared_dir, spread

#: Uncompressed bytes after which a frame ends, and bytes after which a bundle ends.
FRAME, BUNDLE = 1 << 20, 1 << 28
LEVEL = 3
#: Fixed values of the seekable format: the skippable frame of the table, and the mark at its end.
TABLE_MAGIC, FOOTER_MAGIC = 0x184D2A5E, 0x8F92EAB1
#: Fixed value of the archive format: what a revisit is.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = "record_id string, bundle string, frame int, frame_start long, frame_bytes long, start long, bytes long"


class Record(NamedTuple):
    headers: dict[str, str]
    block: bytes
    start: int
    size: int


def new_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share, as an address that tasks can open without Spark."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}")
    folder = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    folder = re.sub("^file:/(?!/)", "file:///", folder)
    register(folder)
    return folder


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: str | None, digest: str) -> str:
    """Made from the page and the digest, so that a revisit can name the response without having seen its record."""
    return f"urn:page:{'-' if page_id is None else '.' + quote(page_id, safe='')}:{digest}"


def page_of(name: str) -> str | None:
    part = name.split(":")[2]
    return None if part == "-" else unquote(part[1:])


def record_bytes(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in [*headers, ("Content-Length", str(len(block)))]), "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def page_record(page_id: str | None, url: str | None, payload: bytes, first_id: str | None, revisit: bool, date: str) -> tuple[str, bytes]:
    """(identifier, bytes) of a page's record. A revisit holds the response's head only; its Content-Length is the payload's."""
    digest = digest_of(payload)
    name = record_id(page_id, digest)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    plain = quote(url or "", safe="%:/?#[]@!$&'()*+,;=-._~") or "urn:page"  # no line end may break a header
    headers = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<{name}>"), ("WARC-Date", date), ("WARC-Target-URI", plain)]
    if plain != url:
        headers.append(("X-Target", json.dumps(url)))
    headers += [("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http;msgtype=response")]
    if revisit:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{record_id(first_id, digest)}>")]
    return name, record_bytes(headers, http if revisit else http + payload)


def records_of(data: bytes) -> Iterator[Record]:
    """The records of a frame, one after another."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].decode().split("\r\n")
        if version != "WARC/1.1":
            raise ValueError(f"no record at {at}")
        headers = dict(line.split(": ", 1) for line in lines)
        begin, size = end + 4, int(headers["Content-Length"])
        if data[begin + size : begin + size + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at {at} does not end where it says")
        yield Record(headers, data[begin : begin + size], at, begin + size + 4 - at)
        at = begin + size + 4


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The closing skippable frame for frames of (compressed, uncompressed) bytes."""
    entries = b"".join(struct.pack("<II", *f) for f in frames)
    return struct.pack("<II", TABLE_MAGIC, len(entries) + 9) + entries + struct.pack("<IBI", len(frames), 0, FOOTER_MAGIC)


def read_seek_table(file, size: int) -> list[tuple[int, int, int]]:
    """(start, compressed, uncompressed) of each frame, from the end of a bundle of ``size`` bytes."""
    file.seek(size - 9)
    n, flags, magic = struct.unpack("<IBI", file.read(9))
    if magic != FOOTER_MAGIC:
        raise ValueError("no seek table at the end")
    width = 12 if flags & 0x80 else 8  # with checksums
    file.seek(size - 9 - n * width)
    table, out, at = file.read(n * width), [], 0
    for k in range(n):
        packed, plain = struct.unpack_from("<II", table, k * width)
        out.append((at, packed, plain))
        at += packed
    return out


class Bundle:
    """A bundle that is being written: frames to a stream, places of records kept until it is closed."""

    def __init__(self, path: str, frame: int):
        import zstandard

        from pyarrow.fs import FileSystem

        fs, inner = FileSystem.from_uri(path)
        fs.create_dir(inner.rpartition("/")[0], recursive=True)
        self.path, self.limit, self.out = path, frame, fs.open_output_stream(inner, compression=None)
        self.pack = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True, write_checksum=True).compress
        self.open, self.frames, self.index, self.pending = io.BytesIO(), [], [], []
        self.size = 0
        self.add(None, record_bytes([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", now()), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))

    def add(self, name: str | None, record: bytes) -> None:
        if self.open.tell() and self.open.tell() + len(record) > self.limit:
            self.end_frame()
        if name is not None:
            self.pending.append((name, self.open.tell(), len(record)))
        self.open.write(record)

    def end_frame(self) -> None:
        packed = self.pack(self.open.getvalue())
        self.out.write(packed)
        self.index += [(name, self.path, len(self.frames), self.size, len(packed), start, n) for name, start, n in self.pending]
        self.frames.append((len(packed), self.open.tell()))
        self.size += len(packed)
        self.open, self.pending = io.BytesIO(), []

    def close(self) -> list[tuple]:
        if self.open.tell():
            self.end_frame()
        self.out.write(seek_table(self.frames))
        self.out.close()
        return self.index


def now() -> str:
    return datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def with_firsts(pages: DataFrame, least: int = 0, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, payload, first_id, revisit) of each page: whether an equal payload has a smaller id, and which.

    Payloads are known by SHA-256 on the way. One may be a great part of all rows, so ids are reduced before they move
    and rows of a frequent payload are dealt over several parts.
    """
    payload = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("sha"))
    known = cut(rows.groupBy("sha").agg(F.count("*").alias("n"), F.min("page_id").alias("first_id")))
    # Only payloads that occur twice can have revisits; the rest of the rows need no partner.
    twice = known.where("n > 1").select("sha", "first_id")
    out = spread(rows, "sha", known)(twice, "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id")) & (F.octet_length("payload") >= least)
    return out.select("page_id", "url", "payload", "first_id", F.coalesce(revisit, F.lit(False)).alias("revisit"))


def write_bundles(pages: DataFrame, folder: str, least: int = 0, frame: int = FRAME, bundle: int = BUNDLE, page_id: str = "page_id", url: str = "url", html: str = "html", date: str | None = None) -> DataFrame:
    """Write a record for each row of pages into bundles in ``folder``; returns the index, which is in folder/index.

    The payload is the html in UTF-8, whole, however long (null: empty): a record longer than a frame has a frame of
    its own. Of rows with equal payloads of ``least`` bytes or more, that with the smallest page_id is a response and
    the others revisit it; null ids count as largest, and rows that repeat the smallest id (or have no id, where all
    have none) are responses too. Extra columns are ignored; an empty table gives an empty index and no bundle.
    """
    date = date or now()
    rows = with_firsts(pages, least, page_id, url, html)
    rows = rows.withColumns({c: F.col(c).cast("string") for c in ("page_id", "first_id")})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = None
        for batch in batches:
            done = []
            for values in zip(*(batch.column(i) for i in range(5)), strict=True):
                page, link, text, first, revisit = values
                name, record = page_record(page.as_py(), link.as_py(), text.as_py().encode(), first.as_py(), revisit.as_py(), date)
                if open_ is not None and open_.size + len(record) > bundle and open_.frames:
                    done += open_.close()
                    open_ = None
                open_ = open_ or Bundle(f"{folder}/{uuid.uuid4().hex}.warc.zst", frame)
                open_.add(name, record)
            if done:
                yield as_batch(done)
        if open_ is not None:
            yield as_batch(open_.close())

    rows.mapInArrow(run, INDEX).write.mode("append").parquet(f"{folder}/index")
    return read_index(pages.sparkSession, folder)


def as_batch(index: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int32(), *(pa.int64(),) * 4)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*index, strict=True), kinds, strict=True)], names=[f.split()[0] for f in INDEX.split(", ")])


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """The index of an archive: record_id, bundle, frame, where the frame is in the bundle, and the record in the frame."""
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def opened(path: str):
    """A bundle as a file that can seek, and its size."""
    from pyarrow.fs import FileSystem

    fs, inner = FileSystem.from_uri(path)
    return fs.open_input_file(inner), fs.get_file_info(inner).size


def frame_at(file, start: int, packed: int) -> bytes:
    import zstandard

    file.seek(start)
    return zstandard.ZstdDecompressor().decompress(file.read(packed))


RECORDS = "record_id string, page string, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to string"


def as_row(record: Record) -> tuple | None:
    """A page's record, None for the bundle's own. A response's digest and size are those of the payload that is there, which must be what the record says."""
    h = record.headers
    kind = h["WARC-Type"]
    if kind not in ("response", "revisit"):
        return None
    head, _, payload = record.block.partition(b"\r\n\r\n")
    said = h["WARC-Payload-Digest"].removeprefix("sha1:")
    size = int(next(line.split(b": ")[1] for line in head.split(b"\r\n") if line.startswith(b"Content-Length: ")))
    name, other = h["WARC-Record-ID"].strip("<>"), h.get("WARC-Refers-To", "").strip("<>")
    if kind == "response" and (digest_of(payload), len(payload)) != (said, size):
        raise ValueError(f"{name}: the payload is not what its record says")
    url = json.loads(h["X-Target"]) if "X-Target" in h else h["WARC-Target-URI"]
    return name, page_of(name), url, kind, payload if kind == "response" else None, size, said, page_of(other) if other else None


def frames_of(spark: SparkSession, folder: str) -> DataFrame:
    """(bundle, frame, start, packed, plain) of all frames of an archive, from the seek tables of the bundles its index knows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                file, size = opened(path)
                with file:
                    table = read_seek_table(file, size)
                n = len(table)
                yield pa.RecordBatch.from_arrays([pa.array([path] * n), pa.array(range(n), pa.int32()), *(pa.array(c, pa.int64()) for c in zip(*table, strict=True))], names=["bundle", "frame", "start", "packed", "plain"])

    bundles = read_index(spark, folder).select("bundle").distinct()
    return bundles.mapInArrow(run, "bundle string, frame int, start long, packed long, plain long")


def _records(places: DataFrame) -> DataFrame:
    """Rows of RECORDS from places (bundle, start, packed, wanted): all records of a frame, or those that begin at the wanted places in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([pa.field(n, {"string": pa.string(), "binary": pa.binary(), "long": pa.int64()}[t]) for n, t in (f.split() for f in RECORDS.split(", "))])
        path, file = None, None
        for batch in batches:
            for bundle, start, packed, wanted in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if bundle != path:
                    if file:
                        file.close()
                    (file, _), path = opened(bundle), bundle
                data = frame_at(file, start, packed)
                found = records_of(data) if wanted is None else (next(records_of(data[w["start"] : w["start"] + w["bytes"]])) for w in wanted)
                rows = [r for r in map(as_row, found) if r]
                if rows:  # a frame at a time
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        if file:
            file.close()

    return places.select("bundle", "start", "packed", "wanted").mapInArrow(run, RECORDS)


def read_bundles(spark: SparkSession, folder: str, page_type: str = "bigint") -> DataFrame:
    """All page records of an archive: page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to, record_id.

    Frames are read by themselves, in any number of tasks. Sizes and digests of responses are taken from the payloads
    read, those of revisits from their records. page_type is the type of page_id. An archive of no record has no row.
    """
    frames = frames_of(spark, folder).withColumn("wanted", F.lit(None).cast("array<struct<start:bigint,bytes:bigint>>"))
    # Frames of one bundle lie together in a part, so that a task opens few files, unless bundles are few.
    dealt = frames.repartition(partitions(spark), "bundle", F.expr("frame div 8")).sortWithinPartitions("bundle", "frame")
    return _typed(_records(dealt), page_type)


def fetch(spark: SparkSession, folder: str, wanted: DataFrame, page_type: str = "bigint") -> DataFrame:
    """The records whose record_id is in ``wanted``, once each, by reading only the frames that hold them.

    Identifiers that the archive does not have are left out.
    """
    places = read_index(spark, folder).join(wanted.select("record_id").distinct(), "record_id").dropDuplicates(["record_id"])
    frames = places.groupBy("bundle", F.col("frame_start").alias("start"), F.col("frame_bytes").alias("packed")).agg(F.array_sort(F.collect_list(F.struct("start", "bytes"))).alias("wanted"))  # of one frame
    return _typed(_records(frames), page_type)


def _typed(records: DataFrame, page_type: str) -> DataFrame:
    return records.select(F.col("page").cast(page_type).alias("page_id"), "url", "payload", "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(page_type).alias("refers_to"), "record_id")
