"""WARC archives as seekable Zstandard bundles.

Records are grouped into independent Zstandard frames of about FRAME_BYTES; each bundle ends in a seek table (the Zstandard
seekable format: a skippable frame that lists the frames' sizes), and an index table maps each record identifier to its
bundle, frame and offset within the frame. Any record is read by one seek and the decompression of one frame.

Of records whose payloads are equal and have at least MIN_REVISIT bytes, those with the least page_id are `response`, others
are `revisit` records that refer to it and store no payload.

Defined results: null html is an empty payload; rows that repeat the least page_id with the same payload are all responses; a
record with a null page_id is always a response; null url is empty; extra columns are ignored; an empty table gives no bundle.
A payload of any length is one record, in a frame of its own if longer than a frame.

Recovery: each attempt of a task writes bundles of names of its own, moved to their place when whole, so no attempt ever replaces a
bundle of another and none is half-written; the index is written by Spark's committer and names only the bundles of the attempts that
it committed. What a lost or late attempt leaves is named by no index row.
"""

from __future__ import annotations

import struct
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 256 << 20
MIN_REVISIT = 100
LEVEL = 3
#: Fixed values of the Zstandard seekable format.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1
INDEX = "page_id long, record_id string, bundle string, frame int, frame_at long, frame_length long, offset long, length long"


def classify(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, payload_digest, payload_bytes, refers_to, refers_url): the last two are set for revisits only."""
    html = F.coalesce("html", F.lit(""))
    keyed = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), html.alias("html"), F.sha2(html, 256).alias("payload_digest"), F.octet_length(html).cast("long").alias("payload_bytes"))
    first = keyed.where(F.col("payload_bytes") >= MIN_REVISIT).groupBy("payload_digest").agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("_first"), F.count("*").alias("_n")).where("_n > 1").select("payload_digest", "_first")
    # pre-aggregated to a row for each repeated payload; a payload that a third of all pages share is split by AQE's skew join
    return keyed.join(first, "payload_digest", "left").withColumn("_first", F.when(F.col("page_id") > F.col("_first.page_id"), F.col("_first"))).select("*", F.col("_first.page_id").alias("refers_to"), F.col("_first.url").alias("refers_url")).drop("_first")


def _headers(fields: list[tuple[str, str]]) -> bytes:
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode()


def identifier(page_id: int | None, url: str, digest: str) -> str:
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}|{url}|{digest}')}"


def _uri(url: str) -> str:
    return url.replace("\r", "%0D").replace("\n", "%0A")


def record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None, refers_url: str | None) -> tuple[str, bytes]:
    """(identifier, bytes) of a record; the same row always gives the same record."""
    rid = identifier(page_id, url, digest)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<{rid}>"), ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", _uri(url)), ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block))), ("X-Payload-Length", str(len(payload))),
    ]
    if page_id is not None:
        fields.append(("X-Page-Id", str(page_id)))
    if refers_to is not None:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("X-Refers-To-Page-Id", str(refers_to)), ("WARC-Refers-To", f"<{identifier(refers_to, refers_url, digest)}>"), ("WARC-Refers-To-Target-URI", _uri(refers_url))]
    return rid, _headers(fields) + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if len(block) != int(fields["Content-Length"]):
        raise ValueError("a record is cut short")
    return fields, block.partition(b"\r\n\r\n")[2]


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class Bundle:
    """Writes one bundle."""

    def __init__(self, folder: str, name: str):
        import zstandard

        self.fs, root = _filesystem(folder)
        self.final, self.partial = f"{root}/{name}", f"{root}/.{name}.{uuid.uuid4().hex}"
        self.uri = f"{folder.rstrip('/')}/{name}"
        self.fs.create_dir(root, recursive=True)
        self.out, self.zstd = self.fs.open_output_stream(self.partial), zstandard.ZstdCompressor(level=LEVEL)
        self.frames: list[tuple[int, int]] = []
        self.buffer, self.at, self.rows = bytearray(), 0, []
        self.done: list[list] = []

    def add(self, page_id: int | None, rid: str, data: bytes) -> None:
        if self.buffer and len(self.buffer) + len(data) > FRAME_BYTES:
            self.flush()
        self.rows.append((page_id, rid, len(self.buffer), len(data)))
        self.buffer += data

    def flush(self) -> None:
        if self.buffer:
            frame = self.zstd.compress(bytes(self.buffer))
            self.out.write(frame)
            self.done += [[page, rid, self.uri, len(self.frames), self.at, len(frame), off, n] for page, rid, off, n in self.rows]
            self.frames.append((len(frame), len(self.buffer)))
            self.at += len(frame)
            self.buffer, self.rows = bytearray(), []

    def close(self) -> list[list]:
        self.flush()
        table = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table)
        self.out.close()
        self.fs.move(self.partial, self.final)
        return self.done


def seek_table(f, size: int) -> list[tuple[int, int, int]]:
    """(start, compressed, plain size) of each frame, from the footer of an open file."""
    f.seek(size - 9)
    n, flags, magic = struct.unpack("<IBI", f.read(9))
    if magic != SEEKABLE_MAGIC or flags & 0x80:
        raise ValueError("no plain seek table")
    f.seek(size - 9 - 8 * n)
    out, at = [], 0
    sizes = struct.unpack(f"<{2 * n}I", f.read(8 * n))
    for i in range(n):
        out.append((at, sizes[2 * i], sizes[2 * i + 1]))
        at += sizes[2 * i]
    return out


def write_bundles(classified: DataFrame, folder: str) -> DataFrame:
    """Writes the bundles to folder and returns the index; evaluate it once, by writing it."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        task, attempt, number, bundle, written = TaskContext.get().partitionId(), uuid.uuid4().hex[:12], 0, None, 0
        names = [x.split(" ")[0] for x in INDEX.split(", ")]

        def rows(done: list[list]):
            columns = list(zip(*done, strict=True))
            types = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

        for batch in batches:
            page, url, html, digest, refers, refers_url = (batch.column(c) for c in ("page_id", "url", "html", "payload_digest", "refers_to", "refers_url"))
            for i in range(len(page)):
                if bundle is None:
                    bundle, written = Bundle(folder, f"part-{task:06d}-{attempt}-{number:04d}.warc.zst"), 0
                    number += 1
                rid, data = record(page[i].as_py(), url[i].as_py(), html[i].as_py().encode(), digest[i].as_py(), refers[i].as_py(), refers_url[i].as_py())
                bundle.add(page[i].as_py(), rid, data)
                written += len(data)
                if written >= BUNDLE_BYTES:
                    yield rows(bundle.close())
                    bundle = None
        if bundle is not None:
            yield rows(bundle.close())

    ready = classified.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", "payload_digest", F.col("refers_to").cast("long").alias("refers_to"), "refers_url")
    return ready.mapInArrow(run, INDEX)


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string"


def read_bundles(index: DataFrame) -> DataFrame:
    """A row for each record of the index, read from its frame: bytes and digest are taken from the stored payload (a revisit
    has those of the payload it refers to, from its headers)."""

    def run(batches):
        import hashlib

        import pyarrow as pa
        import zstandard

        open_uri, f, frames, plain, key = None, None, [], b"", None
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for uri, frame, offset, length, rid in zip(*(batch.column(c).to_pylist() for c in ("bundle", "frame", "offset", "length", "record_id")), strict=True):
                if uri != open_uri:
                    if f is not None:
                        f.close()
                    fs, path = _filesystem(uri)
                    f, open_uri, key = fs.open_input_file(path), uri, None
                    frames = seek_table(f, f.size())
                if key != (uri, frame):
                    at, packed, size = frames[frame]
                    f.seek(at)
                    plain, key = zstandard.ZstdDecompressor().decompress(f.read(packed), max_output_size=size), (uri, frame)
                fields, payload = parse(plain[offset : offset + length])
                if fields["WARC-Record-ID"] != f"<{rid}>":
                    raise ValueError("the index points at another record")
                revisit = fields["WARC-Type"] == "revisit"
                digest = fields["WARC-Payload-Digest"].removeprefix("sha256:") if revisit else hashlib.sha256(payload).hexdigest()
                page, refers = fields.get("X-Page-Id"), fields.get("X-Refers-To-Page-Id")
                row = [None if page is None else int(page), int(fields["X-Payload-Length"]) if revisit else len(payload), digest, fields["WARC-Type"], None if refers is None else int(refers), rid]
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=[x.split(" ")[0] for x in READ.split(", ")])
        if f is not None:
            f.close()

    # whole frames go to a task in order, so each is decompressed once; frames, not bundles, are the unit of parallelism
    dealt = index.repartition("bundle", "frame").sortWithinPartitions("bundle", "frame", "offset")
    return dealt.mapInArrow(run, READ)


def archive(pages: DataFrame, folder: str | None = None) -> tuple[DataFrame, str]:
    """Writes pages as bundles; returns the index (a table in the shared folder) and the bundles' folder."""
    spark: SparkSession = pages.sparkSession
    scratch = Scratch(spark, "warc")
    folder = folder or scratch.path("bundles")
    return scratch.save(write_bundles(classify(pages), folder), "index"), folder
