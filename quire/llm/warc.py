"""WARC archives as seekable Zstandard bundles.

Records are written into bundles: files of independent Zstandard frames of a bounded size, so that any
frame can be read alone. A bundle ends in a seek table, itself a skippable frame that Zstandard tools pass
over: for each frame its compressed and uncompressed size, then the number of frames, a flag byte and the
magic number. The index maps each record to bundle, frame and the offset within the frame.

Of records with equal payloads of at least MIN_REVISIT bytes, the one with the smallest id is a response;
the others are revisits without payload that name it. Payloads are UTF-8; null payloads are empty.

Bundles go to the shared folder through Arrow's file systems. A task writes a bundle under a name of its own
attempt and renames it when it is complete, so lost executors and repeated tasks leave no half archive and
no record twice: the index names one bundle for each record. Null ids are written as such and sort last.
Rows that repeat an id and payload are all of the same type. An empty table gives an empty index. Other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, materialise, shared_dir, small

MIN_REVISIT = 100
#: Uncompressed bytes after which a frame ends, and compressed bytes after which a bundle ends.
FRAME_BYTES, BUNDLE_BYTES = 1 << 20, 256 << 20
LEVEL = 3
#: Frames that a task reads back at most.
FRAMES_EACH = 128
# Fixed values of the seekable format.
SKIPPABLE_MAGIC, SEEK_MAGIC = 0x184D2A5E, 0x8F92EAB1

INDEX = pa.schema([("page_id", pa.int64()), ("bundle", pa.string()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())])
RECORD = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("target_uri", pa.string()), ("bundle", pa.string()), ("frame", pa.int32()), ("offset", pa.int64())])


def _ddl(schema: pa.Schema) -> str:
    name = {pa.int64(): "long", pa.int32(): "int", pa.string(): "string"}
    return ", ".join(f"{f.name} {name[f.type]}" for f in schema)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """A WARC/1.1 record. The digest and length of a revisit are those of the payload it leaves out."""
    uri = "".join(c for c in url or "" if c not in "\r\n")
    ident = "" if page_id is None else page_id
    body = b"" if revisit else payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:x-page:{ident}>", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:x-page:{refers_to}>"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(data: bytes, at: int) -> tuple[dict[str, str], int, int]:
    """Headers, start and end of the body of the record at this offset of a frame."""
    stop = data.index(b"\r\n\r\n", at)
    lines = data[at:stop].decode("utf-8", "surrogatepass").split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"no record at offset {at}")
    head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    return head, stop + 4, stop + 4 + int(head["Content-Length"])


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    body = b"".join(struct.pack("<II", *f) for f in frames) + struct.pack("<IBI", len(frames), 0, SEEK_MAGIC)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body


def read_seek_table(file) -> list[tuple[int, int, int]]:
    """(offset in the file, compressed size, uncompressed size) of each frame. file: seekable, with size()."""
    file.seek(file.size() - 9)
    n, _, magic = struct.unpack("<IBI", file.read(9))
    if magic != SEEK_MAGIC:
        raise ValueError("the file has no seek table")
    file.seek(file.size() - 9 - 8 * n)
    flat = struct.unpack(f"<{2 * n}I", file.read(8 * n))
    out, at = [], 0
    for packed, plain in zip(flat[::2], flat[1::2], strict=True):
        out.append((at, packed, plain))
        at += packed
    return out


class Bundle:
    """One archive being written: frames go out as they fill; only sizes are kept."""

    def __init__(self, at: fs.FileSystem, folder: str, name: str, attempt: str):
        self.fs, self.path, self.name = at, f"{folder}/{name}", name
        self.partial = f"{folder}/.{name}.{attempt}"
        self.out = at.open_output_stream(self.partial)
        self.frames: list[tuple[int, int]] = []
        self.held, self.size, self.written = [], 0, 0
        self.packer = zstandard.ZstdCompressor(level=LEVEL)

    def add(self, data: bytes) -> tuple[int, int]:
        """Frame and offset of the record."""
        if self.size and self.size + len(data) > FRAME_BYTES:
            self.flush()
        self.held.append(data)
        self.size += len(data)
        return len(self.frames), self.size - len(data)

    def flush(self) -> None:
        if self.held:
            packed = self.packer.compress(b"".join(self.held))
            self.out.write(packed)
            self.frames.append((len(packed), self.size))
            self.written += len(packed)
            self.held, self.size = [], 0

    def close(self) -> None:
        self.flush()
        self.out.write(seek_table(self.frames))
        self.out.close()
        self.fs.move(self.partial, self.path)


def write_bundles(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write every row into bundles below folder (a URI); return the index, which is stored in the shared folder.

    Digests are compared first: only ids and digests move, and only payloads that occur twice are joined back.
    """
    spark = pages.sparkSession
    text = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), text.alias("html"))
    digest = F.unhex(F.sha2("html", 256))
    keys = rows.filter(F.octet_length("html") >= MIN_REVISIT).select("page_id", digest.alias("digest"))
    again = materialise(keys.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 AND first IS NOT NULL").select("digest", "first"), "warc-repeats")
    plan = rows.withColumn("digest", digest).join(small(again, 100_000), "digest", "left")
    plan = plan.select("page_id", "url", "html", F.lower(F.hex("digest")).alias("hex"), F.when(F.octet_length("html") >= MIN_REVISIT, F.col("first")).alias("first"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, base = fs.FileSystem.from_uri(folder)
        at.create_dir(base, recursive=True)
        task = TaskContext.get()
        bundle, made = None, 0
        for batch in batches:
            index = []
            for page_id, url, html, hexed, first in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if bundle is None:
                    name = f"{task.partitionId():06d}-{made:04d}-{task.taskAttemptId()}"
                    bundle, made = Bundle(at, base, f"{name}.warc.zst", uuid.uuid4().hex), made + 1
                data = record(page_id, url, html.encode(), hexed, first, first is not None and first != page_id)
                index.append((page_id, bundle.name, *bundle.add(data), len(data)))
                if bundle.written >= BUNDLE_BYTES:
                    bundle.close()
                    bundle = None
            if index:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*index, strict=True), INDEX, strict=True)], schema=INDEX)
        if bundle:
            bundle.close()

    return materialise(map_arrow(plan, write, _ddl(INDEX)), "warc-index")


def read_bundles(index: DataFrame, folder: str) -> DataFrame:
    """Read every indexed record back from its bundle, frame by frame, and check its digest and place.

    Frames are dealt to tasks by range of their place, FRAMES_EACH or less to a task, so one large bundle is read by many.
    """
    spark = index.sparkSession
    frames = index.groupBy("bundle", "frame").agg(F.sort_array(F.collect_list("offset")).alias("offsets"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, base = fs.FileSystem.from_uri(folder)
        name, file, table, unpack = None, None, [], zstandard.ZstdDecompressor()
        for batch in batches:
            for bundle, frame, offsets in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if bundle != name:
                    if file:
                        file.close()
                    name, file = bundle, at.open_input_file(f"{base}/{bundle}")
                    table = read_seek_table(file)
                start, packed, plain = table[frame]
                file.seek(start)
                data = unpack.decompress(file.read(packed), max_output_size=plain)
                out = []
                for offset in offsets:
                    head, a, b = parse(data, offset)
                    digest, kind = head["WARC-Payload-Digest"].removeprefix("sha256:"), head["WARC-Type"]
                    if kind == "response" and hashlib.sha256(data[a:b]).hexdigest() != digest:
                        raise ValueError(f"damaged record at {bundle}, frame {frame}, offset {offset}")
                    ident, other = (head.get(k, "")[12:-1] for k in ("WARC-Record-ID", "WARC-Refers-To"))
                    out.append((int(ident) if ident else None, int(head["X-Payload-Length"]), digest, kind, int(other) if other else None, head["WARC-Target-URI"], bundle, frame, offset))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), RECORD, strict=True)], schema=RECORD)
        if file:
            file.close()

    # The number is given, since adaptive execution would merge partitions by the size of the index, not of what it points to.
    n = index.select("bundle", "frame").distinct().count()
    tasks = max(1, min(n, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // FRAMES_EACH))))
    return map_arrow(frames.repartitionByRange(tasks, "bundle", "frame").sortWithinPartitions("bundle", "frame"), read, _ddl(RECORD))


def fetch(index: DataFrame, folder: str, page_id: int) -> tuple[dict[str, str], bytes]:
    """One record by its id: seeks to the frame, and reads no other."""
    bundle, frame, offset = index.filter(F.col("page_id") == page_id).select("bundle", "frame", "offset").first()
    at, base = fs.FileSystem.from_uri(folder)
    with at.open_input_file(f"{base}/{bundle}") as file:
        start, packed, plain = read_seek_table(file)[frame]
        file.seek(start)
        data = zstandard.ZstdDecompressor().decompress(file.read(packed), max_output_size=plain)
    head, a, b = parse(data, offset)
    return head, data[a:b]


def new_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/quire-warc-{uuid.uuid4().hex}"
