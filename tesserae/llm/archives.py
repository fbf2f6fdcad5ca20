"""WARC records in seekable Zstandard bundles.

Records are grouped into independent frames of about ``frame_bytes``, frames into bundle files of
about ``bundle_bytes``. A bundle ends with a seek table in the public seekable format: a skippable
frame with the packed size, the plain size and a checksum of every frame. The index maps record
identifiers to (file, frame, offset within the unpacked frame), so a record is read by unpacking
one frame.

Payloads that occur more than once are stored once: among records with equal payloads of at least
``least_bytes`` bytes the one with the largest identifier is the response, the others are revisits
that refer to it. Groups of equal payloads are aggregated by digest, never gathered.

Files are written by the tasks with a name of their own per attempt; the index names only files
of attempts that succeeded, so lost or repeated tasks leave unused files but no wrong records.

Defined results: a null payload is an empty one; a null address is left out of the record; rows
with equal identifier and payload are all responses if that identifier is the largest; a record
without identifier is a revisit if its payload has an identifier elsewhere, else a response; an
empty table gives no bundle and an empty result. Only the named columns are read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from urllib.parse import quote

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm.tasks import settled, slices
from tesserae.workspace import new_path

FRAME_BYTES = 1 << 18
BUNDLE_BYTES = 1 << 26
LEVEL = 3
FRAMES_PER_TASK = 64
DATE = "1970-01-01T00:00:00Z"

# Fixed values of the seekable format and of the record format.
SKIPPABLE, SEEKABLE, CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80
VERSION = b"WARC/1.1\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
IDENTIFIER = "<urn:page:{}>"


def record(identifier, url, payload: bytes, digest: str, refers_to, is_revisit: bool, date: str = DATE) -> bytes:
    """One record; a revisit has no block of its own."""
    block = b"" if is_revisit else payload
    head = {"WARC-Type": "revisit" if is_revisit else "response", "WARC-Record-ID": IDENTIFIER.format(identifier), "WARC-Date": date}
    if url is not None:
        head["WARC-Target-URI"] = quote(url, safe="%/:=&?~#+!$,;'@()*[]")
    head["WARC-Payload-Digest"] = f"sha1:{digest}"
    head["WARC-Payload-Length"] = str(len(payload))
    if is_revisit:
        head |= {"WARC-Refers-To": IDENTIFIER.format(refers_to), "WARC-Profile": PROFILE}
    head |= {"Content-Type": "text/html; charset=utf-8", "Content-Length": str(len(block))}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode()
    return VERSION + lines + b"\r\n" + block + b"\r\n\r\n"


def parsed(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """(headers, block, end) of the record at a place of an unpacked frame."""
    if not data.startswith(VERSION, at):
        raise ValueError("no record starts here")
    stop = data.index(b"\r\n\r\n", at)
    lines = data[at + len(VERSION) : stop].decode().split("\r\n")
    head = dict(line.split(": ", 1) for line in lines)
    start, size = stop + 4, int(head["Content-Length"])
    return head, data[start : start + size], start + size + 4


class BundleWriter:
    """Collects records into frames and writes a bundle with its seek table."""

    def __init__(self, stream, frame_bytes: int, level: int):
        self.stream, self.frame_bytes = stream, frame_bytes
        self.packer = zstandard.ZstdCompressor(level=level)
        self.waiting, self.size, self.entries, self.written = [], 0, [], 0

    def add(self, content: bytes) -> tuple[int, int]:
        """Appends a record; returns its frame and the place in the unpacked frame."""
        if self.waiting and self.size + len(content) > self.frame_bytes:
            self.flush()
        place = len(self.entries), self.size
        self.waiting.append(content)
        self.size += len(content)
        self.written += len(content)
        return place

    def flush(self):
        plain = b"".join(self.waiting)
        packed = self.packer.compress(plain)
        self.stream.write(packed)
        self.entries.append(struct.pack("<III", len(packed), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))
        self.waiting, self.size = [], 0

    def close(self):
        if self.waiting:
            self.flush()
        table = b"".join(self.entries) + struct.pack("<IBI", len(self.entries), CHECKSUMS, SEEKABLE)
        self.stream.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.stream.close()


class BundleReader:
    """Random access to the frames of a bundle through its seek table."""

    FOOTER, ENTRY = 9, 12

    def __init__(self, file):
        self.file, size = file, file.size()
        file.seek(size - self.FOOTER)
        count, flags, magic = struct.unpack("<IBI", file.read(self.FOOTER))
        if magic != SEEKABLE or flags != CHECKSUMS:
            raise ValueError("the bundle does not end with a seek table of the expected kind")
        file.seek(size - self.FOOTER - count * self.ENTRY)
        self.entries = np.frombuffer(file.read(count * self.ENTRY), "<u4").reshape(-1, 3).astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.entries[:, 0])])
        self.unpacker = zstandard.ZstdDecompressor()

    def frame(self, number: int) -> bytes:
        packed, plain, check = map(int, self.entries[number])
        self.file.seek(int(self.starts[number]))
        data = self.unpacker.decompress(self.file.read(packed), max_output_size=plain)
        if len(data) != plain or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {number} is damaged")
        return data


def located(spark: SparkSession, folder: str) -> str:
    """A full URI of a folder, as file systems outside the JVM want it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    uri = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri


def revisits(pages: DataFrame, least_bytes: int) -> DataFrame:
    """(``page_id``, ``sha1``, ``refers_to``) of the rows that repeat the payload of a larger identifier."""
    rows = pages.select("page_id", F.length("payload").alias("size"), F.sha1("payload").alias("sha1"))
    rows = rows.filter(F.col("size") >= least_bytes)
    largest = rows.groupBy("sha1", "size").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n"))
    again = rows.join(largest.filter("n > 1 AND refers_to IS NOT NULL"), ["sha1", "size"])
    again = again.filter(F.col("page_id").isNull() | (F.col("page_id") < F.col("refers_to")))
    return again.select("page_id", "sha1", "refers_to").distinct()


def write(
    pages: DataFrame,
    folder: str | None = None,
    id_column: str = "page_id",
    url_column: str = "url",
    payload_column: str = "html",
    least_bytes: int = 0,
    frame_bytes: int = FRAME_BYTES,
    bundle_bytes: int = BUNDLE_BYTES,
    level: int = LEVEL,
) -> DataFrame:
    """Writes the bundles and returns their index (``page_id``, ``file``, ``frame``, ``offset``, ``length``)."""
    spark = pages.sparkSession
    target = located(spark, folder or new_path(spark, "bundles"))
    payload = F.coalesce(F.col(payload_column).cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(
        F.col(id_column).cast("bigint").alias("page_id"), F.col(url_column).cast("string").alias("url"), payload.alias("payload")
    )
    again = settled(revisits(rows, least_bytes), "revisits")
    known = again.select(F.col("page_id").alias("i"), F.col("sha1").alias("s"), "refers_to")
    rows = rows.withColumn("sha1", F.sha1("payload"))
    rows = rows.join(known, F.col("page_id").eqNullSafe(F.col("i")) & (F.col("sha1") == F.col("s")), "left").drop("i", "s")

    def run(batches):
        system, base = pyarrow.fs.FileSystem.from_uri(target)
        system.create_dir(base, recursive=True)
        context = TaskContext.get()
        writer, number, name = None, 0, ""
        for batch in slices(batches, "payload"):
            found = {"page_id": [], "file": [], "frame": [], "offset": [], "length": []}
            columns = (batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "sha1", "refers_to"))
            for identifier, url, content, sha1, refers_to in zip(*columns):
                if writer is None:
                    name = f"{context.partitionId():06d}-{number:04d}-{context.taskAttemptId()}.warc.zst"
                    writer = BundleWriter(system.open_output_stream(f"{base}/{name}", compression=None), frame_bytes, level)
                digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                content = record(identifier, url, content, digest, refers_to, refers_to is not None)
                frame, offset = writer.add(content)
                for key, value in zip(found, (identifier, name, frame, offset, len(content))):
                    found[key].append(value)
                if writer.written >= bundle_bytes:
                    writer.close()
                    writer, number = None, number + 1
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(found.values(), kinds)], list(found))
        if writer is not None:
            writer.close()

    index = rows.mapInArrow(run, "page_id bigint, file string, frame int, offset bigint, length bigint")
    index = settled(index, "bundle-index")
    return index.withColumn("file", F.concat(F.lit(f"{target}/"), "file"))


READ = (
    "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
)


def rows_of(records, with_payload: bool) -> pa.RecordBatch:
    """The parsed (headers, block) pairs as a batch; the digest of every stored payload is verified."""

    def number(name: str):
        inner = name.removeprefix("<urn:page:").removesuffix(">")
        return None if inner == "None" else int(inner)

    columns: dict = {n: [] for n in ("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to")}
    payloads = []
    for head, block in records:
        digest, size = head["WARC-Payload-Digest"].removeprefix("sha1:"), int(head["WARC-Payload-Length"])
        kind = head["WARC-Type"]
        if kind == "response":
            own = base64.b32encode(hashlib.sha1(block).digest()).decode()
            if (own, len(block)) != (digest, size):
                raise ValueError(f"the payload of {head['WARC-Record-ID']} does not match its digest")
        refers_to = number(head["WARC-Refers-To"]) if kind == "revisit" else None
        values = (number(head["WARC-Record-ID"]), head.get("WARC-Target-URI"), size, digest, kind, refers_to)
        for column, value in zip(columns.values(), values):
            column.append(value)
        payloads.append(block)
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
    arrays = [pa.array(v, k) for v, k in zip(columns.values(), kinds)]
    if with_payload:
        return pa.RecordBatch.from_arrays([*arrays, pa.array(payloads, pa.binary())], [*columns, "payload"])
    return pa.RecordBatch.from_arrays(arrays, list(columns))


def read(index: DataFrame, with_payload: bool = False) -> DataFrame:
    """Every record of the bundles of an index; a task reads one bundle, with a frame in memory at a time."""
    files = index.select("file").distinct()
    files = files.repartition(max(1, files.count()))  # names are short, so their bytes say nothing of the work

    def run(batches):
        for batch in batches:
            for name in batch.column("file").to_pylist():
                system, path = pyarrow.fs.FileSystem.from_uri(name)
                with system.open_input_file(path) as file:
                    bundle = BundleReader(file)
                    for number in range(len(bundle.entries)):
                        data, at, found = bundle.frame(number), 0, []
                        while at < len(data):
                            head, block, at = parsed(data, at)
                            found.append((head, block))
                        yield rows_of(found, with_payload)

    return files.mapInArrow(run, READ + (", payload binary" if with_payload else ""))


def fetch(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """The records, with payloads, of the ``page_id`` in ``wanted``: one frame is unpacked per frame that holds some."""
    places = index.join(wanted.select("page_id").distinct(), "page_id", "left_semi")
    frames = places.groupBy("file", "frame").agg(F.sort_array(F.collect_list("offset")).alias("offsets"))
    frames = settled(frames, "wanted-frames")
    frames = frames.repartition(max(1, -(-frames.count() // FRAMES_PER_TASK)))

    def run(batches):
        for batch in batches:
            for name, number, offsets in zip(*(batch.column(c).to_pylist() for c in ("file", "frame", "offsets"))):
                system, path = pyarrow.fs.FileSystem.from_uri(name)
                with system.open_input_file(path) as file:
                    data = BundleReader(file).frame(number)
                yield rows_of([parsed(data, at)[:2] for at in offsets], True)

    return frames.mapInArrow(run, READ + ", payload binary")
