"""WARC archives as seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each holding a few WARC records, followed by two
skippable frames: an index from record id, in order, to (frame, offset in the frame, length) and, last, the seek table
of the Zstandard seekable format. Any record is found by bisection and read by seeking to its frame, which alone is
read and decompressed. ``index`` gives the indexes of bundles as rows, ``fetch`` reads the records of chosen rows.

Of records with equal payloads of at least ``REVISIT_BYTES`` bytes the one with the smallest id is a
response; the others are revisits that refer to it and carry no payload. Bundles are written by the
executors into a folder that all share (a path or any URI that pyarrow's file systems open) under names that
hold the task attempt, and the frame of written bundles lists those of committed attempts only.

Defined results: a null payload or URL is empty; a null id counts as the largest and is null again when read;
repeated rows with the same id are records of the same name, and of equal payloads of one id each is a response;
an empty table writes no bundle; further columns are ignored. A payload is held whole by the task that writes it, and a
frame by the one that reads it, so a very long payload makes a large frame of its own.
"""

from __future__ import annotations

import bisect
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm import work

REVISIT_BYTES = 100
#: Stands for a null id in an archive.
NO_ID = (1 << 63) - 1
#: Uncompressed bytes after which a frame is closed, and compressed bytes after which a bundle is.
FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 16 << 20
#: Fixed values of the Zstandard seekable format: skippable frame magic, seek table magic.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
INDEX = 0x184D2A50


def record(page_id: int, url: str, payload: bytes, sha: str, length: int, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit has headers alone."""
    kind = "response" if refers_to is None else "revisit"
    clean = url.replace("\r", "%0D").replace("\n", "%0A")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page_id}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {clean}", f"WARC-Payload-Digest: sha256:{sha}", f"X-Payload-Length: {length}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    body = payload if refers_to is None else b""
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(data: bytes | memoryview) -> dict:
    """Headers of a record by lower-case name, and its body."""
    data = bytes(data)
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("no WARC record here")
    found = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
    n = int(found["content-length"])
    if rest[n : n + 4] != b"\r\n\r\n" or len(rest) != n + 4:
        raise ValueError("the record's length is wrong")
    return found | {"body": rest[:n]}


class Bundle:
    """Builds one bundle in memory."""

    def __init__(self) -> None:
        self._press = zstandard.ZstdCompressor(level=3, write_checksum=True)
        self._frames: list[tuple[int, int]] = []
        self._index: list[tuple[int, int, int, int]] = []
        self._parts: list[bytes] = []
        self._held, self._size, self.bytes = [], 0, 0

    def add(self, page_id: int, data: bytes) -> None:
        self._index.append((page_id, len(self._frames), self._size, len(data)))
        self._held.append(data)
        self._size += len(data)
        if self._size >= FRAME_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self._held:
            packed = self._press.compress(b"".join(self._held))
            self._parts.append(packed)
            self._frames.append((len(packed), self._size))
            self.bytes += len(packed)
            self._held, self._size = [], 0

    @property
    def records(self) -> int:
        return len(self._index)

    def finish(self) -> bytes:
        self._flush()
        index = b"".join(struct.pack("<qIII", *x) for x in sorted(self._index))
        index += struct.pack("<I", len(self._index))
        skip = struct.pack("<II", INDEX, len(index)) + index
        # the index frame is listed too, with no content, so that frame offsets add up
        table = b"".join(struct.pack("<II", *x) for x in [*self._frames, (len(skip), 0)])
        footer = struct.pack("<IBI", len(self._frames) + 1, 0, SEEKABLE)
        return b"".join([*self._parts, skip, struct.pack("<II", SKIPPABLE, len(table) + len(footer)), table, footer])


class Reader:
    """Random access to the records of a bundle: an open file with ``size`` and ``read_at``, or its bytes. Only what is asked for is read."""

    def __init__(self, source) -> None:
        self._file = pa.BufferReader(source) if isinstance(source, (bytes, memoryview)) else source
        size = self._file.size()
        n, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE or flags:
            raise ValueError("no seek table")
        self._begins = [0]
        for packed, _ in struct.iter_unpack("<II", self._at(size - 9 - 8 * n, 8 * n)):
            self._begins.append(self._begins[-1] + packed)
        found = self._at(self._begins[n - 1], self._begins[n] - self._begins[n - 1])
        if struct.unpack("<I", found[:4])[0] != INDEX:
            raise ValueError("no record index")
        #: (id, frame, offset in the frame, length) in order of the ids
        self.index = list(struct.iter_unpack("<qIII", found[8:-4]))
        self._open, self._frame = -1, b""
        self._press = zstandard.ZstdDecompressor()

    def _at(self, offset: int, n: int) -> bytes:
        return bytes(self._file.read_at(n, offset))

    def frame(self, k: int) -> bytes:
        if k != self._open:
            self._frame = self._press.decompress(self._at(self._begins[k], self._begins[k + 1] - self._begins[k]))
            self._open = k
        return self._frame

    def record(self, frame: int, at: int, n: int) -> dict:
        return parse(self.frame(frame)[at : at + n])

    def get(self, page_id: int) -> list[dict]:
        """Every record of that id."""
        lo = bisect.bisect_left(self.index, (page_id,))
        hi = bisect.bisect_left(self.index, (page_id + 1,))
        return [self.record(*x) for _, *x in self.index[lo:hi]]

    def records(self) -> Iterator[tuple[int, dict]]:
        """All records, frame by frame."""
        for i, *x in sorted(self.index, key=lambda x: (x[1], x[2])):
            yield i, self.record(*x)


def _store(folder: str):
    """(file system, path) of a shared folder."""
    from pyarrow import fs

    if folder.startswith("file:") or "://" not in folder:
        return fs.LocalFileSystem(), folder.removeprefix("file://").removeprefix("file:")
    return fs.FileSystem.from_uri(folder)


def roles(rows: DataFrame) -> DataFrame:
    """(id, sha, refers_to) of the revisits among rows (id, sha, n): only digests are shuffled."""
    keyed = rows.filter(F.col("n") >= REVISIT_BYTES).select("id", "sha")
    first = keyed.groupBy("sha").agg(F.min("id").alias("first"), F.count("*").alias("m")).filter("m > 1").drop("m")
    return keyed.join(first, "sha").filter("id <> first").select("id", "sha", F.col("first").alias("refers_to")).distinct()


def write(pages: DataFrame, folder: str, id_column: str = "page_id", url_column: str = "url", text_column: str = "html") -> DataFrame:
    """Writes the bundles and returns what was written: (path, records, bytes)."""
    payload = F.coalesce(pages[text_column], F.lit("")).cast("binary")
    rows = pages.select(F.coalesce(pages[id_column].cast("long"), F.lit(NO_ID)).alias("id"), pages[url_column].alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("sha"), F.length(payload).alias("n"))
    rows = rows.join(roles(rows), ["id", "sha"], "left").select("id", "url", "payload", "sha", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(folder)
        context, count, bundle = TaskContext.get(), 0, Bundle()

        def put() -> pa.RecordBatch:
            name = f"{base}/part-{context.partitionId():06d}-{context.taskAttemptId()}-{count:05d}.warc.zst"
            data = bundle.finish()
            with store.open_output_stream(name, compression=None) as out:
                out.write(data)
            scheme = folder[: folder.index(base)] if base in folder else ""
            return pa.RecordBatch.from_arrays([pa.array([scheme + name]), pa.array([bundle.records], pa.int64()), pa.array([len(data)], pa.int64())], names=["path", "records", "bytes"])

        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                for r in batch.slice(lo, 512).to_pylist():
                    bundle.add(r["id"], record(r["id"], r["url"] or "", r["payload"], r["sha"], len(r["payload"]), r["refers_to"]))
                    if bundle.bytes >= BUNDLE_BYTES:
                        yield put()
                        bundle, count = Bundle(), count + 1
        if bundle.records:
            yield put()

    return work.table(rows.mapInArrow(run, "path string, records long, bytes long"), "archive-list")


RECORD = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("refers_to", T.LongType())])


def _rows(path: str, records: Iterator[tuple[int, dict]], payload: bool) -> Iterator[pa.RecordBatch]:
    """Records as batches of bounded size; a response whose payload doesn't match its digest is an error."""
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), *([pa.string(), pa.binary()] if payload else [])]
    names = [*RECORD.names, *(["url", "body"] if payload else [])]
    batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names=names)
    done: list[tuple] = []
    size = 0
    for page_id, r in records:
        body, revisit = r["body"], r["warc-type"] == "revisit"
        sha = r["warc-payload-digest"].removeprefix("sha256:")
        if not revisit and hashlib.sha256(body).hexdigest() != sha:
            raise ValueError(f"{path}: the payload of {page_id} doesn't match its digest")
        refers = int(r["warc-refers-to"].removeprefix("<urn:page:").rstrip(">")) if revisit else None
        row = (page_id if page_id != NO_ID else None, int(r["x-payload-length"]) if revisit else len(body), sha, r["warc-type"], refers)
        done.append((*row, r["warc-target-uri"], body) if payload else row)
        size += len(body) if payload else 64
        if size > 8 << 20:
            yield batch()
            done, size = [], 0
    if done:
        yield batch()


def _schema(payload: bool) -> T.StructType:
    return T.StructType([*RECORD.fields, *([T.StructField("url", T.StringType()), T.StructField("body", T.BinaryType())] if payload else [])])


def read(spark: SparkSession, bundles: DataFrame, payload: bool = False) -> DataFrame:
    """The records of the listed bundles, one row each, read frame by frame; ``payload`` adds url and body."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, name = _store(path)
                with store.open_input_file(name) as f:
                    yield from _rows(path, Reader(f).records(), payload)

    return bundles.select("path").repartition(max(1, spark.sparkContext.defaultParallelism), "path").mapInArrow(run, _schema(payload))


def index(bundles: DataFrame) -> DataFrame:
    """The indexes of bundles as rows (path, page_id, frame, at, length): footers are read, no records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, name = _store(path)
                with store.open_input_file(name) as f:
                    rows = Reader(f).index
                ids = pa.array([None if x[0] == NO_ID else x[0] for x in rows], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows)), ids, *(pa.array([x[k] for x in rows], pa.int64()) for k in (1, 2, 3))], names=["path", "page_id", "frame", "at", "length"])

    return bundles.select("path").mapInArrow(run, "path string, page_id long, frame long, at long, length long")


def fetch(wanted: DataFrame, payload: bool = True) -> DataFrame:
    """The records of chosen rows of ``index``: each frame that holds one is read once by a task, no others are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, f, reader = None, None, None
        for batch in batches:
            rows = batch.to_pylist()
            for lo in range(len(rows)):
                if rows[lo]["path"] != path:
                    if f is not None:
                        f.close()
                    path = rows[lo]["path"]
                    store, name = _store(path)
                    f = store.open_input_file(name)
                    reader = Reader(f)
                r = rows[lo]
                yield from _rows(path, iter([(NO_ID if r["page_id"] is None else r["page_id"], reader.record(r["frame"], r["at"], r["length"]))]), payload)
        if f is not None:
            f.close()

    dealt = wanted.select("path", "page_id", "frame", "at", "length").repartition("path").sortWithinPartitions("path", "frame", "at")
    return dealt.mapInArrow(run, _schema(payload))


def digest(pages: DataFrame) -> DataFrame:
    """The contract's columns, from the archives as read back."""
    spark = pages.sparkSession
    return read(spark, write(pages, work.new_path(spark, "archive")))
