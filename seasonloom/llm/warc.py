"""WARC archives with a Zstandard dictionary, written and read in parallel.

Each task writes archives of about ``archive_bytes``: a skippable frame that holds the
dictionary, then one Zstandard frame per record, compressed with it, so a record can be
read alone and a file needs nothing outside itself.  The dictionary is trained on about
``sample_rows`` pages, those whose id hashes lowest (pages of the sample are cut to
``sample_cut`` characters; only the dictionary sees the cut).

Equal payloads of at least ``min_payload`` bytes are stored once, as the response of the
largest page id; the other pages become revisit records that refer to it.  Payloads are
compared by SHA-1 and length, grouped with map-side aggregation, so a payload that a third
of all pages share stays one small row per task.

A task writes under a fresh name and reports its files in a manifest that Spark commits;
files of failed or repeated attempts are in no manifest and are never read.

Defined cases: null html is the empty payload; a null url leaves the target out; a null
page id counts as smaller than any other; rows that repeat a page id and payload are
records of the same id; an empty table writes no archive.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from seasonloom.llm.shipping import shipped
from seasonloom.session import stage, unstage

SKIPPABLE = 0x184D2A5D  # the frame type reserved for a dictionary
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID = "urn:x-page:"

# What a page's record is made of.
_RECORDED = ["page_id", "url", "payload", "digest", "refers_to"]
MANIFEST = "path string, records long, bytes long"
RECORD = pa.schema(
    {
        "page_id": pa.int64(),
        "url": pa.string(),
        "record_type": pa.string(),
        "refers_to": pa.int64(),
        "payload_digest": pa.string(),
        "payload_bytes": pa.int64(),
        "payload": pa.binary(),
    }
)


def classified(pages: DataFrame, min_payload: int = 0) -> DataFrame:
    """``page_id``, ``url``, ``payload``, its hex ``digest`` and ``refers_to`` (null: a response)."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        payload.alias("payload"),
        F.sha1(payload).alias("digest"),
        F.octet_length(payload).alias("length"),
    )
    shared = (
        rows.where(F.col("length") >= min_payload)
        .groupBy("digest", "length")
        .agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("copies"))
        .where("copies > 1")
    )
    joined = rows.join(shared, ["digest", "length"], "left")
    revisit = F.when(F.coalesce(F.col("page_id"), F.col("first") - 1) < F.col("first"), F.col("first"))
    return joined.select("page_id", "url", "payload", "digest", revisit.alias("refers_to"))


def dictionary(
    pages: DataFrame, size: int = 64 << 10, sample_rows: int = 800, pieces: int = 4, piece_bytes: int = 4 << 10
) -> bytes:
    """A dictionary trained on archived records, or none where the sample is too small for one.

    The records of at most ``sample_rows`` pages, those first by a hash of id and html, are
    built as they are archived, headers and revisits included; of a long one ``pieces`` parts
    of ``piece_bytes`` are taken, spread evenly from its head to its end.
    """
    import zstandard

    shipped(pages.sparkSession)
    rows = pages.select("page_id", "url", "html")
    rows = rows.withColumn("mark", F.xxhash64(F.col("page_id").cast("long"), F.col("html").cast("string")))
    # Chosen by their hashes alone, and written out, so that the join need not move the pages.
    marks = stage(rows.select("mark").distinct().orderBy("mark").limit(sample_rows), "warc-sample")
    sample = rows.join(marks, "mark").dropDuplicates(["mark"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for values in zip(*batch.columns, strict=True):
                record = _page_record(*(v.as_py() for v in values))
                last = max(0, len(record) - piece_bytes)
                starts = {last * k // max(1, pieces - 1) for k in range(pieces)} if last else {0}
                found += [record[k : k + piece_bytes] for k in sorted(starts)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], ["piece"])

    records = classified(sample).select(_RECORDED).mapInArrow(run, "piece binary")
    try:
        cut = sorted(bytes(r.piece) for r in records.collect())
        unstage(marks)
        return zstandard.train_dictionary(size, cut, threads=0).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def _open(path: str, mode: str):
    if "://" in path or path.startswith("file:"):
        where, path = fs.FileSystem.from_uri(path)
    else:
        where = fs.LocalFileSystem()
    if mode == "rb":
        return where.open_input_stream(path)
    where.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return where.open_output_stream(path)


def _record(kind: str, name: str, fields: dict[str, str], block: bytes) -> bytes:
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<{name}>", "WARC-Date": DATE, **fields}
    head["Content-Length"] = str(len(block))
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def _page_record(page: int | None, url: str | None, payload: bytes, digest: str, refers: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    fields = {}
    if url is not None:
        fields["WARC-Target-URI"] = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    fields["WARC-Payload-Digest"] = "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()
    fields["Content-Type"] = "application/http;msgtype=response"
    name = f"{ID}{'' if page is None else page}"
    if refers is None:
        return _record("response", name, fields, http.encode() + payload)
    fields |= {"WARC-Profile": PROFILE, "WARC-Refers-To": f"<{ID}{refers}>"}
    return _record("revisit", name, fields, http.encode())


class _Archive:
    def __init__(self, folder: str, trained: bytes):
        import zstandard

        self.path = f"{folder}/{uuid.uuid4().hex}.warc.zst"
        self.records, self.bytes = 0, 0
        self.file = _open(self.path, "wb")
        options = {"dict_data": zstandard.ZstdCompressionDict(trained)} if trained else {}
        self.packer = zstandard.ZstdCompressor(level=3, write_checksum=True, **options)
        if trained:
            self._put(struct.pack("<II", SKIPPABLE, len(trained)) + trained)
        about = b"format: WARC File Format 1.1\r\n"
        fields = {"Content-Type": "application/warc-fields"}
        self._put(self.packer.compress(_record("warcinfo", f"urn:uuid:{uuid.uuid4()}", fields, about)))

    def _put(self, data: bytes) -> None:
        self.file.write(data)
        self.bytes += len(data)

    def add(self, record: bytes) -> None:
        self._put(self.packer.compress(record))
        self.records += 1

    def close(self) -> dict:
        self.file.close()
        return {"path": self.path, "records": self.records, "bytes": self.bytes}


def _qualified(spark: SparkSession, folder: str) -> str:
    """The folder with the scheme that Spark itself would read it by."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return system.makeQualified(path).toString()


def write(rows: DataFrame, folder: str, trained: bytes, archive_bytes: int = 256 << 20) -> DataFrame:
    """Write classified rows below ``folder``; one manifest row per archive."""
    shipped(rows.sparkSession)
    folder = _qualified(rows.sparkSession, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, done = None, []
        for batch in batches:
            columns = [batch.column(n) for n in _RECORDED]
            for values in zip(*columns, strict=True):
                archive = archive or _Archive(folder, trained)
                archive.add(_page_record(*(v.as_py() for v in values)))
                if archive.bytes >= archive_bytes:
                    done.append(archive.close())
                    archive = None
        if archive:
            done.append(archive.close())
        if done:
            yield pa.RecordBatch.from_pylist(done)

    return rows.mapInArrow(run, MANIFEST)


def _frames(path: str, chunk: int = 64 << 10) -> Iterator[bytes]:
    """Decompressed frames of one archive, a chunk of the file at a time."""
    import zstandard

    with _open(path, "rb") as file:
        rest = file.read(8)
        unpack = zstandard.ZstdDecompressor()
        if len(rest) == 8 and struct.unpack("<II", rest)[0] == SKIPPABLE:
            trained = file.read(struct.unpack("<II", rest)[1])
            unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(trained))
            rest = b""
        while rest := rest or file.read(chunk):
            frame, out = unpack.decompressobj(), []
            while rest:
                out.append(frame.decompress(rest))
                rest = frame.unused_data if frame.eof else file.read(chunk)
                if frame.eof:
                    break
            if not frame.eof:
                raise ValueError(f"{path} ends inside a record")
            yield b"".join(out)


def _page(name: str) -> int | None:
    number = name.strip("<>").removeprefix(ID)
    return int(number) if number else None


def parse(record: bytes) -> dict | None:
    """Fields of a page record; none for records about the file."""
    head, rest = record.split(b"\r\n\r\n", 1)
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    if fields["WARC-Type"] == "warcinfo":
        return None
    http, payload = rest[: int(fields["Content-Length"])].split(b"\r\n\r\n", 1)
    length = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    response = fields["WARC-Type"] == "response"
    if response and (len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()) != (length, digest):
        raise ValueError(f"the payload of {fields['WARC-Record-ID']} does not match its digest")
    return {
        "page_id": _page(fields["WARC-Record-ID"]),
        "url": fields.get("WARC-Target-URI"),
        "record_type": fields["WARC-Type"],
        "refers_to": None if response else _page(fields["WARC-Refers-To"]),
        "payload_digest": digest,
        "payload_bytes": length,
        "payload": payload if response else None,
    }


def read(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """All page records of the archives in a manifest, one task per archive."""
    shipped(spark)
    paths = manifest.select("path").repartition(max(1, manifest.count()), "path")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                part = []
                for record in map(parse, _frames(path)):
                    if record:
                        part.append(record)
                    if len(part) >= 1000:
                        yield pa.RecordBatch.from_pylist(part, RECORD)
                        part = []
                if part:
                    yield pa.RecordBatch.from_pylist(part, RECORD)

    return paths.mapInArrow(run, from_arrow_schema(RECORD))
