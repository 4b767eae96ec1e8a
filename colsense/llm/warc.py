"""WARC archives in seekable Zstandard bundles.

A bundle is one file: records are gathered into frames of about
``frame_bytes``, each compressed alone, and a seek table (a skippable frame of
the Zstandard seekable format: sizes of every frame, number of frames, magic
number) ends the file.  A record is found by (bundle, frame, offset within the
frame, length), so reading one record costs one range read and one small frame.

Tasks write bundles straight to the shared folder under names of their own, and
the index table (written by Spark, so only attempts that succeeded count) names
them.  A file that a lost attempt left behind is in no index and is never read.
Files are opened through ``pyarrow.fs``, so the folder may be in any store that
it knows (file, hdfs, s3, gs).
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colsense.llm.common import map_batches, pa_schema, ship, written
from colsense.sources.storage import scratch_path

#: Fixed values of the Zstandard seekable format and of WARC 1.1.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = ("page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, "
         "bundle string, frame int, frame_start long, frame_bytes long, offset long, length long")


def _open(uri: str, mode: str):
    from pyarrow import fs
    store, path = fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + uri)
    if mode == "w":
        store.create_dir(path.rpartition("/")[0], recursive=True)
        return store.open_output_stream(path, compression=None)  # else the name decides
    return store.open_input_file(path)


def _clean(value: str | None) -> str:
    """A header value: control characters, which would end its line, escaped."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in value or "")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None,
           revisit: bool, date: str) -> bytes:
    """One WARC record.  A revisit holds the HTTP header without the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<urn:page:{page_id}>"),
            ("WARC-Date", date), ("WARC-Target-URI", _clean(url)), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if revisit:
        head += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, bytes, int]:
    """(headers, HTTP header, payload, end) of the record that begins at ``at``."""
    end = data.index(b"\r\n\r\n", at)
    first, *lines = data[at:end].decode().split("\r\n")
    if first.encode() != VERSION:
        raise ValueError(f"no WARC record at {at}")
    head = dict(line.split(": ", 1) for line in lines)
    start, size = end + 4, int(head["Content-Length"])
    http, _, payload = data[start:start + size].partition(b"\r\n\r\n")
    return head, http, payload, start + size + 4


def _page(urn: str) -> int | None:
    text = urn.removeprefix("<urn:page:").removesuffix(">")
    return None if text == "None" else int(text)


class _Bundle:
    """Writes frames, then the seek table."""

    def __init__(self, folder: str, level: int):
        self.uri = f"{folder}/{uuid.uuid4().hex}.warc.zst"
        self.file = _open(self.uri, "w")
        self.compress = zstandard.ZstdCompressor(level=level, write_checksum=True).compress
        self.frames: list[tuple[int, int]] = []
        self.start, self.held, self.size, self.waiting = 0, [], 0, []

    def add(self, row: dict, data: bytes) -> None:
        self.waiting.append(row | {"bundle": self.uri, "frame": len(self.frames), "offset": self.size, "length": len(data)})
        self.held.append(data)
        self.size += len(data)

    def end_frame(self) -> list[dict]:
        data = self.compress(b"".join(self.held))
        self.file.write(data)
        done = [r | {"frame_start": self.start, "frame_bytes": len(data)} for r in self.waiting]
        self.frames.append((len(data), self.size))
        self.start += len(data)
        self.held, self.size, self.waiting = [], 0, []
        return done

    def close(self) -> list[dict]:
        done = self.end_frame() if self.held else []
        table = b"".join(struct.pack("<II", *f) for f in self.frames)
        foot = struct.pack("<IBI", len(self.frames), 0, SEEKABLE_MAGIC)
        self.file.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table) + len(foot)) + table + foot)
        self.file.close()
        return done


def write_bundles(pages: DataFrame, folder: str | None = None, min_revisit_bytes: int = 0, frame_bytes: int = 1 << 20,
                  bundle_bytes: int = 256 << 20, level: int = 3, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """A record for every row of ``pages(page_id, url, html)``; gives the index
    (``INDEX``), a table in the shared folder.

    The payload is the html in UTF-8; null is empty.  Of records with equal
    payloads of at least ``min_revisit_bytes``, that with the smallest page_id
    is a response and the others are revisits of it; smaller payloads are all
    responses.  A null page_id counts as larger than any.  Rows that repeat the
    response's own page_id are responses too, as a record can't revisit itself.
    A null url is empty.  Other columns are ignored; an empty table gives an
    empty index.  Payloads go through one shuffle by their digest, joined with
    the digests that occur twice or more; Spark splits a payload with very many
    copies over several tasks, as each row only looks its first page up.
    """
    spark = pages.sparkSession
    ship(spark)
    folder = folder or scratch_path(spark, "warc")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url",
                        F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha1("payload")))
    twice = (rows.where(F.octet_length("payload") >= min_revisit_bytes).groupBy("digest")
             .agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1"))
    rows = rows.join(twice, "digest", "left").select("page_id", "url", "payload", "digest", F.col("first").alias("refers_to"))
    schema = pa_schema(spark, INDEX)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: _Bundle | None = None

        def given(done: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(done, schema=schema)

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for r in batch.slice(at, 256).to_pylist():
                    out = out or _Bundle(folder, level)
                    revisit = r["refers_to"] is not None and r["refers_to"] != r["page_id"]
                    refers = r["refers_to"] if revisit else None
                    digest = base64.b32encode(r["digest"]).decode()
                    out.add({"page_id": r["page_id"], "record_type": "revisit" if revisit else "response",
                             "refers_to": refers, "payload_bytes": len(r["payload"]), "payload_digest": digest},
                            record(r["page_id"], r["url"], r["payload"], digest, refers, revisit, date))
                    if out.size >= frame_bytes:
                        yield given(out.end_frame())
                        if out.start >= bundle_bytes:
                            yield given(out.close())
                            out = None
        if out:
            yield given(out.close())

    return written(rows.mapInArrow(run, INDEX), "warc-index")


def seek_table(bundle: str) -> list[tuple[int, int, int]]:
    """(start, compressed size, size) of each frame, from the file's end."""
    with _open(bundle, "r") as f:
        size = f.size()
        f.seek(size - 9)
        n, flags, magic = struct.unpack("<IBI", f.read(9))
        if magic != SEEKABLE_MAGIC:
            raise ValueError(f"{bundle} has no seek table")
        width = 12 if flags & 0x80 else 8
        f.seek(size - 9 - n * width)
        table = f.read(n * width)
    out, start = [], 0
    for i in range(n):
        packed, full = struct.unpack_from("<II", table, i * width)
        out.append((start, packed, full))
        start += packed
    return out


def _frame(file, start: int, size: int) -> bytes:
    file.seek(start)
    return zstandard.ZstdDecompressor().decompress(file.read(size))


def read_bundles(spark: SparkSession, index: DataFrame) -> DataFrame:
    """All records of the bundles that ``index`` names, from the files alone:
    page_id, url, record_type, refers_to, payload (null for revisits),
    payload_bytes, payload_digest.  Each seek table is read once; the frames
    are then dealt out, so one large bundle keeps many tasks busy.  A response
    whose payload does not have its digest fails the job."""
    def frames(batch: pa.RecordBatch):
        for uri in batch.column("bundle").to_pylist():
            table = seek_table(uri)
            yield {"bundle": [uri] * len(table), "start": [x[0] for x in table], "size": [x[1] for x in table]}

    def records(batch: pa.RecordBatch):
        for uri, start, size in zip(*(batch.column(c).to_pylist() for c in ("bundle", "start", "size"))):
            with _open(uri, "r") as f:
                data, at, out = _frame(f, start, size), 0, []
            while at < len(data):
                head, http, payload, at = parse(data, at)
                digest, kind = head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"]
                fields = dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])
                if kind == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                    raise ValueError(f"{uri}: record {head['WARC-Record-ID']} does not have its digest")
                out.append((_page(head["WARC-Record-ID"]), head["WARC-Target-URI"], kind,
                            _page(head["WARC-Refers-To"]) if kind == "revisit" else None,
                            payload if kind == "response" else None, int(fields["Content-Length"]), digest))
            names = ("page_id", "url", "record_type", "refers_to", "payload", "payload_bytes", "payload_digest")
            yield dict(zip(names, map(list, zip(*out))))

    places = map_batches(index.select("bundle").distinct(), frames, "bundle string, start long, size long", piece_rows=1)
    return map_batches(places.repartition("bundle", "start"), records, "page_id long, url string, record_type string, "
                       "refers_to long, payload binary, payload_bytes long, payload_digest string", piece_rows=1)


def fetch(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """(page_id, payload) of the wanted page_ids by random access: each frame
    that holds one is read once, other frames never.  A revisit's payload is
    null; fetch the page that it refers to."""
    def run(batch: pa.RecordBatch):
        for r in batch.to_pylist():
            with _open(r["bundle"], "r") as f:
                data = _frame(f, r["frame_start"], r["frame_bytes"])
            found = [(p["page_id"], parse(data[p["offset"]:p["offset"] + p["length"]])) for p in r["places"]]
            yield {"page_id": [p for p, _ in found],
                   "payload": [x[2] if x[0]["WARC-Type"] == "response" else None for _, x in found]}

    frames = (index.join(wanted.select("page_id").distinct(), "page_id")
              .groupBy("bundle", "frame", "frame_start", "frame_bytes")
              .agg(F.collect_list(F.struct("page_id", "offset", "length")).alias("places")))
    return map_batches(frames, run, "page_id long, payload binary", piece_rows=16)
