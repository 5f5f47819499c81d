"""WARC archives from a deterministic sharded writer, and their reader.

Records are sorted into ranges of their id, streamed into gzip files (one member a record) that roll by compressed size,
and committed by renaming; a manifest names the files that count. Digests, lengths and record ids are made anew
from the payload, so equal rows give equal archives. Of equal payloads only one is stored; the others are revisit records.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlytics.llm import storage
from gridlytics.llm.ranges import cuts, shard
from gridlytics.llm.text import slices

# Fixed values of the WARC 1.1 format.
VERSION = b"WARC/1.1\r\n"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_TYPE = "application/http; msgtype=response"

DATE = "2000-01-01T00:00:00Z"
LEAST_REVISIT = 1000
SHARD_BYTES = 32 << 20
ROLL_BYTES = 8 << 20


def sha1_of(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id, digest: str, copy: int = 0) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha1(f'{page_id} {digest} {copy}'.encode()).digest()[:16], version=5)}>"


def member(headers: list[tuple[str, object]], block: bytes) -> bytes:
    """One record as a gzip member."""
    head = VERSION + b"".join(f"{name}: {value}\r\n".encode() for name, value in headers if value is not None)
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head + b"\r\n" + block + b"\r\n\r\n") + packer.flush()


def page_record(page_id, url: str | None, payload: bytes, refers_to, date: str, copy: int) -> bytes:
    digest = sha1_of(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    uri = None if url is None else url.replace("\r", "%0D").replace("\n", "%0A")
    return member(
        [
            ("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(page_id, digest, copy)),
            ("WARC-Target-URI", uri), ("WARC-Date", date), ("WARC-Payload-Digest", digest), ("WARC-Block-Digest", sha1_of(block)),
            ("WARC-Profile", None if refers_to is None else REVISIT),
            ("WARC-Refers-To", None if refers_to is None else record_id(refers_to, digest)),
            ("X-Page-ID", page_id), ("X-Refers-To-Page-ID", refers_to), ("Content-Type", HTTP_TYPE), ("Content-Length", len(block)),
        ],
        block,
    )


class Archive:
    """One open file of a shard."""

    def __init__(self, folder: str, number: int, part: int, date: str):
        name = f"part-{number:06d}-{part:04d}.warc.gz"
        self.path, self.place = f"{folder}/{name}", {"shard": number, "part": part}
        self.out, self.records, self.sha1 = storage.Committed(self.path), 0, hashlib.sha1()
        block = b"software: page archive writer\r\nformat: WARC File Format 1.1\r\n"
        self._write(member(
            [("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id("warcinfo", name)), ("WARC-Date", date), ("WARC-Filename", name),
             ("Content-Type", "application/warc-fields"), ("Content-Length", len(block))], block,
        ))

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.sha1.update(data)

    def add(self, record: bytes) -> None:
        self._write(record)
        self.records += 1

    def commit(self) -> dict:
        self.out.commit()
        return self.place | {"path": self.path, "records": self.records, "bytes": self.out.size, "sha1": self.sha1.hexdigest()}


def _write(folder: str, date: str, roll: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, done, at, part = None, [], None, 0
        page, holders, copies = object(), {}, {}
        for batch in slices(batches, "payload"):
            columns = [batch.column(x) for x in ("_shard", "page_id", "holder", "digest", "url", "payload")]
            for number, page_id, holder, digest, url, payload in zip(*(x.to_pylist() for x in columns)):
                if number != at:
                    if file:
                        done.append(file.commit())
                    file, at, part, page = None, number, 0, object()
                if page_id != page:
                    page, holders, copies = page_id, {}, {}
                if payload is None:  # says which page has the payload of this one; sorted before the page
                    holders[digest] = holder
                    continue
                if file and file.out.size >= roll:
                    done.append(file.commit())
                    file, part = None, part + 1
                file = file or Archive(folder, number, part, date)
                copy = copies[digest] = copies.get(digest, -1) + 1
                refers = holders.get(digest)
                if refers == page_id and copy == 0:
                    refers = None
                file.add(page_record(page_id, url, payload, refers, date, copy))
        if file:
            done.append(file.commit())
        if done:
            yield pa.RecordBatch.from_pylist(done)

    return run


def write_archive(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = DATE,
    shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES, least_revisit: int = LEAST_REVISIT,
) -> list[dict]:
    """Write a record per row and return the manifest, a row per file, which is also written beside the files.

    Of rows with equal payloads of at least `least_revisit` bytes the one of the largest (integer) id is the response; the others,
    also its own repeated rows, are revisits of it. A null payload is empty; a null url leaves the header out; rows without
    an id come first, and are responses unless a row with an id has their payload. Only the three named columns are read. An empty table gives an empty manifest.
    """
    storage.make_folder(folder)
    storage.bound_batches(pages.sparkSession)
    payload = F.encode(F.coalesce(F.col(payload_col).cast("string"), F.lit("")), "utf-8")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    large = rows.where(F.octet_length("payload") >= least_revisit).select("page_id", "digest")
    holders = large.groupBy("digest").agg(F.max("page_id").alias("holder"), F.count(F.lit(1)).alias("held")).where("held > 1 AND holder IS NOT NULL")
    marks = large.distinct().join(holders.select("digest", "holder"), "digest").select(
        "page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), "digest", "holder"
    )
    bounds = cuts(rows, "page_id", F.octet_length("payload") + 600, shard_bytes)
    marked = rows.withColumn("holder", F.lit(None).cast("long")).unionByName(marks).withColumn("_shard", shard(F.col("page_id"), bounds))
    sharded = marked.repartitionById(len(bounds) + 1, F.col("_shard")).sortWithinPartitions(
        "_shard", "page_id", F.col("payload").isNotNull(), "digest", "url"
    )
    done = sharded.mapInArrow(_write(folder, date, roll_bytes), "shard long, part long, path string, records long, bytes long, sha1 string")
    manifest = [row.asDict() for row in sorted(done.collect())]
    storage.write_manifest(folder, manifest)
    return manifest


def members(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The uncompressed gzip members of a file, one at a time."""
    rest = b""
    while True:
        if not rest:
            rest = stream.read(chunk)
            if not rest:
                return
        unpacker, out = zlib.decompressobj(31), []
        while not unpacker.eof:
            if not rest:
                rest = stream.read(chunk)
                if not rest:
                    raise ValueError("the archive ends inside a record")
            out.append(unpacker.decompress(rest))
            rest = unpacker.unused_data
        yield b"".join(out)


def parsed(record: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] + "\r\n" != VERSION.decode():
        raise ValueError("not a WARC 1.1 record")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(headers["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    return headers, block


def _number(text: str | None) -> int | None:
    return None if text in (None, "None") else int(text)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([
        ("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
        ("record_type", pa.string()), ("refers_to", pa.int64()), ("record_id", pa.string()),
    ])
    for batch in batches:
        for path in batch.column("path").to_pylist():
            rows, held = [], 0
            with storage.open_input(path) as stream:
                for record in members(stream):
                    headers, block = parsed(record)
                    if headers["WARC-Type"] == "warcinfo":
                        continue
                    if sha1_of(block) != headers["WARC-Block-Digest"]:
                        raise ValueError(f"a record of {path} is damaged")
                    http, _, payload = block.partition(b"\r\n\r\n")
                    revisit = headers["WARC-Type"] == "revisit"
                    if revisit:
                        size = int(http.decode().rpartition("Content-Length: ")[2])
                        digest = base64.b32decode(headers["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                    else:
                        size, digest = len(payload), hashlib.sha1(payload).hexdigest()
                    rows.append({
                        "page_id": _number(headers.get("X-Page-ID")), "url": headers.get("WARC-Target-URI"), "payload": None if revisit else payload,
                        "payload_bytes": size, "payload_digest": digest, "record_type": headers["WARC-Type"],
                        "refers_to": _number(headers.get("X-Refers-To-Page-ID")), "record_id": headers["WARC-Record-ID"],
                    })
                    held += len(block)
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)


def read_archive(spark: SparkSession, manifest: list[dict]) -> DataFrame:
    """One row per page record of the files of a manifest. Payloads of revisits are null; their size and digest are those of the
    payload they stand for. Files stream, a record at a time; a damaged record is an error."""
    files = spark.createDataFrame([(x["path"],) for x in manifest], "path string").repartition(max(1, len(manifest)))
    return files.mapInArrow(
        _read, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string"
    )
