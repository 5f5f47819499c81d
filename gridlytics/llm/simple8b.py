"""Token files in Simple-8b: word-aligned packing of ids, with escapes and block offsets.

A file has blocks of `BLOCK` ids (the last of a group of blocks may be shorter). A word of 64 bits has a selector in its
top four bits and as many ids of equal width as the selector says below. Ids from 32,767 (`ESCAPE`) on stand as that value in the
words and whole, 32 bits each, in the block's list of escapes. File, little-endian: magic; groups, each with its
words and escapes; an index of the blocks (ids, first word, first escape), the documents' ids and token counts, and a
footer with the sizes of these parts. Blocks are packed and unpacked all together, by array operations.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlytics.llm import storage
from gridlytics.llm.ranges import by_shard
from gridlytics.llm.text import slices, texts_of
from gridlytics.llm.tokens import encoder

# The published selectors, how many ids of how many bits a word holds.
COUNTS = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])

BLOCK = 1024
GROUP = 256 * BLOCK
ESCAPE = np.uint32((1 << 15) - 1)
MAGIC, END = b"S8BTOK1\n", b"S8BEND1\n"
FOOTER = "<QQQQQQ8s"
TARGET_BYTES = 32 << 20

INDEX = np.dtype([("ids", "<u4"), ("word", "<u8"), ("escape", "<u8")])
DOCUMENT = np.dtype([("null", "u1"), ("doc_id", "<i8"), ("tokens", "<u8")])


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, escapes and block index of a run of ids (unsigned 32-bit)."""
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, INDEX)
    blocks = -(-n // BLOCK)
    wide = ids >= ESCAPE
    small = np.zeros(blocks * BLOCK, np.uint64)
    small[:n] = np.where(wide, ESCAPE, ids)
    # frexp's exponent is the bit width
    widths = np.frexp(small.astype(np.float64))[1].reshape(blocks, BLOCK)
    room = np.minimum(BLOCK, n - np.arange(blocks) * BLOCK)  # ids of each block
    selector = np.full((blocks, BLOCK), len(BITS) - 1, np.int64)
    for k in range(len(BITS) - 2, -1, -1):  # later ones hold more ids and win
        over = np.zeros((blocks, BLOCK + 1), np.int32)
        np.cumsum(widths > BITS[k], axis=1, out=over[:, 1:])
        last = np.minimum(np.arange(BLOCK) + COUNTS[k], BLOCK)  # behind a block's end there is only padding
        selector[over[:, last] == over[:, :BLOCK]] = k
    at, row = np.zeros(blocks, np.int64), np.arange(blocks)
    begins, rows, order = [], [], []
    step = 0
    while len(row):
        begins.append(at)
        rows.append(row)
        order.append(np.full(len(row), step))
        at = at + COUNTS[selector[row, at]]
        on = at < room[row]
        at, row, step = at[on], row[on], step + 1
    begins, rows, order = (np.concatenate(x) for x in (begins, rows, order))
    sort = np.lexsort((order, rows))
    begins, rows = begins[sort], rows[sort]
    chosen = selector[rows, begins]
    words = chosen.astype(np.uint64) << np.uint64(60)
    padded = np.concatenate([small, np.zeros(COUNTS.max(), np.uint64)])
    for k in range(2, len(BITS)):
        which = np.flatnonzero(chosen == k)
        first = rows[which] * BLOCK + begins[which]
        until = (rows[which] + 1) * BLOCK
        for j in range(COUNTS[k] if len(which) else 0):
            values = np.where(first + j < until, padded[first + j], np.uint64(0))
            words[which] |= values << np.uint64(j * BITS[k])
    index = np.zeros(blocks, INDEX)
    index["ids"] = room
    index["word"] = np.searchsorted(rows, np.arange(blocks))
    index["escape"] = np.concatenate([[0], np.cumsum(np.add.reduceat(wide.astype(np.int64), np.arange(0, n, BLOCK)))[:-1]])
    return words, ids[wide].astype(np.uint32), index


def unpack(words: np.ndarray, escapes: np.ndarray, index: np.ndarray) -> np.ndarray:
    """The ids of whole blocks; `index` counts words and escapes from those given."""
    total = int(index["ids"].sum())
    if not total:
        return np.zeros(0, np.uint32)
    chosen = (words >> np.uint64(60)).astype(np.int64)
    counts = COUNTS[chosen]
    first_word = index["word"].astype(np.int64)
    block = np.searchsorted(first_word, np.arange(len(words)), side="right") - 1
    before = np.cumsum(counts) - counts
    inside = before - before[first_word][block]
    ends = np.cumsum(index["ids"].astype(np.int64))
    begin, end = (ends - index["ids"])[block] + inside, ends[block]
    out = np.zeros(total, np.uint32)
    for k in range(2, len(BITS)):
        which = np.flatnonzero(chosen == k)
        mask = np.uint64((1 << int(BITS[k])) - 1)
        for j in range(COUNTS[k] if len(which) else 0):
            place = begin[which] + j
            real = place < end[which]
            out[place[real]] = ((words[which[real]] >> np.uint64(j * BITS[k])) & mask).astype(np.uint32)
    out[out == ESCAPE] = escapes
    return out


class TokenFile:
    """Writes one file; ids come document by document and are packed a group of blocks at a time."""

    def __init__(self, path: str):
        self.out, self.path = storage.Committed(path), path
        self.out.write(MAGIC)
        self.waiting, self.held, self.crc = [], 0, 0
        self.index, self.groups, self.documents = [], [], []

    def add(self, doc_ids: np.ndarray, null: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        rows = np.zeros(len(doc_ids), DOCUMENT)
        rows["null"], rows["doc_id"], rows["tokens"] = null, doc_ids, counts
        self.documents.append(rows)
        self.waiting.append(ids.astype(np.uint32))
        self.held += len(ids)
        if self.held >= GROUP:
            self._pack(self.held // GROUP * GROUP)

    def _pack(self, n: int) -> None:
        ids = np.concatenate(self.waiting)
        self.waiting, self.held = [ids[n:]], len(ids) - n
        for at in range(0, n, GROUP):
            words, escapes, index = pack(ids[at : at + GROUP])
            body = words.astype("<u8").tobytes() + escapes.astype("<u4").tobytes()
            self.groups.append((self.out.size, len(words), len(escapes), len(index)))
            self.index.append(index)
            self.out.write(body)
            self.crc = zlib.crc32(body, self.crc)

    def commit(self) -> dict:
        if self.held:
            self._pack(self.held)
        groups = np.array(self.groups, "<u8").reshape(-1, 4)
        index = np.concatenate([*self.index, np.zeros(0, INDEX)])
        documents = np.concatenate([*self.documents, np.zeros(0, DOCUMENT)])
        at, ids = self.out.size, int(documents["tokens"].sum())
        for part in (groups, index, documents):
            self.out.write(part.tobytes())
        self.out.write(struct.pack(FOOTER, at, len(groups), len(index), len(documents), ids, self.crc, END))
        self.out.commit()
        return {"path": self.path, "documents": len(documents), "ids": ids, "bytes": self.out.size, "crc": self.crc}


def read_file(path: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Groups of documents (records of `DOCUMENT`) with their ids, in order; raises on a damaged file."""
    with storage.open_input(path) as file:
        size = file.size()
        file.seek(size - struct.calcsize(FOOTER))
        at, n_groups, n_index, n_documents, ids, crc, end = struct.unpack(FOOTER, file.read(struct.calcsize(FOOTER)))
        if end != END:
            raise ValueError(f"{path} has no end mark")
        file.seek(at)
        groups = np.frombuffer(file.read(n_groups * 32), "<u8").reshape(-1, 4).astype(np.int64)
        index = np.frombuffer(file.read(n_index * INDEX.itemsize), INDEX)
        documents = np.frombuffer(file.read(n_documents * DOCUMENT.itemsize), DOCUMENT)
        ends = np.cumsum(documents["tokens"].astype(np.int64))
        done, given, first, seen, held = 0, 0, 0, 0, np.zeros(0, np.uint32)
        for place, words, escapes, blocks in groups:
            file.seek(int(place))
            body = file.read(int(words * 8 + escapes * 4))
            seen = zlib.crc32(body, seen)
            got = unpack(np.frombuffer(body, "<u8", words), np.frombuffer(body, "<u4", escapes, words * 8), index[first : first + blocks])
            held, first = np.concatenate([held, got]), first + int(blocks)
            whole = int(np.searchsorted(ends, given + len(held), side="right"))
            if whole > done:
                taken = int(ends[whole - 1]) - given
                yield documents[done:whole], held[:taken]
                held, given, done = held[taken:], given + taken, whole
        if seen != crc or given != ids:
            raise ValueError(f"{path} is damaged")
        if done < n_documents:
            yield documents[done:], held


def _write(folder: str, tokenizer: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, file, number, rows = encoder(tokenizer), None, None, []
        for part in slices(batches, "text"):
            shards = part.column("_shard").to_numpy()
            bounds = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), part.num_rows]
            for a, b in zip(bounds, bounds[1:]):
                if number != shards[a]:
                    if file:
                        rows.append({"shard": int(number)} | file.commit())
                    number = shards[a]
                    file = TokenFile(f"{folder}/part-{int(number):06d}.s8b")
                ids, offsets = encode.encode(texts_of(part.column("text").slice(a, b - a)))
                doc_ids = part.column("doc_id").slice(a, b - a)
                file.add(
                    doc_ids.fill_null(0).to_numpy(), doc_ids.is_null().to_numpy(zero_copy_only=False),
                    np.insert(ids, offsets[1:], end_id), np.diff(offsets) + 1,
                )
        if file:
            rows.append({"shard": int(number)} | file.commit())
        if rows:
            yield pa.RecordBatch.from_pylist(rows)

    return run


def write_tokens(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", target_bytes: int = TARGET_BYTES
) -> list[dict]:
    """Write the ids of all texts, each with `end_id` behind it, into files in ascending order of the (integer) id.

    Returns the manifest, a row per file in order, also written beside the files. Null texts count as empty; rows without an
    id come first; rows of equal ids are ordered by their text. An empty table gives an empty manifest. Only the two named
    columns are read. Shards are cut by text size at keys of a hashed sample, so a run over the same rows gives the same
    files; a shard streams through its task.
    """
    storage.make_folder(folder)
    storage.bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    sharded = by_shard(rows, "doc_id", F.octet_length("text") + 16, target_bytes, ["doc_id", "text"])
    done = sharded.mapInArrow(_write(folder, tokenizer, end_id), "shard long, path string, documents long, ids long, bytes long, crc long")
    manifest, start = [], 0
    for row in sorted(done.collect()):
        manifest.append(row.asDict() | {"start": start})
        start += row.ids
    storage.write_manifest(folder, manifest)
    return manifest


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            start = row["start"]
            for documents, ids in read_file(row["path"]):
                counts = documents["tokens"].astype(np.int64)
                ends = np.cumsum(counts)
                values = pa.LargeBinaryArray.from_buffers(
                    pa.large_binary(), len(counts), [None, pa.py_buffer(np.concatenate([[0], ends * 4])), pa.py_buffer(ids.astype("<u4"))]
                ).cast(pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(documents["doc_id"], mask=documents["null"].astype(bool)), pa.array(start + ends - counts), pa.array(counts), values],
                    names=["doc_id", "start", "n_tokens", "ids"],
                )
                start += int(counts.sum())


def read_tokens(spark: SparkSession, manifest: list[dict]) -> DataFrame:
    """One row per document of the files of a manifest: its id, the ids of all documents before it, and its own ids as
    little-endian 32-bit integers. Groups of blocks stream; a file is never whole in memory."""
    rows = [(x["path"], x["start"]) for x in manifest]
    files = spark.createDataFrame(rows, "path string, start long")
    return files.repartition(max(1, len(rows))).mapInArrow(_read, "doc_id long, start long, n_tokens long, ids binary")
