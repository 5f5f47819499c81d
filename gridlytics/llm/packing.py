"""Packing of documents into sequences by a grouping genetic algorithm, run as islands with elite migration.

The pieces to pack are dealt by hash into blocks of bounded size. Each block is solved by several islands, each in a task of
its own: crossover puts whole well-filled sequences of one parent into the other, drops the sequences that hold one of
their pieces a second time, and places what was displaced by best fit. After an epoch an island's best goes to the next
island as well. A block's answer is the best that any of its islands has.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlytics.llm import storage
from gridlytics.llm.text import slices, texts_of
from gridlytics.llm.tokens import encoder

CAPACITY = 2048
BLOCK_PIECES = 4096
ISLANDS = 2
EPOCHS = 2
POPULATION = 4
GENERATIONS = 6

STATE = "block long, island int, rows array<long>, lengths array<int>, bins array<int>"


# ---- pieces ----

def _pieces(tokenizer: str, end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for part in slices(batches, "text"):
            ids, offsets = encode.encode(texts_of(part.column("text")))
            ids, totals = np.insert(ids, offsets[1:], end_id), np.diff(offsets) + 1
            first = np.where(totals % capacity == 0, capacity, totals % capacity)
            counts = (totals - first) // capacity + 1
            doc = np.repeat(np.arange(len(totals)), counts)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
            start = np.where(piece == 0, 0, first[doc] + (piece - 1) * capacity)
            length = np.where(piece == 0, first[doc], capacity)
            ends = np.concatenate([[0], np.cumsum(length)])
            values = pa.LargeBinaryArray.from_buffers(
                pa.large_binary(), len(doc), [None, pa.py_buffer(ends * 4), pa.py_buffer(ids.astype("<u4"))]
            ).cast(pa.binary())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), values],
                names=["doc_id", "piece", "start", "length", "ids"],
            )

    return run


def token_pieces(
    docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length and ids (little-endian 32-bit). Only texts of more than `capacity` ids
    are cut, into pieces of `capacity`, of which the first may be shorter. A null text is empty and has the end id only."""
    storage.bound_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        _pieces(tokenizer, end_id, capacity), f"doc_id {kind}, piece int, start long, length long, ids binary"
    )


# ---- the algorithm on one block ----

class Bins:
    """Open bins by what room they have left; the smallest sufficient room comes from one integer used as a bit set."""

    def __init__(self, capacity: int):
        self.by_room, self.rooms = [[] for _ in range(capacity + 1)], 0

    def put(self, number: int, room: int) -> None:
        self.by_room[room].append(number)
        self.rooms |= 1 << room

    def take(self, length: int) -> tuple[int, int] | None:
        above = self.rooms >> length
        if not above:
            return None
        room = length + (above & -above).bit_length() - 1
        found = self.by_room[room]
        number = found.pop()
        if not found:
            self.rooms &= ~(1 << room)
        return number, room


def best_fit(lengths: list[int], items, bins: list[int], room: dict[int, int], capacity: int, fresh: int) -> int:
    """Place items, in the order given, each where it leaves the least room; gives the next unused number."""
    open_bins = Bins(capacity)
    for number, left in room.items():
        if left:
            open_bins.put(number, left)
    for item in items:
        length = lengths[item]
        found = open_bins.take(length)
        if found is None:
            found, fresh = (fresh, capacity), fresh + 1
        number, left = found
        bins[item] = number
        room[number] = left - length
        if left > length:
            open_bins.put(number, left - length)
    return fresh


def dense(bins: np.ndarray) -> np.ndarray:
    return np.unique(bins, return_inverse=True)[1].astype(np.int32)


def fitness(bins: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[int, float]:
    """Few bins first; among equals, a larger mean square of fill, which means some full bins and some nearly empty."""
    fill = np.bincount(bins, lengths) / capacity
    return -len(fill), float((fill**2).mean())


def crossover(into: np.ndarray, giver: np.ndarray, lengths: np.ndarray, capacity: int, draw: np.random.Generator) -> np.ndarray:
    """Well-filled bins of the giver, whole, in place of the bins they meet in the other parent."""
    fill = np.bincount(giver, lengths)
    order = np.argsort(-(fill + draw.random(len(fill)) * 0.02 * capacity), kind="stable")
    chosen = np.zeros(len(fill), bool)
    good = order[: max(1, len(order) // 2)]
    chosen[good[draw.random(len(good)) < draw.uniform(0.2, 0.7)]] = True
    injected = chosen[giver]
    n = int(into.max()) + 1
    hit = np.zeros(n, bool)
    hit[into[injected]] = True
    worst = np.argsort(np.bincount(into, lengths), kind="stable")[: max(1, n // 20)]  # the emptiest are opened too
    hit[worst] = True
    out = np.where(injected, giver + n, into)
    displaced = np.flatnonzero(~injected & hit[into])
    keep = np.setdiff1d(np.unique(out), np.flatnonzero(hit), assume_unique=True)
    filled = np.bincount(out[~(~injected & hit[into])], lengths[~(~injected & hit[into])], minlength=int(out.max()) + 1)
    room = {int(b): int(capacity - filled[b]) for b in keep}
    bins = out.tolist()
    by_size = displaced[np.argsort(-lengths[displaced], kind="stable")]
    best_fit(lengths.tolist(), by_size.tolist(), bins, room, capacity, int(out.max()) + 1)
    return dense(np.array(bins))


def evolve(lengths: np.ndarray, elites: list[np.ndarray], seed: int, capacity: int) -> np.ndarray:
    """The best of some generations that begin with the elites, best fit by falling size, and best fit in blurred orders.
    Ends early where no packing can have fewer bins."""
    draw, n = np.random.default_rng(seed), len(lengths)
    least = math.ceil(int(lengths.sum()) / capacity)
    pool, plain = list(elites), lengths.tolist()
    while len(pool) < POPULATION:
        blur = draw.random(n) * (0 if not pool else capacity * 0.15)
        bins = [0] * n
        best_fit(plain, np.argsort(-(lengths + blur), kind="stable").tolist(), bins, {}, capacity, 0)
        pool.append(dense(np.array(bins)))
        if int(pool[-1].max()) + 1 <= least:
            break
    score = [fitness(x, lengths, capacity) for x in pool]
    for _ in range(GENERATIONS):
        if -max(score)[0] <= least or len(pool) < 2:
            break
        for _ in range(POPULATION):
            one, two = (max(draw.choice(len(pool), 2, replace=False), key=lambda k: score[k]) for _ in range(2))
            child = crossover(pool[one], pool[two], lengths, capacity, draw)
            pool.append(child)
            score.append(fitness(child, lengths, capacity))
        order = sorted(range(len(pool)), key=lambda k: score[k], reverse=True)[:POPULATION]
        pool, score = [pool[k] for k in order], [score[k] for k in order]
    return pool[int(max(range(len(pool)), key=lambda k: score[k]))]


# ---- islands ----

def _first(capacity: int):
    def run(key, frame: pd.DataFrame) -> pd.DataFrame:
        block, island = int(key[0]), int(key[1])
        frame = frame.sort_values(["length", "row"], ascending=[False, True])
        lengths = frame["length"].to_numpy(np.int64)
        best = evolve(lengths, [], block * 31 + island, capacity)
        return _sent(block, island, frame["row"].to_numpy(), lengths, best)

    return run


def _sent(block: int, island: int, rows, lengths, best) -> pd.DataFrame:
    """An island's elite, for itself and for the next one."""
    to = sorted({island, (island + 1) % ISLANDS})
    return pd.DataFrame({"block": block, "island": to, "rows": [rows] * len(to), "lengths": [lengths] * len(to), "bins": [best] * len(to)})


def _next(capacity: int, epoch: int):
    def run(key, frame: pd.DataFrame) -> pd.DataFrame:
        block, island = int(key[0]), int(key[1])
        rows, lengths = np.array(frame["rows"][0]), np.array(frame["lengths"][0], np.int64)
        elites = sorted((np.array(x, np.int32) for x in frame["bins"]), key=lambda x: x.tobytes())
        best = evolve(lengths, elites, (epoch * 1_000_003 + block) * 31 + island, capacity)
        return _sent(block, island, rows, lengths, best)

    return run


def _chosen(capacity: int):
    def run(key, frame: pd.DataFrame) -> pd.DataFrame:
        lengths = np.array(frame["lengths"][0], np.int64)
        bins = max((np.array(x, np.int32) for x in frame["bins"]), key=lambda x: (fitness(x, lengths, capacity), x.tobytes()))
        order = np.argsort(bins, kind="stable")
        ends = np.cumsum(lengths[order])
        begin = ends - lengths[order]
        first = np.concatenate([[True], bins[order][1:] != bins[order][:-1]])
        offset = begin - np.repeat(begin[first], np.diff(np.append(np.flatnonzero(first), len(order))))
        return pd.DataFrame({"row": np.array(frame["rows"][0])[order], "sequence_id": (int(key[0]) << 32) + bins[order].astype(np.int64), "offset": offset})

    return run


def assign(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """`row`, `sequence_id` and `offset` for pieces given as unique `row` and `length` (1 to `capacity`). Pieces that fill a
    sequence get one each; the others go through the islands, `BLOCK_PIECES` to a block on average."""
    pieces = pieces.select("row", F.col("length").cast("int").alias("length"))
    full = pieces.where(F.col("length") >= capacity).select("row", (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = pieces.where(F.col("length") < capacity)
    blocks = max(1, math.ceil(rest.count() / BLOCK_PIECES))
    state = rest.select(
        F.pmod(F.xxhash64("row"), F.lit(blocks)).alias("block"), "row", "length",
        F.explode(F.array(*map(F.lit, range(ISLANDS)))).alias("island"),
    ).groupBy("block", "island").applyInPandas(_first(capacity), STATE)
    for epoch in range(1, EPOCHS):
        state = state.groupBy("block", "island").applyInPandas(_next(capacity, epoch), STATE)
    packed = state.groupBy("block").applyInPandas(_chosen(capacity), "row long, sequence_id long, offset long")
    return packed.unionByName(full)


def staged_pieces(
    docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The pieces of all documents with a number of their own (`row`), written once to the shared folder."""
    numbered = token_pieces(docs, tokenizer, end_id, capacity, id_col, text_col).withColumn("row", F.monotonically_increasing_id())
    return storage.staged(numbered, "pieces")


def placed(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Staged pieces, with whatever columns they have been given, and their sequence_id and offset."""
    return pieces.join(assign(pieces, capacity), "row").drop("row")


def pack_documents(
    docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per piece of every document: doc_id, piece, start, length, ids, sequence_id, offset.

    The islands read the pieces' lengths only. Every row of `docs` is packed:
    a null text as its end id alone, repeated rows once each, null ids too. An empty table gives an empty result.
    """
    return placed(staged_pieces(docs, tokenizer, end_id, capacity, id_col, text_col), capacity)
