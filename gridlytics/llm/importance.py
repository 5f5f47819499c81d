"""Importance resampling towards a target distribution by hashed word n-grams.

Every feature (a run of one or two words) falls in a bucket by the CRC-32 of its bytes. A bucket's gain is the log ratio of its
smoothed shares in the target texts and in all documents; a document's weight is the mean gain of its features, and those with the
highest weight plus Gumbel noise are drawn, which is sampling without replacement in proportion to the weights' exponentials.

The CRCs of a slice's distinct features are computed together: features of equal length form the rows of one byte matrix, all CRCs
are updated column by column through the byte table, and the results are scattered back to where the features stood.

The texts are read twice: once for bucket counts, which each task adds up before they are shuffled (10,000 numbers a task), and once
for the weights, whose slim rows are written. Scores are whole thousandths of a log ratio plus noise of 32 bits, so there are some
hundred thousand distinct ones at most, whatever the input: ranks come from their counts and, inside one score, from a window.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridlytics.llm import storage
from gridlytics.llm.text import coded, flat, rows_of, slices, texts_of

BUCKETS = 10_000
LONGEST = 2
LEAST_WORDS = 20
SEPARATORS = "[\\x00-\\x2f\\x3a-\\x60\\x7b-\\x7f]+"


def byte_table() -> np.ndarray:
    """The remainders of all bytes by the reflected CRC-32 polynomial."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, np.uint32(0xEDB88320), np.uint32(0)) ^ (table >> np.uint32(1))
    return table


def crcs(strings: pa.Array, table: np.ndarray | None = None) -> np.ndarray:
    """The unsigned CRC-32 of the UTF-8 bytes of each string of a large string array."""
    table = byte_table() if table is None else table
    if not len(strings):
        return np.zeros(0, np.uint32)
    offsets = np.frombuffer(strings.buffers()[1], np.int64, len(strings) + 1, strings.offset * 8)
    data = np.frombuffer(strings.buffers()[2] or b"", np.uint8)
    begins, lengths = offsets[:-1], np.diff(offsets)
    out = np.zeros(len(strings), np.uint32)
    order = np.argsort(lengths, kind="stable")
    sizes, at = np.unique(lengths[order], return_index=True)
    for size, rows in zip(sizes.tolist(), np.split(order, at[1:])):
        matrix = data[begins[rows][:, None] + np.arange(size)] if size < 4096 else None
        crc = np.full(len(rows), 0xFFFFFFFF, np.uint32)
        for k in range(size):
            column = matrix[:, k] if matrix is not None else data[begins[rows] + k]
            crc = table[(crc ^ column) & np.uint32(0xFF)] ^ (crc >> np.uint32(8))
        out[rows] = ~crc
    return out


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Runs of digits, letters a to z and characters beyond ASCII, with A to Z lowered."""
    return flat(pc.split_pattern_regex(pc.ascii_lower(texts), SEPARATORS))


def features_of(texts: pa.Array, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The row and bucket of every feature of the texts, repeats included, and each text's number of words."""
    words, offsets = words_of(texts)
    distinct, codes = coded(words)
    row, ends = rows_of(offsets), offsets[1:]
    rows, buckets = [row], [(crcs(distinct, table) % np.uint32(BUCKETS)).astype(np.int32)[codes]]
    at, key = np.arange(len(codes)), codes
    grams = distinct
    for size in range(2, LONGEST + 1):
        inside = at + size <= ends[row[at]]
        at, key = at[inside], key[inside]
        pairs, key = np.unique(key * max(len(distinct), 1) + codes[at + size - 1], return_inverse=True)
        left, right = np.divmod(pairs, max(len(distinct), 1))
        grams = pc.binary_join_element_wise(grams.take(pa.array(left)), distinct.take(pa.array(right)), pa.scalar(" ", pa.large_string()))
        rows.append(row[at])
        buckets.append((crcs(grams, table) % np.uint32(BUCKETS)).astype(np.int32)[key])
    return np.concatenate(rows), np.concatenate(buckets), np.diff(offsets)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts, table = np.zeros(BUCKETS, np.int64), byte_table()
    for part in slices(batches, "text"):
        counts += np.bincount(features_of(texts_of(part.column("text")), table)[1], minlength=BUCKETS)
    full = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(counts[full])], names=["bucket", "n"])


def bucket_counts(texts: DataFrame, text_col: str = "text") -> np.ndarray:
    """How many features of all texts fall in each bucket."""
    storage.bound_batches(texts.sparkSession)
    parts = texts.select(F.col(text_col).cast("string").alias("text")).mapInArrow(_counted, "bucket int, n long")
    counts = np.zeros(BUCKETS, np.int64)
    for bucket, n in parts.groupBy("bucket").agg(F.sum("n")).collect():
        counts[bucket] = n
    return counts


def gains(documents: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of each bucket's log ratio, rounded down."""
    all_documents, all_target = float(documents.sum()) + BUCKETS, float(target.sum()) + BUCKETS
    return np.array(
        [math.floor(1000 * math.log((t + 1.0) * all_documents / ((s + 1.0) * all_target))) for s, t in zip(documents.tolist(), target.tolist())],
        np.int64,
    )


def _weighed(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain, table = sent.value, byte_table()
        for part in slices(batches, "text"):
            row, bucket, words = features_of(texts_of(part.column("text")), table)
            n = np.bincount(row, minlength=part.num_rows).astype(np.int64)
            total = np.bincount(row, weights=gain[bucket], minlength=part.num_rows).astype(np.int64)  # whole numbers: exact
            weight = total // np.maximum(n, 1)
            noise = [math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))) for h in part.column("h").to_pylist()]
            score = weight + np.array(noise, np.int64)
            yield pa.RecordBatch.from_arrays(
                [part.column("_id"), *(pa.array(x.astype(np.int64)) for x in (words, n, weight, score))],
                names=["_id", "n_words", "n_features", "weight", "score"],
            )

    return run


def drawn(
    docs: DataFrame, target: DataFrame, percent: int, seed: int, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text",
    least_words: int = LEAST_WORDS,
) -> DataFrame:
    """Per row: id, n_words, n_features, weight, score, and the rank of those drawn (null for the rest).

    Drawn are the floor(percent * N / 100) highest scores of the N rows with `least_words` words at least, ties to the smaller id. The
    noise of a row comes from the SHA-256 of "seed:id", so equal ids get equal noise. A null text has no words; without features a
    weight is 0; a null id is an empty string in the noise and comes before others. Repeated rows are rows of their own. An empty
    target makes rare features heavy, no more; an empty table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    storage.bound_batches(spark)
    sent = spark.sparkContext.broadcast(gains(bucket_counts(docs, text_col), bucket_counts(target, target_text)))
    seeded = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    rows = docs.select(
        F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text"),
        F.conv(F.substring(F.sha2(seeded.cast("binary"), 256), 1, 8), 16, 10).cast("long").alias("h"),
    )
    kind = dict(docs.dtypes)[id_col]
    weighed = storage.staged(
        rows.mapInArrow(_weighed(sent), f"_id {kind}, n_words long, n_features long, weight long, score long"), "weights"
    )
    meant = weighed.where(F.col("n_words") >= least_words)
    levels = sorted(((r[0], r[1]) for r in meant.groupBy("score").count().collect()), reverse=True)
    take = sum(n for _, n in levels) * percent // 100
    before, starts = 0, []
    for score, n in levels:
        if before >= take:
            break
        starts.append((score, before))
        before += n
    if not starts:
        return weighed.withColumn("rank", F.lit(None).cast("long")).withColumnRenamed("_id", id_col)
    cut = (F.col("n_words") >= least_words) & (F.col("score") >= starts[-1][0])
    places = F.broadcast(spark.createDataFrame(starts, "score long, before long"))
    in_order = Window.partitionBy("score").orderBy("_id")
    ranked = weighed.where(cut).join(places, "score").withColumn("rank", F.row_number().over(in_order) + F.col("before"))
    columns = [*weighed.columns, F.when(F.col("rank") <= take, F.col("rank")).cast("long").alias("rank")]
    rest = weighed.where(~cut).withColumn("rank", F.lit(None).cast("long"))
    return ranked.select(*columns).unionByName(rest).withColumnRenamed("_id", id_col)
