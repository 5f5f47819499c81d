"""Language identification by error-correcting output codes.

Every language has a codeword. Each bit has a binary classifier over character n-grams: naive Bayes log odds between the
languages with the bit and those without. A text's margins are decoded to the codeword of least weighted loss, where a bit weighs
as much as its classifier gets right for the language; two codewords at nearly the same loss make the answer ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlytics.llm import storage
from gridlytics.llm.text import coded, mixed, rows_of, slices, sums, texts_of, words_of

FEATURES = 1 << 16
LENGTHS = (1, 2, 3, 4)
SMOOTHING = 0.1
AMBIGUOUS = 0.1  # part of the loss by which the second codeword must at least be worse

#: Labelled texts on which the bits' weights are measured at most, on average, chosen by the hash of their id.
WEIGHING_ROWS = 4000
#: Languages whose counts a task holds at once.
HELD_LANGUAGES = 64
#: Languages up to which drawn codes are compared pair by pair; beyond, the spread of one long draw is trusted.
COMPARED_LANGUAGES = 512


def gram_sums(words: pa.Array, table: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each distinct word, in lower case between two spaces: its n-grams' features and where they begin; or, given
    a table of features x columns, the sums of its rows and the number of n-grams."""
    lowered = pc.utf8_lower(words).cast(pa.large_string())
    n = len(lowered)
    begins = np.frombuffer(lowered.buffers()[1], np.int64)[lowered.offset : lowered.offset + n + 1]
    data = np.frombuffer(lowered.buffers()[2] or b"", np.uint8)[begins[0] : begins[-1]]
    begins = begins - begins[0]
    offsets = begins + 2 * np.arange(n + 1)
    padded = np.full(offsets[-1], 32, np.uint8)
    row = np.repeat(np.arange(n), np.diff(begins))
    padded[np.arange(len(data)) + 2 * row + 1] = data
    ends = np.repeat(offsets[1:], np.diff(offsets))
    at, rolled = np.arange(len(padded)), np.zeros(len(padded), np.uint64)
    total, counts, found = None, np.zeros(n, np.int64), []
    with np.errstate(over="ignore"):
        for size in range(1, max(LENGTHS) + 1):
            inside = at + size <= ends[at]
            at, rolled = at[inside], rolled[inside]
            rolled = rolled * np.uint64(257) + padded[at + size - 1] + np.uint64(1)
            if size not in LENGTHS:
                continue
            feature = (mixed(rolled + (np.uint64(size) << np.uint64(56))) % np.uint64(FEATURES)).astype(np.int64)
            starts = np.searchsorted(at, offsets)
            counts += np.diff(starts)
            if table is None:
                found.append((feature, starts))
                continue
            part = np.zeros((n, table.shape[1]))
            full = np.flatnonzero(np.diff(starts) > 0)
            for k in range(table.shape[1] if len(full) else 0):
                part[full, k] = np.add.reduceat(table[feature, k], starts[:-1][full])
            total = part if total is None else total + part
    return (found, counts) if table is None else (total, counts)


def codewords(n: int) -> np.ndarray:
    """n rows of +1 and -1: all splits in two for up to seven languages, else the best spread of drawn codes. There are ten bits for each
    doubling of the languages, so two drawn codewords of thousands still differ in a quarter of their bits."""
    if n < 2:
        return np.ones((n, 1))
    if n <= 7:
        splits = np.arange(1, 1 << (n - 1))
        return np.where((splits[None, :] >> np.arange(n)[:, None]) & 1, 1.0, -1.0)
    draw, best, found = np.random.default_rng(n), -1, None
    for _ in range(200):
        code = np.where(draw.random((n, int(np.ceil(10 * np.log2(n))))) < 0.5, 1.0, -1.0)
        if n > COMPARED_LANGUAGES:
            if len(np.unique(np.packbits(code > 0, axis=1), axis=0)) == n:
                return code
            continue
        if (abs(code.sum(0)) == n).any():
            continue
        apart = (code.shape[1] - code @ code.T) / 2
        least = (apart + np.eye(n) * code.shape[1]).min()
        if least > best:
            best, found = least, code
    return found


def _sent_counts(held: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for lang, table in held.items():
        places = np.flatnonzero(table)
        for a in range(0, len(places), 8192):
            some = places[a : a + 8192]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(some)), pa.array(some), pa.array(table[some])], names=["lang", "feature", "count"]
            )


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, np.ndarray] = {}
    for part in slices(batches, "text"):
        words, offsets = words_of(texts_of(part.column("text")))
        distinct, codes = coded(words)
        languages, which = coded(part.column("lang").cast(pa.large_string()))
        of_word = which[rows_of(offsets)]
        found, _ = gram_sums(distinct)
        for k, lang in enumerate(languages.to_pylist()):
            if len(held) >= HELD_LANGUAGES and lang not in held:
                yield from _sent_counts(held)
                held.clear()
            weight = np.bincount(codes[of_word == k], minlength=len(distinct)).astype(np.float64)
            table = held.setdefault(lang, np.zeros(FEATURES))
            for feature, starts in found:
                table += np.bincount(feature, np.repeat(weight, np.diff(starts)), FEATURES)
    yield from _sent_counts(held)


def _bit_sums(sent):
    """Per feature the sums of its shares over the languages with each bit, and over those without; a feature's rows come to one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, whole, ones = sent.value
        place = pa.array(names, pa.string())
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            lang = pc.index_in(batch.column("lang"), place).to_numpy(zero_copy_only=False).astype(np.int64)
            feature, share = batch.column("feature").to_numpy(), batch.column("count").to_numpy() / whole[lang]
            for a in range(0, len(feature), 4096):
                part = slice(a, a + 4096)
                some, which = np.unique(feature[part], return_inverse=True)
                added = np.zeros((len(some), 2, ones.shape[1]))
                np.add.at(added, which, np.stack([ones[lang[part]], ~ones[lang[part]]], 1) * share[part][:, None, None])
                for k, f in enumerate(some.tolist()):
                    held[f] = held[f] + added[k] if f in held else added[k]
        if held:
            values = np.stack(list(held.values()))
            ends = np.arange(0, len(held) * ones.shape[1] + 1, ones.shape[1], dtype=np.int32)
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(values[:, k]).ravel())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), *lists], names=["feature", "ones", "zeros"])

    return run


def _margins(part: pa.RecordBatch, table: np.ndarray) -> np.ndarray:
    """texts x bits: mean log odds of a text's n-grams, times the square root of their number up to a hundred."""
    words, offsets = words_of(texts_of(part.column("text")))
    distinct, codes = coded(words)
    if not len(distinct):
        return np.zeros((part.num_rows, table.shape[1]))
    total, counts = gram_sums(distinct, table)
    grams = np.maximum(sums(counts[codes], offsets), 1)
    out = np.stack([sums(total[codes, k], offsets) for k in range(table.shape[1])], 1)
    return out / grams[:, None] * np.sqrt(np.minimum(grams, 100))[:, None]


def losses(margins: np.ndarray, code: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """texts x languages: weighted logistic loss of the margins against each codeword."""
    out = np.zeros((len(margins), len(code)))
    for k in range(len(code)):
        z = np.clip(margins * code[k], -30, 30)
        out[:, k] = np.log1p(np.exp(-z)) @ weights[k]
    return out


def _right(sent, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, code = sent.value
        place = {name: k for k, name in enumerate(names)}
        right, seen = np.zeros(code.shape), np.zeros(len(names))
        for part in slices(batches, "text"):
            signs = _margins(part, table) > 0
            for lang, sign in zip(part.column("lang").to_pylist(), signs):
                k = place[lang]
                right[k] += sign == (code[k] > 0)
                seen[k] += 1
        full = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays(
            [pa.array(full), pa.array(seen[full]), pa.array(list(right[full]), pa.list_(pa.float64()))], names=["place", "seen", "right"]
        )

    return run


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = WEIGHING_ROWS):
    """Languages, bit tables, code and bit weights from all rows with a text and a language.

    N-grams are counted over every such row, in Spark, and added up there for each bit, so that what comes to the driver is a total
    for each language and two sums for each feature and bit, of which there are ten for each doubling of the languages. The
    weights are measured on about `most` rows. Without such rows there are no languages.
    """
    spark = docs.sparkSession
    storage.bound_batches(spark)
    rows = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")
    )
    counted = rows.select("text", "lang").mapInArrow(_counted, "lang string, feature long, count double")
    found = storage.staged(counted.groupBy("lang", "feature").agg(F.sum("count").alias("count")), "grams")
    totals = dict(found.groupBy("lang").agg(F.sum("count")).collect())
    names = sorted(totals)
    code = codewords(len(names))
    table = np.zeros((FEATURES, code.shape[1]))
    if len(names) > 1:
        # A language's share of a feature is (count + smoothing) / whole, so each language counts alike, however common.
        whole = np.array([totals[name] for name in names]) + SMOOTHING * FEATURES
        ones = code > 0
        rest = np.stack([SMOOTHING * (side / whole[:, None]).sum(0) for side in (ones, ~ones)])
        sides = np.stack([ones.sum(0), (~ones).sum(0)])
        sent = spark.sparkContext.broadcast((names, whole, ones))
        sums_of = found.repartition("feature").mapInArrow(_bit_sums(sent), "feature long, ones array<double>, zeros array<double>").toArrow()
        at = sums_of["feature"].to_numpy()
        for side, name in ((0, "ones"), (1, "zeros")):
            added = np.zeros((FEATURES, code.shape[1]))
            added[at] = sums_of[name].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(at), code.shape[1])
            share = np.log((added + rest[side]) / sides[side])
            table += share if side == 0 else -share
    weights = np.ones(code.shape)
    if len(names) > 1:
        every = max(1, -(-rows.count() // most))
        sent = spark.sparkContext.broadcast((table, code))
        some = rows.where(F.pmod(F.xxhash64("id"), F.lit(every)) == 0).select("text", "lang")
        measured = some.mapInArrow(_right(sent, names), "place long, seen double, right array<double>")
        per_bit = measured.select("place", "seen", F.posexplode("right").alias("bit", "right"))
        for place, bit, right, seen in per_bit.groupBy("place", "bit").agg(F.sum("right"), F.sum("seen")).collect():
            weights[place, bit] = (right + 1) / (seen + 2)
        weights = weights / weights.sum(1, keepdims=True)
    return names, table, code, weights


def _decoded(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, table, code, weights = sent.value
        for part in slices(batches, "text"):
            texts, n = texts_of(part.column("text")), part.num_rows
            letters = pc.match_substring_regex(texts, r"\p{L}").to_numpy(zero_copy_only=False)
            if not names:
                best, share, close = np.zeros(n, np.int64), np.zeros(n), np.ones(n, bool)
                letters[:] = False
            else:
                loss = losses(_margins(part, table), code, weights)
                best = loss.argmin(1)
                near = np.exp(-8 * (loss - loss.min(1, keepdims=True)))
                share = near.max(1) / near.sum(1)
                second = np.sort(loss, axis=1)[:, min(1, len(names) - 1)]
                close = (second - loss.min(1) < AMBIGUOUS * second) & (len(names) > 1)
            said = np.where(letters, np.array([*names, "und"], object)[best], "und")
            yield pa.RecordBatch.from_arrays(
                [part.column("_id"), pa.array(said, pa.string()), pa.array(np.where(letters, share, 0.0)), pa.array(close | ~letters)],
                names=["_id", "lang_pred", "score", "ambiguous"],
            )

    return run


def identify(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score (0 to 1) and ambiguous for every row, from its whole text.

    Null texts and texts without a letter are `und` with score 0; so are all if the model has no language. Repeated rows and
    null ids are kept; only the two named columns are read.
    """
    storage.bound_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(
        _decoded(sent), f"_id {dict(docs.dtypes)[id_col]}, lang_pred string, score double, ambiguous boolean"
    ).withColumnRenamed("_id", id_col)
