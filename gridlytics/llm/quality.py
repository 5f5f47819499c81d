"""Quality classifier: support vectors over n-gram indicators that are scaled by naive Bayes log-count ratios.

The n-grams are those of word shapes (letters by case, digits, other characters as they are, and whether a word repeats the
one before it), one to three words long, and of the words alone. Each is an indicator: there or not. A linear hinge-loss
model over the scaled indicators is fitted by dual coordinate descent, and its margins become probabilities by a logistic curve
fitted to margins of rows that were left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlytics.llm import storage
from gridlytics.llm.text import coded, hashes_of, mixed, rows_of, slices, texts_of, words_of

FEATURES = 1 << 18
LONGEST = 3
PENALTY = 1.0
PASSES = 12
SMOOTHING = 1.0

#: Labelled rows that a model is fitted on at most, on average: those whose hashed id falls in the share that gives so many.
TRAINING_ROWS = 8000


def shapes(words: pa.Array) -> pa.Array:
    """Runs of lower case, of upper case, one upper case letter, other letters, digits: one control character each."""
    for pattern, to in ((r"\p{Ll}+", "\x01"), (r"\p{Lu}\p{Lu}+", "\x02"), (r"\p{Lu}", "\x03"), (r"\p{L}+", "\x04"), (r"\p{N}+", "\x05")):
        words = pc.replace_substring_regex(words, pattern, to)
    return words


def indicators(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The distinct features of each text and where each text's begin. Every text has one that says nothing, so none is without."""
    words, offsets = words_of(texts)
    distinct, codes = coded(words)
    row = rows_of(offsets)
    word = mixed(hashes_of(distinct))[codes]
    shape = mixed(hashes_of(shapes(distinct)) ^ np.uint64(0xA5A5A5A5))[codes]
    again = np.zeros(len(codes), bool)
    again[1:] = (codes[1:] == codes[:-1]) & (row[1:] == row[:-1])
    shape[again] = np.uint64(7)
    ends = offsets[1:][row]
    at, rolled = np.arange(len(codes)), shape
    found = [(np.arange(len(texts)), np.zeros(len(texts), np.uint64)), (row, word)]
    with np.errstate(over="ignore"):
        for size in range(1, LONGEST + 1):
            if size > 1:
                inside = at + size <= ends[at]
                at, rolled = at[inside], rolled[inside]
                rolled = mixed(rolled * np.uint64(0x9E3779B97F4A7C15) + shape[at + size - 1])
            found.append((row[at], rolled))
    key = np.concatenate([r.astype(np.int64) * FEATURES + (h % np.uint64(FEATURES)).astype(np.int64) for r, h in found])
    key = np.unique(key)
    return (key % FEATURES).astype(np.int32), np.searchsorted(key, np.arange(len(texts) + 1) * FEATURES)


def descend(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, costs: np.ndarray, seed: int) -> np.ndarray:
    """Weights of a hinge-loss model by dual coordinate descent: one multiplier a row, moved to its own optimum in turn."""
    draw, weights, alpha = np.random.default_rng(seed), np.zeros(FEATURES), np.zeros(len(rows))
    square = np.array([float(v @ v) for v in values])
    for _ in range(PASSES):
        moved = 0.0
        for k in draw.permutation(len(rows)):
            slope = y[k] * float(weights[rows[k]] @ values[k]) - 1
            new = min(max(alpha[k] - slope / max(square[k], 1e-12), 0.0), costs[k])
            if new != alpha[k]:
                weights[rows[k]] += (new - alpha[k]) * y[k] * values[k]
                moved = max(moved, abs(new - alpha[k]))
                alpha[k] = new
        if moved < 1e-3:
            break
    return weights


def scaled(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray) -> list[np.ndarray]:
    """The indicators by their ratios, each text to length 1."""
    out = [ratio[r] for r in rows]
    return [v / max(float(np.sqrt(v @ v)), 1e-9) for v in out]


def ratios(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    counts = {s: np.full(FEATURES, SMOOTHING) for s in (1, -1)}
    for r, s in zip(rows, y):
        counts[int(s)][r] += 1
    return np.log(counts[1] / counts[1].sum()) - np.log(counts[-1] / counts[-1].sum())


def logistic(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve of the labels over the margins, by Newton's method with a little ridge."""
    beta = np.array([1.0, 0.0])
    x, target = np.stack([margins, np.ones(len(margins))], 1), (y > 0).astype(float)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (target - p) - 1e-2 * beta
        curve = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        step = np.linalg.solve(curve, gradient)
        beta = beta + np.clip(step, -5, 5)
        if abs(step).max() < 1e-6:
            break
    return float(beta[0]), float(beta[1])


def fit(rows: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float]:
    """Ratios, weights, and the curve. With one class only, the curve gives that class's share, smoothed."""
    if not len(y) or abs(y.sum()) == len(y):
        share = ((y > 0).sum() + 1) / (len(y) + 2)
        return np.zeros(FEATURES), np.zeros(FEATURES), 0.0, float(np.log(share / (1 - share)))

    def one(some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        part, label = [rows[k] for k in some], y[some]
        ratio = ratios(part, label)
        costs = np.where(label > 0, len(label) / (2 * max((label > 0).sum(), 1)), len(label) / (2 * max((label < 0).sum(), 1))) * PENALTY
        return ratio, descend(part, scaled(part, label, ratio), label, costs, 1)

    def margins(model, some: np.ndarray) -> np.ndarray:
        ratio, weights = model
        part = [rows[k] for k in some]
        return np.array([float(weights[r] @ v) for r, v in zip(part, scaled(part, y[some], ratio))])

    fold = np.arange(len(y)) % 3
    left_out = np.zeros(len(y))
    for k in range(3):
        inside, outside = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        if len(outside) and abs(y[inside].sum()) < len(inside):
            left_out[outside] = margins(one(inside), outside)
    ratio, weights = one(np.arange(len(y)))
    return ratio, weights, *logistic(left_out, y)


def _sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text"):
        found, offsets = indicators(texts_of(part.column("text")))
        values = pa.ListArray.from_arrays(offsets.astype(np.int32), pa.array(found))
        yield pa.RecordBatch.from_arrays([part.column("id"), part.column("label"), values], names=["id", "label", "features"])


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows, labels = [], []
    for batch in batches:
        ends = batch.column("features").offsets.to_numpy()
        flat = batch.column("features").values.to_numpy()
        rows += [flat[a:b].copy() for a, b in zip(ends, ends[1:])]
        labels += batch.column("label").to_pylist()
    ratio, weights, slope, offset = fit(rows, np.where(np.array(labels, int) > 0, 1, -1) if labels else np.zeros(0))
    yield pa.RecordBatch.from_arrays(
        [pa.array([ratio.astype("<f4").tobytes()]), pa.array([weights.astype("<f4").tobytes()]), pa.array([slope]), pa.array([offset])],
        names=["ratio", "weights", "slope", "offset"],
    )


def train(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str = "doc_id", text_col: str = "text", most: int = TRAINING_ROWS):
    """A model from the texts of labelled rows (1 or 0): its parts, a few megabytes whatever the input.

    About `most` labelled rows are used, chosen by the hash of their id, so they can be sent to where the texts are and fitted in one
    task. Null ids and labels, and ids with both labels, are left out; without rows of both classes all texts get the
    share of the one there is. The same rows give the same model.
    """
    storage.bound_batches(docs.sparkSession)
    given = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(
        F.min(label_col).alias("label"), F.max(label_col).alias("other")
    ).where("label = other").select("id", "label")
    share = max(1, -(-given.count() // most))
    chosen = F.broadcast(given.where(F.pmod(F.xxhash64("id"), F.lit(share)) == 0))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(chosen, "id")
    kind = dict(texts.dtypes)["id"]
    features = texts.select("id", F.col("label").cast("int").alias("label"), "text").mapInArrow(_sample_features, f"id {kind}, label int, features array<int>")
    # fitted on rows in a fixed order; AQE may read the shuffled rows of the sample in any
    alone = features.repartition(1).sortWithinPartitions("id", F.xxhash64("features"))
    row = alone.mapInArrow(_fitted, "ratio binary, weights binary, slope double, offset double").first()
    if row is None:  # Spark doesn't run a task over what it knows to be empty
        return fit([], np.zeros(0))
    return np.frombuffer(row.ratio, "<f4"), np.frombuffer(row.weights, "<f4"), row.slope, row.offset


def scores(texts: pa.Array, model) -> np.ndarray:
    ratio, weights, slope, offset = model
    found, offsets = indicators(texts)
    value = ratio[found].astype(np.float64)
    length = np.sqrt(np.add.reduceat(value * value, offsets[:-1]))
    margin = np.add.reduceat(value * weights[found], offsets[:-1]) / np.maximum(length, 1e-9)
    return 1 / (1 + np.exp(-np.clip(slope * margin + offset, -30, 30)))


def _scored(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            found = scores(texts_of(part.column("text")), sent.value)
            yield pa.RecordBatch.from_arrays([part.column("_id"), pa.array(found)], names=["_id", "score"])

    return run


def score(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score of every row: the probability of label 1 by its whole text. A null text is an empty one; repeated rows and null
    ids are kept; only the two named columns are read."""
    storage.bound_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_scored(sent), f"_id {dict(docs.dtypes)[id_col]}, score double").withColumnRenamed("_id", id_col)


def accept(docs: DataFrame, model, least: float, text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, whose text scores at least `least`."""
    storage.bound_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(column: pd.Series) -> pd.Series:
        batch = pa.RecordBatch.from_arrays([pa.Array.from_pandas(column, type=pa.string())], names=["text"])
        return pd.Series(np.concatenate([np.zeros(0), *(scores(texts_of(part.column("text")), sent.value) for part in slices([batch], "text"))]))

    return docs.where(scored(F.col(text_col).cast("string")) >= least)
