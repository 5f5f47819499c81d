"""Benchmark decontamination: every passage of every text queries a BM25 index of the test items.

The index holds impacts (an item's BM25 weight of a term, as a share of what the item scores against itself), in lists by item, with
the largest impact of each term in each range of items. A passage can reach the threshold in a range only if these sum to
it; ranges that can't are skipped, and in the others block-max WAND walks the lists to all items at or above the threshold.
What it finds counts if enough of the item's question and of its answer is there, word for word.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlytics.llm import storage
from gridlytics.llm.text import coded, hashes_of, slices, texts_of, words_of

# The usual BM25 parameters.
K1, B = 1.2, 0.75

LEAST_SCORE = 0.5
LEAST_QUESTION, LEAST_ANSWER = 0.6, 0.5
GRAM = 3
RANGES = 64
CHUNK = 1 << 17
#: Text of test items that one index holds at most; more items make more indexes, each sent to the tasks in turn, with the same scores.
INDEX_BYTES = 16 << 20

OUT = "item_id long, score double, question_overlap double, answer_overlap double, n_passages long"


def normal(words: pa.Array) -> pa.Array:
    """Lower case, letters and digits only; may be empty."""
    return pc.replace_substring_regex(pc.utf8_lower(words), r"[^\p{L}\p{N}]+", "")


def terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts that have a letter or digit, and where each text's begin."""
    words, offsets = words_of(texts)
    distinct, codes = coded(words)
    plain = normal(distinct)
    full = pc.greater(pc.binary_length(plain), 0).to_numpy(zero_copy_only=False)
    keep = full[codes]
    return hashes_of(plain)[codes[keep]], np.concatenate([[0], np.cumsum(keep)])[offsets]


def halves(text: str) -> tuple[str, str]:
    """Question and answer: the last sentence or line is the answer if there are several, else the last quarter of the words."""
    parts = [x for x in re.split(r"(?<=[.!?])\s+|\n+", text.strip()) if x.strip()]
    if len(parts) > 1:
        return " ".join(parts[:-1]), parts[-1]
    words = text.split()
    cut = max(1, len(words) - len(words) // 4)
    return " ".join(words[:cut]), " ".join(words[cut:])


class Index:
    """Items of similar length: terms, lists of items and impacts by term, and the largest impacts by range of items.

    Where these are not all the items of that length, `of_all` has the number and mean length of all of them and how many hold each
    term, so that an item's impacts are the same in any index."""

    def __init__(self, ids: list[int], words: list[np.ndarray], questions: list[np.ndarray], answers: list[np.ndarray], of_all=None):
        n = len(ids)
        self.ids, self.questions, self.answers = ids, questions, answers
        self.longest = max(map(len, words))
        flat, item = np.concatenate(words), np.repeat(np.arange(n), [len(w) for w in words])
        self.terms, code = np.unique(flat, return_inverse=True)
        pair, count = np.unique(code.astype(np.int64) * n + item, return_counts=True)
        term, item = pair // n, pair % n
        frequency = np.bincount(term, minlength=len(self.terms))
        sizes = np.array([len(w) for w in words])
        total, mean = n, sizes.mean()
        if of_all is not None:
            total, mean, holders = of_all
            frequency = np.array([holders[t] for t in self.terms.tolist()])
        idf = np.log(1 + (total - frequency + 0.5) / (frequency + 0.5))
        impact = idf[term] * count * (K1 + 1) / (count + K1 * (1 - B + B * sizes[item] / mean))
        impact = impact / np.bincount(item, impact, n)[item]
        begins = np.searchsorted(term, np.arange(len(self.terms) + 1))
        self.items = [item[a:b].tolist() for a, b in zip(begins, begins[1:])]
        self.impacts = [impact[a:b].tolist() for a, b in zip(begins, begins[1:])]
        self.width = max(1, -(-n // RANGES))
        self.most = np.zeros((len(self.terms) + 1, -(-n // self.width)), np.float32)
        np.maximum.at(self.most, (term, item // self.width), impact.astype(np.float32))
        self.most *= 1 + 1e-6  # a bound stays one when it is rounded

    def wand(self, query: list[int], block: int, least: float) -> list[tuple[int, float]]:
        """Items of a range that score `least` or more for a query of distinct terms: the lists are walked together, and an
        item is only scored if the largest impacts of the lists that reach it add up to enough."""
        first, last = block * self.width, (block + 1) * self.width
        lists = []
        for t in query:
            at, end = bisect_left(self.items[t], first), bisect_left(self.items[t], last)
            if at < end:
                lists.append([self.items[t][at], at, end, t, float(self.most[t, block])])
        found = []
        while lists:
            lists.sort()
            bound, pivot = 0.0, None
            for k, entry in enumerate(lists):
                bound += entry[4]
                if bound >= least:
                    pivot = k
                    break
            if pivot is None:
                break
            item = lists[pivot][0]
            if lists[0][0] == item:
                score = sum(self.impacts[x[3]][x[1]] for x in lists if x[0] == item)
                if score >= least:
                    found.append((item, score))
                behind = item + 1
            else:
                behind = item
            for entry in lists:
                if entry[0] < behind:
                    entry[1] = bisect_left(self.items[entry[3]], behind, entry[1], entry[2])
                    entry[0] = self.items[entry[3]][entry[1]] if entry[1] < entry[2] else last
            lists = [x for x in lists if x[0] < last]
        return found

    def passages(self, words: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, begin and end of windows of twice the longest item, half overlapping: an item lies whole in one of them."""
        step, counts = self.longest, np.diff(offsets)
        windows = np.where(counts > 0, np.maximum(1, -(-counts // step) - 1), 0)
        text = np.repeat(np.arange(len(counts)), windows)
        k = np.arange(len(text)) - np.repeat(np.cumsum(windows) - windows, windows)
        begin = offsets[:-1][text] + k * step
        return text, begin, np.minimum(begin + 2 * step, offsets[1:][text])

    def search(self, words: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, float, int, int]]:
        """(text, item, score, begin, end) of all passages and items at the threshold."""
        place = np.searchsorted(self.terms, words)
        place[place == len(self.terms)] = 0
        known = self.terms[place] == words
        before = np.concatenate([[0], np.cumsum(known)])
        place = place[known]
        text, begin, end = self.passages(words, offsets)
        lo, hi = before[begin], before[end]
        sizes = hi - lo
        chunk = np.cumsum(sizes) // CHUNK
        for a, b in zip(np.searchsorted(chunk, np.unique(chunk)), [*np.searchsorted(chunk, np.unique(chunk))[1:], len(chunk)]):
            count = sizes[a:b]
            if not count.sum():
                continue
            row = np.repeat(np.arange(b - a), count)
            at = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo[a:b], count)
            pair = np.unique(row * np.int64(len(self.terms)) + place[at])
            row, term = pair // len(self.terms), pair % len(self.terms)
            full, starts = np.unique(row, return_index=True)
            bounds = np.add.reduceat(self.most[term], starts, axis=0)
            ends = np.append(starts[1:], len(row))
            for k, block in zip(*np.nonzero(bounds >= LEAST_SCORE)):
                p = a + int(full[k])
                for item, score in self.wand(term[starts[k] : ends[k]].tolist(), int(block), LEAST_SCORE):
                    yield int(text[p]), item, score, int(begin[p]), int(end[p])


def grams(words: np.ndarray) -> list[bytes]:
    size = min(GRAM, len(words))
    return [words[k : k + size].tobytes() for k in range(len(words) - size + 1)] if size else []


def overlap(part: np.ndarray, passage: np.ndarray) -> float:
    """The share of a part's word n-grams that the passage has; 1 for a part without words."""
    wanted = grams(part)
    if not wanted:
        return 1.0
    size = min(GRAM, len(part))
    there = {passage[k : k + size].tobytes() for k in range(len(passage) - size + 1)}
    return sum(x in there for x in wanted) / len(wanted)


def length_class(n: int) -> int:
    """1 to 64 words, to 128, and so on."""
    return max(6, math.ceil(math.log2(n)))


def built(items: list[tuple[int, str]], of_all: dict | None = None) -> list[Index]:
    """Indexes of items by length. Items without a word are in none. `of_all`: by length, what `Index` takes."""
    by_length: dict[int, list] = {}
    for item_id, text in items:
        question, answer = halves(text)
        words, q, a = (terms(pa.array([x], pa.large_string()))[0] for x in (text, question, answer))
        if len(words):
            by_length.setdefault(length_class(len(words)), []).append((item_id, words, q, a))
    return [Index(*map(list, zip(*rows)), None if of_all is None else of_all[k]) for k, rows in sorted(by_length.items())]


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text"):
        words, offsets = terms(texts_of(part.column("text")))
        for k, (a, b) in enumerate(zip(offsets, offsets[1:])):
            if b > a:
                distinct = np.unique(words[a:b]).view(np.int64)
                columns = [pa.array(np.full(len(distinct), x)) for x in (part.column("block")[k].as_py(), length_class(int(b - a)), int(b - a))]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(np.arange(len(distinct)) == 0), pa.array(distinct)], names=["block", "class", "words", "first", "term"]
                )


def _statistics(items: DataFrame) -> Iterator[dict]:
    """For each block of items, by length: how many items of all blocks there are, their mean length, and how many hold each term of the
    block."""
    found = storage.staged(items.select("block", "text").mapInArrow(_item_terms, "block long, class long, words long, first boolean, term long"), "terms")
    sizes = {r[0]: (r[1], r[2]) for r in found.where("first").groupBy("class").agg(F.count(F.lit(1)), F.avg("words")).collect()}
    holders = storage.staged(found.groupBy("class", "term").agg(F.count(F.lit(1)).alias("n")), "holders")
    for k in range(items.agg(F.max("block")).first()[0] + 1):
        own = found.where(F.col("block") == k).select("class", "term").distinct()
        out = {length: (*size, {}) for length, size in sizes.items()}
        for length, term, n in holders.join(own, ["class", "term"]).select("class", "term", "n").collect():
            out[length][2][term % (1 << 64)] = n
        yield out


def _hits(indexes: list[Index], part: pa.RecordBatch) -> dict[tuple[int, int], list]:
    """By text and item: score, overlaps, and the number of passages that are verified."""
    words, offsets = terms(texts_of(part.column("text")))
    found: dict[tuple[int, int], list] = {}
    for index in indexes:
        for text, item, score, begin, end in index.search(words, offsets):
            passage = words[begin:end]
            question = overlap(index.questions[item], passage)
            if question < LEAST_QUESTION:
                continue
            answer = overlap(index.answers[item], passage)
            if answer >= LEAST_ANSWER:
                best = found.setdefault((text, index.ids[item]), [0.0, 0.0, 0.0, 0])
                best[:] = [max(best[0], score), max(best[1], question), max(best[2], answer), best[3] + 1]
    return found


def _matched(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            found = sorted(_hits(sent.value, part).items())
            if found:
                rows = pa.array([text for (text, _), _ in found])
                columns = [pa.array([item for (_, item), _ in found], pa.int64())]
                columns += [pa.array([values[k] for _, values in found], pa.int64() if k == 3 else pa.float64()) for k in range(4)]
                yield pa.RecordBatch.from_arrays([part.column("_id").take(rows), *columns], names=["_id", *(x.split()[0] for x in OUT.split(", "))])

    return run


def index_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text"):
    """Broadcast indexes, each of about `INDEX_BYTES` of items at most, of all items with an id and a text. How common a term is and how
    long items are is counted over all items, so scores don't depend on the number of indexes."""
    storage.bound_batches(benchmark.sparkSession)
    items = benchmark.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")
    ).distinct()
    blocks = max(1, -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // INDEX_BYTES))
    items = items.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)))
    for k, of_all in enumerate([None] if blocks == 1 else _statistics(items)):
        rows = items.where(F.col("block") == k).collect()
        yield benchmark.sparkSession.sparkContext.broadcast(built(sorted((r.id, r.text) for r in rows), of_all))


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document and test item that it holds: id, item_id, score, overlaps, and the passages that hold it.

    Whole texts; documents without a leak have no row. Null texts have no words; items without an id, a text or a word match nothing;
    repeated documents are reported each, repeated items once; an empty table on either side gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text"))
    out = None
    for sent in index_blocks(benchmark):
        part = rows.mapInArrow(_matched(sent), f"_id {dict(docs.dtypes)[id_col]}, {OUT}")
        out = part if out is None else out.union(part)
    return out.withColumnRenamed("_id", id_col)


def without_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, whose text holds no test item. Null texts stay."""
    for sent in index_blocks(benchmark):
        docs = docs.where(~_holds(sent)(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    return docs


def _holds(sent):
    @F.pandas_udf("boolean")
    def holds(column: pd.Series) -> pd.Series:
        out, at = np.zeros(len(column), bool), 0
        batch = pa.RecordBatch.from_arrays([pa.Array.from_pandas(column, type=pa.string())], names=["text"])
        for part in slices([batch], "text"):
            for text, _ in _hits(sent.value, part):
                out[at + text] = True
            at += part.num_rows
        return pd.Series(out)

    return holds
