"""Toxicity by a learned lexicon whose terms are also found misspelled, with the words around a hit telling abuse from quotation.

Training takes the lexicon from labelled texts: words and stems (beginnings of words, written "stem*") whose log ratio of toxic
against other texts is high, and surer than the best of so many words would be by chance. A hit is a word within some edits of
a term, or with a beginning within some edits of a stem, more the longer the term. The terms form a trie; a set of (trie node, edits so far) is what a
Levenshtein automaton of the read letters and the trie share, and reading a letter gives the next set. Sets are numbered and their
transitions kept as they turn up, so the distinct words of a slice are read side by side, one letter of all of them at a time.

A hit scores its term's log ratio, less what hits with edits are worth less, plus the log ratios of the words around it and of standing
between quotation marks. Document features of these scores go through a logistic curve, fitted to the labelled texts as well.
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
from gridlytics.llm.text import coded, hashes_of, rows_of, slices, texts_of, words_of

#: Labelled rows that a model is fitted on at most, on average: those whose hashed id falls in the share that gives so many.
TRAINING_ROWS = 12_000
#: Terms of a model at most, the surest ones; a bound on what is broadcast.
TERMS = 20_000
LEAST_TEXTS, LEAST_RATIO = 3, 1.5
SHORTEST, LONGEST = 3, 30
STEMS = range(4, 11)
WINDOW = 5
BUCKETS = 1 << 14
QUOTE = "[\"'`\\x{ab}\\x{bb}\\x{2018}-\\x{201f}\\x{2039}\\x{203a}\\x{300c}\\x{300d}]"
#: States whose transitions are kept; beyond that they are found anew.
STATES = 60_000
FEATURES = 7


def edits_of(term: str) -> int:
    """How many edits a word may be away from a term, or its beginning from a stem."""
    if term.endswith("*"):
        return 0 if len(term) < 9 else 1
    return 0 if len(term) < 5 else 1 if len(term) < 10 else 2


class Lexicon:
    """Terms in order of their number, as a trie that is read together with Levenshtein automata."""

    def __init__(self, terms: list[str]):
        self.terms = terms
        self.children: list[dict[int, int]] = [{}]
        self.term, self.most = [-1], [0]
        bases = [t.removesuffix("*") for t in terms]
        self.stem = [t.endswith("*") for t in terms]
        letters = sorted({c for t in bases for c in t})
        self.letters = np.zeros(0x110000, np.int16)  # 0: in no term
        self.letters[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.edits = [edits_of(t) for t in terms]
        for number, term in enumerate(bases):
            node, most = 0, self.edits[number]
            self.most[0] = max(self.most[0], most)
            for c in self.letters[[ord(c) for c in term]].tolist():
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.term.append(-1)
                    self.most.append(0)
                node = self.children[node][c]
                self.most[node] = max(self.most[node], most)
            if self.term[node] < 0 or self.stem[number]:  # a stem stands for its word too
                self.term[node] = number
        self.longest = max((len(t) + e for t, e in zip(bases, self.edits)), default=0)
        self._forget()

    def _forget(self) -> None:
        self.numbers: dict[tuple, int] = {}
        self.sets: list[tuple] = []
        width = int(self.letters.max()) + 1
        self.next = np.full((1024, width), -1, np.int32)
        self.best = np.full((1024, 4), -1, np.int32)  # term and distance of a word that ends here, and of one that goes on
        self._number(())  # 0: nothing can match any more
        self.start = self._number(self._closed({0: 0}))

    def _closed(self, found: dict[int, int]) -> tuple:
        """With the nodes that are reached by letters of a term that the word lacks, and -1 - t for each stem t that has been read."""
        todo = [node for node in found if node >= 0]
        while todo:
            node = todo.pop()
            far = found[node] + 1
            for child in self.children[node].values():
                if far <= self.most[child] and far < found.get(child, 99):
                    found[child] = far
                    todo.append(child)
        for node, far in list(found.items()):
            term = self.term[node] if node >= 0 else -1
            if term >= 0 and self.stem[term] and far <= self.edits[term]:
                found[-1 - term] = min(far, found.get(-1 - term, 99))
        return tuple(sorted(found.items()))

    def _number(self, state: tuple) -> int:
        number = self.numbers.get(state)
        if number is None:
            number = self.numbers[state] = len(self.sets)
            self.sets.append(state)
            if number == len(self.next):
                self.next = np.concatenate([self.next, np.full_like(self.next, -1)])
                self.best = np.concatenate([self.best, np.full_like(self.best, -1)])
            terms = [(far, self.term[n] if n >= 0 else -1 - n) for n, far in state]
            ends = [(far, self.stem[t], t) for far, t in terms if t >= 0 and far <= self.edits[t]]
            for at, some in ((0, ends), (2, [x for x in ends if x[1]])):
                if some:
                    far, _, term = min(some)
                    self.best[number, at : at + 2] = term, far
        return number

    def _step(self, state: int, letter: int) -> int:
        found: dict[int, int] = {}
        for node, far in self.sets[state]:
            if node < 0:
                found[node] = min(far, found.get(node, 99))  # what follows a stem is free
                continue
            if far < self.most[node] and far + 1 < found.get(node, 99):
                found[node] = far + 1  # the word has a letter too many
            for c, child in self.children[node].items():
                new = far + (c != letter)
                if new <= self.most[child] and new < found.get(child, 99):
                    found[child] = new
        return self._number(self._closed(found))

    def find(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The nearest term of each word (of equal ones the first) and its distance; -1 where none is near enough."""
        term, far = np.full(len(words), -1, np.int32), np.full(len(words), -1, np.int32)
        lengths = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        rows = np.flatnonzero((lengths > 0) & ((lengths <= self.longest) | any(self.stem)))
        if not len(rows) or not self.terms:
            return term, far
        goes_on = lengths > self.longest  # a stem is found within so many letters
        if len(self.sets) > STATES:
            self._forget()
        rows = rows[np.argsort(-lengths[rows], kind="stable")]
        lengths = lengths[rows]
        lengths = np.minimum(lengths, self.longest)
        joined = "".join(pc.utf8_slice_codeunits(words.take(pa.array(rows)), 0, self.longest).to_numpy(zero_copy_only=False))
        letters = self.letters[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
        begins = np.cumsum(lengths) - lengths
        live, state = np.arange(len(rows)), np.full(len(rows), self.start, np.int32)

        def end(some: np.ndarray, states: np.ndarray) -> None:
            best = np.where(goes_on[rows[some], None], self.best[states, 2:], self.best[states, :2])
            term[rows[some]], far[rows[some]] = best.T

        for k in range(int(lengths[0])):
            ended = lengths[live] <= k
            if ended.any():
                end(live[ended], state[ended])
                live, state = live[~ended], state[~ended]
            letter = letters[begins[live] + k]
            after = self.next[state, letter]
            missing = np.flatnonzero(after < 0)
            if len(missing):
                for pair in np.unique(state[missing].astype(np.int64) << 16 | letter[missing]).tolist():
                    number = self._step(pair >> 16, pair & 0xFFFF)  # may move the table
                    self.next[pair >> 16, pair & 0xFFFF] = number
                after = self.next[state, letter]
            going = after > 0
            live, state = live[going], after[going]
            if not len(live):
                break
        end(live, state)
        return term, far


class Model:
    def __init__(self, terms, weights, shift, context, quoted, beta):
        self.lexicon, self.weights, self.shift, self.context, self.quoted, self.beta = Lexicon(terms), weights, shift, context, quoted, beta


def tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct lower-case words as they stand, the code of each word of the texts, and where each text's words begin."""
    words, offsets = words_of(pc.utf8_lower(texts))
    distinct, codes = coded(words)
    return distinct, codes, offsets


def bare(distinct: pa.Array) -> pa.Array:
    """Words without what is neither letter nor digit at their ends."""
    return pc.replace_substring_regex(distinct, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")


def hits_of(texts: pa.Array, lexicon: Lexicon) -> dict[str, np.ndarray]:
    """Of every hit its row, place among the row's words, term, distance, whether it is quoted, and the buckets of the words around it
    (-1 beyond the text); and every row's number of words."""
    distinct, codes, offsets = tokens(texts)
    words = bare(distinct)
    term, far = lexicon.find(words)
    at = np.flatnonzero(term[codes] >= 0)
    row = rows_of(offsets)[at]
    begin, end = offsets[row], offsets[row + 1]
    marks = {}
    for name, pattern in (("open", f"^[^\\p{{L}}\\p{{N}}]*{QUOTE}"), ("close", f"{QUOTE}[^\\p{{L}}\\p{{N}}]*$")):
        has = pc.match_substring_regex(distinct, pattern).to_numpy(zero_copy_only=False) if len(distinct) else np.zeros(0, bool)
        marks[name] = np.concatenate([[0], np.cumsum(has[codes])])
    opened = marks["open"][at + 1] - marks["open"][np.maximum(at - WINDOW, begin)] > 0
    closed = marks["close"][np.minimum(at + WINDOW + 1, end)] - marks["close"][at] > 0
    beside = at[:, None] + np.array([d for d in range(-WINDOW, WINDOW + 1) if d])[None, :]
    inside = (beside >= begin[:, None]) & (beside < end[:, None])
    around = np.full(beside.shape, -1, np.int64)
    if len(at):
        near = codes[beside[inside]]
        used, which = np.unique(near, return_inverse=True)
        around[inside] = (hashes_of(words.take(pa.array(used))) % np.uint64(BUCKETS)).astype(np.int64)[which]
    return {
        "row": row, "place": at - begin, "term": term[codes[at]], "far": far[codes[at]], "quoted": opened & closed, "around": around,
        "n_words": np.diff(offsets), "word": words.take(pa.array(codes[at])),
    }


def hit_scores(found: dict[str, np.ndarray], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Of each hit its score, and the part of it that its surroundings give."""
    near = np.where(found["around"] >= 0, model.context[found["around"]], 0.0).sum(axis=1)
    context = np.clip(near, -3, 3) + model.quoted[found["quoted"].astype(int)]
    return model.weights[found["term"]] + model.shift[found["far"]] + context, context


def document_features(found: dict[str, np.ndarray], score: np.ndarray, n: int) -> np.ndarray:
    row = found["row"]
    sure = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
    total = np.bincount(row, weights=sure, minlength=n)
    exact = np.bincount(row[found["far"] == 0], minlength=n)
    other = np.bincount(row[found["far"] > 0], minlength=n)
    quoted = np.bincount(row[found["quoted"]], minlength=n)
    best = np.full(n, 0.0)
    np.maximum.at(best, row, np.clip(score, 0, 12))
    words = np.maximum(found["n_words"], 1)
    out = np.stack([np.ones(n), best / 4, np.log1p(total), np.log1p(100 * total / words), np.log1p(exact), np.log1p(other), np.log1p(quoted)], 1)
    assert out.shape[1] == FEATURES
    return out


def _labelled_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text"):
        distinct, codes, offsets = tokens(texts_of(part.column("text")))
        row, label = rows_of(offsets), part.column("label").to_numpy(zero_copy_only=False)
        words = bare(distinct)
        length = pc.utf8_length(words).to_numpy(zero_copy_only=False)
        for size in (None, *STEMS):
            terms, which = coded(words if size is None else pc.utf8_slice_codeunits(words, 0, size))
            n = max(len(terms), 1)
            pairs = row * n + which[codes]
            pairs = np.unique(pairs if size is None else pairs[(length >= size)[codes]])  # a word once a text
            toxic = np.bincount(pairs % n, weights=label[pairs // n], minlength=n)[: len(terms)].astype(np.int64)
            texts = np.bincount(pairs % n, minlength=n)[: len(terms)].astype(np.int64)
            there = np.flatnonzero(texts)
            found = terms.take(pa.array(there)).cast(pa.string())
            if size is not None:
                found = pc.binary_join_element_wise(found, pa.scalar("*"), pa.scalar(""))
            yield pa.RecordBatch.from_arrays([found, pa.array(toxic[there]), pa.array((texts - toxic)[there])], names=["word", "toxic", "other"])


def _contexts(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows: buckets of words around, then 2 of quoted or not, then 3 of distances
        counts = np.zeros((BUCKETS + 5, 2), np.int64)
        for part in slices(batches, "text"):
            found = hits_of(texts_of(part.column("text")), sent.value)
            label = part.column("label").to_numpy(zero_copy_only=False).astype(np.int64)[found["row"]]
            inside = found["around"] >= 0
            np.add.at(counts, (found["around"][inside], np.repeat(label, inside.sum(axis=1))), 1)
            np.add.at(counts, (BUCKETS + found["quoted"], label), 1)
            np.add.at(counts, (BUCKETS + 2 + found["far"], label), 1)
        full = np.flatnonzero(counts.sum(axis=1))
        columns = [full.astype(np.int32), counts[full, 1], counts[full, 0]]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["bucket", "toxic", "other"])

    return run


def _features(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            found = hits_of(texts_of(part.column("text")), sent.value.lexicon)
            values = document_features(found, hit_scores(found, sent.value)[0], part.num_rows)
            lists = pa.ListArray.from_arrays(np.arange(0, values.size + 1, FEATURES, dtype=np.int32), pa.array(values.ravel()))
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("label"), lists], names=["id", "label", "features"])

    return run


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.3) -> np.ndarray:
    """Coefficients of a logistic curve by Newton's method, with a ridge on all but the first."""
    beta, pull = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    pull[0, 0] = 1e-3
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + pull, x.T @ (y - p) - pull @ beta)
        beta = beta + np.clip(step, -3, 3)
        if abs(step).max() < 1e-8:
            break
    return beta


def ratio(toxic: np.ndarray, other: np.ndarray, all_toxic: float, all_other: float, prior: float) -> np.ndarray:
    """Log ratio of two shares, each smoothed with `prior` texts of the mean of both."""
    mean = (toxic + other + 0.5) / (all_toxic + all_other + 1)
    return np.log((toxic + prior * mean) / (all_toxic + prior)) - np.log((other + prior * mean) / (all_other + prior))


def chosen_terms(candidates: list[tuple[str, float, float]]) -> list[tuple[str, float]]:
    """Of words and stems that hold one another the surest: a whole word before its stems, a long stem before a short one."""
    taken, stems, begun = [], set(), set()
    for term, weight, _ in sorted(candidates, key=lambda x: (-round(x[2], 9), x[0].endswith("*"), -len(x[0]), x[0])):
        base = term.removesuffix("*")
        if any(base[:k] in stems for k in range(1, len(base) + 1)) or term.endswith("*") and base in begun:
            continue
        taken.append((term, weight))
        begun.update(base[:k] for k in range(1, len(base) + 1))
        if term.endswith("*"):
            stems.add(base)
    return sorted(taken)


def train(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str = "doc_id", text_col: str = "text", most: int = TRAINING_ROWS) -> Model:
    """A model from the texts of labelled rows (1: toxic, or 0).

    About `most` labelled rows are used, chosen by the hash of their id, with their whole texts. Null ids and labels, and ids with both
    labels, are left out. With one class, or without a sure term, all texts get the share of class 1, smoothed. The same rows
    give the same model.
    """
    spark = docs.sparkSession
    storage.bound_batches(spark)
    given = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(
        F.min(label_col).cast("int").alias("label"), F.max(label_col).cast("int").alias("other")
    ).where("label = other").select("id", "label")
    share = max(1, -(-given.count() // most))
    chosen = F.broadcast(given.where(F.pmod(F.xxhash64("id"), F.lit(share)) == 0))
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(chosen, "id")
    texts = storage.staged(found.select("id", "label", "text"), "toxicity")
    size = dict(texts.groupBy("label").count().collect())
    n_toxic, n_other = size.get(1, 0), size.get(0, 0)
    base = np.log((n_toxic + 1) / (n_other + 1))
    plain = Model([], np.zeros(0), np.zeros(3), np.zeros(BUCKETS), np.zeros(2), np.array([base] + [0.0] * (FEATURES - 1)))
    if not n_toxic or not n_other:
        return plain

    counted = texts.select("label", "text").mapInArrow(_labelled_words, "word string, toxic long, other long")
    counted = counted.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    n_words = counted.where(F.col("toxic") + F.col("other") >= LEAST_TEXTS).count()
    log_ratio = F.log((F.col("toxic") + 0.5) / (n_toxic + 1)) - F.log((F.col("other") + 0.5) / (n_other + 1))
    share, texts_with = n_toxic / (n_toxic + n_other), F.col("toxic") + F.col("other")
    # Chernoff's bound on the chance of so many toxic texts among those with the word
    sure = F.col("toxic") * F.log(F.col("toxic") / texts_with / share)
    sure = sure + F.when(F.col("other") > 0, F.col("other") * F.log(F.col("other") / texts_with / (1 - share))).otherwise(0.0)
    terms = counted.where((F.col("toxic") >= LEAST_TEXTS) & F.length("word").between(SHORTEST, LONGEST) & F.col("word").rlike(r"\p{L}"))
    terms = terms.select("word", log_ratio.alias("weight"), sure.alias("sure"))
    terms = terms.where((F.col("weight") >= LEAST_RATIO) & (F.col("sure") >= max(float(np.log(max(n_words, 1))), 1.0)))
    rows = chosen_terms([(r.word, r.weight, r.sure) for r in terms.orderBy(F.desc("sure"), "word").limit(TERMS).collect()])
    if not rows:
        return plain

    words, weights = [r[0] for r in rows], np.array([r[1] for r in rows])
    sent = spark.sparkContext.broadcast(Lexicon(words))
    counts = np.zeros((BUCKETS + 5, 2))
    around = texts.select("label", "text").mapInArrow(_contexts(sent), "bucket int, toxic long, other long")
    for bucket, toxic, other in around.groupBy("bucket").agg(F.sum("toxic"), F.sum("other")).collect():
        counts[bucket] = toxic, other
    hits, sides = counts[BUCKETS : BUCKETS + 2].sum(axis=0), counts[:BUCKETS].sum(axis=0)
    context = ratio(counts[:BUCKETS, 0], counts[:BUCKETS, 1], *sides, prior=float(BUCKETS))
    quoted = ratio(counts[BUCKETS : BUCKETS + 2, 0], counts[BUCKETS : BUCKETS + 2, 1], *hits, prior=5.0)
    by_distance = ratio(counts[BUCKETS + 2 :, 0], counts[BUCKETS + 2 :, 1], *hits, prior=5.0)
    model = Model(words, weights, np.minimum(by_distance - by_distance[0], 0.0), context, quoted, plain.beta)

    sent = spark.sparkContext.broadcast(model)
    kind = dict(texts.dtypes)["id"]
    fitted = texts.mapInArrow(_features(sent), f"id {kind}, label int, features array<double>").orderBy("id", "features").collect()
    model.beta = logistic(np.array([r.features for r in fitted]), np.array([r.label for r in fitted], float))
    return model


def scores(texts: pa.Array, model: Model) -> tuple[np.ndarray, dict, np.ndarray]:
    found = hits_of(texts, model.lexicon)
    hit, _ = hit_scores(found, model)
    linear = document_features(found, hit, len(texts)) @ model.beta
    return 1 / (1 + np.exp(-np.clip(linear, -30, 30))), found, hit


def _scored(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            score, found, hit = scores(texts_of(part.column("text")), sent.value)
            n = part.num_rows
            row = found["row"]
            order = np.lexsort((found["place"], -hit, row))
            worst: list[str | None] = [None] * n
            for k in order[np.unique(row[order], return_index=True)[1]].tolist():
                worst[row[k]] = sent.value.lexicon.terms[found["term"][k]]
            counts = [np.bincount(row[mask], minlength=n).astype(np.int64) for mask in (row >= 0, found["far"] > 0, found["quoted"])]
            yield pa.RecordBatch.from_arrays(
                [part.column("_id"), pa.array(score), *map(pa.array, counts), pa.array(worst, pa.string())],
                names=["_id", "score", "n_hits", "n_misspelled", "n_quoted", "worst_term"],
            )

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's id, score (the probability of label 1 by its whole text), hits, hits with edits, quoted hits, and the term of its
    highest hit (null without hits). A null text is an empty one and scores as texts without hits do; repeated rows and null
    ids are kept; only the two named columns are read; an empty table gives no rows."""
    storage.bound_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text"))
    columns = f"_id {dict(docs.dtypes)[id_col]}, score double, n_hits long, n_misspelled long, n_quoted long, worst_term string"
    return rows.mapInArrow(_scored(sent), columns).withColumnRenamed("_id", id_col)


def _listed(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            found = hits_of(texts_of(part.column("text")), sent.value.lexicon)
            hit, context = hit_scores(found, sent.value)
            terms = pd.Series(sent.value.lexicon.terms, dtype=object)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("_id").take(pa.array(found["row"])), pa.array(found["place"].astype(np.int64)), found["word"].cast(pa.string()),
                    pa.array(terms.iloc[found["term"]].tolist(), pa.string()), pa.array(found["far"]), pa.array(found["quoted"]),
                    pa.array(context), pa.array(hit),
                ],
                names=["_id", "place", "word", "term", "edits", "quoted", "context", "score"],
            )

    return run


def hits(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every hit: the row's id, its place among the row's words (from 0), the word, the term it is near, the edits between them, whether
    it is quoted, what its surroundings add, and its score. Rows without hits have none."""
    storage.bound_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text"))
    columns = "place long, word string, term string, edits int, quoted boolean, context double, score double"
    return rows.mapInArrow(_listed(sent), f"_id {dict(docs.dtypes)[id_col]}, {columns}").withColumnRenamed("_id", id_col)
