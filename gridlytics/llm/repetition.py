"""Repetition rules: characters inside duplicated n-grams and lines, from rolling hashes of several lengths."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlytics.llm import storage
from gridlytics.llm.text import coded, flat, hashes_of, mixed, rows_of, slices, sums, texts_of, words_of

# Published repetition limits for web text, shares of a text's characters (of its lines for the first).
DUP_LINES = 0.30
DUP_LINE_CHARS = 0.20
TOP_NGRAM = {2: 0.20, 3: 0.18, 4: 0.16}
DUP_NGRAM = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
LEAST_TOP = 4  # a most frequent n-gram counts as repetition from so many occurrences on; short clean texts repeat a pair twice

BASE = np.uint64(0x9E3779B97F4A7C15)
SYMBOLS = np.zeros(256, np.int64)
SYMBOLS[list(b"#*$%&|<>")] = 1

SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, dup_line_chars long, "
    + ", ".join(f"top_{n} long" for n in TOP_NGRAM) + ", " + ", ".join(f"dup_{n} long" for n in DUP_NGRAM)
)


def _repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which keys occur twice or more; the first position and the count of each distinct key that does."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(keys) else np.zeros(0, np.int64)
    counts = np.diff(np.append(first, len(keys)))
    many = counts > 1
    twice = np.zeros(len(keys), bool)
    twice[order[np.repeat(many, counts)]] = True
    return twice, order[first[many]], counts[many]


def signals(texts: pa.Array) -> dict[str, np.ndarray]:
    """Counts per text. Windows are hashed by rolling the word hashes, one word longer each step; a window can only be
    repeated where its shorter prefix is, so each length looks at what the one before has left."""
    n, out = len(texts), {}
    words, offsets = words_of(texts)
    distinct, codes = coded(words)
    lengths = pc.utf8_length(distinct).to_numpy(zero_copy_only=False).astype(np.int64)[codes]
    out["n_words"], out["word_chars"] = np.diff(offsets), sums(lengths, offsets)

    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    bytes_at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    out["n_symbols"] = sums(SYMBOLS[data[bytes_at[0] : bytes_at[-1]]], bytes_at - bytes_at[0])

    lines, line_offsets = flat(pc.split_pattern(texts, "\n"))
    full = pc.greater(pc.binary_length(pc.ascii_trim_whitespace(lines)), 0).to_numpy(zero_copy_only=False)
    line_row, line_code = rows_of(line_offsets), coded(lines)[1]
    line_chars = pc.utf8_length(lines).to_numpy(zero_copy_only=False).astype(np.int64)
    key = line_row * (len(lines) + 1) + line_code
    _, first = np.unique(key, return_index=True)
    later = full.copy()
    later[first] = False
    out["n_lines"], out["n_dup_lines"] = sums(full, line_offsets), sums(later, line_offsets)
    out["dup_line_chars"] = sums(line_chars * later, line_offsets)

    row = rows_of(offsets)
    word = mixed(hashes_of(distinct))[codes]
    ends = offsets[1:][row]
    chars_to = np.concatenate([[0], np.cumsum(lengths)])
    at, rolling = np.arange(len(codes)), word ^ mixed(row.astype(np.uint64) + np.uint64(1))
    with np.errstate(over="ignore"):
        for size in range(2, max(DUP_NGRAM) + 1):
            inside = at + size <= ends[at]
            at, rolling = at[inside], rolling[inside]
            rolling = rolling * BASE + word[at + size - 1]
            twice, firsts, counts = _repeated(rolling)
            if size in TOP_NGRAM:
                best = np.zeros(n, np.int64)
                often = counts >= LEAST_TOP
                begin = at[firsts[often]]
                np.maximum.at(best, row[begin], counts[often] * (chars_to[begin + size] - chars_to[begin]))
                out[f"top_{size}"] = best
            at, rolling = at[twice], rolling[twice]
            if size in DUP_NGRAM:
                cover = np.zeros(len(codes) + 1, np.int64)
                np.add.at(cover, at, 1)
                np.add.at(cover, at + size, -1)
                covered = np.cumsum(cover[:-1]) > 0
                out[f"dup_{size}"] = sums(lengths * covered, offsets)
                if size == 5:
                    out["n_repeat_words"] = sums(covered, offsets)
    return out


def _measure(id_name: str, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            found = signals(texts_of(part.column("text")))
            yield pa.RecordBatch.from_arrays(
                [part.column(id_name), *[pa.array(found[x].astype(np.int64)) for x in names]], names=[id_name, *names]
            )

    return run


def repetition_signals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the counts of `SCHEMA`. Whole texts, in slices of bounded size, without a shuffle.

    A null text counts as empty and gives zeros; repeated rows and null ids are kept as they are; an empty table gives
    an empty result. Columns other than the two named are not read, so clashing names don't matter.
    """
    storage.bound_batches(docs.sparkSession)
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        _measure("_id", names), f"_id {kind}, {SCHEMA}"
    ).withColumnRenamed("_id", id_col)


def repetition_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The signals with the verdicts: `base_failed` (too short, or too many words in repeated 5-word windows) and `kept`.

    A text is kept if it passes the base rule and no share of its characters inside duplicated lines or n-grams is over
    its limit. A text without a word fails the base rule.
    """
    out = repetition_signals(docs, id_col, text_col)
    share = lambda name: F.col(name) / F.greatest(F.col("word_chars"), F.lit(1))
    over = (F.col("n_dup_lines") > DUP_LINES * F.col("n_lines")) | (share("dup_line_chars") > DUP_LINE_CHARS)
    for n, most in TOP_NGRAM.items():
        over = over | (share(f"top_{n}") > most)
    for n, most in DUP_NGRAM.items():
        over = over | (share(f"dup_{n}") > most)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & ~over)
