"""Near duplicates, components and benchmark decontamination against brute force."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from gridlytics.llm import decontam, minhash, queries
from gridlytics.llm.components import components
from tests.llm.cases import EDGE, documents, edge, empty


def sets_of(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    if len(words) < size:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[k : k + size]) for k in range(len(words) - size + 1))


def brute_groups(rows, size, threshold=80):
    """(doc_id, n_shingles, component) of rows with distinct ids, every pair compared."""
    sets = {doc_id: sets_of(text, size) for doc_id, text in rows}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by_shingle = {}
    for d, s in sets.items():
        for x in s:
            by_shingle.setdefault(x, []).append(d)
    near = {(a, b) for ds in by_shingle.values() if len(ds) < 200 for a in ds for b in ds if a < b}
    for a, b in near:
        common = len(sets[a] & sets[b])
        if 100 * common >= threshold * (len(sets[a]) + len(sets[b]) - common):
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    return {(d, len(s), root(d)) for d, s in sets.items()}


@pytest.mark.parametrize("size", [2, 5])
def test_groups_agree_with_brute_force(spark, sf_dir, size):
    docs = documents(spark, sf_dir.replace("sf0.001", "sf0.01"))
    rows = minhash.near_duplicates(docs, size=size).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in rows} == brute_groups([(r.doc_id, r.text) for r in docs.collect()], size)
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def chains(seed):
    """Chains of texts of which neighbours are similar and ends are not, groups of near copies, and exact copies."""
    draw, rows, n = random.Random(seed), [], 0
    word = lambda: f"w{draw.randrange(100_000)}"
    for _ in range(6):
        text = [word() for _ in range(60)]
        for _ in range(12):
            rows.append((n, " ".join(text)))
            n += 1
            text = list(text)
            text[draw.randrange(60)] = word()
            text[draw.randrange(60)] = word()
    for share in (0.02, 0.05, 0.08):
        base = [word() for _ in range(100)]
        for _ in range(40):
            rows.append((n, " ".join(word() if draw.random() < share else w for w in base)))
            n += 1
    rows += [(n + k, "Twice the same text as before") for k in range(30)]
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, block", [(1, 512), (2, 7)])
def test_chains_and_large_groups(spark, monkeypatch, seed, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "WIDTH", 8 * block)
    rows = chains(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    found = {(r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs, size=2).collect()}
    assert found == brute_groups(rows, 2)


def test_near_duplicate_edge_rows(spark):
    rows = minhash.near_duplicates(edge(spark), size=2).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r[0] for r in EDGE)
    found = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert [found[k].component_id for k in (1, 7, -5)] == [-5, -5, -5]
    assert all(found[k].n_shingles == 0 and found[k].kept for k in (2, 3, 4)) and found[5].n_shingles == 1
    assert all(r.component_id is None and r.kept for r in rows if r.doc_id is None)
    assert minhash.near_duplicates(empty(spark)).count() == 0
    left = minhash.without_near_duplicates(edge(spark)).collect()
    assert Counter(r.doc_id for r in left) == Counter([-5, 2, 3, 4, 5, 6, 8, 9, None, None])
    assert minhash.without_near_duplicates(edge(spark)).columns == edge(spark).columns


def test_rows_of_one_id_are_one_document(spark):
    rows = [(5, "a b c d e f"), (5, "k l m n o p"), (3, "k l m n o p"), (4, "a b c d e f"), (9, "q r s t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in minhash.near_duplicates(docs, size=2).collect()} == {(5, 3), (3, 3), (4, 3), (9, 9)}


def test_estimate_is_corrected_for_chance(spark):
    draw = np.random.default_rng(3)
    for common in (0, 50, 90, 99):
        both, rest = draw.integers(0, 1 << 62, common * 8), lambda: draw.integers(0, 1 << 62, (100 - common) * 4)
        sets = [np.unique(np.concatenate([both, rest()])).astype(np.uint64) for _ in range(2)]
        low = [minhash.packed(minhash.minima(s, np.array([0, len(s)])))[0].view(np.int64).tolist() for s in sets]
        real = len(np.intersect1d(*sets)) / len(np.union1d(*sets))
        row = spark.createDataFrame([(low[0], low[1])], "x array<long>, y array<long>")
        found = row.select(minhash.similarity(row.x, row.y).alias("s")).first().s
        assert abs(found - real) < 0.2


def test_components(spark):
    draw = random.Random(1)
    edges = [(draw.randrange(400), draw.randrange(400)) for _ in range(250)] + [(k, k + 1) for k in range(1000, 1100)] + [(5000, 5000)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    expected = {(x, root(x)) for e in edges if e[0] != e[1] for x in e}
    found = components(spark.createDataFrame([*edges, (None, 1)], "a long, b long")).collect()
    assert {(r.node, r.label) for r in found} == expected and len(found) == len(expected)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain(text):
    return [w for w in (re.sub(r"[\W_]+", "", w.lower()) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")) if w]


def brute_leaks(docs, items):
    """Pairs of which the document has all of the item's words in a row."""
    out = set()
    for doc_id, text in docs:
        joined = " " + " ".join(plain(text)) + " "
        out |= {(doc_id, item_id) for item_id, item in items if plain(item) and f" {' '.join(plain(item))} " in joined}
    return out


def test_leaks_agree_with_brute_force(spark, sf_dir):
    sf = sf_dir.replace("sf0.001", "sf0.01")
    found = queries.op10_decontamination(spark, sf).collect()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    expected = brute_leaks([(r.doc_id, r.text) for r in documents(spark, sf).collect()], items)
    assert expected and {(r.doc_id, r.item_id) for r in found} == expected
    assert all(r.score >= decontam.LEAST_SCORE and r.question_overlap >= 0.6 and r.answer_overlap >= 0.5 for r in found)


def test_search_finds_all_that_score_enough():
    draw = random.Random(6)
    words = [f"t{int(draw.paretovariate(0.8))}" for _ in range(4000)]
    items = [(k, " ".join(draw.choices(words, k=draw.randrange(3, 200)))) for k in range(150)]
    texts = [" ".join(draw.choices(words, k=300)) for _ in range(20)]
    texts += [f"{' '.join(draw.choices(words, k=50))} {items[k][1]} {' '.join(draw.choices(words, k=50))}" for k in range(0, 150, 7)]
    hashed, offsets = decontam.terms(pa.array(texts, pa.large_string()))
    for index in decontam.built(items):
        found = {(text, item, begin): score for text, item, score, begin, _ in index.search(hashed, offsets)}
        lists = [dict(zip(i, s)) for i, s in zip(index.items, index.impacts)]
        expected = {}
        for text, begin, end in zip(*index.passages(hashed, offsets)):
            query = np.flatnonzero(np.isin(index.terms, hashed[begin:end]))
            for item in range(len(index.ids)):
                score = sum(lists[t].get(item, 0.0) for t in query)
                if score >= decontam.LEAST_SCORE + 1e-9:
                    expected[int(text), item, int(begin)] = score
        assert expected.keys() <= found.keys()
        assert all(abs(found[k] - v) < 1e-9 for k, v in expected.items())
        assert all(v >= decontam.LEAST_SCORE for v in found.values())


def test_leak_edge_rows(spark):
    items = [(1, "two three four five six seven eight nine ten"), (1, "two three four five six seven eight nine ten"), (2, None), (None, "word"), (3, ""), (4, "...")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = decontam.leaks(edge(spark), benchmark).collect()
    assert Counter((r.doc_id, r.item_id) for r in found) == Counter([(1, 1), (1, 1), (7, 1), (-5, 1)])
    assert decontam.leaks(empty(spark), benchmark).count() == 0
    assert decontam.leaks(edge(spark), benchmark.limit(0)).count() == 0
    left = decontam.without_leaks(edge(spark), benchmark)
    assert left.columns == edge(spark).columns and left.count() == len(EDGE) - 4


def test_question_without_answer_is_no_leak(spark):
    benchmark = spark.createDataFrame([(1, "What is the name of the tall grey tower by the river? It is called Marrow Keep.")], "item_id long, text string")
    texts = ["He asked what is the name of the tall grey tower by the river and left.", "What is the name of the tall grey tower by the river? It is called Marrow Keep. So"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.doc_id for r in decontam.leaks(docs, benchmark).collect()] == [1]
