"""Both sides of what used to be a limit, or still switches the way that something is computed: the results are the same."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridlytics.llm import decontam, langid, minhash, queries, ranges, storage, tokens
from tests.llm.cases import documents, edge


def spoken(draw, letters, n=30):
    return " ".join("".join(draw.choice(letters) for _ in range(5)) for _ in range(n))


def test_more_languages_than_are_compared_or_held(spark, monkeypatch):
    draw = random.Random(1)
    monkeypatch.setattr(langid, "COMPARED_LANGUAGES", 30)
    monkeypatch.setattr(langid, "HELD_LANGUAGES", 7)
    letters = {f"l{k:03d}": "".join(chr(0x4E00 + 5 * k + j) for j in range(5)) for k in range(80)}
    rows = [(k, spoken(draw, letters[lang]), lang) for k, lang in enumerate(sorted(letters) * 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = langid.train(docs)
    assert len(model[0]) == 80 and len(np.unique(model[2], axis=0)) == 80
    new = spark.createDataFrame([(k, spoken(draw, letters[lang]), lang) for k, lang in enumerate(letters)], "doc_id long, text string, lang string")
    right = langid.identify(new, model).join(new, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right > 0.9


def test_bit_tables_are_those_of_plain_counts(spark, sf_dir):
    docs = documents(spark, sf_dir)
    names, table, code, _ = langid.train(docs)
    counts = {name: np.zeros(langid.FEATURES) for name in names}
    for r in docs.where("text is not null and lang is not null").collect():
        words = pa.array([w for w in r.text.split() if w], pa.large_string())
        if len(words):
            for feature, _ in langid.gram_sums(words)[0]:
                counts[r.lang] += np.bincount(feature, minlength=langid.FEATURES)
    share = np.stack([(counts[n] + langid.SMOOTHING) / (counts[n] + langid.SMOOTHING).sum() for n in names])
    for k in range(code.shape[1]):
        want = np.log(share[code[:, k] > 0].mean(0)) - np.log(share[code[:, k] < 0].mean(0))
        assert np.allclose(table[:, k], want, atol=1e-9)


def test_loss_decoding_is_that_of_a_plain_loop():
    draw = np.random.default_rng(2)
    margins, code, weights = draw.normal(0, 3, (9, 7)), langid.codewords(4), draw.random((4, 7))
    got = langid.losses(margins, code, weights)
    for i in range(9):
        for lang in range(4):
            want = sum(weights[lang, k] * np.log1p(np.exp(-margins[i, k] * code[lang, k])) for k in range(7))
            assert abs(got[i, lang] - want) < 1e-9


def test_items_in_several_indexes_score_the_same(spark, sf_dir, monkeypatch):
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    items = [r.text for r in benchmark.collect()]
    draw = random.Random(3)
    vocabulary = [w for text in items for w in text.split()]
    noisy = []
    for k in range(200):
        words = [w if draw.random() < 0.85 else draw.choice(vocabulary) for w in draw.choice(items).split()]
        noisy.append((k, " ".join([draw.choice(vocabulary) for _ in range(30)] + words)))
    docs = documents(spark, sf_dir).select("doc_id", "text").union(spark.createDataFrame(noisy, "doc_id long, text string"))

    def found():
        return {(r.doc_id, r.item_id): tuple(round(x, 6) for x in r[2:]) for r in decontam.leaks(docs, benchmark).collect()}

    def kept():
        return sorted(r.doc_id for r in decontam.without_leaks(docs, benchmark).collect())

    one, stay = found(), kept()
    assert len(one) > 10
    monkeypatch.setattr(decontam, "INDEX_BYTES", sum(map(len, items)) // 4)
    assert sum(1 for _ in decontam.index_blocks(benchmark)) > 2
    assert found() == one and kept() == stay


def test_shards_keep_their_size(spark):
    assert [ranges.sample_size(n) for n in (1, 10_000, 1_000_000, 3_000_000)] == [20_000, 160_000, 2_000_000, 6_000_000]
    rows = spark.range(50_000).select(F.col("id").alias("k"), (F.col("id") % 100 + 1).alias("w"))
    bounds = ranges.cuts(rows, "k", F.col("w"), 5000)
    total = 50_000 * 50.5
    edges = np.searchsorted(np.arange(50_000), [0, *bounds, 50_000])
    weights = np.add.reduceat(np.arange(50_000) % 100 + 1, edges[:-1])
    assert abs(len(bounds) + 1 - total / 5000) <= 2 and weights.max() < 3 * 5000


def test_texts_are_picked_alike_by_filter_and_by_join(spark, monkeypatch):
    rows = spark.range(3000).select("id", F.concat(F.lit("t"), "id").alias("text"))
    ids = spark.range(0, 3000, 7).select("id")
    wanted = {r.id for r in ids.collect()}
    by_filter = [r.id for r in minhash.among(rows, ids.union(ids)).collect()]
    assert wanted <= set(by_filter) and len(by_filter) < 2 * len(wanted)
    monkeypatch.setattr(minhash, "FILTERED_IDS", 10)
    assert sorted(r.id for r in minhash.among(rows, ids.union(ids)).collect()) == sorted(wanted)
    assert minhash.among(rows, ids.limit(0)).count() == 0


def test_an_encoder_that_forgets_gives_the_same_ids(monkeypatch):
    draw = random.Random(4)
    texts = [" ".join(draw.choice(["word", "Éau,", "don't", "x1", "日本", "end.", "\n"]) + draw.choice(["", "s", str(k % 50)]) for _ in range(30)) for k in range(120)]
    path = f"{queries.TOKENIZERS}/byte_bpe_50k.json"
    monkeypatch.setattr(tokens, "REMEMBERED", 20)
    small = tokens.Encoder(path)
    monkeypatch.setattr(tokens, "REMEMBERED", 10_000)
    large = tokens.Encoder(path)
    for a in range(0, 120, 10):
        part = pa.array(texts[a : a + 10], pa.large_string())
        for one, two in zip(small.encode(part), large.encode(part)):
            assert np.array_equal(one, two)
    assert len(small.memory.old) > 0 and len(large.memory.old) == 0


def test_generations_keep_stretches():
    draw = np.random.default_rng(5)
    generation, known = tokens.Generation(), {}
    for _ in range(40):
        hashes = np.setdiff1d(draw.integers(0, 1 << 63, 4000).astype(np.uint64), np.array(sorted(known), np.uint64))
        lengths = draw.integers(0, 5, len(hashes))
        ids = draw.integers(0, 50_000, lengths.sum()).astype(np.int32)
        for h, part in zip(hashes.tolist(), np.split(ids, np.cumsum(lengths)[:-1])):
            known[h] = part.tolist()
        generation.add(hashes, ids, lengths)
    asked = np.array([*draw.choice(np.array(sorted(known), np.uint64), 500, replace=False), 1, 2], np.uint64)
    starts, lengths = generation.find(asked)
    assert starts[-2:].tolist() == [-1, -1] and len(generation) == len(known)
    for h, a, n in zip(asked[:-2].tolist(), starts, lengths):
        assert generation.blob[a : a + n].tolist() == known[h]


def test_held_out_is_never_null(spark, sf_dir, tmp_path):
    edge(spark).select("doc_id", "text", "lang", F.lit("s").alias("source"), F.lit(1).cast("long").alias("n_chars")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    for name in ("op5_quality", "op7_language", "op12_toxicity"):
        rows = queries.QUERIES[name](spark, str(tmp_path)).collect()
        assert all(r.held_out is not None for r in rows) and any(r.doc_id is None and not r.held_out for r in rows), name


def test_paths_of_common_stores():
    for path, at in (("/a/b", "/a/b"), ("a/b", "a/b"), ("file:///a/b", "/a/b"), ("file:/a/b", "/a/b"), ("dbfs:/a/b", "/dbfs/a/b")):
        assert storage.place(path) == (None, at)
    assert storage.place("s3a://bucket/a")[0] == "s3://bucket/a" and storage.place("hdfs://host:1/a")[0] == "hdfs://host:1/a"


def test_a_machines_own_folder_is_refused_on_a_cluster():
    class Session:
        def __init__(self, master, settings):
            self.conf, self.sparkContext = settings, self
            self.master = master

        def getCheckpointDir(self):
            return "set"

    local = {"spark.sql.warehouse.dir": "file:/w"}
    assert storage.shared_folder(Session("local[8]", local)) == "file:/w/_shared"
    assert storage.shared_folder(Session("yarn", {"spark.sql.warehouse.dir": "hdfs://h/w"})) == "hdfs://h/w/_shared"
    assert storage.shared_folder(Session("yarn", local | {"spark.checkpoint.dir": "file:/shared/"})) == "file:/shared"
    for master in ("yarn", "spark://h:1", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            storage.shared_folder(Session(master, local))
