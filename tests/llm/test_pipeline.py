"""The pipeline against a plain walk through its stages."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import functions as F

from gridlytics.llm import quality, queries
from tests.llm.cases import documents, edge
from tests.llm.test_files import checked_packing
from tests.llm.test_filters import base_spans
from tests.llm.test_groups import brute_groups, brute_leaks


def test_stages_are_the_dealt_ones():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality_classifier", "near_duplicates", "decontamination", "secret_scan", "best_fit_packing",
    ]
    assert {name.partition("_")[0] for name in queries.QUERIES} == {f"op{n}" for n in range(1, 14)}


def test_every_stage_against_brute_force(spark, sf_dir):
    sf = sf_dir.replace("sf0.001", "sf0.01")
    docs = documents(spark, sf)
    given, columns = {r.doc_id: r for r in docs.collect()}, docs.columns
    stages = [f for _, f in corpus_pipeline.STAGES]

    one = stages[0](spark, docs, sf)
    model = quality.train(docs, spark.read.parquet(f"{sf}/labels.parquet"), "quality")
    scores = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    assert one.columns == columns and {r.doc_id for r in one.collect()} == {d for d, s in scores.items() if s >= 0.3}
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    clean = labels.where("quality = 1").join(one, "doc_id", "left_semi").count() / labels.where("quality = 1").count()
    junk = labels.where("quality = 0").join(one, "doc_id", "left_semi").count() / labels.where("quality = 0").count()
    assert clean > 0.97 and junk < 0.2

    two = stages[1](spark, one, sf)
    groups = brute_groups([(r.doc_id, r.text) for r in one.collect()], 5)
    assert two.columns == columns and {r.doc_id for r in two.collect()} == {d for d, _, c in groups if d == c}

    three = stages[2](spark, two, sf)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    leaking = {d for d, _ in brute_leaks([(r.doc_id, r.text) for r in two.collect()], items)}
    assert leaking and {r.doc_id for r in three.collect()} == {r.doc_id for r in two.collect()} - leaking

    four = stages[3](spark, three, sf)
    rows = four.collect()
    assert four.columns == columns and {r.doc_id for r in rows} == {r.doc_id for r in three.collect()}
    for r in rows:
        assert r.n_chars == len(r.text) and not base_spans(r.text)
        if not base_spans(given[r.doc_id].text) and "[SECRET]" not in r.text:
            assert r.text == given[r.doc_id].text

    five = stages[4](spark, four, sf).collect()
    used, least = checked_packing(five, [(r.doc_id, r.text) for r in rows], 2048)
    assert used <= least + 3

    whole = corpus_pipeline.run(spark, sf)
    assert whole.groupBy("doc_id").agg(F.sum("length")).count() == len(rows)


def test_stages_take_edge_rows(spark, sf_dir):
    docs = edge(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == edge(spark).columns
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() > 0
    none = edge(spark).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, sf_dir)
    assert none.count() == 0
