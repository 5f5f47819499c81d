"""Tokens, packing, Simple-8b files and WARC archives: exact round trips and brute force."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridlytics.llm import packing, queries, ranges, simple8b, storage, tokens, warc
from tests.llm.cases import EDGE, documents, edge, empty

BYTE, WORD = (f"{queries.TOKENIZERS}/{name}" for name in ("byte_bpe_50k.json", "word_bpe_49k.json"))
PARTS = [
    "a", "B", "the", "'s", "'S", " ", "  ", "\n", "\t", " \n", "\n ", "é", "İ", "ß", "Σς", "1", "12", "***", "!", "　", "\xa0", "é",
    "😀", "<|endoftext|>", "\x1c", "\x85", "中文", "don't", "_", ",", "’", "ſ", "K",
]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_ids_are_those_of_the_library(path, spark, sf_dir):
    draw = random.Random(5)
    texts = ["".join(draw.choices(PARTS, k=draw.randrange(14))) for _ in range(3000)]
    texts += [r.text or "" for r in documents(spark, sf_dir).select("text").collect()]
    encoder = tokens.Encoder(path)
    assert encoder.kind in ("byte", "word")
    ids, offsets = encoder.encode(pa.array(texts, pa.large_string()))
    for k, text in enumerate(texts):
        assert ids[offsets[k] : offsets[k + 1]].tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids, text


def test_unknown_tokenizers_encode_whole_texts(tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    other = Tokenizer(models.WordLevel({"a": 0, "b": 1, "[UNK]": 2}, unk_token="[UNK]"))
    other.pre_tokenizer = pre_tokenizers.Whitespace()
    other.save(str(tmp_path / "t.json"))
    encoder = tokens.Encoder(str(tmp_path / "t.json"))
    ids, offsets = encoder.encode(pa.array(["a b", "", "c"], pa.large_string()))
    assert encoder.kind == "whole" and ids.tolist() == [0, 1, 2] and offsets.tolist() == [0, 2, 2, 3]


def ids_of(path, text, end):
    return np.array([*tokens.encoder(path).tokenizer.encode(text or "", add_special_tokens=False).ids, end], "<u4")


def checked_packing(rows, docs, capacity):
    """Pieces are whole and right, sequences gapless; gives the number of sequences and the least there can be."""
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append((r.piece, r.start, bytes(r.ids)))
        assert len(r.ids) == 4 * r.length and 1 <= r.length <= capacity and (r.piece == 0 or r.length == capacity)
    expected = defaultdict(list)
    for doc_id, text in docs:
        ids = ids_of(BYTE, text, 0)
        cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
        expected[doc_id] += [(k, a, ids[a:b].tobytes()) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert {k: Counter(v) for k, v in by_doc.items()} == {k: Counter(v) for k, v in expected.items()}
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences), math.ceil(sum(r.length for r in rows) / capacity)


def test_packing_is_whole_and_tight(spark, sf_dir):
    docs = documents(spark, sf_dir)
    rows = packing.pack_documents(docs, BYTE).collect()
    used, least = checked_packing(rows, [(r.doc_id, r.text) for r in docs.collect()], 2048)
    assert used <= least + 3
    query = queries.op8_packing(spark, sf_dir).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, zlib.crc32(r.ids)) for r in rows) == Counter(
        (r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in query
    )


def test_packing_edge_rows(spark):
    for capacity in (16, 2048):
        rows = packing.pack_documents(edge(spark), BYTE, capacity=capacity).collect()
        checked_packing(rows, [r[:2] for r in EDGE], capacity)
    assert packing.pack_documents(empty(spark), BYTE).count() == 0


def test_blocks_and_islands_pack_everything(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_PIECES", 60)
    draw = random.Random(2)
    lengths = [draw.randrange(1, 101) for _ in range(500)]
    rows = spark.createDataFrame(list(enumerate(lengths)), "row long, length int")
    found = packing.assign(rows, 100).collect()
    assert sorted(r.row for r in found) == list(range(500))
    fill = Counter()
    for r in found:
        fill[r.sequence_id] += lengths[r.row]
    assert max(fill.values()) <= 100


def test_crossover_keeps_every_piece_and_the_genes_injected():
    draw = np.random.default_rng(4)
    lengths = draw.integers(1, 60, 300)
    one = packing.evolve(lengths, [], 1, 100)
    bins = [0] * 300
    packing.best_fit(lengths.tolist(), range(300), bins, {}, 100, 0)
    two = packing.dense(np.array(bins))
    child = packing.crossover(two, one, lengths, 100, draw)
    assert len(child) == 300 and np.bincount(child, lengths).max() <= 100
    whole = {tuple(np.flatnonzero(one == k)) for k in range(one.max() + 1)}
    assert sum(tuple(np.flatnonzero(child == k)) in whole for k in range(child.max() + 1)) > 5
    assert packing.fitness(packing.evolve(lengths, [two], 3, 100), lengths, 100) >= packing.fitness(two, lengths, 100)


@pytest.mark.parametrize("top", [1, 2, 3, 300, 32767, 32768, 49408, 1 << 32])
def test_simple8b_round_trip(top):
    draw = np.random.default_rng(top)
    for n in (0, 1, 2, 59, 60, 61, 239, 240, 241, 1023, 1024, 1025, 5000):
        ids = (draw.random(n) ** 3 * top).astype(np.uint32)
        words, escapes, index = simple8b.pack(ids)
        assert (simple8b.unpack(words, escapes, index) == ids).all()
    zeros = np.zeros(240 * 10, np.uint32)
    assert len(simple8b.pack(zeros)[0]) <= 16


@pytest.mark.parametrize("target", [1 << 25, 2000])
def test_token_files_round_trip(spark, sf_dir, target):
    for docs in (documents(spark, sf_dir), edge(spark)):
        folder = storage.new_folder(spark, "t")
        manifest = simple8b.write_tokens(docs, folder, WORD, 1, target_bytes=target)
        assert manifest == storage.read_manifest(folder)
        rows = sorted(simple8b.read_tokens(spark, manifest).collect(), key=lambda r: r.start)
        given = sorted(((r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        at = 0
        for row, (doc_id, text) in zip(rows, given, strict=True):
            ids = ids_of(WORD, text, 1)
            assert (row.doc_id, row.start, row.n_tokens, bytes(row.ids)) == (doc_id, at, len(ids), ids.tobytes())
            at += len(ids)
        again = simple8b.write_tokens(docs.repartition(3), storage.new_folder(spark, "t"), WORD, 1, target_bytes=target)
        assert [x["crc"] for x in again] == [x["crc"] for x in manifest]
    assert simple8b.read_tokens(spark, simple8b.write_tokens(empty(spark), storage.new_folder(spark, "t"), WORD, 1)).count() == 0


def test_damaged_token_files_are_noticed(spark, sf_dir):
    manifest = simple8b.write_tokens(documents(spark, sf_dir), storage.new_folder(spark, "t"), WORD, 1)
    path = storage.filesystem(manifest[0]["path"])[1]
    with open(path, "r+b") as file:
        file.seek(40)
        file.write(b"\xff\x00\xff")
    with pytest.raises(Exception):
        simple8b.read_tokens(spark, manifest).collect()


def test_cuts_do_not_split_keys_and_follow_weights(spark):
    rows = spark.range(10_000).select(F.when(F.col("id") < 4000, 7).otherwise(F.col("id")).alias("k"), F.lit(10).alias("w"))
    found = ranges.cuts(rows, "k", F.col("w"), 10_000)
    assert found == sorted(set(found)) and 5 <= len(found) <= 10
    sizes = rows.select(ranges.shard(F.col("k"), found).alias("s")).groupBy("s").count().collect()
    assert sum(r["count"] for r in sizes) == 10_000 and len(sizes) == len(found) + 1
    assert ranges.cuts(rows.limit(0), "k", F.col("w"), 10) == []


def expected_records(rows):
    """(page_id, size, sha1, type, refers_to) of each row."""
    rows = [(page_id, (text or "").encode()) for page_id, text in rows]
    holder = {}
    for page_id, payload in rows:
        if len(payload) >= 1000 and page_id is not None:
            holder[payload] = max(holder.get(payload, page_id), page_id)
    out, stored = Counter(), set()
    for page_id, payload in rows:
        refers = holder.get(payload)
        if refers == page_id and payload not in stored:
            stored.add(payload)
            refers = None
        out[page_id, len(payload), hashlib.sha1(payload).hexdigest(), "response" if refers is None else "revisit", refers] += 1
    return out


PAGES = [
    (1, "http://a/", "x" * 1200), (2, "http://b/", "x" * 1200), (3, None, "x" * 999), (4, "http://c/", "x" * 999), (5, "u\r\nInjected: 1", None),
    (6, "", ""), (2, "http://b/", "x" * 1200), (None, "http://n/", "x" * 1200), (None, None, None), (7, "http://d/", "é😀\r\n\r\n" * 300),
    (8, "http://e/", "é😀\r\n\r\n" * 300), (-1, "http://f/", "WARC/1.1\r\n\r\n"), (9, "http://g/", "y" * 2000), (9, "http://g/", "y" * 2000),
]


@pytest.mark.parametrize("roll", [warc.ROLL_BYTES, 900])
def test_archives_round_trip(spark, sf_dir, roll):
    edges = spark.createDataFrame([(*r, 1, 2) for r in PAGES], "page_id long, url string, html string, payload int, _shard int")
    for pages in (spark.read.parquet(f"{sf_dir}/pages.parquet"), edges):
        folder = storage.new_folder(spark, "w")
        manifest = warc.write_archive(pages, folder, shard_bytes=40_000, roll_bytes=roll)
        assert manifest == storage.read_manifest(folder)
        rows = warc.read_archive(spark, manifest).collect()
        given = [(r.page_id, r.html) for r in pages.collect()]
        assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows) == expected_records(given)
        assert len({r.record_id for r in rows}) == len(rows) or pages is edges
        kept = Counter(r.payload for r in rows if r.record_type == "response")
        assert set(kept) == {(text or "").encode() for _, text in given}
        again = warc.write_archive(pages.repartition(5), storage.new_folder(spark, "w"), shard_bytes=40_000, roll_bytes=roll)
        assert [x["sha1"] for x in again] == [x["sha1"] for x in manifest]
    assert len(manifest) > 3 or roll > 900


def test_an_empty_table_gives_an_empty_archive(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_archive(spark, warc.write_archive(pages, storage.new_folder(spark, "w"))).count() == 0


def test_only_committed_files_have_a_name(tmp_path):
    out = storage.Committed(str(tmp_path / "f"))
    out.write(b"abc")
    assert [p.name for p in tmp_path.iterdir()] != ["f"]
    out.commit()
    assert [p.name for p in tmp_path.iterdir()] == ["f"]
    other = storage.Committed(str(tmp_path / "g"))
    other.abort()
    assert [p.name for p in tmp_path.iterdir()] == ["f"]
