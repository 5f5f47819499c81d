"""Importance resampling, toxicity and conversation repair against brute force, held-out rows and edge rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import sys
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pytest

from gridlytics.llm import conversations, importance, queries, toxicity
from tests.llm.cases import documents, edge, empty

# ---- importance resampling ----

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def features(text):
    words = WORD.findall((text or "").translate(UPPER))
    return len(words), [zlib.crc32(f.encode()) % 10000 for f in words + [f"{a} {b}" for a, b in zip(words, words[1:])]]


def resampled(docs, target, percent, seed):
    """Every (id, n_features, weight, score, rank), sorted."""
    s, t = Counter(), Counter()
    for text in target:
        t.update(features(text)[1])
    found = [(i, *features(text)) for i, text in docs]
    for _, _, f in found:
        s.update(f)
    all_s, all_t = sum(s.values()) + 10000.0, sum(t.values()) + 10000.0
    rows = []
    for i, words, f in found:
        gains = [math.floor(1000 * math.log((t[b] + 1.0) * all_s / ((s[b] + 1.0) * all_t))) for b in f]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, words, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    meant = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    take = len(meant) * percent // 100
    ranked = [(r[0], *r[2:], k + 1 if k < take else None) for k, r in enumerate(meant)]
    return Counter(ranked + [(r[0], *r[2:], None) for r in rows if r[1] < 20])


def drawn(docs, target, percent=25, seed=7):
    out = importance.drawn(docs, target, percent, seed).select("doc_id", "n_features", "weight", "score", "rank")
    return Counter(tuple(r) for r in out.collect())


def test_resampling_agrees_with_brute_force(spark, sf_dir):
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    items = [r.text for r in target.collect()]
    for docs in (documents(spark, sf_dir), edge(spark)):
        given = [(r.doc_id, r.text) for r in docs.collect()]
        for percent in (0, 25, 100):
            assert drawn(docs, target, percent) == resampled(given, items, percent, 7)


def test_resampling_without_rows_or_target(spark, sf_dir):
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    assert not drawn(empty(spark), target)
    docs = edge(spark)
    assert drawn(docs, target.limit(0)) == resampled([(r.doc_id, r.text) for r in docs.collect()], [], 25, 7)


def test_resampling_breaks_ties_by_id(spark):
    # one id, so one noise: equal scores; and two ids of equal text
    rows = [(k % 3, " ".join(f"w{j}" for j in range(30))) for k in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert drawn(docs, docs.limit(1), 50) == resampled(rows, [rows[0][1]], 50, 7)


def test_crcs_are_those_of_zlib():
    words = ["", "a", "é", "日本語", "x" * 5000, "😀 b", "\x00"] + [f"word{k} {k * 7}" for k in range(300)]
    for strings in (pa.array(words, pa.large_string()), pa.array(["skip", *words], pa.large_string())[1:]):
        assert importance.crcs(strings).tolist() == [zlib.crc32(w.encode()) for w in words]
    assert len(importance.crcs(pa.array([], pa.large_string()))) == 0


# ---- toxicity ----


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def nearest(word, terms):
    """(distance, whether a stem, number) of the nearest term that is near enough."""
    best = None
    for number, term in enumerate(terms):
        most = toxicity.edits_of(term)
        if term.endswith("*"):
            far = min(distance(word[:k], term[:-1]) for k in range(len(word) + 1))
        else:
            far = distance(word, term)
        if far <= most:
            best = min(best or (99, 0, 0), (far, term.endswith("*"), number))
    return best


def test_automata_agree_with_edit_distances():
    draw = random.Random(3)
    terms = sorted({"idiot", "pathetic", "disgusting", "moron", "scum", "lowe*", "disgus*", "worthles*", "ab", "éàü", "trash", "trashes"})
    words = {"", "x", "idiot", "idoit", "lowenfoo", "disgustingly" * 4, "wrthlesness", "z" * 400, "éàü", "eàü"}
    while len(words) < 4000:
        word = list(draw.choice(terms).removesuffix("*") + draw.choice(["", "", "en", "schaft", "x" * 30]))
        for _ in range(draw.randrange(4)):
            at = draw.randrange(len(word) + 1)
            word[at : at + draw.randrange(2)] = draw.choice(["", "a", "t", "é", "#", "ss"])
        words.add("".join(word))
    words = sorted(words)
    for lexicon in (toxicity.Lexicon(terms), toxicity.Lexicon(terms[:1]), toxicity.Lexicon([])):
        found, far = lexicon.find(pa.array(words, pa.large_string()))
        for word, term, d in zip(words, found.tolist(), far.tolist()):
            best = nearest(word, lexicon.terms) if word else None
            assert (d, term) == ((best[0], best[2]) if best else (-1, -1)), word


def test_automata_that_forget_find_the_same(monkeypatch):
    monkeypatch.setattr(toxicity, "STATES", 3)
    terms = ["disgusting", "idiot", "pathetic"]
    lexicon, words = toxicity.Lexicon(terms), pa.array(["idiots", "pathetc", "disgsting", "fine"], pa.large_string())
    assert lexicon.find(words)[1].tolist() == lexicon.find(words)[1].tolist() == [1, 1, 1, -1]


PLAIN = "the weather was mild and people walked by the river to see boats near the old bridge at noon".split()


def talk(draw, n, kind):
    words = [draw.choice(PLAIN) for _ in range(n)]
    for _ in range(2 if kind == "clean" and n > 60 else 0):
        words[draw.randrange(n)] = draw.choice(["bridges", "river,"])
    at = draw.randrange(5, n - 5)
    if kind == "abuse":
        words[at : at + 1] = ["you", draw.choice(["blockhead", "dimwitted", "numbskull"])]
    if kind == "quoted":
        words[at : at + 1] = ["he", "wrote", f'"{draw.choice(["blockhead", "dimwitted", "numbskull"])}"', "again"]
    return " ".join(words)


def test_quotation_is_told_from_abuse_and_misspellings_are_found(spark):
    draw = random.Random(5)
    kinds = ["abuse"] * 150 + ["quoted"] * 40 + ["clean"] * 400
    rows = [(k, talk(draw, draw.randrange(20, 80), kind)) for k, kind in enumerate(kinds)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(kind == "abuse")) for k, kind in enumerate(kinds) if k % 4], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, "toxic")
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    held = [(kind, got[k]) for k, kind in enumerate(kinds) if not k % 4]
    right = [(r.score >= 0.5) == (kind == "abuse") for kind, r in held]
    assert np.mean(right) > 0.95 and all(r.n_quoted >= 1 for kind, r in held if kind == "quoted")
    extra = spark.createDataFrame(
        [(1, "and you blokhead walked by the river to see the old boats"), (2, 'and he wrote "blockhead" again by the river to see the old boats'),
         (3, "and people walked by the river to see the old boats")], "doc_id long, text string",
    )
    one, two, three = (r.score for r in toxicity.score(extra, model).orderBy("doc_id").collect())
    assert one > two > 0 and one > three
    hit = toxicity.hits(extra, model).where("doc_id = 1 and edits > 0").first()
    assert (hit.word, hit.term, hit.edits, hit.quoted, hit.place) == ("blokhead", "blockhead", 1, False, 2) or hit.term.endswith("*")


def test_toxicity_holds_out(spark):
    """On held-out labelled rows of the given tables; the words of a few languages have too few labels here to be learned."""
    folder = "/root/testdata/sf0.01"
    found = {r.doc_id: r for r in queries.op12_toxicity(spark, folder).collect()}
    rows = [(r.toxic, found[r.doc_id]) for r in spark.read.parquet(f"{folder}/labels.parquet").collect() if found[r.doc_id].held_out]
    toxic, clean = [r for t, r in rows if t], [r for t, r in rows if not t]
    assert np.mean([r.predicted for r in toxic]) > 0.6 and np.mean([r.predicted for r in clean]) < 0.02
    assert np.mean([a.score > b.score for a in toxic for b in clean]) > 0.75


def test_toxicity_edge_rows(spark):
    docs, labels = edge(spark), spark.createDataFrame([(1, 1), (6, 0), (7, 1), (None, 1), (8, None), (9, 0), (9, 1)], "doc_id long, toxic int")
    clash = labels.selectExpr("doc_id", "toxic", "1 AS id", "2 AS label", "3 AS text")
    for given in (labels, clash, labels.where("toxic = 1"), labels.limit(0)):
        model = toxicity.train(docs, given, "toxic")
        found = toxicity.score(docs, model)
        assert Counter(r.doc_id for r in found.collect()) == Counter(r.doc_id for r in docs.collect())
        assert all(0 < r.score < 1 for r in found.collect())
        assert toxicity.score(empty(spark), model).count() == toxicity.hits(empty(spark), model).count() == 0
    assert toxicity.train(empty(spark), labels, "toxic").lexicon.terms == []


def test_logistic_agrees_with_plain_descent():
    draw = np.random.default_rng(1)
    x = np.concatenate([np.ones((300, 1)), draw.normal(size=(300, 2))], 1)
    y = (x @ np.array([0.3, 1.0, -2.0]) + draw.normal(size=300) > 0).astype(float)
    beta, plain = toxicity.logistic(x, y), np.zeros(3)
    for _ in range(20000):
        plain += 0.01 * (x.T @ (y - 1 / (1 + np.exp(-(x @ plain)))) - np.array([1e-3, 0.3, 0.3]) * plain)
    assert np.allclose(beta, plain, atol=1e-4)


# ---- conversation repair ----

BLANK = re.compile("[^\x20\x09-\x0d]")


def cheapest(rows):
    """(cost, audit, repaired lines) of one conversation's (role, text, fault) by looking at all edits from the end."""
    keep = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}

    sys.setrecursionlimit(20_000)

    @lru_cache(None)
    def best(i, q, inserted):
        options = [(0, "")] if i == len(rows) and q in (0, 3) else []
        to = 3 if q == 2 else 2
        if inserted < 4:
            cost, audit = best(i, to, inserted + 1)
            options.append((cost + 3, "I" + audit))
        if i < len(rows):
            role, _, fault = rows[i]
            more = 3 if fault == "truncated" else 0
            cost, audit = best(i + 1, q, 0)
            options.append((cost + 4, "D" + audit))
            if fault not in ("blank", "duplicate"):
                if (q, role[:1]) in keep:
                    cost, audit = best(i + 1, keep[q, role[:1]], 0)
                    options.append((cost + more, "K" + audit))
                cost, audit = best(i + 1, to, 0)
                options.append((cost + more + 3, "R" + audit))
        return min(options, default=(math.inf, ""))

    cost, audit = best(0, 0, 0)
    lines, q, i = [], 0, 0
    for edit in audit:
        if edit == "K":
            q = keep[q, rows[i][0][:1]]
            lines.append(f"{rows[i][0]}:{rows[i][1]}")
        elif edit != "D":
            q = 3 if q == 2 else 2
            lines.append(f"{'assistant' if q == 3 else 'user'}:{rows[i][1] if edit == 'R' else ''}")
        i += edit != "I"
    return cost, audit, lines


def repaired(given):
    """What `report` must say, by conversation, of (conv, turn, role, text) rows."""
    out, by_conv = {}, {}
    for conv, turn, role, text in given:
        by_conv.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    for conv, rows in by_conv.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
        seen, faulty = set(), []
        for _, role, text in rows:
            bare = text.rstrip("\x20\x09\x0a\x0b\x0c\x0d")
            fault = "blank" if not BLANK.search(text) else "duplicate" if (role, text) in seen else None if bare[-1] in ".!?" else "truncated"
            seen.add((role, text))
            faulty.append((role, text, fault))
        cost, audit, lines = cheapest(faulty)
        turns, kinds = [r[0] for r in rows if r[0] is not None], Counter(f for _, _, f in faulty)
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[conv] = (conv, gaps, kinds["blank"], kinds["duplicate"], kinds["truncated"], illegal, cost, audit, sha)
    return out


SCHEMA = "conv_id long, turn long, role string, text string"


def random_talk(draw, conv):
    turn, out = draw.randrange(3), []
    for _ in range(draw.choice([0, 1, 2, 3, 5, 8, 13])):
        turn += draw.choice([0, 1, 1, 1, 3])
        role = draw.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None])
        out.append((conv, draw.choice([turn, turn, turn, None]), role, draw.choice(["Yes.", "No!", "Why?  \n", "cut", "é", "", " \t", None, "x. y"])))
    return out


def test_repair_agrees_with_brute_force(spark):
    draw = random.Random(11)
    rows = [r for conv in [None, *range(300)] for r in random_talk(draw, conv)]
    rows += [(900, k, draw.choice(["user", "user", "assistant"]), f"t{k % 60}" + draw.choice([".", ""])) for k in range(250)]  # a long one
    rows += [(901, k, "user", f"t{k}.") for k in range(200)] + [(902, 5, "user", "same.")] * 50  # ties that stay open; copies
    want = repaired(rows)
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS conv", "'x' AS kind", "2 AS copies", "'d' AS digest")
    for parts in (1, 8):
        got = {r.conv_id: tuple(r) for r in conversations.report(frame.repartition(parts)).collect()}
        assert got == want


def test_repair_emits_the_repaired_conversation(spark):
    draw = random.Random(12)
    rows = [r for conv in range(120) for r in random_talk(draw, conv)] + [(500, k, "user", f"t{k}.") for k in range(3000)]
    frame = spark.createDataFrame(rows, SCHEMA)
    audits = {r.conv_id: r for r in conversations.report(frame).collect()}
    found = {}
    for r in conversations.edits(frame).collect():
        found.setdefault(r.conv_id, []).append(r)
    assert {k for k, r in audits.items() if r.audit} == set(found)
    for conv, its in found.items():
        its.sort(key=lambda r: r.place)
        assert [r.place for r in its] == list(range(len(its))) and "".join(r.edit for r in its) == audits[conv].audit
        lines = [f"{r.role}:{r.text}" for r in its if r.role is not None]
        assert hashlib.sha256("\n".join(lines).encode()).hexdigest() == audits[conv].repaired_sha256
        assert re.fullmatch("(s?(ua)+)?", "".join(r.role[0] for r in its if r.role is not None))


def test_settled_edits_leave_the_tree():
    """However long the talk, the tree holds the unresolved stretch only."""
    paths, most = conversations.Survivors(True), 0
    for k in range(5000):
        paths.row((k, "user" if k % 2 == 0 else "assistant"), k % 97 == 0, k % 31 == 0, b"x")
        size, todo = 0, [paths.root]
        while todo:
            node = todo.pop()
            size += 1
            todo += node.children
        most = max(most, size)
    assert most < 20


def test_repair_of_nothing(spark):
    assert conversations.report(spark.createDataFrame([], SCHEMA)).count() == 0
    assert conversations.edits(spark.createDataFrame([], SCHEMA)).count() == 0


def test_damage_keeps_conversations_without_rows(spark):
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    twice = next(k for k in range(1000) if zlib.crc32(f"{k}: ".encode()) % 20 == 3)
    rows = [(gone, 0, "user", "Gone."), (twice, None, "user", "Twice."), (None, None, None, None)]
    damaged, copies, away = conversations.damaged(spark.createDataFrame(rows, SCHEMA))
    got = {r.conv_id: tuple(r)[1:] for r in conversations.report(damaged, copies=copies, gone=away).collect()}
    assert got[gone] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got[twice] == (0, 0, 1, 0, 1, 7, "KDI", hashlib.sha256(b"user:Twice.\nassistant:").hexdigest())
    assert None in got


def test_repair_reads_texts_once(spark):
    plan = conversations.report(spark.createDataFrame([], SCHEMA))._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count("RepartitionByExpression") == 1


@pytest.mark.parametrize("name", ["op11_importance", "op13_conversations"])
def test_queries_agree_with_sql(spark, sf_dir, name):
    from tests.oracle_check import compare, connect

    assert compare(spark, connect(sf_dir), sf_dir, queries.QUERIES[name], queries.ORACLES[name]) == ""
