"""Main text of pages."""

from __future__ import annotations

import html
import re

import numpy as np
import pytest

from gridlytics.llm import boilerplate
from gridlytics.llm.boilerplate import LOOSE, MAIN, OTHER, blocks


def article_of(page):
    """By the tables' own pattern: what stands between <article> and its end or the footer, block by block."""
    inside = re.search(r"<article>(.*?)(</article>|<footer|\Z)", page or "", re.S)
    parts = re.split(r"</?(?:p|h1|br)>", inside[1]) if inside else []
    return "\n".join(t for t in (" ".join(html.unescape(re.sub(r"<[^>]*>", "", p)).split()) for p in parts) if t)


def test_articles_of_all_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/pages.parquet")
    found = {r.page_id: r for r in boilerplate.main_text(pages).collect()}
    given = pages.collect()
    assert len(found) == len(given)
    for r in given:
        assert found[r.page_id].text == article_of(r.html) and found[r.page_id].n_chars == len(found[r.page_id].text)


@pytest.mark.parametrize("page, expected", [
    ("", []),
    ("plain &amp; simple", [("plain & simple", LOOSE)]),
    ("<p>one<p>two<br>three <b>bold</b>er", [("one", LOOSE), ("two", LOOSE), ("three bolder", LOOSE)]),
    ("<nav>menu<ul><li>x</ul></nav><main><header>by us</header><p>text</main>tail", [("menu", OTHER), ("x", OTHER), ("by us", MAIN), ("text", MAIN), ("tail", LOOSE)]),
    ("<article>a<div class='ad box'>buy<div>more</div></div>b</article>", [("a", MAIN), ("buy", OTHER), ("more", OTHER), ("b", MAIN)]),
    ("<article>a<section id=comments><p>I think</section>b</article>", [("a", MAIN), ("I think", OTHER), ("b", MAIN)]),
    ("<script>if (a<b) { '</p>' }</script>x<style>p{}</style>", [("x", LOOSE)]),
    ("<script>never closed <p>y", []),
    ("x<!-- <p>no</p> -->y<!-- open", [("xy", LOOSE)]),
    ("a &lt;b&gt; &#233;&nbsp;&#x1F600; &copy &bogus; &am", [("a <b> é 😀 © &bogus; &am", LOOSE)]),
    ('<p title="a > b">t</p><div hidden>h</div><div style="display:none">n</div>', [("t", LOOSE), ("h", OTHER), ("n", OTHER)]),
    ("<article><p>cut in the mid", [("cut in the mid", MAIN)]),
    ("<article>x<form><input><button>go</button></form><aside>y</aside>z", [("x", MAIN), ("go", OTHER), ("y", OTHER), ("z", MAIN)]),
    ("<ARTICLE><P>Big</P></ARTICLE><FOOTER>f</FOOTER>", [("Big", MAIN), ("f", OTHER)]),
    ("1 < 2 and 3 > 2 <", [("1 < 2 and 3 > 2 <", LOOSE)]),
    ("<pre> a\n   b </pre><td>c</td><td>d</td>", [("a b", LOOSE), ("c", LOOSE), ("d", LOOSE)]),
])
def test_blocks(page, expected):
    assert blocks(page) == expected


def test_broken_markup_is_read_in_linear_time():
    for page in ("<a href='" * 20_000, "<" * 50_000, "<p" * 50_000, "<!--" * 20_000, "<div>" * 20_000 + "x"):
        blocks(page)


def test_repeated_runs_against_brute_force():
    draw = np.random.default_rng(2)
    for _ in range(20):
        pages, streams = int(draw.integers(1, 6)), []
        common = draw.integers(1, 50, 20)
        for p in range(pages):
            own = draw.integers(1, 6, int(draw.integers(0, 60)))
            streams.append(np.concatenate([own, common if draw.random() < 0.7 else [], own[:9], [-1 - p]]).astype(np.int64))
        tokens, page = np.concatenate(streams), np.repeat(np.arange(pages), [len(s) for s in streams])
        seen = {}
        for k in range(len(tokens) - boilerplate.RUN + 1):
            run = tuple(tokens[k : k + boilerplate.RUN])
            seen.setdefault(run, set()).add(int(page[k]))
        expected = np.zeros(len(tokens), bool)
        for k in range(len(tokens) - boilerplate.RUN + 1):
            run = tuple(tokens[k : k + boilerplate.RUN])
            if len(seen[run]) >= min(boilerplate.LEAST_PAGES, max(pages, 2)):
                expected[k : k + boilerplate.RUN] = True
        assert (boilerplate.repeated_runs(tokens, page, pages) == expected).all()


def test_what_a_host_repeats_goes_where_no_article_is_marked(spark):
    story = lambda k: " ".join(f"story{k}-{j}" for j in range(12))
    chrome = "<div>Welcome to our site home of the very best offers in town today</div>"
    end = "<div>All rights are reserved by the owner of this fine site since long ago</div>"
    rows = [(k, f"https://h.example/{k}", f"{chrome}<div>{story(k)}</div>{end}") for k in range(9)]
    rows += [(100, "https://other.example/", chrome)]
    found = {r.page_id: r.text for r in boilerplate.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [found[k] for k in range(9)] == [story(k) for k in range(9)]
    assert found[100].startswith("Welcome")


def test_an_article_printed_twice_is_kept(spark):
    rows = [(k, "https://h.example/", "<article><p>The same long article that several pages of a host print in full, word for word.</article>") for k in range(6)]
    found = boilerplate.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.text for r in found} == {"The same long article that several pages of a host print in full, word for word."} and len(found) == 6


def test_hot_hosts_are_split(spark, monkeypatch):
    monkeypatch.setattr(boilerplate, "CHUNK_PAGES", 20)
    rows = [(k, "https://hot.example/x", f"<div>one two three four five six seven eight nine ten</div><p>own {k} {k + 1} {k + 2} {k} {k * 3}") for k in range(300)]
    for most in (boilerplate.MOST_SENT, -1):
        monkeypatch.setattr(boilerplate, "MOST_SENT", most)
        found = boilerplate.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
        assert {(r.page_id, r.text) for r in found} == {(k, f"own {k} {k + 1} {k + 2} {k} {k * 3}") for k in range(300)}


def test_page_edge_rows(spark):
    rows = [(1, None, None, "x"), (None, "not a url", "<p>t", "y"), (2, "", "", "z"), (2, "", "", "z"), (3, "http://u:p@H.example:80/a", "<article>é</article>", "h")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    found = boilerplate.main_text(pages).collect()
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in found) == [(0, "t", 1), (1, "", 0), (2, "", 0), (2, "", 0), (3, "é", 1)]
    assert boilerplate.main_text(pages.limit(0)).count() == 0
    assert pages.select(boilerplate.host(pages.url).alias("h")).collect()[4].h == "h.example"


def _texts(spark, rows):
    found = boilerplate.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(8)).collect()
    return {r.page_id: (r.text, r.n_repeated) for r in found}


@pytest.mark.parametrize("most", [boilerplate.MOST_SENT, -1])
def test_a_rare_run_is_found_over_the_whole_of_a_large_host(spark, monkeypatch, most):
    monkeypatch.setattr(boilerplate, "MOST_SENT", most)
    notice = "This shop is shut from noon to three on the days before a feast"
    story = lambda k: " ".join(f"s{k}-{j}" for j in range(12))
    rows = [(k, "https://big.example/x", f"<div>{story(k)}</div>" + (f"<p>{notice}</p>" if k % 800 == 7 else "")) for k in range(4000)]
    rows += [(9000 + k, "https://big.example/x", f"<div>{story(9000 + k)}</div><p>{notice[::-1]}</p>") for k in range(2)]
    rows += [(9100 + k, "https://small.example/x", f"<div>{story(9100 + k)}</div><p>{notice}</p>") for k in range(2)]
    rows += [(9200, "https://one.example/x", f"<div>{story(9200)}</div><p>{notice}</p>")]
    found = _texts(spark, rows)
    assert all(found[k] == (story(k), len(notice) * (k % 800 == 7)) for k in range(4000))
    assert [found[k][0] for k in (9000, 9100, 9101)] == [f"{story(9000)}\n{notice[::-1]}", story(9100), story(9101)]
    assert found[9200] == (f"{story(9200)}\n{notice}", 0)


def test_copies_of_an_unmarked_page_are_one_page(spark):
    story = lambda k: " ".join(f"s{k}-{j}" for j in range(12))
    rows = [(k, "https://h.example/a", f"<p id=x{k}>{story(0)}</p><div>{story(1)}</div>") for k in range(30)]
    rows += [(100, "https://h.example/b", f"<div>{story(2)}</div>")] * 5
    assert set(_texts(spark, rows).values()) == {(f"{story(0)}\n{story(1)}", 0), (story(2), 0)}
    rows += [(200 + k, "https://h.example/c", f"<p>{story(20 + k)}</p><div>{story(1)}</div>") for k in range(2)]
    found = _texts(spark, rows)
    assert [found[k] for k in (0, 29, 200, 201)] == [(story(k), len(story(1))) for k in (0, 0, 20, 21)]
