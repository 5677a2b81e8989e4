"""Pages on which a mark covers less than the main text."""

from __future__ import annotations

import collections
import os
import re

import numpy as np
import pyarrow.parquet as pq
import pytest

from quirework.llm import html_extract, queries

from .test_operators import SF


def test_unshared_lines_stay_beside_a_marked_teaser(spark):
    page = lambda k: f"<div>Site name</div><div class=story>Teaser {k}</div><p>Long text {k}</p><p>Second part {k}</p><div>All rights reserved</div>"
    rows = [(k, f"http://h.de/{k}", page(k)) for k in range(4)]
    got = {r.page_id: r.text for r in html_extract.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: f"Teaser {k}\n\nLong text {k}\n\nSecond part {k}" for k in range(4)}


def test_copied_article_lines_stay_and_shared_open_lines_go():
    lines = html_extract.page_lines("<div>Site name</div><article><p>Same story</p></article><nav>n</nav><p>By A</p>")
    other = html_extract.page_lines("<div>Site name</div><article><p>Same story</p></article><nav>n</nav><p>By B</p>")
    assert html_extract.main_text(lines, other) == ("Same story\n\nBy A", 1, 1)
    assert html_extract.main_text(lines, lines)[0] == "Same story"
    assert html_extract.main_text(lines, None) == ("Site name\n\nSame story\n\nBy A", 0, 1)


NAMES = [
    ('<main><p>Body</p><article class="comment"><p>I agree</p></article></main>', "Body"),
    ('<article><p>Story</p></article><article class="teaser"><p>Read on</p></article>', "Story"),
    ('<article><div class="entry-header"><h1>Title</h1></div><h2 id="related-work">Related work</h2><p class="ad-hoc">An ad hoc group</p><div class="social-history">History</div></article>', "Title\n\nRelated work\n\nAn ad hoc group\n\nHistory"),
    ('<article><p>Story</p><div class="user-comments">c</div><section id="respond">r</section><ul class="share-tools"><li>s</li></ul></article><div class="disqus_thread">d</div>', "Story"),
    ('<article><p>Story</p><div data-ad="7">Buy</div><div data-ad-slot="top">Now</div><p data-added="x">More</p></article>', "Story\n\nMore"),
    ('<div class="site-header">Site</div><div class="comment-list">c</div><div id="ad-slot-3">ad</div><p>Text</p><div class="footer-links">f</div>', "Text"),
]


@pytest.mark.parametrize("html,want", NAMES)
def test_names_of_elements(html, want):
    assert html_extract.main_text(html_extract.page_lines(html), None)[0] == want


def plain_pairs(rows):
    """Every page with its neighbour's lines by the docstring: one sorted list of each host."""
    hosts = {}
    for page_id, url, html in rows:
        rest = (url or "").partition("://")[2]
        host, path = re.match(r"([^/?#]*)([^?#]*)", rest).groups()
        hosts.setdefault(host.lower(), []).append((path, page_id if page_id is not None else -1, url or "", html or ""))
    for pages in hosts.values():
        pages.sort()
        lines = [html_extract.page_lines(p[3]) for p in pages]
        for k, p in enumerate(pages):
            beside = [j for j in (k - 1, k + 1) if 0 <= j < len(pages) and lines[j] != lines[k]]
            near = max(beside, key=lambda j: len(os.path.commonprefix((p[0], pages[j][0]))), default=None)
            yield p[1], lines[k], None if near is None else lines[near]


def plain_lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_pages_against_plain_pairing(spark):
    """Neighbours and longest common subsequences of all given pages, the decisions that follow, and how many unmarked lines differencing takes."""
    pages = pq.read_table(f"{SF}/pages.parquet").to_pandas()
    got = {r.page_id: r for r in queries.op3_html_differencing(spark, SF).collect()}
    n_shared = 0  # unmarked lines that go because the neighbour has them
    for page_id, lines, near in plain_pairs(zip(pages.page_id, pages.url, pages.html, strict=True)):
        want = html_extract.main_text(lines, near)
        assert (got[page_id].text, got[page_id].n_shared, got[page_id].n_marked) == want
        if near:
            a, b = [x for _, x in lines], [x for _, x in near]
            assert len(html_extract.common_lines(a, b)) == plain_lcs(a, b)
        n_shared += want[1]
    assert n_shared == 0  # the given pages mark all their lines, so that marks alone decide; pages with open lines are tested beside


def test_same_rows_however_partitioned(spark, monkeypatch):
    page = lambda k: f"<div>Site name</div><p>Long text {k}</p><div>Group {k // 5}</div><div>All rights reserved</div>"
    rows = [(k % 50 if k % 7 else None, f"http://{'ab'[k % 3 == 0]}.de/x/{k % 40}?q={k}", page(k % 45)) for k in range(60)] + [(1, None, page(1)), (None, "", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    seen = []
    for parts, size in ((1, 1 << 20), (4, 1000), (211, 1), (4, 300)):
        monkeypatch.setattr(html_extract, "RANGE_BYTES", size)
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        seen.append(collections.Counter(html_extract.extract_main_text(df.repartition(1 + parts % 7)).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", 8)
    assert seen[0] == seen[1] == seen[2] == seen[3] and sum(seen[0].values()) == len(rows)
    plain = collections.Counter((html_extract.main_text(a, b)[0], None if i == -1 else i) for i, a, b in plain_pairs(rows))
    assert collections.Counter((r.text, r.page_id) for r in seen[0].elements()) == plain


def test_long_pages_of_few_lines():
    """Two alignments agree in length, and cells that recur thousands of times don't multiply."""
    rng = np.random.default_rng(1)
    for _ in range(30):
        a, b = ([str(x) for x in rng.integers(0, 4, int(rng.integers(0, 30)))] for _ in range(2))
        assert len(html_extract._by_bits(a, b)) == plain_lcs(a, b)
    a, b = ([str(x) for x in rng.integers(0, 3, 20_000)] for _ in range(2))
    assert 10_000 < len(html_extract.common_lines(a, b)) <= 20_000
    cells = "".join(f"<td>{x}</td>" for x in rng.integers(0, 2, 20_000))
    assert len(html_extract.page_lines(f"<table><tr>{cells}</table>")) == 20_000
