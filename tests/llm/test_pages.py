"""Main text of pages: by hand, against the pages' own article, and the style tree's statistics by plain Python."""

import html
import math
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tallyline.llm import pages


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("just text &amp; more\n\n here", "just text & more here"), ("<p>a<p>b<b>c</b> d<br>e", "a\nbc d e"),
    ("<nav><ul><li><a href=x>menu</a></ul></nav><article><h1>T&eacute;</h1><p>one\n two</p></article><footer>f</footer>", "Té\none two"),
    ("<article><p>x<div class='ad'>buy</div><p>y<script>var t='</p>';</script><form>z<input></form></article>", "x\ny"),
    ("<main><p>m</p><div id=comments><p>first!</p></div><div class='cookie-notice'>ok</div></main><p>out", "m"),
    ("<body class='has-sidebar'><div class='sidebar'>s</div><div><p>t</p></div><!-- c --><style>p{}</style>", "t"),
    ("<header>top</header><article><header><h1>h</h1></header><p>b</p><footer>by me</footer></article>", "h\nb"),
    ("<table><tr><td>1<td>2<tr><td>3</table>", "1\n2\n3"), ("<ul><li>a<li>b<ul><li>c</ul></ul></p></div>", "a\nb\nc"),
    ("<p>a&nbsp;&#8212;&lt;b&gt;</p><div hidden>no</div><p role=alert>no</p>", "a —<b>"), ("<script>never closed <p>x", "")])
def test_main_text(page, text):
    assert pages.main_text(page, set()) == text


def test_articles_of_the_pages(spark, sf):
    for r in pages.extract(spark.read.parquet(f"{sf}/pages.parquet")).join(
            spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html"), "page_id").collect():
        body = re.search("<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<br>", " ", re.sub("</?b>", "", b))).split())
                  for b in re.split("</?(?:p|h1)>", body)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


@pytest.fixture(scope="module")
def site(spark):
    """A site whose every page repeats an unnamed box, and a site of copies too small to judge."""
    rows = [(i, f"http://A.example.com/{i}", f"<div class=x17><p>Always the same box.</p></div><div class=y><p>Story {i} of many</p>"
             f"<p>and its own end {i * i}</p></div>") for i in range(12)]
    rows += [(50 + i, "https://b.example.com:80/", "<div class=x17><p>Twin</p></div>") for i in range(2)]
    rows += [(90, None, "<p>no url"), (91, "no host", "<p>no host"), (92, "http://a.example.com/n", None), (0, "http://a.example.com/0", "")]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"host": F.lit(1), "text": F.lit("x")})


def test_repeated_branches_go(site):
    got = defaultdict(list)
    for r in pages.extract(site).collect():
        got[r.page_id].append((r.text, r.n_chars))
    for i in range(1, 12):
        text = f"Story {i} of many\nand its own end {i * i}"
        assert got[i] == [(text, len(text))]
    assert sorted(t for t, _ in got[0]) == ["", "Story 0 of many\nand its own end 0"]
    assert got[50] == got[51] == [("Twin", 4)] and got[90] == [("no url", 6)] and got[91] == [("no host", 7)]
    assert got[92] == [("", 0)] and sum(map(len, got.values())) == site.count()
    assert pages.extract(site.limit(0)).count() == 0


def test_importance_by_hand(site):
    have, patterns, blocks = defaultdict(int), defaultdict(lambda: defaultdict(int)), defaultdict(lambda: defaultdict(int))
    for r in site.where("page_id < 50 and html is not null").collect():
        page = pages.read(r.html)
        for p in {p for p, _ in page.patterns}:
            have[p] += 1
        for p, s in page.patterns:
            patterns[p][s] += 1
        for p, text in {(a, b[4]) for b in page.blocks for a in pages.ancestors(b[0])}:
            blocks[p][text] += 1
    got = {r.path: r for r in pages.importance(site).where("host = 'a.example.com'").collect()}
    assert len(got) == sum(n > 1 for n in have.values()) > 3
    for p, n in have.items():
        r, total = got[pages.path_hash(p)], sum(patterns[p].values())
        shown = -sum(k / total * math.log(k / total, n) for k in patterns[p].values())
        content = 1 - sum(math.log(k, n) for k in blocks[p].values()) / len(blocks[p])
        assert (r.pages, r.presentation, r.content) == (n, pytest.approx(min(1, shown), abs=1e-9), pytest.approx(content, abs=1e-9))


def test_copies_of_a_page_do_not_cut_its_article(spark):
    """Hosts of equal pages only, of a large group of copies, and of an article with an element of its own."""
    wrap = lambda x: f"<html><body><article>{x}</article></body></html>"
    article = "".join(f"<p>part {i} of a long read</p>" for i in range(100))
    quoted = "<p>before</p><blockquote><p>only here</p></blockquote><p>after</p>"
    rows = [(i, "http://same.org/x", "<html><body><div><p>All the same.</p></div></body></html>") for i in range(6)]
    rows += [(100 + i, "http://mirror.org/x", wrap(article)) for i in range(1000)]
    rows += [(2000 + i, "http://mirror.org/y", wrap(f"<p>short note {i}</p>")) for i in range(20)]
    rows += [(3000 + i, "http://quote.org/x", wrap(quoted)) for i in range(8)]
    rows += [(4000 + i, "http://quote.org/y", wrap(f"<p>other story {i}</p>")) for i in range(20)]
    got = {r.page_id: r.text for r in pages.extract(
        spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)).collect()}
    assert len(got) == len(rows)
    assert all(got[i] == "All the same." for i in range(6))
    assert all(got[100 + i] == "\n".join(f"part {j} of a long read" for j in range(100)) for i in range(1000))
    assert all(got[2000 + i] == f"short note {i}" for i in range(20))
    assert all(got[3000 + i] == "before\nonly here\nafter" for i in range(8))
    assert all(got[4000 + i] == f"other story {i}" for i in range(20))


def test_cuts_leave_main_text():
    page = "<html><body><div class=a><p>x</p></div><article><p>y</p></article></body></html>"
    every = {pages.path_hash(a) for b in pages.read(page).blocks for a in pages.ancestors(b[0])}
    assert pages.main_text(page, every) == "y"
    assert pages.main_text(page, {pages.path_hash("/html"), pages.path_hash("/html/body/article")}) == "y"
    assert pages.main_text("<div><p>all of it</p></div>", {pages.path_hash("/div")}) == "all of it"
