"""WARC archives and main text of pages: edges, brute force, round trips."""

import gzip
import hashlib
import html
import random
import re
import time
from base64 import b32encode

import pytest
from pyspark.sql import functions as F

from runweave.llm import html_text, warc
from runweave.llm.html_text import page_blocks, repeated_classes, suffix_array
from runweave.llm.queries import op10_html_text
from runweave.storage import cut_lineage

PAGES = "page_id long, url string, html string, digest string, _key string, row_id long"


@pytest.fixture
def odd_pages(spark):
    rows = [
        (1, "http://a.example/x y\r\nEvil: 1", "<p>same</p>"),
        (2, None, "<p>same</p>"),
        (None, "http://a.example/", "<p>same</p>"),
        (3, "http://b.example/", None),
        (4, "http://b.example/", ""),
        (5, "http://b.example/", "\r\n\r\nWARC/1.1\r\n\r\né" + "x" * 50_000),
        (6, "http://b.example/", "<p>twice</p>"),
        (6, "http://b.example/", "<p>twice</p>"),
        (None, None, "<p>nobody's</p>"),
    ]
    return spark.createDataFrame([(*r, "d", "k", 0) for r in rows], PAGES)


# ---------------------------------------------------------------------- warc


def test_captures_of_odd_pages(spark, odd_pages):
    got = [r.capture for r in warc.captures(odd_pages).collect()]
    rows = odd_pages.collect()
    assert len(got) == len(rows)
    by = {}
    for c in got:
        by.setdefault(c.metadata.page_id, []).append(c)
    assert (by[1][0].answer.kind, by[2][0].answer.kind, by[2][0].metadata.refers_to) == ("response", "revisit", 1)
    assert by[2][0].answer.payload is None and by[1][0].answer.payload == "<p>same</p>"
    assert sorted((c.answer.kind, c.metadata.refers_to) for c in by[None]) == [("response", None), ("revisit", 1)]
    assert (by[3][0].answer.kind, by[4][0].answer.kind, by[4][0].metadata.refers_to) == ("response", "revisit", 3)
    assert [c.answer.kind for c in by[6]] == ["response", "response"]
    assert by[5][0].answer.payload == rows[5].html
    for c in got:
        page = next(r for r in rows if r.page_id == c.metadata.page_id and (c.metadata.page_id or r.html != "<p>same</p>" or c.metadata.refers_to))
        raw = (page.html or "").encode()
        assert c.answer.n_bytes == len(raw) and c.answer.digest == b32encode(hashlib.sha1(raw).digest()).decode()
        assert c.request.record_id != c.answer.record_id


def test_archives_are_warc_files(spark, odd_pages, tmp_path):
    path = str(tmp_path / "warc")
    warc.write_archives(odd_pages, path)
    records = [r for f in (tmp_path / "warc").glob("*.gz") for r in warc.parse_records(gzip.decompress(f.read_bytes()))]
    assert len(records) == 3 * odd_pages.count()
    ids = {f["warc-record-id"] for f, _ in records}
    assert len(ids) == len(records)
    assert all(f["warc-concurrent-to"] in ids for f, _ in records if f["warc-type"] in ("request", "metadata"))
    assert all("evil" not in f for f, _ in records)
    assert all(f["warc-profile"] == warc.PROFILE for f, _ in records if f["warc-type"] == "revisit")


def test_files_stay_small_whatever_the_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 1_000)
    monkeypatch.setattr(warc, "MAX_TASKS", 2)
    # A third of the pages are equal and have no id.
    html = F.when(F.col("id") % 3 == 0, "<p>same</p>").otherwise(F.concat(F.lit("<p>"), F.repeat(F.col("id").cast("string"), 20)))
    pages = spark.range(600).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("page_id"), F.lit("http://a.example/").alias("url"), html.alias("html"))
    path = tmp_path / "warc"
    warc.write_archives(pages, str(path))
    sizes = [len([1 for f, _ in warc.parse_records(gzip.decompress(f.read_bytes())) if f["warc-type"] == "metadata"]) for f in path.glob("*.gz")]
    assert sum(sizes) == 600 and len({f.name[:10] for f in path.glob("*.gz")}) <= 2
    total = sum(len(r.html) for r in pages.collect())
    assert max(sizes) <= 4 * 600 * 1_000 // total and len(sizes) > 2
    assert warc.assemble(warc.read_archives(spark, str(path))).count() == 600


def test_no_pages(spark, odd_pages):
    assert warc.captures(odd_pages.where("false")).count() == 0
    assert html_text.main_text(odd_pages.where("false")).count() == 0


def test_broken_payload_is_seen(spark, odd_pages, tmp_path):
    path = tmp_path / "warc"
    warc.write_archives(odd_pages.where("page_id = 1"), str(path))
    for f in path.glob("*.gz"):
        f.write_bytes(gzip.compress(gzip.decompress(f.read_bytes()).replace(b"<p>same", b"<p>some")))
    for f in path.glob(".*.crc"):
        f.unlink()
    with pytest.raises(Exception, match="digest"):
        warc.read_archives(spark, str(path)).count()


# ---------------------------------------------------------------------- html


def test_articles_of_the_tables(spark, tables):
    raw = {r.page_id: r.html for r in spark.read.parquet(f"{tables}/pages.parquet").collect()}

    def article(page):
        inner = page.split("<article>")[1].split("</article>")[0]
        inner = re.sub(r"</?b>", "", re.sub(r"<br>", " ", re.sub(r"</?(?:p|h1)>", "\x00", inner)))
        return "\n".join(x for b in inner.split("\x00") if (x := " ".join(html.unescape(b).split())))

    rows = op10_html_text(spark, tables).collect()
    assert len(rows) == len(raw)
    assert all(r.text == article(raw[r.page_id]) and r.n_chars == len(r.text) for r in rows)


@pytest.mark.parametrize(
    "page,want",
    [
        ("", []),
        ("just text", [(1, "just text")]),
        ("<article><h1>A &amp; B</h1><p>x<br>y  z<p>w</article>", [(3, "A & B"), (3, "x y z"), (3, "w")]),
        ("<article><nav>m</nav><p>x</p><div class='comments'>c<p>d</p></div><p>y</p></article>", [(0, "m"), (3, "x"), (0, "c"), (0, "d"), (3, "y")]),
        ("<header>h</header><main>t<aside>s</aside>u</main><footer>f", [(0, "h"), (2, "t"), (0, "s"), (2, "u"), (0, "f")]),
        ("<script>var t='</p>';</script>a<style>b</style><!-- c --><form>d</form>e", [(1, "a"), (0, "d"), (1, "e")]),
        ("<div class='ad'>x</div><p>a<b>b</b>c &#233;&nbsp;d</p>", [(0, "x"), (1, "abc é d")]),
        ("<article class='post ad'><header><h1>T</h1></header><div><p>open<article>in", [(3, "T"), (3, "open"), (3, "in")]),
        ("<a href='x>y'>link</a><p title=\"</p>\">t", [(1, "link"), (1, "t")]),
    ],
)
def test_blocks(page, want):
    assert page_blocks(page) == want


ART = "<article><p>text</p></article>"


@pytest.mark.parametrize(
    "page,want",
    [
        (f"<div class='no-sidebar'>{ART}</div>", [(3, "text")]),
        (f"<div id='content-with-sidebar'>{ART}<div class='left-sidebar'>s</div></div>", [(3, "text"), (0, "s")]),
        (f"<body><div class='modal-ready'><p>free</p></div>{ART}", [(1, "free"), (3, "text")]),
        (f"<form id='f'><input><div>menu</div>{ART}</form>", [(1, "menu"), (3, "text")]),
        ("<form><nav>m</nav><div>free</div><footer>f</footer></form>", [(0, "m"), (1, "free"), (0, "f")]),
        (f"<div class='modal'>{ART}</div>", [(3, "text")]),
        (f"<div class='modal'><main>a</main></div><div id='nav'><div itemprop='articleBody'>b</div></div>", [(2, "a"), (3, "b")]),
        (f"<article>whole</article><div class='related'>{ART}</div>", [(3, "whole"), (0, "text")]),
        (f"<p>free text of it</p><div class='related-posts'>{ART}</div>", [(1, "free text of it"), (0, "text")]),
        (f"<div id='comments'>{ART}</div>", [(0, "text")]),
        ("<article><section id='social'>a</section><div class='related-work'>b</div><div class='site-footer'>c</div>", [(3, "a"), (3, "b"), (0, "c")]),
        ("<div>a<select><option>o</div><p>b</p><select><option>o</select>c", [(1, "a"), (1, "b"), (1, "c")]),
        ("<p>a<svg><path/><text>t</text></p><p>b</p><svg><g></g></svg>c", [(1, "a"), (1, "b"), (1, "c")]),
        ("<p>a</p><canvas><p>b</p>c", [(1, "a"), (1, "b"), (1, "c")]),
        ("<p>a</p><noscript><div>n</div></noscript><template><p>t</p></template><object><p>o</p></object>b", [(1, "a"), (1, "b")]),
        ("<head><meta charset='x'><title>t</title><p>b</p>", [(1, "b")]),
        ("<div>a<svg><svg></svg><style>p{}</p></style></svg>b", [(1, "a b")]),
    ],
)
def test_no_article_is_lost(page, want):
    assert page_blocks(page) == want


@pytest.mark.parametrize("names", ["class='user-comments'", "class='readerComments'", "class='comment-thread'", "id='commentlist'", "class='article-sidebar'", "class='ad slot'"])
def test_comments_and_adverts_inside_an_article_go(names):
    assert page_blocks(f"<article><p>a</p><div {names}>no<p>no</p></div><p>b</p></article>") == [(3, "a"), (0, "no"), (0, "no"), (3, "b")]


@pytest.mark.parametrize(
    "page,want",
    [
        ("<article><p>a</p><p class='advert'>no<p>b</p></article>", [(3, "a"), (3, "b")]),
        ("<article><p>a <span class='ad'>no <b>no</b></span> b</p></article>", [(3, "a b")]),
        ("<article><ul><li>a<li class='sponsored'><p>no</p></li><li>b</ul></article>", [(3, "a"), (3, "b")]),
        ("<article><p>a</p><article class='comment-body'><p>no</p></article></article>", [(3, "a"), (0, "no")]),
        ("<article><pre>x <i class='hljs-comment'># kept</i></pre><h2 class='ad'>kept</h2></article>", [(3, "x # kept"), (3, "kept")]),
        ("<article><div class='no-comments'>a</div><div class='ad-free'>b</div><div class='commentary'>c</div></article>", [(3, "a"), (3, "b"), (3, "c")]),
        ("<div class='cookie-notice-overlay'>no</div><p>free", [(0, "no"), (1, "free")]),
        (f"<div class='page-with-ads'>{ART}</div><div class='ads-layout'>{ART}</div>", [(3, "text"), (3, "text")]),
        ("<p title=don't>it's</p>", [(1, "it's")]),
        ("<p class=\"a>b</p><p>c</p>", [(1, "b"), (1, "c")]),
        ("a < b <c", [(1, "a < b <c")]),
        ("a<!-- <p>no", [(1, "a")]),
        ("<p>a</p><script>if (a<b) no", [(1, "a")]),
    ],
)
def test_names_and_broken_tags(page, want):
    assert page_blocks(page) == want


@pytest.mark.parametrize(
    "part", ['<a href="', "<a ", "<svg><p>x", "<svg>", "<div>", "<!", "<title>", '<p class="a>t</p>', "<head>", "<select>", "<p class=ad>x", "<script>x</script>", "</p>", "<![CDATA["]
)
def test_pages_are_read_in_linear_time(part):
    began = time.process_time()
    page_blocks(part * (5_000_000 // len(part) // (1 if part in ('<a href="', "<a ", "<!", "<![CDATA[") else 4)))
    assert time.process_time() - began < 10


def test_repeated_rows_and_clashing_columns(spark, odd_pages):
    clash = [F.lit("x").alias(c) for c in ("row_id", "host", "text", "loose", "stream", "n_chars")]
    want = sorted(map(str, html_text.main_text(odd_pages).collect()))
    twice = odd_pages.select("*", *clash)
    got = sorted(map(str, html_text.main_text(twice.unionAll(twice)).collect()))
    assert got == sorted(want * 2)


def test_suffix_array_orders_by_tokens():
    rng = random.Random(1)
    tokens = [rng.randrange(1, 4) for _ in range(300)]
    import numpy as np

    for depth in (1, 2, 5, 6, 9):
        order, rank = suffix_array(np.array(tokens), depth)
        keys = [tuple((tokens + [0] * depth)[i : i + depth]) for i in range(300)]
        assert [keys[i] for i in order] == sorted(keys)
        assert all((keys[i] == keys[j]) == (rank[i] == rank[j]) for i in range(0, 300, 7) for j in range(300))


def test_classes_of_runs_equal_brute_force():
    rng = random.Random(2)
    streams = [[rng.choice("ab") for _ in range(rng.randrange(0, 40))] for _ in range(12)]
    want = {}
    for s, stream in enumerate(streams):
        for at in range(len(stream) - html_text.RUN + 1):
            want.setdefault(tuple(stream[at : at + html_text.RUN]), []).append((s, at))
    got = {run: (pages, sorted(spots)) for run, pages, spots in repeated_classes(streams)}
    assert got == {run: ({s for s, _ in spots}, sorted(spots)) for run, spots in want.items()}
    assert repeated_classes([]) == []


@pytest.mark.parametrize("chunk", [200_000, 25])
def test_boilerplate_of_a_host_goes_unique_runs_stay(spark, monkeypatch, chunk):
    monkeypatch.setattr(html_text, "CHUNK_TOKENS", chunk)
    menu = "<div>home about our company contact us now</div>"
    end = "<div>all rights of this page are reserved by us</div>"
    pages = [(i, f"http://h.example/{i}", f"{menu}<p>story{i} has words{i} of{i} its{i} own{i} here{i}</p>{end}") for i in range(12)]
    pages += [(50 + i, "http://copy.example/", "<p>one text that is on three pages of a host with the same words</p>") for i in range(3)]
    pages += [(60, None, None), (61, None, "<p>alone</p>"), (62, "http://h.example/", menu + "<article>kept</article>")]
    got = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"story{i} has words{i} of{i} its{i} own{i} here{i}" for i in range(12))
    assert all(got[50 + i] == "one text that is on three pages of a host with the same words" for i in range(3))
    assert (got[60], got[61], got[62]) == ("", "alone", "kept")


def test_text_around_articles_stays(spark):
    pages = [
        "<main><div>the text</div><article>card</article><article>other</article></main>",
        "<main><h1>title</h1><p>lead</p><article>story<nav>m</nav></article></main>",
        "<div>free text</div><article>card</article><p>end",
        "<main>short</main><div>free text</div>",
    ]
    df = spark.createDataFrame([(i, f"http://h{i}.example/", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_text.main_text(df).collect()}
    assert got == {0: "the text\ncard\nother", 1: "title\nlead\nstory", 2: "free text\ncard\nend", 3: "short\nfree text"}


def test_copies_are_dealt_once_and_only_where_a_page_waits(spark):
    menu = "<nav>one menu of the host with eight words</nav>"
    pages = [(i, "http://copy.example/", f"{menu}<article>story {i}</article>") for i in range(40)]
    pages += [(100 + i, "http://free.example/", f"{menu}<article>story {i}</article>") for i in range(40)]
    pages += [(200 + i, "http://free.example/", "<p>words of a page that has copies here</p>") for i in range(30)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    rows = cut_lineage(html_text._cut_pages(df), "cut-pages")
    streams = html_text._streams(rows).collect()
    assert sorted((r.host, r.waits) for r in streams) == [("free.example", False), ("free.example", True)]
    got = {r.page_id: r.text for r in html_text.main_text(df).collect()}
    assert all(got[200 + i] == "words of a page that has copies here" for i in range(30)) and len(got) == 110


@pytest.mark.parametrize("chunk", [200_000, 60])
def test_shared_sentences_in_free_text_stay(spark, monkeypatch, chunk):
    monkeypatch.setattr(html_text, "CHUNK_TOKENS", chunk)
    said = "a quotation of more than six words that many pages have in common"
    long = " ".join(f"licence{i}" for i in range(35))
    own = [f"page{i} tells {said} and goes on{i}" for i in range(20)]
    pages = [(i, "http://h.example/", f"<nav>one two three four five six seven</nav><p>{t}</p>") for i, t in enumerate(own)]
    pages = [(i, u, h + (f"<p>intro{i} {long} outro{i}</p>" if i < 12 else "") + (f"<p>{said}</p>" if i < 6 else "")) for i, u, h in pages]
    pages = [(i, u, h + ("<div>Home</div><div>About us</div><div>Our three offices</div>" if i > 3 else "")) for i, u, h in pages]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r.text.split("\n") for r in html_text.main_text(df).collect()}
    for i in range(20):
        # Six of twenty pages are too few for a block; the passage on twelve goes.
        want = [own[i]] + ([f"intro{i} outro{i}"] if i < 12 else []) + ([said] if i < 6 else [])
        assert got[i] == want
    # Four near-copies are no boilerplate of each other.
    few = spark.createDataFrame([(i, "http://f.example/", f"<p>{long}</p><p>{i}</p>") for i in range(4)], df.schema)
    assert {r.text for r in html_text.main_text(few).collect()} == {f"{long}\n{i}" for i in range(4)}


def test_sequences_of_whole_blocks():
    got = html_text.block_sequences([["a"] * 3, ["b"], ["c"] * 3, ["d"] * 7])
    assert got == {(0, 7, "a a a\nb\nc c c"), (3, 11, "b\nc c c\nd d d d d d d"), (4, 10, "c c c\nd d d d d d d"), (7, 7, "d d d d d d d")}
