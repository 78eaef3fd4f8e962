"""HTML text, WARC and top-k search against hand-made cases and brute force."""

import base64
import hashlib
import html as entities
import re
import time

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F

from agora.llm import html, queries, topk, warc
from agora.llm.shared import file_system, new_folder

SF = "/root/testdata/sf0.001"

CASES = [
    ("<p>a&amp;b <b>c</b>d<br>e\n\n f</p><p>g", "a&b cd e f g"),
    ("<body><nav>menu</nav><header>site</header><article><h1>T</h1><p>x<p>y<ul><li>one<li>two</ul></article><aside>side</aside><footer>f</footer>", "T x y one two"),
    ('<div id="content"><p>main text of the page here</p><div class="comment">nice!</div></div><div class="sidebar">s</div>', "main text of the page here"),
    ("<article>x<script>if (a<b) document.write('</p>')</script><style>p{}</style><!-- <p>no</p> -->y<form>q</form></article>", "xy"),
    ('<main><article class="comment">c</article><article><p>story</p><section id="comments">z</section></article></main>', "story"),
    ('<body class="has-sidebar"><article class="post with-comments"><header><p>by line</p><h1>T</h1></header>b &#233;&nbsp;x</article>', "T b é x"),
    ('<div class="cookie-notice">cookies</div><p>just a page</p><div role="search">s</div><p hidden>h</p>', "just a page"),
    ("<p title=it's>one</p><p title='a>b' alt=\"x>y\" q=it\"s>two</p>", "one two"), ("<p>wo<img src=x>rd</p>", "word"),
    ("<article>before<aside>side</aside>after<script>x</script>wards</article>", "before afterwards"),
    ("", ""), (None, ""), ("<", "<"), ("a < b & c", "a < b & c"), ("<div><script>never closed", ""),
    ("<div>" * 3000 + "deep" + "</div>" * 3000, "deep"),
]


@pytest.mark.parametrize("page,text", CASES)
def test_main_text(page, text):
    assert html.main_text(page) == text


LONG = "the story of the page is told here in more words than a card has"


@pytest.mark.parametrize("page,text", [
    (f"<main><p>{LONG}</p><article><p>a card</p></article></main>", f"{LONG} a card"),
    (f"<body><nav>menu</nav><p>{LONG}</p><article><p>a card</p></article><p>{LONG}</p></body>", f"{LONG} a card {LONG}"),
    (f"<body><header>site</header><main><article><p>one {LONG}</p></article><p>and</p><article><p>two</p></article></main><footer>f</footer></body>", f"one {LONG} and two"),
    (f"<body><article><h1>T</h1><p>{LONG}</p></article><article><p>two</p></article><article class='related'>z</article></body>", f"T {LONG} two"),
    (f"<body><div>{'<ul><li><a>menu entry</a></li></ul>' * 30}</div><article><p>short</p></article></body>", "short"),
    (f"<article><p>{LONG}</p><article><p>inner</p></article></article><p>side</p>", f"{LONG} inner"),
])
def test_the_article_is_what_has_the_text(page, text):
    assert html.main_text(page) == text


def test_very_deep_and_very_flat_pages_take_linear_time():
    began = time.perf_counter()
    for page in ("<div>" * 50_000 + "deep" + "</div>" * 50_000, "<article>" + "<p>flat" * 50_000 + "</article>", "<article>x</article>" * 20_000):
        assert html.subtrees(page) is not None and html.main_text(page)[:4] in ("deep", "flat", "x x ")
    assert time.perf_counter() - began < 20


@pytest.mark.parametrize("page", [
    "<a " * 330_000, "<a<b=\"" * 160_000, "<a " * 300_000 + "x=\">\"", "<p x='" * 160_000 + ">", "<i>" * 160_000 + "</b>" * 130_000, "<p><div>" + "<i>" * 160_000 + "<hr>" * 120_000,
    "<ul><li>x" * 110_000, "<div class=ad>" * 70_000 + "x", "<header><p>a</p>" * 60_000, "<article><header>" * 50_000, "<li>x" * 200_000, "<div class=related>x" * 50_000, "<!--" * 250_000, "<script>" * 120_000, "&amp" * 250_000,
])
def test_megabytes_of_odd_markup_take_linear_time(page):
    began = time.perf_counter()
    html.subtrees(page)
    html.main_text(page)
    assert time.perf_counter() - began < 10


def test_leads_and_prose_in_soft_boxes_stay():
    lead = "A lead paragraph that says in more than a line what the article is about."
    prose = "<p>" + "This section reads as prose and belongs to the article. " * 4 + "</p>"
    page = f"<article><header><h1>T</h1><p>By A. B.</p><p>{lead}</p><nav>n</nav></header><p>Body text.</p><div class=related-work><h2>Related work</h2>{prose}</div><div class=related><a href=x>other</a></div><div class=share>Share this</div></article>"
    want = f"T {lead} Body text. Related work " + " ".join(("This section reads as prose and belongs to the article. " * 4).split())
    assert html.main_text(page) == want
    assert html.main_text("<article>a<p title='x>b</p>c</article>") == "a b c" and html.main_text("<p>a <b") == "a <b"


def test_pages_of_the_table(spark):
    """These pages have one article of plain blocks; its text is what is left without tags."""
    for row in queries.op5_html_text(spark, SF).join(spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html"), "page_id").collect():
        article = re.search(r"<article>(.*)</article>", row.html, re.S)[1]
        want = " ".join(entities.unescape(re.sub(r"<(/?)(p|h1|br)[^>]*>", " ", re.sub(r"</?b>", "", article))).split())
        assert row.text == want and row.n_chars == len(want)


def test_site_templates_go_and_copied_articles_stay(spark):
    site = lambda n, body: (n, "http://Site.example:80/p", f"<body><div>Subscribe to all of our news today</div>{body}<div>All rights of this site</div></body>")
    rows = [site(n, f"<p>Own words number {n} of this page</p>") for n in range(12)]
    rows += [(100 + n, "http://other.example/", "<body><p>The very same page again and again</p></body>") for n in range(12)]
    rows += [(200 + n, "http://third.example/", f"<article><p>A passage on every page</p><p>and {n}</p></article>") for n in range(12)]
    rows += [(300, None, "<p>no host</p>"), (301, "", None), (301, "", None), (302, "x:/y", "")]
    pages = spark.createDataFrame([(*r, "old", 1) for r in rows], "page_id bigint, url string, html string, text string, template int")
    got = html.extract(pages)
    assert got.count() == len(rows) and set(got.columns) == set(pages.columns)
    text = {r.page_id: r.text for r in got.collect()}
    assert [text[n] for n in range(12)] == [f"Own words number {n} of this page" for n in range(12)]
    assert text[105] == "The very same page again and again" and text[203] == "A passage on every page and 3"
    assert text[300] == "no host" and text[301] == "" and text[302] == ""
    assert html.extract(pages.limit(0)).count() == 0


def test_recurring_boxes_inside_articles_go_and_copied_articles_stay(spark):
    box = "<div class='x1'><p>Get our letter each week</p></div>"
    prose = lambda k: "".join(f"<section><p>{k} part {j} of a long story told at length</p></section>" for j in range(4))
    rows = [(n, "http://a.example/", f"<article><h1>T{n}</h1><p>Story number {n} of this site is told here at some length</p>{box}<p>end {n}</p></article>") for n in range(12)]
    rows += [(100 + n, "http://b.example/", f"<article><h1>Copy {n}</h1>{prose('same')}</article>") for n in range(12)]
    rows += [(200 + n, "http://c.example/", f"<article><h1>Copy {n}</h1><div>{prose('same')}</div></article>") for n in range(12)]
    text = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    told = " ".join(f"same part {j} of a long story told at length" for j in range(4))
    assert [text[n] for n in range(12)] == [f"T{n} Story number {n} of this site is told here at some length end {n}" for n in range(12)]
    assert [text[100 + n] for n in range(12)] == [text[200 + n] for n in range(12)] == [f"Copy {n} {told}" for n in range(12)]


def test_a_template_does_not_depend_on_the_size_of_its_host(spark):
    menu = "<div><p>Menu of one section</p></div>"
    page = lambda n: f"<body>{menu if n < 6 else ''}<p>Own words number {n}</p></body>"
    pages = spark.createDataFrame([(n, "http://big.example/", page(n)) for n in [*range(200), *[3] * 40]], "page_id bigint, url string, html string")
    for some in (pages, pages.where("page_id < 25")):
        rows = html.extract(some.repartition(3)).collect()
        assert len(rows) == some.count() and all(r.text == f"Own words number {r.page_id}" for r in rows)


INNER = warc.page_record(77, "http://evil", b"inside", None, "2024-01-01T00:00:00Z").decode()
PAGES = [(1, "http://a/ b\r\n", "same"), (5, "u", "same"), (5, "u", "same"), (2, None, None), (3, "v", ""), (4, "w", INNER + "tail"), (6, "x", "WARC/1.1\r\nContent-Length: 5\r\n\r\nabc" * 40), (7, "y", "é" * 5000), (None, "z", "alone"), (None, "z", "same")]


@pytest.mark.parametrize("range_bytes", [64, 700, 1 << 20])
def test_warc_round_trip(spark, range_bytes):
    pages = spark.createDataFrame([(*p, 0) for p in PAGES], "page_id bigint, url string, html string, payload int")
    folder = new_folder(spark, "w")
    warc.write_warc(pages.coalesce(1), folder, file_bytes=9000)
    got = [(r.page_id, r.record_type, r.payload_digest, r.payload_bytes, None if r.payload is None else bytes(r.payload), r.refers_to) for r in warc.read_warc(spark, folder, range_bytes).collect()]
    newest = {}
    for i, _, h in PAGES:
        newest[h or ""] = max(newest.get(h or "", -1), -1 if i is None else i)
    want = []
    for i, _, h in PAGES:
        payload, top = (h or "").encode(), newest[h or ""]
        own = i == top or top < 0
        want.append((i, "response" if own else "revisit", base64.b32encode(hashlib.sha1(payload).digest()).decode(), len(payload), payload if own else None, None if own else top))
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_warc_reads_headers_of_any_length(spark):
    rows = [(1, "http://a/", "first"), (2, "http://long/" + "x" * 1_300_000, "long"), (3, "http://b/", "last")]
    folder = new_folder(spark, "w")
    warc.write_warc(spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1), folder)
    got = warc.read_warc(spark, folder, 1 << 18).collect()
    assert sorted((r.page_id, r.url, bytes(r.payload).decode()) for r in got) == rows


@pytest.mark.parametrize("piece", ["WARC/1.1\r\n", "WARC/1.1\r\nContent-Length: 9\r\n", "WARC/1.0\r\n\r\n", "\r\n\r\n", "\r\nContent-Length: 7\r\n"])
def test_payloads_full_of_magic_take_linear_time(spark, tmp_path, piece):
    payload = (piece * (1_000_000 // len(piece) + 1))[:1_000_000]
    records = [warc.page_record(n, "u", body.encode(), None, "2024-01-01T00:00:00Z") for n, body in enumerate(("a", payload, "b"))]
    data = b"".join(records)
    path = tmp_path / "one.warc"
    path.write_bytes(data)
    began, ends = time.perf_counter(), np.cumsum([0, *map(len, records)]).tolist()
    with pafs.LocalFileSystem().open_input_file(str(path)) as file:
        for start in range(0, len(data), 300_000):
            heads = warc._Heads(file, len(data), start, min(len(data), start + 300_000))
            next_of = {start + m.start(): heads.successor(start + m.start()) for m in warc.MAGIC.finditer(heads.buffer)}
            for at, after in zip(ends, ends[1:]):
                if start <= at < start + 300_000:
                    assert next_of[at] == after and heads.head(at).startswith(b"WARC/1.1\r\nWARC-Type: response")
    assert time.perf_counter() - began < 5


def test_warc_ranges_without_a_record_have_the_same_columns(tmp_path):
    data = b"".join(warc.page_record(n, "u", body, None, "2024-01-01T00:00:00Z") for n, body in enumerate((b"a", b"x" * 5000, b"b")))
    (tmp_path / "one.warc").write_bytes(data)
    cut = [("one.warc", len(data), start, min(len(data), start + 1000)) for start in range(0, len(data), 1000)]
    asked = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*cut)], names=["file", "size", "start", "end"])
    found = list(warc._candidates(str(tmp_path))(iter([asked])))
    assert 0 in [b.num_rows for b in found] and sum(b.num_rows for b in found) == 3
    assert len({b.schema.to_string() for b in found}) == 1


def test_warc_finds_a_broken_file(spark):
    folder = new_folder(spark, "w")
    manifest = warc.write_warc(spark.createDataFrame([(n, "u", f"page {n}") for n in range(50)], "page_id bigint, url string, html string").coalesce(1), folder)
    name = manifest.first().file
    fs, path = file_system(folder)
    with fs.open_input_file(f"{path}/{name}") as f:
        data = f.read()
    with fs.open_output_stream(f"{path}/{name}") as f:
        f.write(data.replace(b"Content-Length: 84", b"Content-Length: 83", 1) if b"Content-Length: 84" in data else data[:-9] + b"123456789")
    if b"Content-Length: 84" in data:
        with pytest.raises(ValueError, match="does not reach"):
            warc.read_warc(spark, folder, 512)
    empty = new_folder(spark, "w")
    warc.write_warc(spark.createDataFrame([], "page_id bigint, url string, html string"), empty)
    assert warc.read_warc(spark, empty).count() == 0


def test_top_k_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 64)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 2)
    monkeypatch.setattr(topk, "HEADS", 3)
    monkeypatch.setattr(topk, "FILES_BYTES", 5000)
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=6).astype("float32")]) for i in range(0, 600)]
    rows += [(1000 + i, rows[3][1]) for i in range(60)] + [(3, rows[3][1])]
    odd = [(700, None), (2000, [None] * 6), (2100, [float("nan")] * 6), (2200, [float("inf")] + [0.0] * 5), (None, [0.0] * 6), (3000, [1.0, 2.0]), (3001, [2.0, 1.0]), (4000, [])]
    table = spark.createDataFrame([(*r, 1) for r in rows + odd], "vec_id bigint, embedding array<float>, score int")
    v = {i: [int(np.floor(1024 * np.float64(np.float32(x)))) for x in e] for i, e in rows + odd[5:]}
    want = set()
    for q in (i for i in v if i % 100 == 0):
        scored = sorted((-sum(a * b for a, b in zip(v[q], e)), i) for i, e in v.items() if i != q and len(e) == len(v[q]))[:10]
        want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(scored)}
    assert {tuple(r) for r in topk.top_k(table, F.col("vec_id") % 100 == 0).collect()} == want
    assert topk.top_k(table.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_search_stops_early_and_stays_exact():
    rng = np.random.default_rng(2)
    centres = rng.integers(-900, 900, (20, 16))
    c = np.repeat(centres, 100, axis=0) + rng.integers(-20, 20, (2000, 16))
    pivots = topk.choose_pivots(c[::50].tolist(), 16)[16]
    apart = lambda x: np.stack([np.linalg.norm(x - p, axis=1) for p in pivots], axis=1)
    ids = np.arange(2000)
    for own, found, scores in topk.search_block(ids[:5], c[:5], apart(c[:5]), ids, c, apart(c), 10):
        exact = c @ c[own]
        order = [i for i in np.lexsort((ids, -exact)) if i != own][:10]
        assert list(found) == order and list(scores) == list(exact[order])
