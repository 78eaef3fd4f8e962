"""Elements of pages leave in bounded batches, and records are told from one reading of a page."""

import pyarrow as pa
import pytest

from agora.plans import landings
from agora.sources import pages


def test_batches_of_elements_are_bounded():
    batch = pa.RecordBatch.from_pydict({"page": list(range(6)), "html": ["<p>x</p>" * 7_000] * 5 + [None]})
    made = list(pages._chunks(iter([batch]), frozenset({"p"}), ("div",), True))
    assert sum(m.num_rows for m in made) == 5 * 14_000 and max(m.num_rows for m in made) <= pages.CHUNK_ROWS
    assert [m.column("page")[0].as_py() for m in made] == [0, 0, 1, 2, 2, 3, 4]


ROW = lambda *cells: "<tr>" + "".join(c if c.startswith("<t") else f"<td>{c}</td>" for c in cells) + "</tr>"
LINK = "<a class=c-board-title href='?articleNo={}'>{}</a>"
BOARD = "<table>" + ROW("1", LINK.format(7, "A") + LINK.format(7, "B"), "Desk", "2024.01.02") + ROW(LINK.format(8, "C")) + "</table>"
BILL = "<td class=subject><a href='/gcom/nsmLmSts/out/{}/detailRP'>{}</a></td>"
BILLS = "<table>" + ROW("<td data-th=의안번호>1234567</td>", "<td data-th=의안번호>none</td>", BILL.format(1234567, "X")) + "</table>" + BILL.format(7654321, "loose")
HEADS = "<table>" + ROW("<th>a</th>", "1", "<th>b</th>", "<th>c</th>", "2") + ROW("<th>a</th>", "3") + "</table>"
PARTIES = "<table>" + ROW("P", "d", "Kim, Lee", "x") + ROW("Q", "d") + "</table>"


@pytest.mark.parametrize(
    "read, html, wanted",
    [
        (pages.listing, BOARD, [("7", "B", "Desk"), ("8", "C", None)]),
        (pages.bills, BILLS, [("1234567", "X", "broken"), ("1234567", "X", "broken"), ("7654321", "loose", "broken")]),
        (pages.headed_fields, HEADS, [("a", "3"), ("c", "2")]),
        (pages.party_leaders, PARTIES, [(1, "P", "d", "대표", "Kim"), (1, "P", "d", "대표", "Lee")]),
    ],
)
def test_one_reading_of_a_page(spark, html, read, wanted):
    page = spark.createDataFrame([(1, html)], "page int, html string")
    df = read(pages.elements(page, "page", "html", ("a", "td", "th"), above=("tr",)), "page").drop("page", "published")
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(wanted, key=repr)
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("MapInArrow") == 1


def test_references_that_are_not_closed_are_text(spark, tmp_path):
    page = "<article><h1>a &amp;&amp</h1><p>b &lt; &#65 c</p></article>"
    spark.createDataFrame([(1, page)], "page_id bigint, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert [tuple(r) for r in landings.article_segments(spark, str(tmp_path)).collect()] == [(1, "a &&amp b < &#65 c", 2, True)]


def test_plain_markup_is_read_without_the_parser_and_alike(monkeypatch):
    plain = ["", "<p>a &amp; b\n c<p class=x>d</p>", "<table><tr><td id='q r'>1</td><td data-a=\"2\">x<br>\ny</td></tr></div>z", "<p>a&ltb</p>", "<a href='/q?x=1'> </a> end"]
    other = ["<p>a</p>&lt", "<P>a</p>", "<br/>a", "a < b<p>c", "<script>x<p></script><p>y", "<!-- <p> --><p>z", "<p a='1&amp;2' b>c", "<title>x<b></title>", "<p"]
    read = lambda page: list(pages._Elements(page, frozenset(("p", "td")), ("tr",), True))
    found = {page: read(page) for page in plain + other}
    with monkeypatch.context() as m:
        m.setattr(pages._Elements, "_plain", lambda self, page: False, raising=False)
        assert found == {page: read(page) for page in plain + other}
    monkeypatch.setattr(pages._Elements, "feed", lambda self, page: pytest.fail("the parser was asked"))
    assert [read(page) for page in plain] == [found[page] for page in plain]
