"""Selectors, profiles and segments against plain walks over the same pages."""

import random
import time

import pytest

from agora.sources import pages, profiles, segments, selectors


def random_page(rng):
    parts, open_ = [], []
    for _ in range(rng.randrange(5, 60)):
        roll = rng.random()
        if roll < 0.5 or not open_:
            tag = rng.choice(["div", "p", "ul", "li", "section", "h1"])
            attributes = rng.choice(["", " class=a", " class='a b'", " id=x", " class=b data-k='v w'", " data-k=vw"])
            parts.append(f"<{tag}{attributes}>")
            open_.append(tag)
        elif roll < 0.8:
            parts.append(f"</{rng.choice(open_) if rng.random() < 0.2 else open_[-1]}>")
            open_.pop()
        else:
            parts.append(rng.choice([" text &amp; more ", "<br>", "<img class=a alt=n>", "<!-- c -->", "</nothing>", "\n"]))
    return "".join(parts)


SELECTORS = ["div", ".a", "div.a.b", "div p", "div > p", ".a .b li", "section > div > .a, h1", "#x *", "[data-k]", "[data-k=vw]", "p[data-k~='w']", "[data-k^=v]", "[data-k$='w']", "[data-k*=' ']", "* > li"]


def plain(rows, selector):
    """Ids by walking up the parents."""
    by_id = {r.id: r for r in rows}

    def fits(r, step):
        attributes = r.attributes
        _, _, _, _, _, tag, id_, classes, held = step
        value = lambda n: attributes.get(n)
        ops = {"": lambda v, s: True, "=": lambda v, s: v == s, "~=": lambda v, s: s in v.split(), "^=": lambda v, s: v.startswith(s), "$=": lambda v, s: v.endswith(s), "*=": lambda v, s: s in v}
        return (tag is None or r.tag == tag) and (id_ is None or value("id") == id_) and set(classes) <= set((value("class") or "").split()) and all(value(n) is not None and ops[op](value(n), s) for n, op, s in held)

    def found(r, chain):
        if not fits(r, chain[-1]):
            return False
        if len(chain) == 1:
            return True
        up = by_id.get(r.parent)
        if chain[-1][4]:
            return up is not None and found(up, chain[:-1])
        while up is not None:
            if found(up, chain[:-1]):
                return True
            up = by_id.get(up.parent)
        return False

    parsed = selectors.steps(selector)
    chains = [[s for s in parsed if s[1] == k] for k in sorted({s[1] for s in parsed})]
    return sorted(r.id for r in rows if r.tag != pages.TEXT and any(found(r, c) for c in chains))


@pytest.fixture(scope="module")
def trees(spark):
    rng = random.Random(11)
    bodies = [(i, "one" if i % 2 else "two", random_page(rng)) for i in range(40)] + [(40, "one", ""), (41, "one", None), (42, "two", "<div class=a><p>x")]
    read = spark.createDataFrame(bodies, "page int, spec string, html string")
    return bodies, pages.elements(read, ["page", "spec"], "html", ("p",), above=("div",), texts=True).cache()


def test_intervals_and_places(trees):
    bodies, tree = trees
    source = {i: h for i, _, h in bodies}
    rows = {}
    for r in tree.collect():
        rows.setdefault(r.page, []).append(r)
    assert set(rows) == {i for i, _, h in bodies if h}
    for page, found in rows.items():
        found.sort(key=lambda r: r.id)
        assert [r.id for r in found] == list(range(len(found)))
        for r in found:
            below = [x.id for x in found if x.id != r.id and up(found, x, r.id)]
            assert below == list(range(r.id + 1, r.last + 1))
            assert source[page][r.at :].startswith(f"<{r.tag}") or r.tag == pages.TEXT
            assert r.at < r.upto <= len(source[page])
            around = [x.id for x in found if x.tag == "div" and up(found, r, x.id)]
            assert r.above.get("div") == (max(around) if around else None)
            if r.tag == "p":
                assert r.text == " ".join(x.text for x in found if x.tag == pages.TEXT and r.id < x.id <= r.last)


def up(rows, r, ancestor):
    while r.parent is not None:
        r = rows[r.parent]
        if r.id == ancestor:
            return True
    return False


def test_selectors_equal_a_walk(spark, trees):
    _, tree = trees
    asked = spark.createDataFrame([(s, f"f{i}", c) for s in ("one", "two") for i, c in enumerate(SELECTORS) if not (s == "two" and i % 3 == 0)], "spec string, field string, selector string")
    got = {}
    for r in selectors.select(tree, ["page", "spec"], asked, selectors.table(spark, SELECTORS)).select("page", "field", "id").collect():
        got.setdefault((r.page, r.field), []).append(r.id)
    rows, some = {}, 0
    for r in tree.collect():
        rows.setdefault((r.page, r.spec), []).append(r)
    for (page, spec), found in rows.items():
        for i, selector in enumerate(SELECTORS):
            want = [] if spec == "two" and i % 3 == 0 else plain(found, selector)
            assert sorted(got.get((page, f"f{i}"), [])) == want, (page, selector)
            some += len(want)
    assert some > 400


@pytest.mark.parametrize("bad", ["", "div >", "> p", "a:hover", "p,,q", "#a#b", "a[", "a > > b"])
def test_what_is_no_selector(bad):
    with pytest.raises(ValueError):
        selectors.steps(bad)


@pytest.mark.parametrize("page", ["<div class=a>" * 60_000, "<i>" * 60_000 + "</b>" * 60_000, "<ul><li>" * 30_000, "<p>x</p>\n" * 60_000, "<tr><td>x" * 40_000])
def test_odd_pages_take_linear_time(page):
    began = time.perf_counter()
    assert len(pages._Elements(page, frozenset(), ("tr",), True).found()) >= 40_000
    assert time.perf_counter() - began < 8


NAMED = dict(spec="a", url="https://x.go.kr/a", expected_name="홍길동", position="시장", name_selector="h1.n", context_selector="p.c")
CASES = [
    ("<h1 class=n>홍 길 동</h1><p class=c>시장 홍길동</p>", {}, "success"),
    ("<h1 class=n>홍길동</h1><h1 class=n>홍길동</h1><p class=c>시장 홍길동</p>", {}, "markup_changed"),
    ("<h1 class=n>김철수</h1><p class=c>시장 홍길동</p>", {}, "identity_changed"),
    ("<h1 class=n>새홍길동님</h1><p class=c>시장 홍길동</p>", {}, "name_surface_review_required"),
    ("<h1 class=n>홍길동</h1><p class=c>시장</p>", {}, "attribute_review_required"),
    ("<h1 class=n title=홍길동>x</h1><p class=c>시장 홍길동</p>", {"name_attribute": "title"}, "attribute_review_required"),
    ("<h1 class=n>시장 홍길동</h1><p class=c>현 시장 홍길동 약력</p>", {"name_template": "시장 {name}"}, "success"),
    ("<h1 class=n>시장홍길동</h1><p class=c>현 시장 홍길동 약력</p>", {"name_template": "시장 {name}"}, "name_surface_review_required"),
    ("<table><caption>현직</caption><tr><td><h1 class=n>홍길동</h1><p class=c>시장 홍길동</p></td></tr></table>", {"caption_selector": "caption"}, "success"),
    ("<caption>현직</caption><table><tr><td><h1 class=n>홍길동</h1><p class=c>시장 홍길동</p></td></tr></table>", {"caption_selector": "caption"}, "markup_changed"),
    ('{"d": {"h": "<h1 class=n>홍길동</h1><p class=c>시장 홍길동</p>"}}', {"json_text_path": ("d", "h")}, "success"),
    ('{"d": 1}', {"json_text_path": ("d", "h")}, "failed"),
    (None, {}, "failed"),
    ("", {}, "markup_changed"),
]
LISTED = dict(spec="a", url="https://x.go.kr/a", expected_name="홍길동", position="시장", json_list_path=("d", "l"), json_name_field="NM", json_position_field="POS")
LISTS = [
    ('{"d": {"l": [{"NM": "x"}, {"NM": "홍길동", "POS": "시장"}, 5]}}', "success"), ('{"d": {"l": [{"NM": "홍길동", "POS": "의원"}]}}', "role_changed"), ('{"d": {"l": [{"NM": "홍길동"}]}}', "role_changed"),
    ('{"d": {"l": []}}', "identity_changed"), ('{"d": {"l": [{"NM": "홍길동", "POS": "시장"}, {"NM": "홍길동", "POS": "의원"}]}}', "ambiguous_identity"), ('{"d": {"l": {"NM": "홍길동"}}}', "failed"), ("{", "failed"), (None, "failed"),
    ('{"d": {"l": [' + ",".join(['{"NM": "x"}'] * 2001) + "]}}", "failed"),
]


def test_all_outcomes_of_profiles(spark):
    specs = [profiles.Profile(**NAMED | more | {"spec": f"p{i}"}) for i, (_, more, _) in enumerate(CASES)] + [profiles.Profile(**LISTED | {"spec": f"l{i}"}) for i in range(len(LISTS))]
    read = [(i, f"p{i}", body) for i, (body, _, _) in enumerate(CASES)] + [(100 + i, f"l{i}", body) for i, (body, _) in enumerate(LISTS)] + [(999, "unknown", "x")]
    found = profiles.observe(spark.createDataFrame(read, "page int, spec string, body string"), profiles.table(spark, specs)).collect()
    assert {r.spec: r.status for r in found} == {f"p{i}": s for i, (_, _, s) in enumerate(CASES)} | {f"l{i}": s for i, (_, s) in enumerate(LISTS)}
    assert {r.status for r in found} == {"success", "markup_changed", "identity_changed", "ambiguous_identity", "role_changed", "name_surface_review_required", "attribute_review_required", "failed"}
    by = {r.spec: r for r in found}
    assert by["p8"].context == "현직 홍길동 시장 홍길동".replace("홍길동 시장", "시장", 1) and by["p8"].locator == "html:caption + p.c"
    assert by["p10"].locator == "json:/d/h|html:p.c" and by["p10"].format == "json" and by["l0"].locator == "JSON $.d.l[1] fields NM,POS"
    assert by["l0"].record_id.startswith("provisional-profile:") and by["p1"].record_id is None and by["p0"].surface == "홍길동"


def test_equal_bodies_of_a_profile_are_read_once(spark, monkeypatch):
    specs = [profiles.Profile(**NAMED), profiles.Profile(**NAMED | {"spec": "b", "expected_name": "김철수"}), profiles.Profile(**LISTED | {"spec": "c"})]
    read = [(i, "abcd"[i % 4], (CASES[0][0], None, CASES[2][0])[i % 3]) for i in range(120)]
    counts, kept = [], profiles.landed
    monkeypatch.setattr(profiles, "landed", lambda df, path: (lambda d: (counts.append(d.count()), d)[1])(kept(df, path)))
    found = profiles.observe(spark.createDataFrame(read, "page int, spec string, body string"), profiles.table(spark, specs)).collect()
    want = {"a": ("success", "failed", "identity_changed"), "b": ("identity_changed", "failed", "attribute_review_required"), "c": ("failed",) * 3}
    assert {r.page: r.status for r in found} == {i: want[s][i % 3] for i, s, _ in read if s != "d"} and len(found) == 90
    assert counts[0] == 9 and max(counts) < 90


@pytest.mark.parametrize("change", [{"name_selector": None}, {"name_selector": "a:b"}, {"name_attribute": "href"}, {"name_template": "x {name}"}, {"spec": "a b"}, {"json_text_path": ("a.b",)}, {"json_list_path": ("l",)}, {"expected_name": ""}])
def test_profiles_that_are_refused(change):
    with pytest.raises(ValueError):
        profiles.Profile(**NAMED | change)
    for fields in ({"json_name_field": "TEL_NO"}, {"json_position_field": "NM"}, {"name_selector": "p"}):
        with pytest.raises(ValueError):
            profiles.Profile(**LISTED | fields)


def test_segments_map_back_to_their_source(spark):
    body = "<nav><p>menu</p></nav><main><p>One <b>two</b></p><ul><li>three<p>four</p></li><li> </li></ul><script>x</script><footer><p>f</p></footer></main><article>alone <i>text</i></article><main><tr>r</tr></main>"
    read = spark.createDataFrame([(1, body), (2, None), (3, "<p>outside</p>"), (4, "<main></main>")], "id int, html string")
    got = sorted(map(tuple, segments.html_segments(read, "id", "html").select("id", "container", "block", "text", "locator", "at", "upto").collect()))
    assert [g[:4] for g in got] == [(1, 0, 0, "One two"), (1, 0, 1, "three four"), (1, 1, 0, "alone text"), (1, 2, 0, "r")]
    assert [body[a:b] for *_, a, b in got] == ["<p>One <b>two</b>", "<li>three<p>four</p>", "<article>alone <i>text</i>", "<tr>r"]
    assert got[0][4] == "html:main, article:container[0]:block[0]"
    data = spark.createDataFrame([(1, '{"a": {"b": 1.5}, "c": "x", "d": true, "e": null, "f": []}'), (2, "{"), (3, None)], "id int, raw string")
    assert sorted(tuple(r) for r in segments.json_segments(data, "id", "raw", ["c", "a.b", "d", "e", "f", "a", "a.b.c"]).collect()) == [(1, 0, "x", "json:c"), (1, 1, "1.5", "json:a.b")]


def test_first_title_and_body_count(spark):
    read = spark.createDataFrame([(1, "s", "<h1>a</h1><h1>b</h1><div class=t>c</div><div class=t>d</div>", None, None), (2, "s", "<h1>a</h1>", None, "x"), (3, "s", None, None, "x")], "page int, source string, html string, listed timestamp_ntz, agency string")
    got = {r.page: (r.status, r.title, r.body, r.published, r.agency) for r in segments.details(read, [segments.Detail("s", "h1", "time", ".t")]).collect()}
    assert got == {1: ("ok", "a", "c", None, None), 2: ("structure_missing", "a", None, None, "x"), 3: ("structure_missing", None, None, None, "x")}
