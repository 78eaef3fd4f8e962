"""Main text of HTML pages, with site templates removed.

Every page is parsed to a tree.  Each block element's subtree has a hash of its tags, class, id and text.  Spark
counts, per host, on how many different pages a subtree occurs; a subtree on ``least_pages`` of them, however many the
host has, is part of the site's template and is deleted wherever it recurs on that host.  Pages that are whole copies of each other count once.

Inside the page's own article, copied prose is protected: paragraphs, headings, quotes and cells are never taken out by
themselves unless they are mostly links; a box (any other block) with at least half of the article's text is not counted,
and any other box counts once per longest text outside of it, so copies of an article, also with small changes, count
once.  A box that recurs in different articles of the host is template, whatever its share of links.

Beside templates, elements that HTML itself or their class, id or role marks as navigation, header, footer, sidebar,
notice, advert, form, script, style or reader comments go.  What is left of the article is the text: character references
decoded, white space in a block made one space, blocks joined by one space in page order.  The article is the ``article``
element, or the least element around all of several; else ``main``; else the element that its class or id marks as
content; each only if it has at least half of the text of the page that is neither boilerplate nor template.  If none
has, the whole body is the text.

Defined results: a null or empty html, or one with no text, gives an empty text.  A page without a host has no site and
no template.  Repeated rows are pages of their own.  An empty table gives an empty table.  All columns of the input are
kept; an added column replaces one of its name.
"""

from __future__ import annotations

import html as entities
import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from .shared import HOT_SHARE, join_spread, new_folder, written

# Names of HTML elements by what they are, and words that mark boilerplate in class, id and role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
DROPPED = RAW | frozenset("head template svg math object embed canvas audio video map nav footer aside form button select input datalist dialog menu fieldset".split())
#: Of what is dropped, elements that stand inside a line and so part no words.
IN_LINE = INLINE | frozenset("script style noscript template svg math object embed canvas audio video map iframe button input select datalist".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SCOPE = frozenset("html body article main section aside nav header footer div table td th tr ul ol dl li dd dt blockquote form figure fieldset button caption".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd td th tr tbody thead tfoot caption figcaption summary address center hgroup header main html body br".split())
LISTS = frozenset("ul ol dl table menu select datalist body html".split())
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promos promotion banner banners nav navbar"
    " navigation navi menu menus submenu breadcrumb breadcrumbs sidebar sidebars sidenav aside rail widget widgets footer foot"
    " masthead topbar cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe"
    " subscription signup login paywall share sharing sharebar social related recommended recommendations comment comments"
    " commentlist disqus reply replies respond responses discussion toolbar pagination pager skip copyright search searchbox".split()
)
ARTICLE_MARKS = frozenset("ad ads advert advertisement sponsored promo comment comments reply replies related teaser".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
CONTENT = frozenset("content article articlebody post entry story maincontent".split())

#: Marks of boxes that may be prose: inside of an article such a box stays if it has SOFT_LETTERS or more that are mostly no links.
SOFT = frozenset("related recommended recommendations discussion search copyright skip social share sharing".split())
SOFT_LETTERS = 200
#: A paragraph in an article's own header with so many letters is a lead, not a line of names and dates.
LEAD_LETTERS = 60

SPREAD_PAGES = 4096

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*+)>|[^<]+|<", re.S)
#: The same for what follows a tag whose quotes reach the end of the page: quotes mean nothing, a tag ends at the next bracket.
_BROKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)>|[^<]+|<", re.S)
_OPENS = re.compile(r"</?[a-zA-Z]")
_ATTRIBUTE = re.compile(r"([^\s=/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_WORDS = re.compile(r"[a-z0-9]+")


class Node:
    __slots__ = ("tag", "attributes", "children", "hash", "letters", "linked", "holds", "gone")

    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag, self.attributes, self.children = tag, attributes, []
        self.hash = self.letters = self.linked = 0
        self.holds = self.gone = False


def parse(html: str) -> Node:
    """The element tree of a page; contents of scripts, styles and the like are left out."""
    root = Node("#root", {})
    stack = [root]
    at, end, last = 0, len(html), html.rfind(">")
    token_of, places = _TOKEN, {"#root": [0]}

    def top(tags) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    def close(tags, within) -> None:
        """Ends the innermost open element of ``tags``, and what is in it, unless one of ``within`` is around it."""
        k = top(tags)
        if k and k >= top(within):
            for node in stack[k:]:
                places[node.tag].pop()
            del stack[k:]

    while at < end:
        if at > last and _OPENS.match(html, at):  # no tag ends any more
            stack[-1].children.append("<")
            at += 1
            continue
        token = token_of.match(html, at)
        if token_of is _TOKEN and token[0] == "<" and _OPENS.match(html, at):
            token_of = _BROKEN  # its quotes reach the end
            continue
        at = token.end()
        name = token[2]
        if name is None:
            if (text := token[0])[0] != "<" or text == "<":
                stack[-1].children.append(entities.unescape(text) if "&" in text else text)
            continue
        name = name.lower()
        if token[1]:
            if name == "p" or name in INLINE:
                close((name,), SCOPE)
            else:
                close((name,), ("html",) if name in ("body", "html") else ("body",))
            continue
        if name in ("html", "body") and places.get(name):
            continue
        if name == "body":
            close(("head",), ())
        if name in CLOSES_P:
            close(("p",), SCOPE)
        if name in SIBLINGS:
            close(SIBLINGS[name], LISTS)
        attributes = {}
        if token[3]:
            for k, a, b, c in _ATTRIBUTE.findall(token[3]):
                attributes.setdefault(k.lower(), entities.unescape(a or b or c))
        node = Node(name, attributes)
        stack[-1].children.append(node)
        if name in RAW:
            found = re.compile(rf"</{name}\b[^>]*>?", re.I).search(html, at)
            at = found.end() if found else end
        elif name not in VOID and not token[3].endswith("/"):
            places.setdefault(name, []).append(len(stack))
            stack.append(node)
    return root


def _marks(node: Node) -> set[str]:
    names = f"{node.attributes.get('class', '')} {node.attributes.get('id', '')}".lower().split()
    return {w for n in names if not n.startswith(("has-", "with-", "no-", "is-")) for w in _WORDS.findall(n)}


def _boilerplate(node: Node) -> bool:
    """What an element by itself is; ``holds`` must be known: whether it has an article or main element that is none."""
    tag, attributes = node.tag, node.attributes
    if tag in DROPPED:
        return True
    if not attributes or tag in ("html", "body", "main"):
        return False
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", attributes.get("style", ""), re.I):
        return True
    marks = _marks(node)
    if tag == "article":
        return bool(marks & ARTICLE_MARKS)
    if attributes.get("role", "").lower() in ROLES:
        return True
    return bool(marks & MARKS) and not node.holds


def _prose(node: Node) -> bool:
    """A box inside of an article that only its soft marks call boilerplate, and that reads as prose."""
    return bool(node.attributes) and node.tag not in DROPPED and _marks(node) & MARKS <= SOFT and node.letters >= SOFT_LETTERS and 2 * node.linked <= node.letters and "hidden" not in node.attributes and node.attributes.get("aria-hidden") != "true" and "none" not in node.attributes.get("style", "").lower() and node.attributes.get("role", "").lower() not in ROLES


def walk(node: Node):
    """A node and all below it, parents first."""
    stack = [node]
    while stack:
        own = stack.pop()
        yield own
        stack.extend(c for c in reversed(own.children) if type(c) is not str)


def digest(root: Node) -> None:
    """Sets hash, letters, letters in links, and what is boilerplate, of every subtree, children first."""
    from xxhash import xxh64_intdigest

    for node in reversed(list(walk(root))):
        parts, letters, linked = [node.tag, node.attributes.get("class", ""), node.attributes.get("id", "")], 0, 0
        for child in node.children:
            if type(child) is str:
                text = " ".join(child.split())
                parts.append(text)
                letters += len(text)
            else:
                parts.append(f"\x1f{child.hash:016x}")
                letters += child.letters
                linked += child.linked
                node.holds = node.holds or child.holds or (child.tag in ("article", "main") and not child.gone)
        node.letters, node.linked = letters, linked + (letters if node.tag == "a" else 0)
        node.gone = _boilerplate(node)
        node.hash = xxh64_intdigest("\x1e".join(parts).encode("utf-8", "replace"))


def _letters(root: Node, template: frozenset[int]) -> dict[int, int]:
    """Letters of each node (by its id) without boilerplate, headers, lists of links and templates below it."""
    own: dict[int, int] = {}
    nodes, stack = [], [root]
    while stack:
        node = stack.pop()
        nodes.append(node)
        stack.extend(c for c in node.children if type(c) is not str and not (c.gone or c.tag == "header" or c.hash in template))
    for node in reversed(nodes):
        letters = sum(len(" ".join(c.split())) if type(c) is str else own.get(id(c), 0) for c in node.children)
        own[id(node)] = 0 if node.tag in ("ul", "ol") and 2 * node.linked > node.letters else letters
    return own


def main_element(root: Node, template: frozenset[int] = frozenset()) -> Node | None:
    """The element that the page itself says is the article, if at least half of the page's own text is in it.

    Of several articles with text none inside another, it is the least element around them all.
    """
    letters = _letters(root, template)
    total = letters[id(root)]
    articles, mains, marked = [], [], []
    stack: list[tuple[Node, tuple, bool]] = [(root, (), False)]
    while stack:
        node, above, within = stack.pop()
        if not letters.get(id(node)):
            continue
        if node.tag == "article":
            if not within:
                articles.append((*_path(above), node))
            within = True
        elif node.tag == "main" or node.attributes.get("role", "").lower() == "main":
            mains.append(node)
        elif node.attributes and node.tag not in ("html", "body") and _marks(node) & CONTENT:
            marked.append(node)
        stack.extend((c, (above, node), within) for c in reversed(node.children) if type(c) is not str)
    around = None
    for level in zip(*articles):
        if any(n is not level[0] for n in level):
            break
        around = level[0]
    for best in (around, max(mains, key=lambda n: letters[id(n)], default=None), max(marked, key=lambda n: letters[id(n)], default=None)):
        if best is not None and best.tag not in ("#root", "html", "body") and 2 * letters[id(best)] >= total:
            return best
    return None


def _path(above: tuple) -> list[Node]:
    """Nodes from the root down, of a chain of (chain, node)."""
    found = []
    while above:
        above, node = above
        found.append(node)
    return found[::-1]


def _articles(root: Node) -> list[Node]:
    """The outermost articles of a page without a main element; their prose is protected as that of a main element."""
    found, stack = [], [root]
    while stack:
        node = stack.pop()
        if node.gone:
            continue
        if node.tag == "article" and node.letters:
            found.append(node)
        else:
            stack.extend(c for c in node.children if type(c) is not str)
    return found


def _boxes(main: Node) -> dict[int, int]:
    """Hashes of the boxes inside an article, with the hash of the longest text outside of each."""
    from xxhash import xxh64_intdigest

    texts, spans, stack = [], [], [(main, False)]
    begins: list[int] = []
    while stack:  # each text and each box takes its place in page order; a box spans the texts from begin to end
        node, done = stack.pop()
        if type(node) is str:
            if text := " ".join(node.split()):
                texts.append((len(text), text))
        elif done:
            spans.append((node, begins.pop(), len(texts)))
        else:
            if node is not main and node.letters and node.tag not in PROSE and node.tag not in INLINE and node.tag not in RAW:
                begins.append(len(texts))
                stack.append((node, True))
            stack.extend((c, False) for c in reversed(node.children))
    before, after = [(0, "")], [(0, "")]
    for text in texts:
        before.append(max(before[-1], text))
    for text in reversed(texts):
        after.append(max(after[-1], text))
    found = {}
    for node, begin, end in spans:
        if 2 * node.letters < main.letters:
            longest = max(before[begin], after[len(texts) - end])[1]
            found[node.hash] = xxh64_intdigest(longest.encode("utf-8", "replace"))
    return found


def subtrees(html: str | None) -> dict[int, int]:
    """Hashes of a page's block subtrees with text, each with the hash of what counts once: outside of the article the
    whole page, inside of it the longest text outside of the subtree."""
    root = parse(html or "")
    digest(root)
    main, stack = main_element(root), [root]
    inside = _articles(root) if main is None else [main]
    found = {h: k for n in inside for h, k in _boxes(n).items()}
    holders, ends = set(), {id(n) for n in inside}
    for node in reversed(list(walk(root))):  # children first
        if id(node) in ends or any(type(c) is not str and id(c) in holders for c in node.children):
            holders.add(id(node))
    while stack:
        node = stack.pop()
        if id(node) in ends or node.tag in ("head", *RAW):
            continue
        if node.letters and node.tag not in INLINE and node.tag not in ("#root", "html", "body") and id(node) not in holders:
            found[node.hash] = root.hash
        stack.extend(c for c in node.children if type(c) is not str)
    return found


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _told(header: Node) -> list[Node]:
    """Headings, and paragraphs of LEAD_LETTERS or more that are mostly no links, in an article's header, in page order."""
    found, stack = [], [header]
    while stack:
        node = stack.pop()
        if re.fullmatch("h[1-6]", node.tag) or (node.tag in ("p", "blockquote") and node.letters >= LEAD_LETTERS and 2 * node.linked <= node.letters and not node.gone):
            found.append(node)
        elif node is header or not node.gone:
            stack.extend(c for c in reversed(node.children) if type(c) is not str)
    return found


def main_text(html: str | None, template: frozenset[int] = frozenset()) -> str:
    """The text of the article, without boilerplate and without the subtrees in ``template``."""
    root = parse(html or "")
    digest(root)
    main = main_element(root, template)
    inside = {id(n) for n in (_articles(root) if main is None else [main])}
    out: list[str] = []
    stack: list = [(main or root, False)]
    while stack:
        node, own = stack.pop()
        if type(node) is str:
            out.append(node)
            continue
        own = own or id(node) in inside
        if node is not main:
            gone = (node.gone and not (own and _prose(node))) or (not own and (node.hash in template or (node.tag in ("ul", "ol") and 2 * node.linked > node.letters)))
            if gone:
                out.append("" if node.tag in IN_LINE else " ")
                continue
            if node.tag == "header":  # a page's header goes; of an article's own, headings and leads stay
                if own:
                    out.append(" ")
                    stack.extend((n, True) for n in reversed(_told(node)))
                continue
            if own and node.hash in template and id(node) not in inside and (node.tag not in PROSE | INLINE or 2 * node.linked > node.letters):
                out.append("" if node.tag in IN_LINE else " ")
                continue
        if node.tag not in INLINE:
            out.append(" ")
            stack.append((" ", own))
        stack.extend((c, own) for c in reversed(node.children))
    return " ".join("".join(out).split())


def host_of(url: Column) -> Column:
    """Lower-case host without user and port; null if there is none."""
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1))
    return F.when(host != "", host)


def _subtrees(pages: DataFrame, html: str, url: str) -> DataFrame:
    """(doc, once, subtree, key) of the pages with a host: ``doc`` stands for equal pages of a host, ``once`` for what
    counts once, and ``key`` for host and subtree; as 64-bit hashes they make little shuffle."""

    def emit(batches):
        for batch in batches:
            columns: list[list] = [[], [], [], []]
            for host, doc, page in zip(*(batch.column(c).to_pylist() for c in ("host", "doc", "html"))):
                found = subtrees(page)
                for column, values in zip(columns, ([host] * len(found), [doc] * len(found), map(_signed, found.values()), map(_signed, found))):
                    column += values
            types = (pa.string(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["host", "doc", "once", "subtree"])

    host = host_of(F.col(url))
    asked = pages.select(host.alias("host"), F.xxhash64(host, F.col(html)).alias("doc"), F.col(html).alias("html")).where("host IS NOT NULL")
    found = asked.mapInArrow(emit, "host string, doc bigint, once bigint, subtree bigint").select("doc", "once", "subtree", F.xxhash64("host", "subtree").alias("key"))
    return written(found, new_folder(pages.sparkSession, "html-subtrees"))


def templates(found: DataFrame, least_pages: int = 5) -> DataFrame:
    """(key, parts): the subtrees in ``found`` on at least ``least_pages`` different pages of a host, and into how many parts the
    rows of each are cut."""
    counted = found.groupBy("key", "once").agg(F.count("*").alias("rows")).groupBy("key").agg(F.count("*").alias("n"), F.sum("rows").alias("rows"))
    return counted.where(F.col("n") >= least_pages).select("key", F.ceil(F.col("rows") / SPREAD_PAGES).alias("parts"))


def extract(pages: DataFrame, html: str = "html", url: str = "url", least_pages: int = 5) -> DataFrame:
    """``pages`` with ``text``, their main text.

    A page meets its own subtrees that are templates, not its host's whole list; a template is spread over a part per
    SPREAD_PAGES of the pages that have it, and pages with very many copies over all tasks.
    """
    found = _subtrees(pages, html, url)
    often = written(templates(found, least_pages), new_folder(pages.sparkSession, "html-templates"))
    # Templates on more than SPREAD_PAGES pages: no more than the most frequent HOT_SHARE of them are spread.
    large = F.broadcast(often.where(F.col("parts") > 1).orderBy(F.col("parts").desc(), "key").limit(HOT_SHARE).select(F.col("key").alias("__large"), F.col("parts").alias("__parts")))
    parted = found.select("doc", "subtree", "key").join(large, F.col("key") == F.col("__large"), "left")
    parted = parted.select("doc", "subtree", "key", F.pmod(F.xxhash64("doc"), F.coalesce("__parts", F.lit(1).cast("bigint"))).alias("part"))
    met = parted.join(often.select("key", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part")), ["key", "part"])
    own = met.groupBy(F.col("doc").alias("__page")).agg(F.collect_set("subtree").alias("__template"))
    kept = [c for c in pages.columns if c != "text"]
    host = host_of(F.col(url))
    rows = pages.select(*kept, F.when(host.isNotNull(), F.xxhash64(host, F.col(html))).alias("__page"))
    by = [F.col(f.name) for f in pages.schema.fields if f.name in kept and f.name != html and isinstance(f.dataType, AtomicType)]
    joined = join_spread(rows, own, ["__page"], by or [F.lit(0)])

    @F.pandas_udf("string")
    def text_of(page: pd.Series, template: pd.Series) -> pd.Series:
        sets = (frozenset() if hashes is None else frozenset(h & ((1 << 64) - 1) for h in hashes.tolist()) for hashes in template)
        return pd.Series([main_text(*both) for both in zip(page, sets)], dtype=object)

    return joined.select(*kept, text_of(F.col(html), F.col("__template")).alias("text"))
