"""HTML extraction by removing site templates.

Pass one cuts every whole page, nothing removed yet, into element subtrees,
hashes each (its tags and texts; links count by their text) and counts in Spark
on how many pages of a host with different main content each hash occurs.
Subtrees that recur are the host's template. Pass two deletes them first: menus,
headers, footers, sidebars, notices and adverts need neither class names nor
marked articles for that. Deleted by recurrence inside a marked article are only
containers, never its paragraphs and headings, and pages that copy each other
count once, so copied articles aren't taken for a template.

What recurrence can't see is text that differs from page to page. For it HTML's
own meaning decides (scripts, styles, forms, nav, footer, aside, hidden elements
and their like, ARIA roles). A last rule covers reader comments and changing
adverts: a container whose class or id is, as a whole word, the name of such a
part. It holds for containers only, never for prose, and never for a wrapper of
the article. ``removed_chars`` tells how much each of the three took.

A host's template list is short whatever the host's size: subtrees that each
lie on at least a share s of its pages number at most (subtrees per page) / s.

Defined cases: null and empty pages give an empty text; markup that is cut off
or not closed is repaired as browsers do for paragraphs and list items, text
outside any element counts as a block; a null or hostless URL is a host of its
own; repeated rows give repeated results; an empty table gives an empty table;
further columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladespark.llm.common import bounded_batches, sliced, written

#: A subtree is template if it is on at least this many pages and this share of its host's pages.
MIN_PAGES, SHARE = 3, 0.01

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
#: A start of one of these closes an open paragraph.
_CLOSES_P = _BLOCK - frozenset("caption tbody td tfoot th thead tr option optgroup html head body".split())
_PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th figcaption".split())
_DROP_TAG = frozenset("head script style noscript template title nav footer aside form button select textarea input iframe svg canvas object audio video dialog menu math map noframes noembed search".split())
_DROP_ROLE = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar status".split())
#: Elements that a name can mark: containers, not prose.
_CONTAINER = frozenset("div section ul ol dl table article center details".split())
# Names of page parts in a class or id, and what may stand after them in a compound: fixed values.
_PART = (
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr"
    " notice notices notification alert popup modal overlay nav navbar navigation menu menus breadcrumb breadcrumbs sidebar"
    " widget widgets share sharing social newsletter subscribe subscription signup login comment comments commentlist replies respond"
    " discussion disqus footer masthead toolbar pagination pager paywall header topbar"
)
_AFTER = "area banner bar block box buttons container form links list panel section thread top wrap wrapper"
_NAME = re.compile(rf"(?:(?:site|page|top|main|global|user|reader|cookie)[-_])?(?:{'|'.join(_PART.split())})(?:[-_](?:{'|'.join(_AFTER.split())}|\d+))*")
_MAIN_CLASS = frozenset("content main main-content maincontent page-content article article-body article-content post post-body post-content entry entry-content story story-body".split())


class Node:
    __slots__ = ("attrs", "kids", "tag", "up")

    def __init__(self, tag: str, attrs: str, up: Node | None):
        self.tag, self.attrs, self.up, self.kids = tag, attrs, up, []

    def attributes(self) -> dict[str, str]:
        return {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(self.attrs)} if "=" in self.attrs else {}


def parse(page: str) -> Node:
    """A tree of elements and texts; the end tags that HTML lets authors leave out are supplied."""
    root = at = Node("#root", "", None)
    pos, size = 0, len(page)
    open_tags: Counter = Counter()  # so that the walk upwards is only made for something that is there

    def close(node: Node, below: Node) -> Node:
        while node is not below:
            open_tags[node.tag] -= 1
            node = node.up
        return below

    while pos < size:
        m = _TOKEN.search(page, pos)
        if m is None:
            at.kids.append(page[pos:])
            break
        if m.start() > pos:
            at.kids.append(page[pos : m.start()])
        pos = m.end()
        tag = m["tag"] or m["tag2"]
        if tag is None:
            continue
        tag = tag.lower()
        if m["end"] or m["end2"]:
            if not open_tags[tag]:
                continue
            node = at
            while node.up is not None and node.tag != tag:
                # an end tag doesn't reach out of the article, cell or section it stands in
                if node.tag in ("article", "main", "table", "td", "th", "body") and tag not in _BLOCK:
                    break
                node = node.up
            if node.tag == tag and node.up is not None:
                at = close(at, node.up)
            continue
        at = close(at, _implied(at, tag, open_tags))
        node = Node(tag, m["attrs"] or m["attrs2"] or "", at)
        at.kids.append(node)
        if tag in _RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, pos)
            node.kids.append(page[pos : end.start() if end else size])
            pos = end.end() if end else size
        elif tag not in _VOID and (tag in _BLOCK or not (m["attrs"] or "").endswith("/")):
            at = node  # HTML ignores the slash
            open_tags[tag] += 1
    return root


def _implied(at: Node, tag: str, open_tags: Counter) -> Node:
    """Where an element starts, once open elements that it ends are closed."""
    ends: tuple[tuple[str, ...], tuple[str, ...]] | None = None
    if tag in _CLOSES_P and open_tags["p"]:
        node = at
        while node.up is not None and node.tag not in ("article", "div", "section", "main", "td", "th", "table", "body", "li", "button", "blockquote"):
            if node.tag == "p":
                at = node.up
                break
            node = node.up
    if tag == "li":
        ends = (("li",), ("ul", "ol", "menu"))
    elif tag in ("dt", "dd"):
        ends = (("dt", "dd"), ("dl",))
    elif tag in ("td", "th"):
        ends = (("td", "th"), ("tr", "table"))
    elif tag == "tr":
        ends = (("tr",), ("table",))
    elif tag in ("option", "optgroup"):
        ends = (("option",), ("select",))
    elif tag == "body":
        ends = (("head",), ("html",))
    if ends and any(open_tags[t] for t in ends[0]):
        node = at
        while node.up is not None and node.tag not in ends[1]:
            if node.tag in ends[0]:
                return node.up
            node = node.up
    return at


def _declared(node: Node, inside: bool) -> bool:
    """Boilerplate by HTML's own meaning: tag, role or being hidden. ``inside``: below an article or main."""
    tag = node.tag
    if tag in _DROP_TAG:
        return True
    if tag == "header":
        return not inside
    if tag in ("html", "body", "main", "#root") or not node.attrs:
        return False
    attrs = node.attributes()
    return attrs.get("role", "").lower() in _DROP_ROLE or attrs.get("aria-hidden") == "true" or bool(_HIDDEN.search(attrs.get("style", ""))) or bool(_HIDDEN_ATTR.search(_QUOTED.sub("", node.attrs)))


_HIDDEN, _HIDDEN_ATTR, _QUOTED = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden"), re.compile(r"(?:^|\s)hidden(?:\s|$|=)"), re.compile(r"\"[^\"]*\"|'[^']*'")


def _named(node: Node, inside: bool) -> bool:
    """A container whose class or id names a part of the page; an article may have a header of its own."""
    if node.tag not in _CONTAINER or not node.attrs:
        return False
    attrs = node.attributes()
    return any(_NAME.fullmatch(word) and not (inside and word.endswith("header")) for key in ("class", "id") if key in attrs for word in attrs[key].lower().split())


def _cores(root: Node) -> set[int]:
    """Elements that hold an article, a main or the body, or are one: never dropped for an attribute."""
    found: set[int] = set()
    todo = [root]
    while todo:
        node = todo.pop()
        if node.tag in ("article", "main", "body"):
            up = node.up
            while up is not None and id(up) not in found:
                found.add(id(up))
                up = up.up
        todo += [k for k in node.kids if isinstance(k, Node)]
    return found


def prune(root: Node, names: bool = True) -> None:
    """Remove what HTML or, with ``names``, a class or id declares as boilerplate, in place."""
    cores = _cores(root)
    todo = [(root, False)]
    while todo:
        own, inside = todo.pop()
        inside |= own.tag in ("article", "main")
        own.kids = [k for k in own.kids if isinstance(k, str) or k.tag not in _DROP_TAG and id(k) in cores or not (_declared(k, inside) or names and _named(k, inside))]
        todo += [(k, inside) for k in own.kids if isinstance(k, Node)]


def _marked(root: Node) -> list[Node]:
    """The outermost articles, else mains, that no dropped element holds."""
    for tag in ("article", "main"):
        found, todo = [], [root]
        while todo:
            own = todo.pop()
            if own.tag == tag:
                found.append(own)
            else:
                todo += [k for k in reversed(own.kids) if isinstance(k, Node) and k.tag not in _DROP_TAG]
        if found:
            return found
    return []


def delete(root: Node, template: set[int] | frozenset[int], tops: list[Node] | None = None) -> None:
    """Remove the subtrees whose hash is in ``template``, in place; only below ``tops`` if given (marked articles). Nothing is hashed where nothing can go."""
    inside = tops is not None
    for top in tops if inside else [root]:
        able = list(_candidates(top, inside))
        known = _hashes(top) if able else {}
        gone = {id(n) for n in able if known.get(id(n)) in template}
        todo = [top] if gone else []
        while todo:
            own = todo.pop()
            own.kids = [k for k in own.kids if id(k) not in gone]
            todo += [k for k in own.kids if isinstance(k, Node)]


def main_nodes(root: Node) -> list[Node]:
    """The outermost articles, else main, else containers named as content, else everything."""
    def outermost(test) -> list[Node]:
        found, todo = [], [root]
        while todo:
            own = todo.pop()
            if own is not root and test(own):
                found.append(own)
            else:
                todo += [k for k in reversed(own.kids) if isinstance(k, Node)]
        return found

    for test in (lambda n: n.tag == "article", lambda n: n.tag == "main", lambda n: n.tag in ("div", "section", "td") and bool(n.attrs) and (n.attributes().get("role") == "main" or bool({*n.attributes().get("class", "").lower().split(), n.attributes().get("id", "").lower()} & _MAIN_CLASS))):
        if found := outermost(test):
            return found
    return [root]


def blocks(nodes: list[Node]) -> list[str]:
    """Texts of the blocks in page order, white space collapsed, empty ones left out."""
    out: list[str] = []
    held: list[str] = []

    def flush() -> None:
        if held:
            text = " ".join(entities.unescape("".join(held)).split())
            if text:
                out.append(text)
            held.clear()

    for top in nodes:
        flush()
        todo: list = [top]
        while todo:
            own = todo.pop()
            if own is None:
                flush()
            elif isinstance(own, str):
                held.append(own)
            elif own.tag in ("br", "wbr"):
                held.append(" " if own.tag == "br" else "")
            else:
                if own.tag in _BLOCK:
                    flush()
                    todo.append(None)
                todo += reversed(own.kids)
        flush()
    return out


def _hashes(root: Node) -> dict[int, int]:
    """id(node) -> hash of each element with text: its tag and the tags and texts below it."""
    found: dict[int, int] = {}

    todo: list[tuple[Node, bool]] = [(root, False)]
    parts: dict[int, tuple[str, bool]] = {}
    while todo:
        node, done = todo.pop()
        if not done:
            todo.append((node, True))
            todo += [(k, False) for k in node.kids if isinstance(k, Node)]
            continue
        text, full = [node.tag], False
        for kid in node.kids:
            if isinstance(kid, Node):
                part, has = parts.pop(id(kid), ("", False))
                text.append(part)
                full |= has
            elif kid and not kid.isspace():
                text.append(" ".join(kid.split()))
                full = True
        h = xxhash.xxh3_64_intdigest("\x00".join(text).encode("utf-8", "surrogatepass"))
        parts[id(node)] = (format(h, "x"), full)
        if full and node.tag in _BLOCK and node.tag not in _RAW:
            found[id(node)] = h - 2**63
    return found


def _candidates(root: Node, inside: bool = False) -> Iterator[Node]:
    """Elements that recurrence may delete: not the page itself, nor prose inside a marked article."""
    todo: list[tuple[Node, bool]] = [(root, inside)]
    while todo:
        node, inside = todo.pop()
        inside |= node.tag in ("article", "main")
        if node.tag in _BLOCK and node.tag not in ("html", "body", "article", "main") and not (inside and node.tag in _PROSE):
            yield node
        todo += [(k, inside) for k in node.kids if isinstance(k, Node)]


def subtree_hashes(page: str | None) -> tuple[int, list[int]]:
    """A hash of the page's main content, and those of the distinct candidate subtrees of the whole page."""
    root = parse(page or "")
    known = _hashes(root)
    found = sorted({known[id(n)] for n in _candidates(root) if id(n) in known})
    if marked := _marked(root):
        content = " ".join(str(known.get(id(n))) for n in marked)
    else:
        prune(root)
        content = " ".join(blocks(main_nodes(root)))
    return xxhash.xxh3_64_intdigest(content.encode("utf-8", "surrogatepass")) - 2**63, found


def extract(page: str | None, template: set[int] | frozenset[int] = frozenset()) -> str:
    """The page's main text without the subtrees in ``template``."""
    root = parse(page or "")
    tops = _marked(root) if template else []
    if template:
        # what lies outside marked articles isn't main text anyway
        delete(root, template, tops or None)
    prune(root)
    nodes = main_nodes(root)
    if tops and not all(any(n is t for t in tops) for n in nodes):  # the marked ones were dropped after all
        root = parse(page or "")
        delete(root, template)
        prune(root)
        nodes = main_nodes(root)
    return " ".join(blocks(nodes))


def removed_chars(page: str | None, template: set[int] | frozenset[int]) -> tuple[int, int, int]:
    """Characters of text that recurrence, then HTML's own meaning, then names take from a page outside scripts and styles."""
    sizes = []
    for step in range(4):
        root = parse(page or "")
        if step:
            delete(root, template)
        if step > 1:
            prune(root, names=step > 2)
        sizes.append(sum(map(len, blocks([n for n in [root] if not _strip_raw(n)]))))
    return sizes[0] - sizes[1], sizes[1] - sizes[2], sizes[2] - sizes[3]


def _strip_raw(root: Node) -> None:
    todo = [root]
    while todo:
        own = todo.pop()
        own.kids = [k for k in own.kids if isinstance(k, str) or k.tag not in _RAW]
        todo += [k for k in own.kids if isinstance(k, Node)]


def _host(url: str):
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def templates(pages: DataFrame, url_col: str = "url", html_col: str = "html", min_pages: int = MIN_PAGES, share: float = SHARE) -> DataFrame:
    """(host, template): xxhash64 of each host, and the hashes of the subtrees that recur on it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            hosts, hashes, contents = [], [], []
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                content, found = subtree_hashes(page)
                hashes += (0, *found)  # 0 stands for the page itself
                hosts += [host] * (len(found) + 1)
                contents += [content] * (len(found) + 1)
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.int64()), pa.array(hashes, pa.int64()), pa.array(contents, pa.int64())], names=["host", "h", "content"])

    seen = pages.select(F.xxhash64(_host(url_col)).alias("host"), F.col(html_col).alias("html")).mapInArrow(run, "host long, h long, content long")
    counts = seen.distinct().groupBy("host", "h").agg(F.count("*").alias("n"))
    counts = written(counts.filter((F.col("n") >= min_pages) | (F.col("h") == 0)), "subtrees")
    whole = counts.filter("h = 0").select("host", F.col("n").alias("pages"))
    often = counts.filter("h <> 0").join(whole, "host").filter(F.col("n") >= share * F.col("pages"))
    return written(often.groupBy("host").agg(F.sort_array(F.collect_list("h")).alias("template")), "templates")


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", **options) -> DataFrame:
    """(page_id, url, text) for every page."""
    bounded_batches(pages.sparkSession)
    found = templates(pages, url_col, html_col, **options).withColumnRenamed("host", "_t_host")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), F.xxhash64(_host(url_col)).alias("host"))
    rows = rows.join(found, F.col("host") == F.col("_t_host"), "left").select("id", "url", "html", "template")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = [extract(page, frozenset(t or ())) for page, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["id", "url", "text"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, url string, text string").withColumnRenamed("id", id_col)
