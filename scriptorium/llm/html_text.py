"""Main text of web pages, with site templates removed.

Every element outside a page's main content is hashed (tags and text of its subtree). Spark counts in how many pages of a
host each hash occurs; subtrees that recur in at least `least_pages` pages and `least_share` of the host's pages, or in
`many_pages` of however many, are that site's template and are deleted, whichever pages they stand in. The main content is the largest <article>, else <main>,
else what is left of the body; inside it, recurring subtrees are deleted only where they hold links or controls but no
paragraph of their own, since authors repeat passages too. Menus, footers, sidebars, notices, adverts, forms and reader
comments that only one page has are known by their elements, roles and class names. A class name or id counts if it is a
word of HINTS, or made of such words and words of PLACES only ("cookie-notice", "sidebar-left", but not "no-sidebar" or
"related-work"); never on <html> or <body>, nor above the main content where no other article is found, nor where nothing
would be left.

Text: character references decoded, white space inside a block as one space, blocks joined by a newline in page order.

The templates of all hosts are broadcast if they are at most `most_broadcast` hashes in all, and joined by host otherwise.
Null html gives an empty text. Pages without a host in their url (or with a null url) have no site and lose nothing as its
template. Broken markup (unclosed or crossing elements, a cut-off end) is read as browsers would. Repeated rows are counted
and returned once each. An empty table gives an empty result. Columns other than page_id, url and html are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, read_table

LEAST_PAGES, LEAST_SHARE, MANY_PAGES, MOST_BROADCAST = 3, 0.2, 100, 1_000_000

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)(?:>|\Z)|<(?P<close2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*+)(?:>|\Z)""", re.S)
ATTR = re.compile(r"""([a-zA-Z-]+)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)|(\bhidden\b)""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea xmp title svg math object".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split())
CLOSES_SAME = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
DROPPED = frozenset("nav footer aside form script style noscript template iframe button select textarea input svg math object menu dialog title head fieldset audio video canvas".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
HINTS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner promo promotion sponsor sponsored nav navbar navigation menu breadcrumb breadcrumbs sidebar side footer masthead cookie cookies consent gdpr notice notices notification popup modal overlay comment comments commentary disqus reply replies respond share sharing social related recommended recommendations newsletter subscribe subscription signup login search widget toolbar pagination pager skip".split()
)
PLACES = frozenset("area bar bars block bottom box button buttons container desktop global icons inner left link links list mobile outer panel primary right row secondary section site small top widget widgets wrap wrapper".split())
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Node:
    __slots__ = ("children", "hash", "marks", "size", "tag")

    def __init__(self, tag: str, marks: int):
        self.tag, self.marks, self.children, self.hash, self.size = tag, marks, [], 0, 0


OWN, HEADER, NAMED = 1, 2, 3


def _hinted(name: str) -> bool:
    words = [w.lower() for w in WORDS.findall(name)]
    return any(w in HINTS for w in words) and all(w in HINTS or w in PLACES for w in words)


def _boilerplate(tag: str, attrs: str) -> int:
    """OWN: what such an element holds is not the article's; HEADER: the same, unless it is inside the article; NAMED: the
    same by its name only."""
    if tag in DROPPED:
        return OWN
    mark = HEADER if tag == "header" else 0
    if attrs:
        for m in ATTR.finditer(attrs):
            name, value = (m[1] or m[3]).lower(), (m[2] or "").strip("\"'")
            if name == "role" and value.lower() in ROLES or name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
                return OWN
            if name in ("class", "id") and tag not in ("html", "body") and any(map(_hinted, value.split())):
                mark = NAMED
    return mark


def parse(html: str) -> Node:
    """The tree of a page. Texts are children too, as strings."""
    root = Node("#", 0)
    stack, at = [root], 0
    while True:
        m = TAG.search(html, at)
        if m is None:
            break
        if m.start() > at:
            stack[-1].children.append(html[at : m.start()])
        at = m.end()
        if m["cdata"]:
            stack[-1].children.append(m["cdata"])
        tag = m["name"] or m["name2"]
        if not tag:
            continue
        tag = tag.lower()
        if m["close"] or m["close2"]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if stack[i].tag in ("article", "main", "body") and tag not in ("article", "main", "body", "html"):
                    break  # a stray end tag doesn't close what it stands in
            continue
        if tag in BLOCK:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    del stack[i:]
                    break
                if stack[i].tag in BLOCK:
                    break
        if tag in CLOSES_SAME:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag or {stack[i].tag, tag} == {"dt", "dd"} or {stack[i].tag, tag} == {"td", "th"}:
                    del stack[i:]
                    break
                if stack[i].tag in CLOSES_SAME[tag]:
                    break
        attrs = m["attrs"] or m["attrs2"] or ""
        node = Node(tag, _boilerplate(tag, attrs))
        stack[-1].children.append(node)
        if tag in VOID or tag in ("svg", "math") and attrs.endswith("/"):
            continue  # other elements don't close themselves
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?:\s[^>]*)?>", re.I).search(html, at)
            at = end.end() if end else len(html)
            continue
        stack.append(node)
    if at < len(html):
        stack[-1].children.append(html[at:])
    return root


def measure(root: Node) -> list[Node]:
    """Sets hash and size (characters of text) of all nodes, and returns them, children first."""
    import xxhash

    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [x for x in node.children if not isinstance(x, str)]
    order.reverse()
    for node in order:
        parts, size = [node.tag], 0
        for x in node.children:
            if isinstance(x, str):
                if own := " ".join(x.split()):
                    parts.append(own)
                    size += len(own)
            else:
                parts.append(f"\0{x.hash}")
                size += x.size
        node.hash = xxhash.xxh3_64_intdigest("\1".join(parts).encode("utf-8", "surrogatepass")) >> 1
        node.size = size
    return order


def main_content(root: Node) -> Node:
    """The largest article that is not reader comments or the like, else the largest main, else the page."""
    for dropped in ((OWN, NAMED), (OWN,)):
        best: dict[str, Node] = {}
        todo = [root]
        while todo:
            node = todo.pop()
            if node.tag in ("article", "main") and (node.tag not in best or node.size >= best[node.tag].size):
                best[node.tag] = node
            todo += [x for x in node.children if not isinstance(x, str) and x.marks not in dropped]
        if best:
            break
    article, main = best.get("article"), best.get("main")
    return article if article is not None and (main is None or article.size >= 0.5 * main.size) else main or root


def _own_paragraph(node: Node) -> bool:
    todo = [node]
    while todo:
        x = todo.pop()
        if x.tag in ("p", "h1", "h2", "h3", "blockquote", "pre"):
            return True
        todo += [y for y in x.children if not isinstance(y, str)]
    return False


def candidates(root: Node) -> list[int]:
    """Distinct hashes of the subtrees with text that may be deleted as a template: those that don't hold the main content,
    and inside it those without a paragraph."""
    order = measure(root)
    main = main_content(root)
    above = set()

    def find(node: Node) -> bool:
        todo = [(node, ())]
        while todo:
            x, path = todo.pop()
            if x is main:
                above.update(map(id, (*path, x)))
                return True
            todo += [(y, (*path, x)) for y in x.children if not isinstance(y, str)]
        return False

    find(root)
    inside, todo = set(), [main]
    while todo:
        x = todo.pop()
        inside.add(id(x))
        todo += [y for y in x.children if not isinstance(y, str)]
    free = main is root
    return list({x.hash for x in order if x.size and id(x) not in above and (free or id(x) not in inside or (x.tag in BLOCK and not _own_paragraph(x) and x.tag in ("div", "section", "ul", "ol", "table")))})


def main_text(root: Node, templates: frozenset | set) -> str:
    """The text of the main content without templates (hashes); measure() or candidates() comes first."""
    main = main_content(root)
    return _text(main, root, templates, (OWN, NAMED)) or _text(main, root, templates, (OWN,))


def _text(main: Node, root: Node, templates: frozenset | set, dropped: tuple) -> str:
    blocks, now = [], []

    def flush() -> None:
        if now and (text := " ".join(unescape("".join(now)).split())):
            blocks.append(text)
        now.clear()

    # texts and nodes in page order; None ends a block
    todo: list = [main]
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            now.append(x)
        elif x is not main and (x.marks in dropped or x.marks == HEADER and main is root or x.hash in templates):
            now.append(" ")
        elif x.tag == "br" or x.tag in ("td", "th", "img"):
            now.append(" ")
            todo += reversed(x.children)
        elif x.tag in BLOCK:
            flush()
            todo.append(None)
            todo += reversed(x.children)
        else:
            todo += reversed(x.children)
    flush()
    return "\n".join(blocks)


def _hosted(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return pages.select("page_id", "url", "html", host.alias("host"))


def site_templates(pages: DataFrame, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE, many_pages: int = MANY_PAGES) -> DataFrame:
    """(host, hashes) of the subtrees that recur across pages (page_id, url, html). A host has at most (its pages' mean number
    of subtrees) times the greater of 1 / least_share and its pages / many_pages of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, hashes = [], []
            for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = [0, *candidates(parse(html))]  # 0 counts the host's pages
                hosts += [host] * len(own)
                hashes += own
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(hashes, pa.int64())], ["host", "hash"])

    seen = _hosted(pages).where("host != '' and html is not null").select("host", "html").mapInArrow(run, "host string, hash long")
    counts = cut(seen.groupBy("host", "hash").agg(F.count("*").alias("n")).where(F.col("n") >= least_pages), "subtrees")
    sites = counts.where("hash = 0").select("host", F.col("n").alias("pages"))
    kept = counts.where("hash != 0").join(sites, "host").where(F.col("n") >= F.least(F.col("pages") * least_share, F.lit(many_pages)))
    return kept.groupBy("host").agg(F.collect_set("hash").alias("hashes"))


def extract(pages: DataFrame, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """(page_id, url, text) for each row of pages (page_id, url, html)."""
    spark = pages.sparkSession
    templates = cut(site_templates(pages), "templates")
    hosted = _hosted(pages)
    size = templates.agg(F.sum(F.size("hashes") + 1)).first()[0] or 0
    shared = None
    if size <= most_broadcast:
        shared = spark.sparkContext.broadcast({r.host: frozenset(r.hashes) for r in templates.collect()})
        joined = hosted.withColumn("hashes", F.lit(None).cast("array<long>"))
    else:
        joined = hosted.join(templates, "host", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none: frozenset = frozenset()
        for batch in batches:
            texts = []
            for host, hashes, html in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                root = parse(html or "")
                measure(root)
                texts.append(main_text(root, shared.value.get(host, none) if shared else set(hashes or ())))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return joined.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "host", "hashes", "html").mapInArrow(run, "page_id long, url string, text string")


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read_table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
