"""Main text of web pages by site template removal.

Every page is read into its elements.  Each element subtree outside the main
content has a hash of its shape (tags, classes, ids, not the text), and each
container inside it a hash of shape and text.  Spark counts, per host, on how
many pages *with different main texts* a subtree occurs; those that recur on
``min_pages`` of them, and on ``MIN_SHARE`` of the host's, are its template and their subtrees are deleted.
Copies of one article have one main text, so an article copied many times on a
host is not template, and text blocks inside the main content never are.

Hosts with few pages show no recurrence, so elements that are page furniture
by their meaning (navigation, footers, forms, scripts, adverts and comments by
tag, role, class or id) go on every page, and a page that marks its main
content keeps only that.

What is left is cut into blocks at block-level tags; white space inside a
block becomes one space, and blocks are joined by an empty line.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from transcripta.llm.common import table
from transcripta.session import cut_lineage

MIN_PAGES = 5
#: Part of a host's pages with different main texts that a template is on: a paragraph on a few of very many is none.
MIN_SHARE = 0.1
#: Mark that every page has, to count a host's pages.
PAGE = 0

# Kinds of HTML elements.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
BLOCK = set("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure
footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th
thead tr ul""".split())
#: Never part of the text.
FURNITURE = set("""nav footer aside form script style noscript template iframe object embed applet svg canvas audio video
button select option input textarea head title menu dialog map datalist noembed noframes""".split())
FURNITURE_ROLES = set("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog toolbar".split())
#: Whole tokens of a class, or an id, that mark furniture.
FURNITURE_WORDS = set("""ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar
navigation menu menubar breadcrumb breadcrumbs sidebar footer masthead cookie cookies consent gdpr notice popup modal overlay
newsletter subscribe subscription signup login social share sharing related recommended recommendations comment comments
commentlist disqus respond reply replies widget toolbar pagination pager skip""".split())
CONTENT_WORDS = set("article content entry main post story".split())
#: End tags that HTML lets authors leave out: a start tag of the key closes open tags of the value.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
          "option": {"option"}}
SCOPES = {"ul", "ol", "dl", "table", "menu", "body", "html"}

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)", re.S)  # the last: a quote left open
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
GAP = re.compile(r"\s+")
#: Deeper elements are put beside, not into, the deepest one.
MAX_DEPTH = 256


class Node:
    __slots__ = ("tag", "attrs", "kids", "mark")

    def __init__(self, tag: str, attrs: dict):
        self.tag, self.attrs, self.kids = tag, attrs, []
        self.mark = None  # hash of the subtree, if it may be template

    def tokens(self) -> set[str]:
        return set(f"{self.attrs.get('class') or ''} {self.attrs.get('id') or ''}".lower().split())

    def words(self) -> set[str]:
        return set(re.findall(r"[a-z]+", f"{self.attrs.get('class') or ''} {self.attrs.get('id') or ''}".lower()))


def parse(page: str) -> Node:
    """The element tree of a page; never fails, whatever the markup."""
    root = Node("#root", {})
    stack, at = [root], 0
    while at < len(page):
        m = TOKEN.search(page, at)
        if m is None:
            stack[-1].kids.append(page[at:])
            break
        if m.start() > at:
            stack[-1].kids.append(page[at:m.start()])
        at, tag, given = m.end(), (m["tag"] or m["tag2"] or "").lower(), m["attrs"] or m["attrs2"] or ""
        if not tag:
            continue
        if m["end"] or m["end2"]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
            continue
        if tag in BLOCK:  # a block ends an open paragraph, with the inline elements in it
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    del stack[i:]
                    break
                if stack[i].tag in BLOCK:
                    break
        if tag in CLOSES:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in CLOSES[tag]:
                    del stack[i:]
                    break
                if stack[i].tag in SCOPES:
                    break
        attrs = {a[0].lower(): entities.unescape(a[1] or a[2] or a[3]) for a in ATTRIBUTE.findall(given)} if given.strip() else {}
        node = Node(tag, attrs)
        stack[-1].kids.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>|</{tag}\Z", re.I).search(page, at)
            node.kids.append(page[at:end.start() if end else len(page)])
            at = end.end() if end else len(page)
        elif tag not in VOID and len(stack) < MAX_DEPTH:
            stack.append(node)  # a slash at the end of the tag means nothing in HTML
    return root


def is_furniture(node: Node, by_name: bool = True) -> bool:
    """By tag, role or hiding and, if asked, by class or id; main content and what holds a main element only by the former."""
    if node.tag in FURNITURE or (node.attrs.get("role") or "").lower() in FURNITURE_ROLES or "hidden" in node.attrs \
            or (node.attrs.get("aria-hidden") or "").lower() == "true" or re.search(r"display\s*:\s*none", node.attrs.get("style") or ""):
        return True
    if not by_name or node.tag in ("html", "body") or is_content(node) or not node.tokens() & FURNITURE_WORDS:
        return False
    return not any(n.tag == "main" or (n.attrs.get("role") or "").lower() == "main" for n in _all(node))


def is_content(node: Node) -> bool:
    return node.tag in ("article", "main") or (node.attrs.get("role") or "").lower() in ("main", "article")


def main_nodes(root: Node) -> list[Node]:
    """The outermost main-content elements; without any, those so named by class or id."""
    named = lambda n: n.tag in ("div", "section", "td") and bool(n.words() & CONTENT_WORDS)
    # main content inside elements named as furniture counts if there is no other
    for test, by_name in ((is_content, True), (is_content, False), (named, True)):
        found, todo = [], [root]
        while todo:
            node = todo.pop()
            if node is not root and is_furniture(node, by_name):
                continue
            if test(node):
                found.append(node)
            else:
                todo.extend(k for k in reversed(node.kids) if isinstance(k, Node))
        if not found:
            continue
        if any(f.tag == "article" for f in found):
            return found
        # a main element around one article: the articles say more
        inner = _articles(found, True)
        return inner or (found if blocks(found, set()) else _articles(found, False)) or found
    return []


def _articles(nodes: list[Node], by_name: bool) -> list[Node]:
    return [n for f in nodes for n in _inside(f, lambda x: x.tag == "article", by_name)]


def _inside(node: Node, test, by_name: bool) -> list[Node]:
    out = []
    for k in node.kids:
        if isinstance(k, Node) and not is_furniture(k, by_name):
            out.extend([k] if test(k) else _inside(k, test, by_name))
    return out


def mark(root: Node, mains: list[Node]) -> None:
    """Hash every subtree that may be template."""
    inside = set(map(id, mains))

    def walk(node: Node, within: bool) -> tuple[str, bool]:
        within = within or id(node) in inside
        shape, holds = [node.tag, str(node.attrs.get("class") or ""), str(node.attrs.get("id") or "")], id(node) in inside
        for k in node.kids:
            if isinstance(k, Node):
                s, h = walk(k, within)
                shape.append(s)
                holds = holds or h
            elif k.strip():
                shape.append(GAP.sub(" ", k).strip() if within else "#text")
        digest = hashlib.blake2b("\x1f".join(shape).encode("utf-8", "surrogatepass"), digest_size=8).digest()
        own = node.tag in ("div", "section", "ul", "ol", "table", "aside", "header", "footer", "nav", "form") if within \
            else node.tag not in ("#root", "html", "head", "body", "p", "br", "b", "i", "em", "strong", "span", "a", "meta", "link")
        if own and not holds:
            node.mark = int.from_bytes(digest, "big", signed=True)
        return digest.hex(), holds

    if not mains:
        inside = {id(root)}
        walk(root, False)
        for n in _all(root):  # every element of a page without marked content may recur
            if n.mark is None and n.tag in ("p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "div", "section"):
                n.mark = _text_mark(n)
    else:
        walk(root, False)


def _all(node: Node) -> Iterator[Node]:
    for k in node.kids:
        if isinstance(k, Node):
            yield k
            yield from _all(k)


def _text_mark(node: Node) -> int:
    body = node.tag + "\x1f" + "\n\n".join(blocks([node], set()))
    return int.from_bytes(hashlib.blake2b(body.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def blocks(nodes: list[Node], template: set[int]) -> list[str]:
    """Text blocks in page order, without furniture and template subtrees.

    Without marked main content (the whole page is given) a header is the site's.
    """
    whole = len(nodes) == 1 and nodes[0].tag == "#root"
    out: list[str] = []
    run: list[str] = []

    def close():
        text = GAP.sub(" ", "".join(run)).strip()
        run.clear()
        if text:
            out.append(text)

    todo: list = [x for n in reversed(nodes) for x in (None, n, None)]
    while todo:
        x = todo.pop()
        if x is None:
            close()
        elif isinstance(x, str):
            run.append(entities.unescape(x))
        elif x.mark in template or is_furniture(x) or whole and (x.tag == "header" or "header" in x.words()):
            continue
        elif x.tag == "br":
            run.append(" ")
        elif x.tag in BLOCK:
            todo.append(None)
            todo.extend(reversed(x.kids))
            todo.append(None)
        else:
            todo.extend(reversed(x.kids))
    close()
    return out


def extract(page: str, template: set[int] = frozenset()) -> str:
    """Main text of one page, given its host's template hashes."""
    root = parse(page)
    mains = main_nodes(root)
    mark(root, mains)
    return "\n\n".join(blocks(mains or [root], template))


def _marks(batches: Iterator) -> Iterator:
    """Per page: the distinct subtree hashes and a hash of the main text."""
    import pandas as pd
    for pdf in batches:
        rows = []
        for page_id, host, page in zip(pdf["page_id"], pdf["host"], pdf["html"]):
            root = parse(page)
            mains = main_nodes(root)
            mark(root, mains)
            body = "\n\n".join(blocks(mains or [root], set()))
            text = int.from_bytes(hashlib.blake2b(body.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)
            rows.extend((page_id, host, m, text) for m in {n.mark for n in _all(root)} - {None} | {PAGE})
        yield pd.DataFrame(rows, columns=["page_id", "host", "mark", "body"]).astype({"mark": "int64", "body": "int64"})


def _texts(batches: Iterator) -> Iterator:
    import pandas as pd
    for pdf in batches:
        texts = [extract(h, set() if t is None else set(t)) for h, t in zip(pdf["html"], pdf["template"])]
        yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": texts, "n_removed": [0 if t is None else len(t) for t in pdf["template"]]})


def host_of(url):
    """The host of a URL, lower case, without port; empty if there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def page_templates(marks: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """``host, mark`` of the subtrees on ``min_pages`` or more pages of a host with different main texts, and on ``MIN_SHARE`` of them."""
    different = marks.select("host", "mark", "body").distinct()
    often = different.groupBy("host", "mark").agg(F.count("*").alias("n")).filter(F.col("n") >= min_pages)
    pages = often.filter(F.col("mark") == PAGE).select("host", F.col("n").alias("pages"))
    return often.filter(F.col("mark") != PAGE).join(pages, "host").filter(F.col("n") >= MIN_SHARE * F.col("pages")).select("host", "mark")


def main_texts(pages: DataFrame, min_pages: int = MIN_PAGES, page_id: str = "page_id", url: str = "url",
               html: str = "html") -> DataFrame:
    """``page_id, url, text, n_removed``, one row per page (null html: empty text).

    ``n_removed`` counts the page's template subtree hashes.  Ids are meant to
    be unique; pages that share one share their host templates.  A null id or
    url takes no part in the counts.
    """
    p = pages.select(F.col(f"`{page_id}`").cast("long").alias("page_id"), F.col(f"`{url}`").alias("url"),
                     F.coalesce(F.col(f"`{html}`"), F.lit("")).alias("html"))
    counted = p.filter("page_id IS NOT NULL AND url IS NOT NULL").select("page_id", host_of(F.col("url")).alias("host"), "html")
    marks = cut_lineage(counted.mapInPandas(_marks, "page_id long, host string, mark long, body long"), "page-marks")
    found = marks.select("page_id", "host", "mark").join(page_templates(marks, min_pages), ["host", "mark"])
    per_page = found.groupBy("page_id").agg(F.collect_set("mark").alias("template"))
    per_page = per_page.withColumnRenamed("page_id", "__id")
    out = p.join(per_page.hint("shuffle_hash"), p["page_id"] == per_page["__id"], "left").drop("__id")
    return out.select("page_id", "url", "html", "template").mapInPandas(
        _texts, "page_id long, url string, text string, n_removed int")


def op6_template_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = main_texts(table(spark, sf_dir, "pages"))
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select("page_id", "url", "text", "n_chars", "n_removed")
