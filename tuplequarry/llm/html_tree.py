"""Main text of web pages by a site style tree.

Pages of one host are laid over each other: nodes with the same path of styles (tag with its class and id) are one node
of the site's style tree. For each such node two entropies are computed over all pages of the host that have it:

* content: of the hashes of its text, relative to the number of pages. Text that all pages share has entropy 0, text of
  each page's own has 1;
* presentation: of the sequences of its children's styles, in the same way.

Copies of a page say nothing about its template, so pages of a host that say the same count once.

A node's importance is the larger one of the two. Branches whose root is less important than ``LEAST`` go from every page
of the host. Hosts with fewer than ``PAGES`` different pages say too little, so their branches stay; article and main elements always
stay, and a page that would be left without any text is read by the fixed rules alone.

Branches whose style names their role (the fixed tags and class words below: menus, headers, footers, side bars, adverts,
notices, forms, comments, scripts) are unimportant on any host, and where a page has article or main elements, only what is
inside of them is important.

Distribution: statistics are aggregated by (host, node, hash) and then by (host, node), both with map-side combining, so
that a hot host is spread over its nodes and texts. Only the unimportant nodes come back, one list a host, broadcast if
few and joined otherwise (a skewed host's pages can then be split).

Edge cases: null and empty html give an empty text; broken and unclosed markup is read to its end; missing hosts (null
url) are one site; repeated rows come out as often as they went in; an empty table gives an empty result; further columns
stay out.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, cut, tidy
from .url_rules import url_host

LEAST, PAGES, FEW_NODES = 0.3, 8, 1_000_000
PRIME = (1 << 64) - 1469  # of texts' hashes; (PRIME - 1) / 2 is prime too, so powers of 256 do not come round

# HTML elements without content, those that a new one of their kind ends, those that form no block of
# their own, those whose content is no markup, and those that are never main text.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
JUNK_TAGS = {"aside", "button", "dialog", "datalist", "embed", "footer", "form", "frameset", "head", "header", "iframe", "input", "menu", "nav", "noembed", "noframes", "noscript", "object", "optgroup", "option", "script", "select", "style", "svg", "template", "textarea", "title"}
JUNK_ROLES = {"alert", "alertdialog", "banner", "complementary", "contentinfo", "dialog", "form", "menu", "menubar", "navigation", "search"}
JUNK_WORDS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "cookie", "cookies", "consent", "disqus", "footer", "gdpr", "header", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "notification", "pagination", "pager", "popup", "promo", "promoted", "promotion", "recommended", "related", "replies", "respond", "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget", "widgets"}
FIRM_WORDS = {"comment", "comments", "disqus", "recommended", "related", "replies", "respond"}
MAIN_TAGS = {"article", "main"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "optgroup": {"option", "optgroup"}, "rt": {"rt", "rp"}, "rp": {"rt", "rp"}}
SCOPES = {"html", "body", "table", "ul", "ol", "dl", "select", "div", "article", "section", "main", "ruby", "tr"}
ENDS_P = {"address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "ul"}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<[!?][^>]*(?:>|\Z)|<[A-Za-z/][^<]*\Z", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_BLANK = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "style", "path", "junk", "parts")

    def __init__(self, tag: str, style: str, path: int, junk: int):
        self.tag, self.style, self.path, self.junk = tag, style, path, junk
        self.parts: list = []  # text and nodes in page order


def _style(tag: str, raw: str) -> tuple[str, int]:
    """The node's style, and whether its tag, role, class or id name it as no main text: 0 no, 2 yes, 1 yes unless it
    turns out to hold an article or main element (a page's outer form, or a wrapper named for its side bar)."""
    named = (1 if tag == "form" else 2) if tag in JUNK_TAGS else 0
    if not raw.strip():
        return tag, named
    a = {k.lower(): entities.unescape(x or y or z) for k, x, y, z in _ATTRIBUTE.findall(raw)}
    own = f"{a.get('class', '')} {a.get('id', '')}"
    words = {w.lower() for w in _WORD.findall(own)}
    hidden = "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", "").lower()
    firm = hidden or bool(words & FIRM_WORDS) or a.get("role", "").lower() in JUNK_ROLES
    junk = 0 if tag in ("html", "body") else max(named, 2 * firm, int(bool(words & JUNK_WORDS)))
    shown = " ".join(sorted(a.get("class", "").split()))
    return f"{tag}.{shown}#{re.sub(r'[0-9]+', '0', a.get('id', ''))}", junk


def parse(page: str) -> Node:
    """The page's tree. Character references in text are decoded; comments and declarations are left out."""
    root = Node("", "", 0, 0)
    stack = [root]
    at = 0

    def say(text: str) -> None:
        if text:
            stack[-1].parts.append(entities.unescape(text))

    while m := _TOKEN.search(page, at):
        say(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if tag in INLINE and stack[k].tag not in INLINE:
                    break  # a stray end tag of an inline element leaves its block alone
            else:
                if tag == "br" or tag == "p":
                    stack[-1].parts.append(Node("br", "br", 0, 0))
            continue
        if tag in ENDS_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    del stack[k:]
                    break
                if stack[k].tag not in INLINE:
                    break
        if tag in CLOSES:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in CLOSES[tag]:
                    del stack[k:]
                    break
                if stack[k].tag in SCOPES:
                    break
        style, junk = _style(tag, m[3])
        node = Node(tag, style, xxhash.xxh64_intdigest(style, stack[-1].path & 0xFFFFFFFF) ^ (stack[-1].path >> 7), junk)
        stack[-1].parts.append(node)
        if tag in MAIN_TAGS and not junk:
            for x in stack:
                x.junk -= x.junk == 1
        if tag in VOID or (m[3].endswith("/") and tag not in INLINE | RAW):
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            node.parts.append(page[at : end.start() if end else len(page)])
            at = end.end() if end else len(page)
        else:
            stack.append(node)
    say(page[at:])
    return root


def _joined(a: tuple[int, int], b: tuple[int, int]) -> tuple[int, int]:
    """The hash of two texts one after the other from their hashes, each with 256 to the text's length."""
    return (a[0] * b[1] + b[0]) % PRIME, a[1] * b[1] % PRIME


def _texts(node: Node) -> Iterator[str]:
    """All text below a node, without recursion (trees may be deep)."""
    todo = [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            yield x
        else:
            todo.extend(reversed(x.parts))


def node_facts(page: str) -> dict[int, tuple[int, int]]:
    """{path: (hash of the text, hash of the children's styles)} over the page's nodes of that path together."""
    text: dict[int, tuple[int, int]] = {}
    shape: dict[int, xxhash.xxh64] = {}
    # Bottom-up: a closed node hands its text's hash to its parent, so that any depth costs the same a node.
    below = [(0, 1)]  # hashes of the open nodes' texts so far
    todo: list = [parse(page)]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            if not x.isspace():
                raw = x.encode("utf-8", "surrogatepass")
                below[-1] = _joined(below[-1], (int.from_bytes(raw) % PRIME, pow(256, len(raw), PRIME)))
        elif isinstance(x, int):
            own = below.pop()
            below[-1] = _joined(below[-1], own)
            text[x] = _joined(text[x], own)
        elif not x.junk:
            if x.path:
                text.setdefault(x.path, (0, 1))
                s = shape.setdefault(x.path, xxhash.xxh64())
                s.update(" ".join(y.style for y in x.parts if not isinstance(y, str)))
                if x.parts:
                    below.append((0, 1))
                    todo.append(x.path)
            todo.extend(reversed(x.parts))
    return {p: (xxhash.xxh64_intdigest(b"%d %d" % text[p]), shape[p].intdigest()) for p in text}


def page_identity(facts: dict[int, tuple[int, int]]) -> int:
    """A hash of all that the page says, the same for copies that differ in junk only."""
    return xxhash.xxh64_intdigest(repr(sorted(x for x, _ in facts.values())))


def _has_main(root: Node) -> bool:
    todo = [root]
    while todo:
        x = todo.pop()
        if not isinstance(x, str) and not x.junk:
            if x.tag in MAIN_TAGS and any(not y.isspace() for y in _texts(x)):
                return True
            todo.extend(x.parts)
    return False


def main_text(page: str, low: frozenset = frozenset()) -> str:
    """Blocks of the page's important branches in page order, joined by one space."""
    root = parse(page)
    only = _has_main(root)
    blocks: list[str] = []
    open_: list[str] = []

    def close() -> None:
        if open_:
            if x := _BLANK.sub(" ", "".join(open_)).strip():
                blocks.append(x)
            open_.clear()

    END = object()
    todo: list[tuple] = [(root, not only)]
    while todo:
        x, inside = todo.pop()
        if x is END:
            close()
        elif isinstance(x, str):
            if inside:
                open_.append(x)
        elif x.tag == "br":
            open_.append(" ")
        elif not x.junk and (x.path not in low or x.tag in MAIN_TAGS):
            inside = inside or x.tag in MAIN_TAGS
            if x.tag not in INLINE:
                close()
                todo.append((END, inside))
            todo.extend((y, inside) for y in reversed(x.parts))
    close()
    return " ".join(blocks)


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    for b in batches:
        rows = []
        for host, page in zip(b["host"].to_pylist(), b["html"].to_pylist(), strict=True):
            facts = node_facts(page or "")
            own = signed(page_identity(facts))
            for path, both in facts.items():
                rows += [(host, own, signed(path), k, signed(h)) for k, h in enumerate(both)]
        cols = list(zip(*rows, strict=True)) or [()] * 5
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["host", "page", "path", "kind", "fact"])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sets: dict[str, frozenset] = {}
    for b in batches:
        texts = []
        for host, page, low in zip(b["host"].to_pylist(), b["html"].to_pylist(), b["low"], strict=True):
            if host not in sets:
                if len(sets) > 1000:
                    sets.clear()
                sets[host] = frozenset(x & 0xFFFFFFFFFFFFFFFF for x in (low.as_py() or ()))
            text = main_text(page or "", sets[host])
            texts.append(text if text or not sets[host] else main_text(page or ""))
        yield pa.RecordBatch.from_arrays([b["id"], b["url"], pa.array(texts, pa.string())], ["id", "url", "text"])


def unimportant_nodes(pages: DataFrame, least: float = LEAST, pages_needed: int = PAGES) -> DataFrame:
    """(host, path) of the site style tree's nodes below the least importance. pages: host, html."""
    facts = pages.select("host", "html").mapInArrow(tidy(_facts), "host string, page long, path long, kind int, fact long").distinct()
    c = facts.groupBy("host", "path", "kind", "fact").agg(F.count("*").alias("c"))
    n = F.sum("c")
    # Entropy of the facts relative to the log of the number of pages: log n - sum(c log c) / n, over log n.
    e = c.groupBy("host", "path", "kind").agg(n.alias("n"), (1 - F.sum(F.col("c") * F.log("c")) / (n * F.log(n))).alias("entropy"))
    e = e.where(F.col("n") >= pages_needed).groupBy("host", "path").agg(F.max("entropy").alias("importance"))
    return e.where(F.col("importance") < least).select("host", "path")


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: id, url, text and n_chars."""
    bound_batches(pages.sparkSession)
    kind = pages.schema[id_col].dataType.simpleString()
    p = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    p = p.withColumn("host", url_host(F.col("url")))
    low = cut(unimportant_nodes(p), "unimportant-nodes")
    by_host = low.groupBy("host").agg(F.collect_list("path").alias("low"))
    if low.limit(FEW_NODES + 1).count() <= FEW_NODES:
        by_host = F.broadcast(by_host)
    out = p.join(by_host, "host", "left").select("id", "url", "host", "html", "low").mapInArrow(tidy(_extract), f"id {kind}, url string, text string")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"))
