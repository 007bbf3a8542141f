"""HTML pages to text: noise removal, site rules, and a density score for all other sites.

A page's elements are read by the standard library's parser in Arrow batches; which element wins is decided on plain
rows. Text of an element is its stripped strings joined without a separator (paragraphs) or by line feeds (whole).
Defined results: null and empty pages have no text; unclosed tags are closed by the end of their parent.
"""

from __future__ import annotations

from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvana.functions.arrow import map_batches
from corvana.functions.constants import NOISE_TAGS

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: strategy -> (containers in order of preference: (tag, class), paragraph class or None); a fixed value for the known sites.
SITES = {"a": ((("article", "fck_detail"), ("div", "fck_detail")), "Normal"), "b": ((("div", "singular-content"), ("div", "detail-content")), None)}
DISPATCH = (("vnexpress.net", "a"), ("dantri.com.vn", "b"))


class Node:
    __slots__ = ("children", "classes", "tag")

    def __init__(self, tag: str, classes: tuple[str, ...]):
        self.tag, self.classes, self.children = tag, classes, []

    def walk(self):
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            stack += [c for c in reversed(n.children) if isinstance(c, Node)]

    def strings(self) -> list[str]:
        out, stack = [], [self]
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                if n.strip():
                    out.append(n.strip())
            else:
                stack += reversed(n.children)
        return out


class _Tree(HTMLParser):
    def __init__(self, noise: frozenset[str]):
        super().__init__(convert_charrefs=True)
        self.root = Node("", ())
        self.stack = [self.root]
        self.noise, self.muted = noise, []

    def handle_starttag(self, tag, attrs):
        if self.muted or tag in self.noise:
            if tag not in VOID:
                self.muted.append(tag)
            return
        node = Node(tag, tuple((dict(attrs).get("class") or "").split()))
        self.stack[-1].children.append(node)
        if tag not in VOID:
            self.stack.append(node)

    def handle_endtag(self, tag):
        if self.muted:
            if tag in self.muted:
                del self.muted[len(self.muted) - 1 - self.muted[::-1].index(tag) :]
            return
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                del self.stack[i:]
                return

    def handle_data(self, data):
        if not self.muted:
            self.stack[-1].children.append(data)


def tree(html: str | None, noise: frozenset[str] = frozenset(NOISE_TAGS)) -> Node:
    p = _Tree(noise)
    if html:
        p.feed(html)
        p.close()
    return p.root


def paragraphs(node: Node, cls: str | None = None, longer_than: int = 0) -> str:
    texts = ["".join(n.strings()) for n in node.walk() if n.tag == "p" and (cls is None or cls in n.classes)]
    return "\n\n".join(t for t in texts if len(t) > longer_than)


def site_text(html: str | None, strategy: str) -> str | None:
    containers, cls = SITES[strategy]
    root = tree(html)
    for tag, name in containers:
        node = next((n for n in root.walk() if n.tag == tag and name in n.classes), None)
        if node is not None:
            return paragraphs(node, cls) or "\n".join(node.strings())
    return None


def strategy(url: Column) -> Column:
    c = F.when(F.lit(False), F.lit(""))
    for part, name in DISPATCH:
        c = c.when(F.contains(url, F.lit(part)), F.lit(name))
    return c.otherwise(F.lit("density"))


def candidates(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, pos, tag, text_len, tags, text): blocks of 200 characters or more, with the number of tags inside."""
    kind = dict(pages.dtypes)[key]

    def run(_, cols):
        rows = []
        for k, h in zip(cols[key], cols[html]):
            for pos, n in enumerate(x for x in tree(h).walk() if x.tag in ("div", "article", "section")):
                text = "".join(n.strings())
                if len(text) >= 200:
                    rows.append((k, pos, n.tag, len(text), sum(1 for _ in n.walk()) - 1, paragraphs(n, longer_than=30) or "\n".join(n.strings())))
        return dict(zip((key, "pos", "tag", "text_len", "tags", "text"), map(list, zip(*rows)))) if rows else None

    return map_batches(pages.select(key, html), run, f"`{key}` {kind}, pos int, tag string, text_len int, tags int, text string", rows=200)


def densest(blocks: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, text): the block with most text per tag, articles half as much again; the first of equals."""
    s = F.col("text_len") / (F.col("tags") + 1) * F.when(F.col("tag") == "article", 1.5).otherwise(1.0)
    return blocks.groupBy(key).agg(F.max_by("text", F.struct(s, -F.col("pos"))).alias("text"))


def page_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, text) by the page's strategy."""
    p = pages.withColumn("_s", strategy(F.col(url)))
    kind = dict(pages.dtypes)[key]

    def run(_, cols):
        return {key: cols[key], "text": [site_text(h, s) for h, s in zip(cols[html], cols["_s"])]}

    sites = map_batches(p.where("_s <> 'density'").select(key, html, "_s"), run, f"`{key}` {kind}, text string", rows=200)
    return sites.unionByName(densest(candidates(p.where("_s = 'density'"), key, html), key))


def without_noise(html: Column) -> Column:
    """Noise elements and comments removed by pattern, inside the JVM (well-formed input)."""
    c = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    for t in NOISE_TAGS:
        c = F.regexp_replace(c, rf"(?is)<{t}\b[^>]*>.*?</{t}>", "")
    return c
