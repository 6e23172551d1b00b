"""Main text of web pages by site style trees.

The pages of a host are merged into one tree: a node is a path of block elements with their class and id words. Each
node has the presentations (sequences of child tags) and the contents (text digests) that pages show there. The entropy
of the presentations over the pages, and of each content over the pages that repeat it, give the node's importance; a
branch that looks alike on the host's pages and says the same there is of low importance and is removed from each page.

A host with few pages says nothing about repetition, so the elements that HTML itself names as surroundings, and the
class and id words that authors use for them, are of no importance on any host. Where a page marks its article or
main part, only that part is read, and its headings, paragraphs and lists stay, however often a host repeats them.

Equal pages count once in a tree. Trees are grouped sums by host and path. The hosts' removable paths are a small table
that is written before it meets the pages, so that its size decides how they are joined; page contents are shuffled only
where it is too large to be sent to them.

Defined cases: a null or empty page has an empty text; markup that is never closed ends with the page; a url without a
host belongs to the host ''; repeated rows are extracted each; other columns are ignored.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartulary.session import settle

LEAST_PAGES = 5
LEAST_IMPORTANCE = 0.35

# Element names of HTML, and words of class and id attributes that name surroundings.
RAW = {"script", "style", "noscript", "template", "textarea", "select", "svg", "iframe", "object", "title", "math", "canvas", "video", "audio"}
VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr", "param"}
INLINE = {
    "a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s",
    "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "ruby", "rb", "rt", "rp", "wbr",
}
SURROUNDING_TAGS = {"nav", "aside", "footer", "form", "menu", "dialog", "button", "head", "fieldset", "datalist"}
SURROUNDING_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner", "nav", "navbar",
    "navigation", "menu", "breadcrumb", "breadcrumbs", "sidebar", "aside", "widget", "widgets", "footer", "masthead", "topbar", "cookie",
    "cookies", "consent", "gdpr", "notice", "notices", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription",
    "signup", "login", "share", "sharing", "social", "related", "recommended", "comment", "comments", "commentlist", "disqus", "respond",
    "reply", "replies", "search", "toolbar", "pagination", "pager", "skip", "copyright", "legal",
}
SURROUNDING_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "alertdialog", "dialog", "menu", "menubar"}
TEXT_TAGS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "dl", "dt", "dd", "pre", "blockquote", "table", "tbody", "tr", "td", "th", "figure", "figcaption"}
CLOSES_ITSELF = {"p", "li", "dt", "dd", "tr", "td", "th", "option", "thead", "tbody"}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}}

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^"'>])*)>""", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_WORDS = re.compile(r"[a-z]+")
_HOST = re.compile(r"^[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")


def host_of(url: str | None) -> str:
    found = _HOST.match(url or "")
    return found[1].lower() if found else ""


@dataclass
class Block:
    path: str
    text: str
    main: bool
    plain: bool


@dataclass
class _Open:
    tag: str
    path: str
    hidden: bool
    main: bool
    plain: bool
    children: list[str] = field(default_factory=list)


def _attributes(source: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape((m[2] or "").strip("\"'")) for m in _ATTRIBUTE.finditer(source)} if source.strip() else {}


class PageParser:
    """Blocks of a page in page order, and the child tags seen at each path."""

    def __init__(self, source: str) -> None:
        self.blocks: list[Block] = []
        self.styles: dict[str, list[str]] = {}
        self.stack = [_Open("", "", False, False, True)]
        self.text: list[str] = []
        at, end = 0, len(source)
        while at < end:
            token = _TOKEN.search(source, at)
            if not token:
                self._say(source[at:])
                break
            self._say(source[at : token.start()])
            at = token.end()
            if token[2]:
                tag = token[2].lower()
                if token[1]:
                    self._close(tag)
                elif tag in RAW:
                    if not token[3].endswith("/"):
                        closing = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(source, at)
                        at = closing.end() if closing else end
                else:
                    self._open(tag, token[3])
        self._flush()

    def _say(self, text: str) -> None:
        if text and not self.stack[-1].hidden:
            self.text.append(text)

    def _flush(self) -> None:
        if self.text:
            said = " ".join(html.unescape("".join(self.text)).split())
            self.text = []
            if said:
                top = self.stack[-1]
                self.blocks.append(Block(top.path, said, top.main, top.plain))

    def _open(self, tag: str, source: str) -> None:
        if tag == "br" or tag == "hr":
            self.text.append(" ")
            return
        if tag in VOID:
            return
        top = self.stack[-1]
        attributes = _attributes(source)
        marks = _WORDS.findall(f"{attributes.get('class', '')} {attributes.get('id', '')}".lower())
        hidden = top.hidden or tag in SURROUNDING_TAGS or "hidden" in attributes or attributes.get("aria-hidden") == "true"
        hidden = hidden or bool(SURROUNDING_WORDS.intersection(marks)) or attributes.get("role", "").lower() in SURROUNDING_ROLES
        hidden = hidden or "display:none" in attributes.get("style", "").replace(" ", "").lower()
        if tag in ("header", "hgroup") or "header" in marks:
            hidden = hidden or not top.main
        if tag in ("body", "html", "article", "main"):  # an odd class word of the page itself says nothing
            hidden = top.hidden or (hidden and tag == "article" and bool({"comment", "comments", "reply", "ad", "related"}.intersection(marks)))
        if tag in INLINE:
            if hidden != top.hidden:
                self._flush()
            self.stack.append(_Open(tag, top.path, hidden, top.main, top.plain))
            return
        self._flush()
        self._end_open_blocks(tag)
        top = self.stack[-1]
        top.children.append(tag)
        main = top.main or tag in ("article", "main") or attributes.get("role", "").lower() in ("main", "article")
        plain = top.plain and (tag in TEXT_TAGS or tag in ("article", "main", "section", "header")) if top.main else True
        name = ".".join([tag, *sorted(set(marks))])
        self.stack.append(_Open(tag, f"{top.path}/{name}", hidden or top.hidden, main, plain))

    def _end_open_blocks(self, tag: str) -> None:
        """A paragraph ends at the next block; list items, terms and cells end at the next one of their list."""
        for ended in {"p", tag} & CLOSES_ITSELF:
            for place in range(len(self.stack) - 1, 0, -1):
                if self.stack[place].tag == ended:
                    self._pop(place)
                    break
                if self.stack[place].tag in SCOPES.get(ended, ()) or ended == "p" and self.stack[place].tag not in INLINE:
                    break

    def _close(self, tag: str) -> None:
        for place in range(len(self.stack) - 1, 0, -1):
            if self.stack[place].tag == tag:
                if tag not in INLINE:
                    self._flush()
                elif self.stack[place].hidden != self.stack[place - 1].hidden:
                    self._flush()
                self._pop(place)
                return
            if tag in INLINE and self.stack[place].tag not in INLINE:
                return

    def _pop(self, place: int) -> None:
        for node in self.stack[place:]:
            if node.tag not in INLINE:
                self.styles.setdefault(node.path, []).append(",".join(node.children))
        del self.stack[place:]


def main_blocks(source: str | None) -> tuple[list[Block], dict[str, list[str]]]:
    parser = PageParser(source or "")
    blocks = parser.blocks
    if any(b.main for b in blocks):
        blocks = [b for b in blocks if b.main]
    return blocks, parser.styles


def _mark(text: str) -> int:
    value = xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))
    return value - 2**64 if value >= 2**63 else value


_PARSED = "page_id long, url string, site long, page long, nodes array<struct<path:long,style:long,marks:array<long>>>, packed binary"
_NODE = pa.list_(pa.struct([("path", pa.int64()), ("style", pa.int64()), ("marks", pa.list_(pa.int64()))]))


def parse(pages: DataFrame) -> DataFrame:
    """Blocks of every page, packed, with the digests that the host's tree needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sites, marks, nodes, packed = [], [], [], []
                for url, source in zip(part["url"].to_pylist(), part["html"].to_pylist()):
                    blocks, styles = main_blocks(source)
                    said: dict[str, set[int]] = {}
                    for block in blocks:
                        said.setdefault(block.path, set()).add(_mark(block.text))
                    nodes.append([{"path": _mark(p), "style": _mark("|".join(styles.get(p, ()))), "marks": sorted(m)} for p, m in said.items()])
                    sites.append(_mark(host_of(url)))
                    marks.append(_mark("\n".join(b.text for b in blocks)))
                    packed.append(packer.compress(json.dumps([[_mark(b.path), b.text, b.main and b.plain] for b in blocks]).encode()))
                yield pa.RecordBatch.from_arrays(
                    [part["page_id"], part["url"], pa.array(sites, pa.int64()), pa.array(marks, pa.int64()), pa.array(nodes, _NODE), pa.array(packed, pa.binary())],
                    ["page_id", "url", "site", "page", "nodes", "packed"],
                )

    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return own.mapInArrow(run, _PARSED)


def importance(parsed: DataFrame) -> DataFrame:
    """(site, path, pages, presentation, content): both from 0 (the same on every page) to 1."""
    # repeated pages of a site count once: only the least id of each is read
    one = parsed.groupBy("site", "page").agg(F.min("page_id").alias("page_id"))
    nodes = parsed.select("site", "page", "page_id", F.explode("nodes").alias("node")).join(one, ["site", "page", "page_id"], "left_semi")
    nodes = nodes.select("site", "page", "node.path", "node.style", "node.marks").distinct()
    styles = nodes.groupBy("site", "path", "style").agg(F.count(F.lit(1)).alias("n"))
    shown = styles.groupBy("site", "path").agg(F.sum("n").alias("pages"), F.sum(F.col("n") * F.log("n")).alias("alike"))
    marks = nodes.select("site", "path", F.explode("marks").alias("mark")).groupBy("site", "path", "mark").agg(F.count(F.lit(1)).alias("n"))
    said = marks.groupBy("site", "path").agg((F.sum(F.col("n") * F.log("n")) / F.sum("n")).alias("repeated"))
    full = F.log("pages")
    return shown.join(said, ["site", "path"]).select(
        "site", "path", "pages",
        F.when(F.col("pages") > 1, 1 - F.col("alike") / F.col("pages") / full).otherwise(1.0).alias("presentation"),
        F.when(F.col("pages") > 1, 1 - F.col("repeated") / full).otherwise(1.0).alias("content"),
    )


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages(page_id, url, html)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            texts = []
            for data, removed in zip(batch["packed"].to_pylist(), batch["removed"].to_pylist()):
                gone = set(removed or ())
                texts.append(" ".join(text for path, text, stays in json.loads(unpack.decompress(data)) if stays or path not in gone))
            sizes = np.fromiter(map(len, texts), np.int64, len(texts))
            yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array(sizes)], ["page_id", "url", "text", "n_chars"])

    parsed = settle(parse(pages))
    low = importance(parsed).where((F.col("pages") >= LEAST_PAGES) & (F.greatest("presentation", "content") < LEAST_IMPORTANCE))
    removed = settle(low.groupBy("site").agg(F.collect_list("path").alias("removed")))
    return parsed.select("page_id", "url", "site", "packed").join(removed, "site", "left").select("page_id", "url", "packed", "removed").mapInArrow(
        run, "page_id long, url string, text string, n_chars long"
    )
