"""Main text of web pages, with site template removal.

A page is read into elements and runs of text. Every element's subtree is hashed (tags and texts), and Spark counts for
every host on how many of its different pages each hash occurs. A subtree outside the article goes if it recurs on
OUTSIDE_PAGES pages of its host and on OUTSIDE_SHARE of them, for sites have several variants of a menu; a subtree that may
be the article's own (within it, or anywhere on a page that marks none) goes if it recurs on INSIDE_PAGES and
INSIDE_SHARE, and then outside of articles too. Rules for tags, roles and classes then take what never recurs, as on hosts of fewer than OUTSIDE_PAGES
different pages, where nothing can: menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, comments.
Of what stays, only the text within the elements that mark an article counts, unless they hold less than the rest: then they
are teasers, and all of it counts.

Plan: one Arrow pass hashes subtrees (8 bytes each); two sums with partial aggregation count them; the templates of a
host are joined to its pages (broadcast up to BROADCAST_HASHES hashes in all, else a shuffle join with skew handling), and a
second Arrow pass extracts. Pages that are copies of each other count once, so that an article which many pages of
a host repeat is not taken for a template. The list of a host has at most (subtrees a page) / (share) entries, whatever
the number of its pages. Reading is linear in the page.

Nulls and edge cases: null html counts as empty and gives an empty text; a null url has no host, so nothing is taken
for a template there; unclosed and misnested tags are closed where browsers would; extra columns are ignored; rows that
repeat are extracted each. Whatever its length, a page is read whole.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumage.llm import common as C

OUTSIDE_PAGES, OUTSIDE_SHARE = 3, 0.05
INSIDE_PAGES, INSIDE_SHARE = 10, 0.5
BROADCAST_HASHES = 1_000_000

#: The beginning of a tag, a comment or another declaration.
_OPEN = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)|(!--)|[!?/])")
#: Where a tag ends, or a quoted value begins, in which > doesn't end it.
_STOP = re.compile(r">|=\s*([\"'])")
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_RAW = {"script", "style", "textarea", "title", "xmp", "noembed", "noframes"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset",
    "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main",
    "menu", "nav", "ol", "option", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
#: What a start tag closes if it is open above the nearest of the second set.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
}
_DROP = {
    "aside", "audio", "button", "canvas", "datalist", "dialog", "fieldset", "footer", "form", "head", "iframe", "input", "label", "legend", "map", "menu",
    "nav", "noscript", "object", "optgroup", "option", "search", "select", "svg", "template", "video",
} | _RAW
#: Elements that hold the page or its article.
_WHOLE = {"html", "body", "article", "main"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_ROLES = {"alert", "alertdialog", "banner", "complementary", "contentinfo", "dialog", "form", "menu", "menubar", "navigation", "search", "toolbar"}
#: Words that mark what is no article where a class or id, one name between spaces, is made of them alone and of `_BESIDE`.
_WORDS = {
    "ad", "ads", "adv", "advert", "advertisement", "advertising", "adsense", "adslot", "banner", "breadcrumb", "breadcrumbs", "comment", "comments",
    "consent", "cookie", "cookies", "copyright", "disqus", "footer", "gdpr", "header", "login", "masthead", "menu", "modal", "nav", "navbar",
    "navigation", "newsletter", "notice", "notification", "pager", "pagination", "paywall", "popup", "promo", "promoted", "recommended", "related",
    "replies", "reply", "respond", "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget",
}

#: Words that say no more than where such a part is or what shape it has.
_BESIDE = {
    "area", "bar", "bottom", "box", "button", "buttons", "container", "content", "form", "global", "icons", "inner", "item", "items", "left", "link", "links",
    "list", "local", "main", "media", "outer", "page", "panel", "posts", "primary", "right", "secondary", "section", "site", "slot", "top", "unit", "wrap", "wrapper",
}


def _marks(name: str) -> bool:
    """Whether a class or id names what is no article: "ad", "site-footer", "ad-slot-2", but not "share-price"."""
    words = {w for w in re.split(r"[_-]+", name) if w and not w.isdigit()}
    return bool(words & _WORDS) and words <= _WORDS | _BESIDE


class Page:
    """elements: tag, parent, whether the rules drop it, whether an article holds it, its subtree's hash (0: no text);
    blocks: lists of (element, raw text)."""

    def __init__(self, html: str):
        self.html, self.absent = html, set()
        self.tag, self.parent, self.drop, self.article, self.hash, self.dropped_from = ["#root"], [-1], [False], [False], [0], [0]
        self.inside: list[list[str]] = [["#root"]]
        self.blocks: list[list[tuple[int, str]]] = [[]]
        self.stack, self.main = [0], False
        self.depths: dict[str, list[int]] = defaultdict(list)  # of the open elements, by tag
        self.open_blocks: list[int] = []  # depths
        at, n = 0, len(html)
        while at < n:
            m = _OPEN.search(html, at)
            if m is None:
                self._text(html[at:])
                break
            end = self._end_of_tag(m) if m[3] is None else self._find("-->", m.end()) + 2
            if m[3] and end < m.end():
                end = n
            if end < 0:  # no tag ends from here on
                comment = html.find("<!--", m.end())
                self._text(html[at : comment if comment >= 0 else n])
                break
            if m.start() > at:
                self._text(html[at : m.start()])
            at = end + 1
            name = (m[2] or "").lower()
            if not name:
                continue
            if m[1]:
                self._end(name)
                continue
            self._start(name, html[m.end() : end])
            if name in _RAW:
                shut = re.compile(rf"</{name}\b", re.I).search(html, at)
                self._text(html[at : shut.start() if shut else n])
                end = self._find(">", shut.end()) if shut else -1
                at = end + 1 if end >= 0 else n
                self._close(len(self.stack) - 1)
        self._close(0)
        del self.html

    def _find(self, what: str, at: int) -> int:
        """Where `what` stands next; once it is absent it isn't looked for again."""
        found = -1 if what in self.absent else self.html.find(what, at)
        if found < 0:
            self.absent.add(what)
        return found

    def _end_of_tag(self, m: re.Match) -> int:
        """Where the > of the tag is: outside of quoted values, or the first if a value's quote is never closed."""
        first = self._find(">", m.end())
        if first < 0 or not m[2]:
            return first
        at = m.end()
        while stop := _STOP.search(self.html, at):
            if not stop[1]:
                return stop.start()
            at = self._find(stop[1], stop.end()) + 1
            if not at:
                break
        return first

    def _text(self, text: str) -> None:
        if text and not text.isspace():
            top = self.stack[-1]
            self.blocks[-1].append((top, text))
            self.inside[top].append(" ".join(text.split()))
        elif text and self.blocks[-1]:
            self.blocks[-1].append((self.stack[-1], text))

    def _break(self) -> None:
        if self.blocks[-1]:
            self.blocks.append([])

    def _start(self, name: str, attributes: str) -> None:
        if name in _BLOCK:
            self._break()
            if self.open_blocks and self.tag[self.stack[self.open_blocks[-1]]] == "p":  # a block ends an open paragraph
                self._close(self.open_blocks[-1])
        if name in _CLOSES:
            shut, within = _CLOSES[name]
            border = max((self.depths[t][-1] for t in within if self.depths[t]), default=0)
            above = [d[i] for t in shut if (d := self.depths[t]) and (i := bisect_right(d, border)) < len(d)]
            if above:
                self._close(min(above))
        if name == "br":
            self.blocks[-1].append((self.stack[-1], " "))
        if name in _VOID:
            return
        above = self.stack[-1]
        article = self.article[above] or name == "article" or name == "main"
        self.tag.append(name)
        self.parent.append(above)
        drop = self.drop[above] or name in _DROP
        if attributes and not drop and name not in ("html", "body"):
            found = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(attributes)}
            names = f"{found.get('class') or ''} {found.get('id') or ''}".lower().split()
            role = found.get("role", "").lower()
            article |= role in ("main", "article")
            drop = any(map(_marks, names)) or role in _ROLES or "hidden" in found or found.get("aria-hidden", "").lower() == "true"
        drop |= name == "header"
        if name in _HEADINGS and self._own_header(above):
            drop = False
        e = len(self.tag) - 1
        self.dropped_from.append(self.dropped_from[above] if drop and self.drop[above] else e)
        self.drop.append(drop)
        self.article.append(article)
        self.main |= article and not drop
        self.hash.append(0)
        self.inside.append([name])
        self.depths[name].append(len(self.stack))
        if name in _BLOCK:
            self.open_blocks.append(len(self.stack))
        self.stack.append(e)

    def _own_header(self, element: int) -> bool:
        """Whether the uppermost of the dropped elements around is a plain header of an article."""
        top = self.dropped_from[element]
        return self.drop[element] and self.tag[top] == "header" and self.article[self.parent[top]]

    def _end(self, name: str) -> None:
        if name in _BLOCK:
            self._break()
        own = self.depths[name][-1] if self.depths[name] else 0
        # an inline end tag without a start in this block is none
        if own and (name in _BLOCK or not self.open_blocks or own > self.open_blocks[-1]):
            self._close(own)

    def _close(self, depth: int) -> None:
        """Close the elements of the stack from the top down to that depth."""
        while len(self.stack) > depth:
            e = self.stack.pop()
            if e:
                self.depths[self.tag[e]].pop()
                if self.tag[e] in _BLOCK:
                    self.open_blocks.pop()
            parts = self.inside[e]
            if len(parts) > 1:
                self.hash[e] = xxhash.xxh3_64_intdigest("\x1f".join(parts)) or 1
                if e:
                    self.inside[self.parent[e]].append(f"\x1e{self.hash[e]:x}")
            self.inside[e] = []

    def key(self, e: int) -> int:
        """A subtree's hash, whose lowest bit tells whether it is outside the article."""
        outside = self.main and not self.article[e]
        return self.hash[e] & ~1 | outside

    def subtrees(self) -> set[int]:
        """Keys of the elements with text, those aside that hold the article or the page."""
        return {self.key(e) for e in range(1, len(self.tag)) if self.hash[e] and self.tag[e] not in _WHOLE}

    def text(self, template: set[int] = frozenset()) -> str:
        return self.extract(template)[0]

    def extract(self, template: set[int] = frozenset()) -> tuple[str, int, int]:
        """Blocks of what stays, joined by two newlines; and the numbers of subtrees with text that go as templates
        (keys of `template`) and, after those, by the rules for tags and classes; subtrees inside of such don't count."""
        gone, gone_by_site, by_site, by_rule = [False] * len(self.tag), [False] * len(self.tag), 0, 0
        for e in range(1, len(self.tag)):
            above = self.parent[e]
            heading = self.drop[above] and not self.drop[e]  # which an article's header keeps
            site = self.hash[e] != 0 and (self.key(e) in template or self.hash[e] & ~1 in template) and self.tag[e] not in _WHOLE
            gone[e] = self.drop[e] or site or (gone[above] and not heading)
            gone_by_site[e] = site or gone_by_site[above]
            by_site += site and not gone_by_site[above]
            by_rule += self.hash[e] != 0 and self.drop[e] and not self.drop[above] and not gone_by_site[e]
        stays = [[(e, t) for e, t in block if not gone[e]] for block in self.blocks]
        within, beside = (sum(len(t.strip()) for block in stays for e, t in block if self.article[e] == own) for own in (True, False))
        out, whole = [], not self.main or beside > within
        for block in stays:
            raw = "".join(t for e, t in block if whole or self.article[e])
            if raw and (text := " ".join(unescape(raw).split())):
                out.append(text)
        return "\n\n".join(out), by_site, by_rule


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, html) to (host, page, subtrees): hash of the text that the rules leave, and hashes of its subtrees."""
    for batch in batches:
        pages, trees = [], []
        for html in batch.column(1).to_pylist():
            p = Page(html or "")
            pages.append(_signed(xxhash.xxh3_64_intdigest(p.text())))
            trees.append([_signed(h) for h in p.subtrees()])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(pages, pa.int64()), pa.array(trees, pa.list_(pa.int64()))], names=["host", "page", "subtrees"]
        )


def host(url: str):
    """The host of a url, in lower case; null if it has none."""
    found = F.lower(F.regexp_extract(F.col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(found != "", found)


def templates(pages: DataFrame) -> DataFrame:
    """(host, template): the keys of the subtrees that recur on many of the host's different pages."""
    rows = pages.select(F.xxhash64(host("url")).alias("host"), "html", host("url").alias("name")).where("name is not null")
    found = C.materialize(rows.select("host", "html").mapInArrow(_subtrees, "host long, page long, subtrees array<long>"))
    size = found.select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("pages")).where(F.col("pages") >= OUTSIDE_PAGES)
    seen = found.select("host", "page", F.explode("subtrees").alias("subtree")).distinct().groupBy("host", "subtree").agg(F.count("*").alias("n"))
    outside = F.col("subtree").bitwiseAND(1) == 1
    enough = (F.col("n") >= F.when(outside, OUTSIDE_PAGES).otherwise(INSIDE_PAGES)) & (F.col("n") >= F.when(outside, OUTSIDE_SHARE).otherwise(INSIDE_SHARE) * F.col("pages"))
    many = seen.where(F.col("n") >= OUTSIDE_PAGES).join(size, "host").where(enough)
    return C.materialize(many.groupBy("host").agg(F.collect_list("subtree").alias("template")))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [
            Page(h or "").extract({x & (1 << 64) - 1 for x in t or ()})
            for h, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
        ]
        text, by_site, by_rule = zip(*found, strict=True) if found else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(text, pa.string()), *(pa.array(x, pa.int64()) for x in (list(map(len, text)), by_site, by_rule))],
            names=["page_id", "url", "text", "n_chars", "n_templates", "n_ruled"],
        )


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars, n_templates, n_ruled), one row per row of pages; the last two are the numbers of
    subtrees that went as templates and by the rules."""
    known = templates(pages)
    hashes = known.agg(F.coalesce(F.sum(F.size("template")), F.lit(0))).first()[0]
    side = F.broadcast(known) if hashes <= BROADCAST_HASHES else known
    rows = pages.select(F.col("page_id").cast("long"), "url", "html", F.xxhash64(host("url")).alias("host")).join(side, "host", "left")
    return rows.select("page_id", "url", "html", "template").mapInArrow(_extract, "page_id long, url string, text string, n_chars long, n_templates long, n_ruled long")


def op10(spark, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
