"""Main text of HTML pages by consensus host paths.

Each page scores its containers by the running text they hold and votes for the tag-class path of its best one. Spark adds the
votes up per host, and every page is read again with the path that won on its host, so a page whose own layout misleads
follows its neighbours. A page without an element on the winning path falls back to its own best container.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""(?:^|[\s/"'])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/]|$)""", re.I)
_RAW = {"script", "style", "textarea", "title", "xmp", "noembed", "noframes"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements that may hold the article.
_CONTAINERS = {"body", "article", "main", "section", "div", "td", "center", "blockquote"}
#: Elements whose start and end part blocks of text.
_BLOCKS = _CONTAINERS | {
    "html", "head", "p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "dl", "dt", "dd", "table", "caption", "thead", "tbody", "tfoot", "tr", "th", "pre", "hr",
    "address", "figure", "figcaption", "fieldset", "details", "summary", "nav", "header", "footer", "aside", "form", "hgroup", "menu", "dialog", "search",
}
#: Elements that never belong to the article.
_APART = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "select", "option", "head", "template", "noscript", "iframe", "object", "svg", "canvas", "audio", "video", "search"}
#: Words of a class or id that say the same, and roles.
_APART_NAMES = {
    "nav", "navbar", "navigation", "menu", "footer", "header", "masthead", "sidebar", "ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored",
    "promo", "promotion", "banner", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "comment", "comments", "reply", "replies", "disqus", "share", "sharing", "social",
    "related", "tags", "breadcrumb", "breadcrumbs", "pagination", "pager", "newsletter", "subscribe", "popup", "modal", "overlay", "login", "widget", "toolbar", "hidden",
}
#: Words that no part of an article bears, however much text the element holds.
_NEVER_NAMES = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "cookie", "cookies", "consent", "gdpr", "comment", "comments", "reply", "replies", "disqus"}
#: First and last parts of names that tell how a page is laid out and not what an element is (`has-sidebar`, `header-fixed`).
_STATE_FIRST = {"has", "no", "not", "with", "without"}
_STATE_LAST = {"fixed", "sticky", "enabled", "disabled", "open", "closed", "on", "off"}
#: Names that wrappers of an article bear too; an element with another whole name has to hold more to be one.
_LAYOUT_NAMES = {"nav", "navbar", "navigation", "menu", "footer", "header", "masthead", "sidebar", "banner", "widget", "toolbar", "overlay", "modal", "popup"}
_APART_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar", "form"}
#: Named by the page itself as its content: names in their class don't set them apart.
_TRUSTED = {"html", "body", "article", "main"}
#: What a container's score passes on to the container around it.
_PASSED_ON = 0.8


def _named(token: str) -> int:
    """Whether a class or id sets its element apart: 0 no, 1 unless the element wraps the article, 2 hardly ever, 3 unless
    the page's main element lies within."""
    parts = re.findall(r"[a-z]+", token)
    said = [i for i, part in enumerate(parts) if part in _APART_NAMES]
    if not said or len(parts) > 1 and (parts[0] in _STATE_FIRST or parts[-1] in _STATE_LAST) or all(i and parts[i - 1] in _STATE_FIRST for i in said):
        return 0
    if not _NEVER_NAMES.isdisjoint(parts):
        return 3
    return 2 if len(parts) == 1 and parts[0] not in _LAYOUT_NAMES else 1


def _attributes(raw: str) -> tuple[str, int, bool]:
    """The generalised class of a tag, digits as N, whether its names set it apart (as `_named`), and whether its role or
    being hidden does."""
    named = 0
    apart = False
    classes: list[str] = []
    for m in _ATTRIBUTE.finditer(raw):
        key, value = m[1].lower(), next((g for g in m.groups()[1:] if g is not None), "").lower()
        if key == "class":
            classes += value.split()
        if key in ("class", "id"):
            named = max([named, *map(_named, value.split())])
        elif key == "role":
            apart |= value in _APART_ROLES
        elif key == "hidden" or value == "true":
            apart = True
    return ".".join(sorted({re.sub(r"[0-9]+", "N", c) for c in classes})), named, apart


class Page:
    """The text blocks of a page and its containers.

    `blocks`: (text, characters inside links, container) of text outside elements that are set apart, in page order.
    `containers`: (path, container around it). A path is a hash of the tags and generalised classes from the root; containers
    that are set apart have none.

    What a name sets apart is read like the rest and left out at the end, unless the element turns out to wrap the article.
    """

    def __init__(self, source: str | None):
        self.blocks: list[tuple[str, int, int]] = []
        self.containers: list[tuple[int | None, int]] = [(0, -1)]
        #: Elements that a name sets apart: the one around it, and what `_named` said. Number 0 is the page.
        self._marks: list[tuple[int, int]] = [(-1, 0)]
        #: The innermost such element of each block, of each container, and of each article and main.
        self._block_marks: list[int] = []
        self._container_marks: list[int] = [0]
        self._container_tags: list[str] = [""]
        self._articles: list[tuple[str, int]] = []
        self._pieces: list[str] = []
        self._linked = 0
        self._in_link = False
        #: Open elements: tag, container, whether set apart, mark. Only containers and elements that are set apart are kept.
        self._open: list[tuple[str, int, bool, int]] = [("", 0, False, 0)]
        #: How many elements of a tag are open, so that an end tag without one is told at once.
        self._opened: Counter[str] = Counter()
        if source:
            self._read(source)

    def _read(self, source: str) -> None:
        at = 0
        search = _TAG.search
        while True:
            m = search(source, at)
            if m is None:
                self._text(source[at:])
                break
            if m.start() > at:
                self._text(source[at:m.start()])
            at = m.end()
            tag = m[2] or m[5]
            if tag is None:
                continue
            tag = tag.lower()
            if m[1] or m[4]:
                self._end(tag)
            else:
                raw = m[3] if m[2] else m[6]
                self._start(tag, raw)
                if tag in _RAW:  # a closing slash means nothing here
                    close = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(source, at)
                    at = close.end() if close else len(source)
                    self._end(tag)
        self._flush()
        if len(self._marks) > 1:
            self._leave_out()

    def _leave_out(self) -> None:
        """Leaves out what names set apart. Comments, adverts and consents stay only around a main element. Elements with a whole name that no wrapper bears stay only if they hold a main, or
        all articles and most running text; of what is left, the others stay if they hold a main, all articles or most
        running text."""
        out = [False] * len(self._marks)
        for least in (3, 2, 1):
            running, articles, mains = ([0] * len(out) for _ in range(3))
            for (text, linked, _), m in zip(self.blocks, self._block_marks):
                if not out[m]:
                    running[m] += max(0, len(text) - 2 * linked)
            for tag, m in self._articles:
                if not out[m]:
                    (mains if tag == "main" else articles)[m] += 1
            for counts in (running, articles, mains):
                for m in range(len(out) - 1, 0, -1):
                    counts[self._marks[m][0]] += counts[m]
            for m in range(1, len(out)):
                around, named = self._marks[m]
                most, every = 2 * running[m] > running[0], articles[m] and articles[m] == articles[0]
                wraps = mains[m] or (False if least == 3 else every and most if least == 2 else every or most)
                out[m] |= out[around] or named == least and not wraps
        self.blocks = [b for b, m in zip(self.blocks, self._block_marks) if not out[m]]
        self.containers = [(None if out[m] else path, around) for (path, around), m in zip(self.containers, self._container_marks)]

    def _text(self, text: str) -> None:
        if self._open[-1][2]:
            return
        if "&" in text:
            text = html.unescape(text)
        self._pieces.append(text)
        if self._in_link:
            self._linked += len(text.strip())

    def _flush(self) -> None:
        if self._pieces:
            text = " ".join("".join(self._pieces).split())
            if text:
                self.blocks.append((text, self._linked, self._open[-1][1]))
                self._block_marks.append(self._open[-1][3])
            self._pieces = []
        self._linked = 0

    def _start(self, tag: str, raw: str) -> None:
        if tag in _BLOCKS:
            self._flush()
            top = self._open[-1][0]
            if top == "p" or top == tag and tag in ("li", "td", "th", "dt", "dd"):
                self._pop()
        elif tag in ("option", "optgroup"):
            while self._open[-1][0] == "option" or self._open[-1][0] == tag:
                self._flush()
                self._pop()
        elif tag in ("br", "img", "wbr"):
            self._pieces.append(" " if tag != "wbr" else "")
        elif tag == "a":
            self._in_link = True
        if tag in _VOID:
            return
        _, container, apart, mark = self._open[-1]
        label, named, kept_out = _attributes(raw) if raw else ("", 0, False)
        trusted = tag in _TRUSTED
        apart_here = apart or tag in _APART or kept_out and not trusted
        named = 0 if trusted or apart_here else named
        if named:
            self._flush()
            self._marks.append((mark, named))
            mark = len(self._marks) - 1
        if tag in ("article", "main") and not apart_here:
            self._articles.append((tag, mark))
        if tag in _CONTAINERS and not apart_here:
            path = hashlib.blake2b(f"{self.containers[container][0]}>{tag}.{label}".encode("utf-8", "surrogatepass"), digest_size=8).digest()
            self.containers.append((int.from_bytes(path, "big", signed=True), container))
            self._container_marks.append(mark)
            self._container_tags.append(tag)
            self._push(tag, len(self.containers) - 1, False, mark)
        elif named or apart_here and not apart or tag in _CONTAINERS or tag in _APART:
            self._flush()
            self._push(tag, container, apart_here, mark)

    def _push(self, tag: str, container: int, apart: bool, mark: int) -> None:
        self._open.append((tag, container, apart, mark))
        self._opened[tag] += 1

    def _pop(self) -> str:
        tag = self._open.pop()[0]
        self._opened[tag] -= 1
        return tag

    def _end(self, tag: str) -> None:
        if tag == "a":
            self._in_link = False
        if tag in _BLOCKS:
            self._flush()
        if self._opened[tag]:
            self._flush()
            while self._pop() != tag:
                pass

    def best(self) -> tuple[int, float] | None:
        """The path of the container with the best score, and the score: running text outside links, of which a
        container passes a share on to the one around it. The deeper one wins a tie."""
        scores = [0.0] * len(self.containers)
        for text, linked, container in self.blocks:
            scores[container] += max(0, len(text) - 2 * linked)
        for c in range(len(self.containers) - 1, 0, -1):
            scores[self.containers[c][1]] += _PASSED_ON * scores[c]
        best = max(range(1, len(scores)), key=lambda c: (scores[c], c), default=None)
        return None if best is None or scores[best] <= 0 else (self.containers[best][0], scores[best])

    def _whole(self, found: list[bool]) -> list[bool]:
        """Containers widened to the article they belong to: the innermost article around one, else the innermost main, else
        the outermost container of those around it that hold running text of their own, which a page's body or cell is not."""
        own = [False] * len(found)
        for text, linked, container in self.blocks:
            own[container] |= len(text) > 2 * linked
        tags, around = self._container_tags, [a for _, a in self.containers]
        # For each container the nearest article, main, and the top of its chain of containers with text of their own.
        article, main, top = [0] * len(found), [0] * len(found), [0] * len(found)
        for c in range(1, len(found)):
            up = around[c]
            article[c] = c if tags[c] == "article" else article[up]
            main[c] = c if tags[c] == "main" else main[up]
            top[c] = top[up] if own[up] and up and tags[up] not in ("body", "td", "center") else c
        out = [False] * len(found)
        for c in range(1, len(found)):
            if found[c]:
                out[article[c] or main[c] or top[c]] = True
        return out

    def text(self, path: int | None) -> str:
        """The blocks inside elements on `path`, widened to the article they belong to, joined by line feeds; without such an
        element, inside the page's own best container; without that, all blocks."""
        if path is None or all(p != path for p, _ in self.containers[1:]):
            own = self.best()
            path = own[0] if own else None
        if path is None:
            return "\n".join(b[0] for b in self.blocks)
        inside = self._whole([c > 0 and p == path for c, (p, _) in enumerate(self.containers)])
        for c, (_, around) in enumerate(self.containers[1:], 1):
            inside[c] |= inside[around]
        return "\n".join(b[0] for b in self.blocks if inside[b[2]])


def host(url: Column) -> Column:
    """The host of a URL in lower case; empty for null and for what is no URL."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def host_paths(pages: DataFrame) -> DataFrame:
    """`host`, `path`: the path with most votes of the host's pages, then the highest score, then the smallest number."""

    @F.pandas_udf("path long, score double")
    def best_of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in batches:
            found = [Page(h).best() for h in part]
            yield pd.DataFrame({"path": pd.array([f[0] if f else None for f in found], "Int64"), "score": [f[1] if f else None for f in found]})

    votes = pages.select(host(F.col("url")).alias("host"), best_of(F.col("html")).alias("v")).where("v.path is not null")
    counted = votes.groupBy("host", "v.path").agg(F.count("*").alias("n"), F.sum("v.score").alias("s"))
    return counted.groupBy("host").agg(F.max(F.struct("n", F.round("s").alias("s"), (-F.col("path")).alias("p"))).alias("w")).select("host", (-F.col("w.p")).alias("path"))


def extract_main_text(pages: DataFrame) -> DataFrame:
    """`page_id`, `url`, `text`, `n_chars`, one row per row of `pages` (`page_id`, `url`, `html`).

    Character references are decoded, white space inside a block becomes one space, blocks stand in page order on lines of
    their own. Null, empty and text-free pages give an empty text; null URLs and what is no URL vote as one host; repeated
    rows vote and answer like any other; ties are settled as `host_paths` says; an empty table gives none; further columns
    are not read.
    """
    winners = cut_lineage(host_paths(pages))

    @F.pandas_udf("string")
    def read(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for pages_part, paths in batches:
            yield pd.Series([Page(h).text(None if pd.isna(p) else int(p)) for h, p in zip(pages_part, paths)], dtype=object)

    # Numbers travel as text, for a long next to a null would become a double.
    named = winners.select(F.col("host").alias("_host"), F.col("path").cast("string").alias("_path"))
    rows = pages.select("page_id", "url", F.col("html").alias("_html")).join(named, host(F.col("url")) == F.col("_host"), "left")
    return rows.select("page_id", "url", read("_html", "_path").alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))
