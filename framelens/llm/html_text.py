"""Main text of web pages by composite text density.

Every element gets a density: its characters per tag, adjusted by the share of characters and tags in
links. An element's density sum is that of its children. The element with the greatest sum holds the
article; the smallest density on the path from it up to the body is the threshold by which parts beside
that path still belong to it. Elements that say what they are (navigation, forms, adverts, comments, ...)
are left out before any density is computed, unless they hold most of the page's text outside links.

The base of the logarithm in the density is raised by one: as published it can be 1, where none exists.

A page is parsed in one pass without recursion, in its own row. Nulls: null html is an empty page with
text "". Null ids and urls are passed on. Repeated rows are extracted each. An empty table gives no rows.
Broken pages (cut off, tags left open, wrong ends) are read as browsers would, elements closed early.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from math import e, log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Kinds of elements in HTML.
RAW = {"script", "style", "noscript", "template", "iframe", "textarea", "title", "xmp", "noembed", "noframes"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre "
    "section select summary table tbody td tfoot th thead tr ul".split()
)
# Never text, and left out unless they hold most of it.
CONTROLS = set("audio button canvas datalist input object optgroup option select svg video".split())
NOT_TEXT = CONTROLS | set("aside dialog footer form head menu nav".split())
# Those that pages also put around whole articles.
AROUND = {"form", "head"}
# Elements that an opening tag of the same set ends, up to the nearest element that holds such lists.
SIBLINGS = {t: s for s in ({"li"}, {"dt", "dd"}, {"tr"}, {"td", "th"}, {"option"}, {"thead", "tbody", "tfoot"}) for t in s}
HOLDERS = set("ul ol dl menu table tr select body td th".split())
# A class, id or role by which an element says that it isn't part of the article: these words alone, joined
# to each other, or joined to words for a place or a kind of box. Anything else (has-sidebar) says less.
_TALK = "comments?|disqus|respond|responses?"
_WORD = (
    r"ads?|adverts?|advertisements?|advertising|sponsor(?:s|ed)?|promos?|promotions?|banner|nav|navbar|navigation|menu|"
    rf"breadcrumbs?|sidebar|footer|masthead|{_TALK}|cookies?|consent|notice|popup|modal|newsletter|subscribe|share|"
    r"sharing|social|related|widget|search|login|complementary|contentinfo"
)
_PLACE = (
    r"left|right|top|bottom|upper|lower|primary|secondary|site|global|mobile|desktop|wrap|wrapper|container|area|"
    r"section|block|box|bar|list|links?|items?|buttons?|icons?|posts?|form|signup|\d+"
)
ELSEWHERE = re.compile(rf"(?:(?:{_PLACE})[_-]+)*(?:{_WORD})(?:[_-]+(?:{_WORD}|{_PLACE}))*", re.I).fullmatch
TALK = re.compile(rf"(?:.*[_-])?(?:{_TALK})(?:[_-].*)?", re.I).fullmatch
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+|[^>]*)>|<[/a-zA-Z][^>]*\Z",
    re.S,
)
_ATTRIBUTES = re.compile(r"([^\s/>=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?").findall
# What an element says of itself: nothing, that it isn't part of the article, the same beyond doubt, that it
# is no text.
PART, APART, SURELY, NO_TEXT = range(4)


def _says(attributes: str) -> int:
    """PART, APART or SURELY by the attributes of a tag; of repeated attributes the first counts."""
    given: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTES(attributes):
        given.setdefault(name.lower(), a or b or c)
    if "hidden" in given or given.get("aria-hidden", "").strip().lower() == "true":
        return SURELY
    tokens = [t for n in ("class", "id", "role") if n in given for t in unescape(given[n]).split() if ELSEWHERE(t)]
    return (SURELY if any(map(TALK, tokens)) else APART) if tokens else PART


class Page:
    """Elements in page order (a parent before its children) and the runs of text below them."""

    def __init__(self, html: str):
        self.tag, self.parent, self.says = ["html"], [-1], [PART]
        self.chars, self.links = [0], [0]
        # Per run of text its pieces, each with its element.
        self.runs: list[list[tuple[int, str]]] = []
        self._stack, self._links, self._run = [0], 0, []
        self._parse(html)

    def _parse(self, html: str) -> None:
        at = 0
        while m := _TOKEN.search(html, at):
            self._text(html[at : m.start()])
            at = m.end()
            name = (m[2] or "").lower()
            if not name:
                continue
            if m[1]:
                self._close(name)
            elif name in RAW:
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.I).search(html, at)
                at = end.end() if end else len(html)
            else:
                self._open(name, m[3])
        self._text(html[at:])
        self._flush()

    def _text(self, raw: str) -> None:
        if not raw:
            return
        text, node = unescape(raw), self._stack[-1]
        n = sum(map(len, text.split()))
        self.chars[node] += n
        self.links[node] += n * (self._links > 0)
        if self._run or n:
            self._run.append((node, text))

    def _flush(self) -> None:
        if self._run:
            self.runs.append(self._run)
            self._run = []

    def _open(self, name: str, attributes: str) -> None:
        if name in BLOCKS:
            self._flush()
        if name == "br" and self._run:
            self._run.append((self._stack[-1], " "))
        if name in VOID:
            return
        if name in BLOCKS and "p" in (self.tag[i] for i in self._stack[-8:]):
            self._close("p")
        if name in SIBLINGS:
            for i in reversed(self._stack):
                if self.tag[i] in SIBLINGS[name]:
                    self._close(self.tag[i])
                    break
                if self.tag[i] in HOLDERS:
                    break
        above = self._stack[-1]
        says = PART
        if name in CONTROLS:
            says = NO_TEXT
        elif name in NOT_TEXT or (name == "header" and not self._inside("article", "main")):
            says = APART if name in AROUND else SURELY
        elif attributes and name != "body" and name != "html":
            says = _says(attributes)
        self.tag.append(name)
        self.parent.append(above)
        self.says.append(says)
        self.chars.append(0)
        self.links.append(0)
        self._stack.append(len(self.tag) - 1)
        self._links += name == "a"

    def _inside(self, *names: str) -> bool:
        return any(self.tag[i] in names for i in self._stack)

    def _close(self, name: str) -> None:
        if name in BLOCKS:
            self._flush()
        for k in range(len(self._stack) - 1, 0, -1):
            if self.tag[self._stack[k]] == name:
                for i in self._stack[k:]:
                    self._links -= self.tag[i] == "a"
                del self._stack[k:]
                return
            # The end of an inline element doesn't end the block around it.
            if name not in BLOCKS and self.tag[self._stack[k]] in BLOCKS:
                return

    def _left_out(self) -> list[bool]:
        """Per element whether it or one around it is left out.

        A form, or what only a name tells, stays in if it holds more than half of the page's text outside
        links. Comments, footers and the like can be longer than the article, so they stay in by that rule
        only where nothing else has such text.
        """
        size = len(self.tag)
        plain = [c - n for c, n in zip(self.chars, self.links, strict=True)]
        own = plain[:]
        for i in range(size - 1, 0, -1):
            if self.says[i] != NO_TEXT:
                plain[self.parent[i]] += plain[i]
        most = [2 * n > plain[0] for n in plain]
        out = [False] * size
        for never in ((SURELY, NO_TEXT), (NO_TEXT,)):
            for i in range(1, size):
                out[i] = out[self.parent[i]] or self.says[i] in never or (self.says[i] != PART and not most[i])
            if any(n and not o for n, o in zip(own, out, strict=True)):
                break
        return out

    def text(self) -> str:
        size, out = len(self.tag), self._left_out()
        chars, links, tags, link_tags = self.chars[:], self.links[:], [0] * size, [0] * size
        for i in range(size - 1, 0, -1):
            p = self.parent[i]
            if not out[i]:
                chars[p] += chars[i]
                links[p] += links[i]
                tags[p] += tags[i] + 1
                link_tags[p] += link_tags[i] + (self.tag[i] == "a")
        if not chars[0]:
            return ""
        share = links[0] / chars[0]
        density, sums = [0.0] * size, [0.0] * size
        for i in range(size - 1, -1, -1):
            c, t, lc = chars[i], tags[i] or 1, links[i]
            if c and not out[i]:
                base = 1 + log(c / max(c - lc, 1) * lc + share * c + e)
                density[i] = c / t * max(0.0, log(c * t / (max(lc, 1) * (link_tags[i] or 1)), base))
            if i:
                sums[self.parent[i]] += density[i]
        blocks = [i for i in range(size) if self.tag[i] in BLOCKS and not out[i]]
        best = max(blocks or [0], key=lambda i: (sums[i], -i))
        path = [best]
        while path[-1]:
            path.append(self.parent[path[-1]])
        least = min(density[i] for i in path)
        on_path = set(path)
        # What belongs: the best subtree, text directly on the path, and dense enough parts beside it.
        kept = [False] * size
        for i in range(size):
            p = self.parent[i]
            if i == best or i in on_path:
                kept[i] = True
            elif p >= 0 and kept[p] and not out[i]:
                kept[i] = p not in on_path or p == best or density[i] >= least
        blocks_of_text = []
        for run in self.runs:
            inside = [(i, t) for i, t in run if not out[i]]
            # A run belongs where its first word stands.
            at = next((i for i, t in inside if t.strip()), None)
            if at is not None and kept[at]:
                blocks_of_text.append(" ".join("".join(t for _, t in inside).split()))
        return "\n\n".join(blocks_of_text)


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url and text of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [Page(html.as_py() or "").text() for html in batch["html"]]
            yield pa.RecordBatch.from_arrays(
                [batch["page_id"].cast(pa.int64()), batch["url"].cast(pa.string()), pa.array(text, pa.string())],
                ["page_id", "url", "text"],
            )

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string")


def with_length(texts: DataFrame) -> DataFrame:
    return texts.withColumn("n_chars", F.char_length("text").cast("long"))
