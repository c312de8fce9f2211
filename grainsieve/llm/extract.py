"""Main text of web pages by tree scoring: paragraphs pass points up, the best container and its siblings are kept."""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Elements without content, elements whose content is not markup, and elements that are no text of the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
DROPPED = RAW | frozenset("nav footer aside form button select option svg math canvas object audio video template dialog menu head".split())
#: Elements that begin and end a block of text.
BLOCKS = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol p pre section summary table tbody td tfoot th "
    "thead tr ul".split())
#: Elements that an opening tag of the same list closes, up to the nearest container.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}}
_SCOPE = frozenset("ul ol dl table select article section div main body html td th blockquote".split())
#: Words of class and id that mark what is not the article, and words that mark what is.
UNWANTED = frozenset(
    "ad ads advert adverts advertisement sponsor sponsored banner promo promotion sidebar nav navbar navigation menu "
    "breadcrumb breadcrumbs footer header masthead cookie cookies consent gdpr notice notices popup modal overlay newsletter "
    "subscribe signup share sharing social related recommended comment comments disqus respond reply replies login "
    "search widget toolbar pagination pager alert".split())
WANTED = frozenset("article post entry content story body main".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu form".split())

_TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*+)((?:[^<>"']++|"[^"<]*+"|'[^'<]*+')*+)>|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>|<!--|<[!?/][^>]*+>""")
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)\b(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]++))?""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Page:
    """The tree of a page as parallel lists; a node's parent always has a smaller number."""

    def __init__(self, source: str):
        self.tag, self.parent, self.flag = ["html"], [-1], [False]
        self.runs: list[tuple[int, str]] = []  # node and text, in page order
        self._parse(source)

    def _open(self, tag: str, parent: int, flag: bool) -> int:
        self.tag.append(tag)
        self.parent.append(parent)
        self.flag.append(flag)
        return len(self.tag) - 1

    def _parse(self, s: str) -> None:
        """Linear in the page: every step of it moves on in the text, closes an element, or looks at a few stacks."""
        at, now, tag, parent = 0, 0, self.tag, self.parent
        stacks: dict[str, list[int]] = {"html": [0]}  # open elements by name, from the outermost in
        tags_end = s.rfind(">") + 1  # nothing behind can be a tag
        while m := _TAG.search(s, at, tags_end):
            if m.start() > at:
                self.runs.append((now, s[at:m.start()]))
            at = m.end()
            name = m[2] or m[5]
            if name is None:
                if m[0] == "<!--":
                    end = s.find("-->", m.start() + 2)
                    at = len(s) if end < 0 else end + 3
                continue
            name = name.lower()
            if m[1] or m[4]:
                if name == "p" and not stacks.get("p"):
                    self._open("p", now, False)
                elif name == "br":
                    self.runs.append((self._open("br", now, False), " "))
                elif name != "html" and stacks.get(name):
                    now = self._leave(stacks[name][-1], now, stacks)
                continue
            if name == "html" or name == "body" and stacks.get(name):
                continue
            if name in BLOCKS and stacks.get("p"):
                now = self._close({"p"}, now, stacks)
            if name in CLOSES:
                now = self._close(CLOSES[name], now, stacks)
            node = self._open(name, now, _unwanted(m[3] or m[6] or ""))
            if name in RAW:
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(s, at)
                if not end:
                    return
                close = s.find(">", end.end())
                at = len(s) if close < 0 else close + 1
            elif name in VOID:
                self.runs.append((node, " " if name in ("br", "hr") else ""))
            else:
                stacks.setdefault(name, []).append(node)
                now = node
        rest = s.find("<!--", at)  # a comment without an end
        if at < len(s):
            self.runs.append((now, s[at:] if rest < 0 else s[at:rest]))

    def _leave(self, node: int, now: int, stacks: dict[str, list[int]]) -> int:
        """Close all from the innermost open element to this one."""
        while True:
            stacks[self.tag[now]].pop()
            if now == node:
                return self.parent[now]
            now = self.parent[now]

    def _close(self, names: set[str], now: int, stacks: dict[str, list[int]]) -> int:
        """Close the outermost of these elements that is open within the nearest container."""
        container = max((stacks[t][-1] for t in _SCOPE - names if stacks.get(t)), default=0)
        inner = (bisect_right(stacks.get(t, ()), container) for t in names)
        found = min((stacks[t][i] for t, i in zip(names, inner) if i < len(stacks.get(t, ()))), default=0)
        return self._leave(found, now, stacks) if found else now


def _unwanted(attributes: str) -> bool:
    if not attributes or "=" not in attributes and "hidden" not in attributes:
        return False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or "").strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value.lower() in _ROLES:
            return True
        if name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return True
        if name in ("class", "id"):
            words = {w.lower() for w in _WORD.findall(value)}
            if words & UNWANTED and not (words & WANTED and not words & {"comment", "comments", "ad", "ads", "footer", "sidebar"}):
                return True
    return False


def main_text(source: str | None) -> str:
    """The main text of a page: blocks with single spaces, joined by one space; empty if there is none."""
    if not source:
        return ""
    page = Page(source)
    tag, parent, n = page.tag, page.parent, len(page.tag)
    holds = [t in ("article", "main") for t in tag]  # an article lies here or below
    for i in range(n - 1, 0, -1):
        holds[parent[i]] |= holds[i]
    gone, block, link, article = [False] * n, [0] * n, [False] * n, [-1] * n
    for i in range(1, n):
        p, t = parent[i], tag[i]
        article[i] = i if t in ("article", "main") and article[p] < 0 else article[p]
        bad = t in DROPPED and not (holds[i] and t not in RAW) or t == "header" and article[p] < 0 and not holds[i]
        gone[i] = gone[p] or bad or page.flag[i] and not holds[i] and t not in ("html", "body")
        block[i] = i if t in BLOCKS else block[p]
        link[i] = link[p] or t == "a"

    texts = [(node, entities.unescape(run)) for node, run in page.runs if not gone[node]]
    length, linked, commas = [0] * n, [0] * n, [0] * n
    for node, run in texts:
        size = len(run) if run and not run.isspace() else 0
        b = block[node]
        length[b] += size
        commas[b] += run.count(",") + run.count("、") + run.count("，")
        if link[node]:
            linked[b] += size
    points = [0.0] * n
    for i in range(n):
        if not length[i]:
            continue
        own = (1 + commas[i] + min(length[i] / 100, 3.0)) * (1 - linked[i] / length[i])
        # a paragraph passes its points to the blocks above it; loose text counts for its own block
        share, up = 1.0, i if tag[i] in ("div", "section", "article", "main", "body", "td", "blockquote") else block[parent[i]] if i else 0
        for level in range(4):
            points[up] += own * share
            if not up:
                break
            share = 1 / (2 + level)
            up = block[parent[up]]
    below, below_linked = length[:], linked[:]
    for i in range(n - 1, 0, -1):
        below[parent[i]] += below[i]
        below_linked[parent[i]] += below_linked[i]

    def score(i: int) -> float:
        return (points[i] + 25 * (tag[i] in ("article", "main"))) * (1 - below_linked[i] / below[i]) if below[i] else 0.0

    best = max(range(n), key=lambda i: (score(i), -i))
    if not score(best):
        best = 0
    if article[best] >= 0:
        best = article[best]  # a part of an article stands for all of it
    keep = {best}
    if best and tag[best] not in ("body", "html"):
        least = max(10.0, 0.2 * score(best))
        for i in range(best and parent[best] + 1, n):
            if parent[i] == parent[best] and not gone[i] and below[i] and tag[i] in BLOCKS:
                low = below_linked[i] < 0.25 * below[i]
                if score(i) >= least and low or tag[i] == "p" and below[i] > 80 and low:
                    keep.add(i)
    inside = [False] * n
    for i in range(n):
        inside[i] = i in keep or i > 0 and inside[parent[i]]

    out: list[str] = []
    last = -1
    for node, run in texts:
        if inside[node]:
            if block[node] != last:
                out.append(" ")
                last = block[node]
            out.append(run)
    return " ".join("".join(out).split())


def extract(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns `keep`, then `text` (main text) and `n_chars` (its code points).

    Null and empty pages give an empty text. Each page stands for itself, so there is no shuffle and repeated rows
    repeat; other columns are left behind.
    """
    kinds = T.StructType([pages.schema[c] for c in keep] + [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "__html"):
            found = [main_text(h) for h in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(len(keep))]
                + [pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], names=kinds.names)

    return pages.select(*keep, F.col(html).alias("__html")).mapInArrow(run, kinds)
