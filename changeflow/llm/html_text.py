"""Main text of web pages by tag-path ratios.

A tolerant scanner turns a page into pieces of text, each with its path of elements from the root (tag and class words).
Per path, text length and punctuation are summed over its blocks and divided by their number: two ratios. Each is smoothed
along the paths: half is the path's own, a quarter its region's, a quarter that of all in and around the region (means of
paths, weighted by text). A region is the path up to its last sectioning element (div, section, article, ...); lists, tables and paragraphs are no
regions of their own, so that a short item of an article is judged with the article. The region of a heading is the nearest
that holds other text too. The two ratios are fused (their geometric mean, less the share of text in links) and weighed by
what an element says about itself: menus, adverts, notices and forms count a tenth, reader comments a hundredth, text
beside an article or main element half. Paths that reach `threshold` of the mean (weighted by text) are content, and every
piece on them is kept, wherever it stands; nothing else is.

Weights only compare: a page that is all notice or all form keeps its text. Only what is no text of the page at all goes
unjudged: scripts, styles, controls, hidden elements, and elements or roles for navigation, headers, footers and asides.

Each page is one row in and one row out, without a shuffle; time and memory are linear in its length. Defined results: null
and empty pages, and pages without visible text, give an empty string; repeated rows are extracted alike; an empty table
gives no rows; other columns are carried along.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape
from math import sqrt

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from changeflow.llm.common import arrow_batches

#: What elements, roles and names of classes and ids tell.
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr output q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp noframes iframe noembed".split())
OUTSIDE = set("head nav footer aside script style textarea title noscript template svg math object iframe button select option datalist label legend dialog menu audio video canvas xmp noframes noembed".split())
ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar tablist".split())
NAMES = set(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer header masthead cookie cookies consent gdpr notice popup modal overlay newsletter subscribe subscription signup login social share sharing related recommended recommendations search widget widgets toolbar pagination pager legal copyright alert".split()
)
COMMENTS = set("comment comments commentlist respond disqus replies".split())
OWN = set("article post entry content main story body text".split())
#: Elements that begin a region; headings.
REGIONS = set("html body main article section div form header center fieldset details".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
    "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "thead", "tbody"},
}
#: Elements beyond which an implied end doesn't reach.
SCOPES = set("ul ol dl table div section article main body html td th blockquote".split())
#: Weights of elements by what they say about themselves, and of what stands beside an article.
NAMED, COMMENT, BESIDE = 0.1, 0.01, 0.5
THRESHOLD = 0.3

_token = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*+)(?P<rest>(?:[^>"']++|"[^"]*+"|'[^']*+')*+>|[^>]*+(?:>|\Z))""", re.S
)
_attribute = re.compile(r"""(?<![^\s"'/])(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?(?=[\s/>])""", re.I)
_parts = re.compile(r"[A-Z]?[a-z]+|[A-Z]+").findall
_marks = re.compile(r"[.,;:!?…。，！？]").findall


@dataclass(eq=False)
class Element:
    """path: its number among paths. weight: what it and those around it say about themselves. outside: never content."""

    name: str
    inline: bool
    outside: bool
    weight: float
    path: int
    article: bool


@dataclass
class Block:
    """Pieces of text without a break, each with its path and whether it is in a link."""

    pieces: list[tuple[str, int, bool]] = field(default_factory=list)


def says(name: str, rest: str, in_article: bool) -> tuple[bool, float, str]:
    """Whether an element is outside, its weight, and its label in paths."""
    got = {k.lower(): v.strip("\"'") for k, v in _attribute.findall(rest)} if len(rest) > 1 else {}
    own = {p.lower() for k in ("class", "id") for p in _parts(got.get(k, ""))}
    label = f"{name}.{'.'.join(sorted(own))}" if own else name
    hidden = "hidden" in got or got.get("aria-hidden", "").lower() == "true" or "display:none" in got.get("style", "").replace(" ", "").lower()
    if hidden or name in OUTSIDE or name == "header" and not in_article or got.get("role", "").lower() in ROLES:
        return True, 1.0, label
    if name in ("html", "body", "main"):
        return False, 1.0, label
    if own & COMMENTS:
        return False, COMMENT, label
    named = own & NAMES and not (own & OWN and not own & {"ad", "ads"})
    return False, NAMED if named or name == "form" else 1.0, label


class Page:
    """The scanned page: blocks, and by path its parent, tag, weight and whether it is in an article."""

    def __init__(self, html: str):
        self.blocks, self.up, self.tag, self.weight, self.article = [Block()], [0], [""], [1.0], [False]
        self._paths: dict[tuple[int, str], int] = {}
        self._scan(html)
        self.blocks = [b for b in self.blocks if "".join(p for p, _, _ in b.pieces).strip()]

    def _path(self, up: int, label: str, name: str, weight: float, article: bool) -> int:
        at = self._paths.get((up, label))
        if at is None:
            at = self._paths[up, label] = len(self.up)
            self.up.append(up)
            self.tag.append(name)
            self.weight.append(weight)
            self.article.append(article)
        return at

    def _scan(self, html: str) -> None:
        stack, at, links = [Element("", False, False, 1.0, 0, False)], 0, 0

        def add(raw: str) -> None:
            if raw and not stack[-1].outside:
                self.blocks[-1].pieces.append((raw, stack[-1].path, links > 0))

        def cut() -> None:
            if self.blocks[-1].pieces:
                self.blocks.append(Block())

        def pop_to(k: int) -> None:
            nonlocal links
            links -= sum(e.name == "a" for e in stack[k:])
            del stack[k:]
            cut()

        for m in iter(lambda: _token.search(html, at), None):
            add(unescape(html[at : m.start()]))
            at = m.end()
            name = (m["name"] or "").lower()
            if not name:
                continue
            inline = name in INLINE
            if m["end"]:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].name == name:
                        if inline:
                            links -= name == "a"
                            del stack[k]
                        else:
                            pop_to(k)
                        break
                    if inline and not stack[k].inline:
                        break
                continue
            if name in VOID:
                if name in ("br", "hr"):
                    add(" ")
                if name == "hr":
                    cut()
                continue
            if not inline:
                ends = CLOSES.get(name, set())
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].name == "p" or stack[k].name in ends:
                        pop_to(k)
                        if not ends:
                            break
                    elif stack[k].name in SCOPES and stack[k].name not in ends:
                        break
            top = stack[-1]
            article = top.article or name in ("article", "main")
            outside, weight, label = says(name, m["rest"], top.article)
            weight = min(weight, top.weight)
            # Inline elements that say nothing about themselves are on the path of what holds them.
            path = top.path if inline and weight == top.weight else self._path(top.path, label, name, weight, article)
            stack.append(Element(name, inline, outside or top.outside, weight, path, article))
            if name in RAW:
                close = re.compile(rf"</{name}", re.I).search(html, at)
                at = close.start() if close else len(html)
            links += name == "a"
            if not inline:
                cut()
            elif m["rest"].endswith("/>"):
                stack.pop()
                links -= name == "a"
        add(unescape(html[at:]))


def chosen(page: Page, threshold: float = THRESHOLD) -> list[bool]:
    """Which paths are content. Paths stand after their parents: sums go up and ratios down in one pass each."""
    n = len(page.up)
    own = [[0, 0, 0, 0] for _ in range(n)]  # text, marks, blocks, text in links
    for b in page.blocks:
        for path in {p for _, p, _ in b.pieces}:
            text = " ".join("".join(t for t, p, _ in b.pieces if p == path).split())
            linked = " ".join("".join(t for t, p, a in b.pieces if p == path and a).split())
            if text:
                for k, v in enumerate((len(text), len(_marks(text)), 1, min(len(linked), len(text)))):
                    own[path][k] += v
    # By path: both ratios times the text, and the text: their sums give means over paths, weighted by text.
    ratio = [(x[0] * x[0] / x[2], x[0] * (x[1] + 0.5) / x[2], x[0]) if x[2] else (0.0, 0.0, 0) for x in own]
    below, other = [list(x) for x in ratio], [x[0] if t not in HEADINGS else 0 for x, t in zip(own, page.tag, strict=True)]
    for p in range(n - 1, 0, -1):
        other[page.up[p]] += other[p]
        for k in range(3):
            below[page.up[p]][k] += below[p][k]
    region = [0] * n
    direct = [[0.0, 0.0, 0] for _ in range(n)]  # sums over the paths of a region
    for p in range(1, n):
        up = page.up[p]
        region[p] = p if page.tag[p] in REGIONS else region[up]
        if page.tag[p] in HEADINGS:
            while region[p] and not other[region[p]]:
                region[p] = region[page.up[region[p]]]
    for p in range(n):
        for k in range(3):
            direct[region[p]][k] += ratio[p][k]
    means = lambda x: (x[0] / x[2], x[1] / x[2]) if x[2] else (0.0, 0.0)
    beside = any(page.article[p] and own[p][0] and page.weight[p] == 1 for p in range(n))
    fused, weight = [0.0] * n, [0.0] * n
    for p in range(n):
        if not own[p][2]:
            continue
        r = region[p]
        around = region[page.up[r]] if r else 0
        text, marks = (a / 2 + b / 4 + c / 4 for a, b, c in zip(means(ratio[p]), means(direct[r]), means(below[around]), strict=True))
        says_so = page.weight[p] * (BESIDE if beside and not page.article[p] else 1)
        fused[p] = sqrt(text * marks) * (1 - own[p][3] / own[p][0]) * says_so
        weight[p] = (own[p][0] - own[p][3]) * says_so
    total = sum(weight)
    if not total:  # nothing but links
        return [bool(x[2]) for x in own]
    bar = threshold * sum(f * w for f, w in zip(fused, weight, strict=True)) / total
    return [bool(x[2]) and f >= bar for x, f in zip(own, fused, strict=True)]


def extract(html: str | None, threshold: float = THRESHOLD) -> str:
    """threshold: of the mean score of paths, weighted by text."""
    page = Page(html or "")
    if not page.blocks:
        return ""
    keep = chosen(page, threshold)
    texts = (" ".join("".join(t for t, p, _ in b.pieces if keep[p]).split()) for b in page.blocks)
    return " ".join(filter(None, texts))


def main_text(pages: DataFrame, html: str = "html", into: str = "text") -> DataFrame:
    """pages with the main text of each."""
    arrow_batches(pages.sparkSession)

    @pandas_udf("string")
    def extracted(raw: pd.Series) -> pd.Series:
        return raw.map(extract, na_action=None)

    return pages.withColumn(into, extracted(F.coalesce(F.col(html), F.lit(""))))
