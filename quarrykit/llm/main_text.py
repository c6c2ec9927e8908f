"""Main text of web pages by composite text density.

Every node of a page's tree has a density: its characters a tag, adjusted by how many of them are links. The node whose
children's densities have the largest sum is the main content; the least density on its way up to the body is the threshold by which
other parts of the page join it.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape
from math import e, log

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Elements that begin and end a block of text.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup "
    "hr html legend li main menu nav noscript ol p pre search section summary table tbody tfoot thead tr ul".split()
)
#: Elements that a start tag ends if they are the innermost block, beside a paragraph, which every block ends.
ENDED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"}, "option": {"option"}, "a": {"a"}}
HEADINGS = frozenset({"h1", "h2"})
ARTICLES = frozenset({"article", "main"})
#: Elements that are never part of an article.
DROPPED = frozenset(
    "head nav footer aside script style noscript template iframe svg math canvas object embed audio video button select option textarea input label fieldset dialog menu noembed noframes xmp title search".split()
)
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
#: Names, or first or last parts of names with hyphens or underscores, of classes and ids.
DROPPED_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adsense banner sponsor sponsored sponsors promo promotion "
    "nav navbar navigation menu breadcrumb breadcrumbs pagination pager sidebar aside rail related recommended recommendations trending widget widgets "
    "footer copyright masthead topbar cookie cookies consent gdpr notice notices alert alerts popup modal overlay newsletter subscribe subscription paywall "
    "share sharing social comment comments commentlist disqus discussion replies reply respond form login signup search".split()
)
#: First parts of names that say what a page has or lacks, not what an element is.
LAYOUT = frozenset({"has", "no", "with", "without"})
#: The same as ``DROPPED_NAMES``, outside articles only, as an article has a header of its own.
DROPPED_HEADERS = frozenset({"header", "site-header", "page-header", "top-header", "main-header", "global-header", "header-top", "header-bar"})

_OPEN = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>]*))")
_END = re.compile(r"""(?:[^"'>]|"[^"]*"|'[^']*')*>""")
_NAMED = re.compile(r"""(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_PARTS = re.compile(r"[-_]")


class _Tree:
    """Nodes in page order, and the pieces of text in them. Node 0 is the page itself."""

    def __init__(self, html: str):
        self.tags, self.parents, self.marks = ["body"], [-1], [""]
        self.pieces: list[tuple[int, int, str]] = []
        self.stack, self.open, self.block = [0], Counter(), 0
        self.read(html)

    def text(self, raw: str) -> None:
        if raw:
            self.pieces.append((self.stack[-1], self.block, unescape(raw)))

    def pop(self, size: int) -> None:
        for node in self.stack[size:]:
            self.open[self.tags[node]] -= 1
        del self.stack[size:]

    def innermost(self, tags: set[str], bound: bool) -> int:
        """The place in the stack of the innermost open element of ``tags``; 0 if there is none, or, with ``bound``, if another block is in between."""
        if any(self.open[t] for t in tags):
            for k in range(len(self.stack) - 1, 0, -1):
                tag = self.tags[self.stack[k]]
                if tag in tags:
                    return k
                if bound and tag in BLOCKS:
                    break
        return 0

    def start(self, tag: str, attributes: str) -> None:
        if tag in ("html", "body"):
            return
        ended = ENDED.get(tag, set()) | ({"p"} if tag in BLOCKS else set())
        while ended and (k := self.innermost(ended, bound=True)):
            self.pop(k)
        if tag in BLOCKS:
            self.block += 1
        if tag in ("br", "td", "th"):
            self.text(" ")
        self.tags.append(tag)
        self.parents.append(self.stack[-1])
        self.marks.append(attributes)
        if tag not in VOID:
            self.stack.append(len(self.tags) - 1)
            self.open[tag] += 1

    def end(self, tag: str) -> None:
        if tag in BLOCKS:
            self.block += 1
        if k := self.innermost({tag}, bound=tag not in BLOCKS):
            self.pop(k)

    def read(self, html: str) -> None:
        """One pass: each tag, comment and run of raw text is looked at once. A tag or comment that the page's end cuts off is dropped."""
        at, size, quoted = 0, len(html), True
        while at < size:
            found = _OPEN.search(html, at)
            if found is None:
                self.text(html[at:])
                break
            self.text(html[at : found.start()])
            comment, declared, slash, name = found.groups()
            if comment:
                stop = html.find("-->", found.end() - 2)
                at = size if stop < 0 else stop + 3
                continue
            stop = _END.match(html, found.end()) if quoted else None
            if stop is None:  # a quote that doesn't end: from here on quotes are plain characters
                quoted = False
                closed = html.find(">", found.end()) + 1
            else:
                closed = stop.end()
            if not closed:
                break
            at = closed
            if declared:
                continue
            tag = name.lower()
            if slash:
                self.end(tag)
                continue
            self.start(tag, html[found.end() : closed - 1])
            if tag in RAW:
                stop = re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE).search(html, at)
                at = size if stop is None else stop.start()


def _unwanted(tag: str, attributes: str, inside: bool) -> tuple[bool, bool]:
    """Whether an element is left out by its tag, and by its role, class or id; ``inside``: in an article."""
    by_tag = tag in DROPPED or (tag == "header" and not inside)
    if tag == "form":  # some pages are one form
        return False, True
    if not attributes or tag in ARTICLES:
        return by_tag, False
    for key, *values in _NAMED.findall(attributes):
        names = "".join(values).lower().split()
        if key.lower() == "role":
            if not DROPPED_ROLES.isdisjoint(names):
                return by_tag, True
            continue
        for name in names:
            parts = _PARTS.split(name)
            if parts[0] in LAYOUT:
                continue
            if name in DROPPED_NAMES or parts[0] in DROPPED_NAMES or parts[-1] in DROPPED_NAMES or (name in DROPPED_HEADERS and not inside):
                return by_tag, True
    return by_tag, False


def _density(chars: int, tags: int, link_chars: int, link_tags: int, page_ratio: float) -> float:
    """Characters a tag, scaled by a logarithm of the shares without links, whose base grows with the links."""
    if not chars:
        return 0.0
    tags, links, link_tags = max(tags, 1), max(link_chars, 1), max(link_tags, 1)
    base = log(chars / max(chars - link_chars, 1) * links + page_ratio * chars + e)
    return chars / tags * max(log(chars / links * tags / link_tags), 0.0) / log(max(base, 1.0001))


def main_text(html: str) -> str:
    """The main text of one page: blocks in page order, each with single spaces, joined by line ends."""
    tree = _Tree(html)
    n = len(tree.tags)
    tags, parents = tree.tags, tree.parents
    # an element that holds an article is kept whatever its names are
    holds = [t in ARTICLES for t in tags]
    for k in range(n - 1, 0, -1):
        if holds[k]:
            holds[parents[k]] = True
    inside, gone, link = [False] * n, [False] * n, [False] * n
    for k in range(1, n):
        p = parents[k]
        inside[k] = inside[p] or tags[k] in ARTICLES
        by_tag, by_name = _unwanted(tags[k], tree.marks[k], inside[k])
        gone[k] = gone[p] or by_tag or (by_name and not holds[k])
        link[k] = link[p] or tags[k] == "a"

    pieces = [(k, block, text) for k, block, text in tree.pieces if not gone[k]]
    chars, link_chars, count, links, own = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
    for k, _, text in pieces:
        size = len(text.strip())
        own[k] += size
        if link[k]:
            link_chars[k] += size
    for k in range(n - 1, 0, -1):
        if gone[k]:
            continue
        p = parents[k]
        chars[k] += own[k]
        chars[p] += chars[k]
        link_chars[p] += link_chars[k]
        count[p] += count[k] + 1
        links[p] += links[k] + (tags[k] == "a")
    chars[0] += own[0]
    if not chars[0]:
        return ""
    ratio = link_chars[0] / chars[0]
    density = [_density(chars[k], count[k], link_chars[k], links[k], ratio) for k in range(n)]
    sums = [0.0] * n
    for k in range(1, n):
        if not gone[k]:
            sums[parents[k]] += density[k]
    for k in range(n):  # text of a node's own counts as a child
        if own[k]:
            sums[k] += _density(own[k], 1, own[k] if link[k] else 0, 0, ratio)

    # the node with the largest sum, the outermost of equals; an article around it is the whole
    best = max(range(n), key=lambda k: (sums[k], -k))
    least, k = density[best], best
    while k:
        k = parents[k]
        least = min(least, density[k])
    taken = {best}
    if inside[best]:
        k = best
        while tags[k] not in ARTICLES:
            k = parents[k]
        taken = {k}
    else:
        # in every part of the page at the threshold and above, the node with the largest sum
        top = list(range(n))
        for k in range(n - 1, 0, -1):
            p = parents[k]
            if not gone[k] and (sums[top[k]], -top[k]) > (sums[top[p]], -top[p]):
                top[p] = top[k]
        taken |= {top[k] for k in range(n) if not gone[k] and chars[k] and density[k] >= least}
        # the headings right before the main content, or before the closest part around it that has any
        way, k = {}, best
        while k:
            way[parents[k]] = k
            k = parents[k]
        heads = [k for k in range(1, best) if tags[k] in HEADINGS and not gone[k] and k < way.get(parents[k], 0)]
        closest = max((parents[k] for k in heads), default=-1)
        taken |= {k for k in heads if parents[k] == closest}
    kept = [False] * n
    for k in range(n):
        kept[k] = k in taken or (k > 0 and kept[parents[k]])

    blocks: dict[int, list[str]] = {}
    for k, block, text in pieces:
        if kept[k]:
            blocks.setdefault(block, []).append(text)
    lines = (" ".join("".join(own).split()) for own in blocks.values())
    return "\n".join(x for x in lines if x)


def extract_main_text(pages: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """Adds the main text of each page's whole html as ``text_col``; pages are read one by one, so repeats come out alike.

    Left out are the elements, roles, classes and ids that stand for menus, headers, footers, sidebars, notices, adverts, forms, scripts and
    comments, unless an article lies inside; the rest is chosen by density. Null and empty html, and pages without text, give an empty text.
    Any other column stays; one named ``text_col`` is replaced.
    """

    @F.pandas_udf("string")
    def extract(html: pd.Series) -> pd.Series:
        return pd.Series([main_text(x) if x else "" for x in html], dtype=object)

    return pages.withColumn(text_col, extract(F.coalesce(F.col(html_col), F.lit(""))))
