"""Main text of web pages by tag-path ratios: paths dense in text and punctuation hold the article."""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Elements of HTML by what they do.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub "
    "sup time tt u var wbr".split())
NEVER = frozenset(
    "aside audio button canvas datalist dialog fieldset footer frameset head iframe input menu nav noframes noscript object "
    "option script select style svg template textarea title video".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Words of a class or id that name page furniture.
FURNITURE = frozenset(
    "ad ads advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright "
    "disclaimer discussion disqus footer gdpr legal login masthead menu modal nav navbar navigation newsletter notice notices notification overlay "
    "pager paginator pagination paywall popup promo promoted promotion recommended recommendations related reply replies respond responses "
    "search share sharing sidebar signup skip social sponsor sponsored subscribe subscription teaser teasers toolbar widget widgets".split())
#: Words that say nothing of what an element is when they end its name, and those after which a name tells what it has.
FILLERS = frozenset(
    "area bar block bottom box button buttons col column container even first group icons inner item items last left level line link links list "
    "module odd outer panel right row section top unit wrap wrapper".split())
HAVING = frozenset("has hide in is no on show with without".split())
ARTICLE_WORDS = frozenset("article body content entry main post story text".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Elements that can hold an article: a lone block of another kind, as a paragraph, belongs to the next of these around it.
SECTIONS = frozenset("article body div html main section".split())
HOLDS = frozenset("article aside body div footer form header li main nav ol section table td th ul dl blockquote".split())

PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？]")
WORD_IN_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: A path is content if its fused ratio reaches this share of the highest one.
THRESHOLD = 0.1
LINKED = 0.5


SURE, SUSPECT = 2, 1


def name_kind(names: str) -> int:
    """What class and id names tell: SURE of furniture, SUSPECT (the ratios decide), or 0.

    A name is read from its last word, which says what the element is, fillers
    aside: "site-footer" and "comment-list" are furniture, "has-sidebar" and
    "post-with-comments" are not. Where only the first word is furniture
    ("share-price-analysis", "comment-body"), or another name of the element is
    one of an article, it is a suspicion.
    """
    kind, article = 0, False
    for name in names.split():
        words = [w.lower() for w in WORD_IN_NAME.findall(name)]
        article |= bool(words) and ARTICLE_WORDS.issuperset(words)
        if HAVING.intersection(words):
            continue
        while words and words[-1] in FILLERS and len(words) > 1:
            words.pop()
        if words and words[-1] in FURNITURE:
            kind = SURE
        elif words and words[0] in FURNITURE:
            kind = max(kind, SUSPECT)
    return min(kind, SUSPECT) if article else kind


class _Page(HTMLParser):
    """Blocks of a page that are not sure to be furniture: their text, tag path, share of linked text, and the node that holds it.

    Nodes are the elements that are not inline, numbered as they open, so a
    node's number is over its parent's, and its descendants follow it without a
    gap; 0 is the page. Paths are numbers too, one for each (path of the
    parent, name)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool, int]] = []  # tag, opens furniture, node
        self.open: Counter = Counter()
        self.skipped = self.links = self.articles = 0
        # Of each node: tag, parent, path, suspicion, outermost article or main around it, nearest element named like an article
        # (0 for none), and nearest element that can hold an article.
        self.tags, self.parents, self.paths, self.suspect = ["html"], [0], [0], [0]
        self.article, self.named, self.section = [0], [0], [0]
        self.path_numbers: dict[tuple[int, str], int] = {}
        self.path_parents = [0]
        self.blocks: list[tuple[str, int, float, int]] = []
        self.parts: list[str] = []
        self.linked = 0

    def _furniture(self, tag: str, attrs: dict) -> int:
        if tag in NEVER or attrs.get("role", "").lower() in ROLES or "hidden" in attrs or attrs.get("aria-hidden") == "true":
            return SURE
        if tag in ("html", "body"):
            return 0
        if tag == "header":
            return 0 if self.articles else SURE
        if re.search(r"display\s*:\s*none", attrs.get("style", "")):
            return SURE
        names = f"{attrs.get('class', '')} {attrs.get('id', '')}"
        words = {w.lower() for w in WORD_IN_NAME.findall(names)}
        if "header" in words and not words & (ARTICLE_WORDS | HAVING) and not self.articles and tag not in ("article", "main"):
            return SURE
        return max(name_kind(names), SUSPECT if tag == "form" else 0)

    def _node(self) -> int:
        return self.stack[-1][2] if self.stack else 0

    def _flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            node = self._node()
            self.blocks.append((text, self.paths[node], self.linked / len(text), node))
        self.parts, self.linked = [], 0

    def _pop_to(self, at: int) -> None:
        for tag, furniture, _ in self.stack[at:]:
            self.open[tag] -= 1
            self.skipped -= furniture
            self.links -= tag == "a"
            self.articles -= tag in ("article", "main")
        del self.stack[at:]

    def _close(self, tags: tuple[str, ...], within: frozenset[str]) -> None:
        if not any(self.open[t] for t in tags):
            return
        for at in range(len(self.stack) - 1, -1, -1):
            if self.stack[at][0] in tags:
                self._pop_to(at)
                return
            if self.stack[at][0] in within:
                return

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag not in INLINE:
            self._flush()
            self._close(("p",), HOLDS)
            if tag in CLOSES:
                self._close(CLOSES[tag], frozenset(("ul", "ol", "dl", "table", "select")))
        elif tag in ("br", "img", "wbr"):
            self.parts.append(" " if tag == "br" else "")
        if tag in VOID:
            return
        found = {k: v or "" for k, v in attrs}
        kind, node = self._furniture(tag, found), self._node()
        if tag not in INLINE:
            name = ".".join([tag, *found.get("class", "").split()])
            path = self.path_numbers.setdefault((self.paths[node], name), len(self.path_parents))
            if path == len(self.path_parents):
                self.path_parents.append(self.paths[node])
            self.tags.append(tag)
            self.parents.append(node)
            self.paths.append(path)
            self.suspect.append(kind == SUSPECT)
            node = len(self.tags) - 1
            up = self.parents[node]
            self.article.append(self.article[up] or (node if tag in ("article", "main") else 0))
            names = f"{found.get('class', '')} {found.get('id', '')}" if tag in ("div", "section") else ""
            self.named.append(node if ARTICLE_WORDS & {w.lower() for w in WORD_IN_NAME.findall(names)} else self.named[up])
            self.section.append(node if tag in SECTIONS or tag in ("td", "th") else self.section[up])
        self.stack.append((tag, kind == SURE, node))
        self.open[tag] += 1
        self.skipped += kind == SURE
        self.links += tag == "a"
        self.articles += tag in ("article", "main")

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag not in INLINE:
            self._flush()
        if not self.open[tag]:
            return
        for at in range(len(self.stack) - 1, -1, -1):
            if self.stack[at][0] == tag:
                self._pop_to(at)
                return
            if tag in INLINE and self.stack[at][0] not in INLINE:
                return

    def handle_data(self, data: str) -> None:
        if not self.skipped:
            self.parts.append(data)
            if self.links:
                self.linked += len(data)


def path_ratios(blocks: list[tuple]) -> dict:
    """Fused ratio of each tag path of (text, path, linked share, ...) blocks.

    Text length and punctuation are summed over the blocks of a path and
    divided by their number; along the page, both series are smoothed with the
    neighbours on each side, and their product is averaged back by path. Paths
    of mostly linked text have none, unless all are: then those with marks have.
    """
    count = Counter(path for _, path, *_ in blocks)
    chars, marks, linked = Counter(), Counter(), Counter()
    for text, path, link, *_ in blocks:
        chars[path] += len(text)
        marks[path] += len(PUNCTUATION.findall(text))
        linked[path] += link * len(text)
    series = np.array([[chars[p] / count[p], 1 + marks[p] / count[p]] for _, p, *_ in blocks])
    edged = np.pad(series, ((1, 1), (0, 0)), mode="edge")
    smooth = (edged[:-2] + 2 * edged[1:-1] + edged[2:]) / 4
    fused = np.sqrt(smooth * series).prod(axis=1)
    total: Counter = Counter()
    for (_, path, *_), value in zip(blocks, fused.tolist(), strict=True):
        total[path] += value
    menus = {p for p in count if linked[p] > LINKED * chars[p]}
    if len(menus) == len(count):
        menus = {p for p in count if not marks[p]}
    return {p: 0.0 if p in menus else total[p] / n for p, n in count.items()}


def _cleared(page: _Page) -> list:
    """The page's blocks without suspects that the ratios confirm: those that hold no block of the highest path.

    A form is cleared only by a paragraph or an article in it.
    """
    if not any(page.suspect) or not page.blocks:
        return page.blocks
    ratio = path_ratios(page.blocks)
    best = max(ratio, key=ratio.get)
    holds = [False] * len(page.tags)
    texts = [False] * len(page.tags)  # a paragraph or article of the highest path is inside
    for _, path, _, node in page.blocks:
        if path == best:
            holds[node] = True
            texts[node] |= page.tags[node] == "p" or bool(page.article[node])
    for node in range(len(page.tags) - 1, 0, -1):
        holds[page.parents[node]] |= holds[node]
        texts[page.parents[node]] |= texts[node]
    out = [False]
    for node in range(1, len(page.tags)):
        kept = texts[node] if page.tags[node] == "form" else holds[node]
        out.append(out[page.parents[node]] or page.suspect[node] and not kept)
    return [b for b in page.blocks if not out[b[3]]]


def _join(page: _Page, ends: list[int], a: int, b: int) -> int:
    """The deepest node that holds both."""
    a, b = min(a, b), max(a, b)
    while not a <= b < ends[a]:
        a = page.parents[a]
    return a


def _containers(page: _Page, blocks: list, ratio: dict, content: set) -> set[int]:
    """Nodes that hold the article: the common one of the passing paths, and those of passing blocks outside of it.

    It starts with the common node of the highest path's blocks. Another
    passing path widens it to what holds both, unless that is the whole body:
    then that path's blocks are held by what stands around each of them.
    """
    found: dict = {}
    for _, path, _, node in blocks:
        if path in content:
            found.setdefault(path, set()).add(node)
    first, *others = sorted(found, key=lambda p: -ratio[p])
    whole = lambda node: page.tags[node] in ("html", "body")
    inner = set(page.parents[1:])
    ends = list(range(1, len(page.tags) + 1))  # one past each node's last descendant
    for node in range(len(page.tags) - 1, 0, -1):
        ends[page.parents[node]] = max(ends[page.parents[node]], ends[node])

    def around(node: int) -> int:
        """What holds a lone node; of a div or cell without elements in it, the section around it."""
        if node not in inner and not whole(node) and page.tags[node] not in ("article", "main"):
            upper = page.section[page.parents[node]]
            return upper if not whole(upper) or page.tags[node] not in SECTIONS else node
        return page.section[node]

    main, apart = around(_join(page, ends, min(found[first]), max(found[first]))), set()
    for path in others:
        both = _join(page, ends, main, _join(page, ends, min(found[path]), max(found[path])))
        wider = page.section[both]
        if whole(wider) and not whole(main):
            apart.update(map(around, found[path]))
        else:
            main = wider
    return {page.article[node] or page.named[node] or node for node in (main, *(n for n in apart if not whole(n)))}


def main_text(html: str | None) -> str:
    """The article of a page: white space in a block is one space, blocks are joined by a line break.

    Menus, headers, footers, sidebars, notices, adverts, scripts, styles and
    comments are left out as the page's elements and their names mark them;
    names that may mean either, and forms, are left out unless they hold the
    highest path's text. Of the rest, paths over the threshold are content on
    every page. The section that they have in common, widened to an article
    element or one so named around it, is kept with all that it holds
    (headings, lists, tables, short lines), but for paths of mostly linked text
    outside article elements. Headings beside a passing path in the same parent
    belong to it. Null and empty pages have the empty text. Time is linear in
    the page's length, however deep its elements are nested.
    """
    if not html:
        return ""
    page = _Page()
    page.feed(html)
    page.close()
    page._flush()
    blocks = _cleared(page)
    if not blocks:
        return ""
    ratio = path_ratios(blocks)
    least = THRESHOLD * max(ratio.values())
    content = {p for p, r in ratio.items() if r and r >= least}
    if not content:
        return ""
    containers = _containers(page, blocks, ratio, content)
    held = [0 in containers]
    for node in range(1, len(page.tags)):
        held.append(node in containers or held[page.parents[node]])
    parents = {page.path_parents[p] for p in content}
    return "\n".join(text for text, path, _, node in blocks
                     if path in content or held[node] and (ratio[path] or page.article[node])
                     or page.tags[node] in HEADINGS and page.path_parents[path] in parents)


def extract(df: DataFrame, html_col: str = "html") -> DataFrame:
    """``df`` with the columns text and n_chars (code points) of each page's main text; columns so named are replaced.

    Rows are independent: repeated ones give equal results, an empty table no
    row, null html the empty text. A very long or deep page is one row's work.
    """
    text = F.pandas_udf(lambda pages: pd.Series([main_text(p) for p in pages], dtype=object), StringType())
    return df.withColumn("text", text(F.col(html_col))).withColumn("n_chars", F.length("text").cast("long"))
