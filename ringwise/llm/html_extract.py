"""Main text of web pages by tag-path ratios.

A page is read once into text nodes, each with its root-to-leaf tag path (sections also by their class); inline
elements belong to the path of the block around them. Per path the text length and the punctuation are added up
and divided by the number of its blocks; both ratios are smoothed along the order in which paths appear and fused with the
path's whole text and with what a path's names say: text in an article or main element counts ten thousand times as much, text
under a name such as "sidebar" or "comments" as many times less. Elements that are no text of a page by
their tag or role (scripts, forms, menus, page headers and footers) are left out from the start.

Paths whose fused ratio reaches a share of the mean over all paths are content. The content node is the deepest
section that holds all of them, or the outermost one around it that is an article or has headings or
paragraphs of its own and mostly content. Its text is returned: the paths that pass, and headings,
paragraphs and other prose blocks beside them, however short, unless their names speak against them.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick, table

TAG = re.compile(r"<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:\"[^\"]*+\"|'[^']*+'|[^<>\"'])*+)>|<(/?)([a-zA-Z][^\s/<>]*+)([^<>]*+)>|<[!?/][^<>]*+>", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"']+)))?")
#: Elements by their part in a page.
RAW = set("script style title textarea noscript iframe xmp noembed noframes template svg math".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol option p pre section summary table tbody tfoot thead tr ul".split()
)
CELL = set("td th br".split())
SECTION = set("html body main article section div center".split())
BOILERPLATE = set("nav footer aside form head script style noscript template iframe button select option textarea dialog menu object svg math canvas input".split())
BOILERPLATE_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
BOILERPLATE_NAMES = set(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion promoted banner sidebar side menu nav navbar navigation navi "
    "breadcrumb breadcrumbs pagination pager footer foot header masthead topbar comment comments commentlist disqus reply replies respond discussion cookie cookies consent gdpr "
    "notice notices notification popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations "
    "widget widgets toolbar copyright skip alert alerts announcement disclaimer paywall teaser teasers".split()
)
#: What the names of an element say about its text: a factor of its ratio. "has-sidebar" says nothing of the kind.
FOR, AGAINST = 1e4, 1e-4
ABOUT_OTHERS = re.compile(r"(?i)\b(?:has|with|without|no|is-not)[-_][\w-]*")
CONTENT = {"article", "main"}
PROSE = set("h1 h2 h3 h4 h5 h6 p blockquote pre li dd dt figcaption td th".split())
#: An open element that a start tag of the key ends, looked for up to the elements in the second set.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？]")
SPACE = re.compile(r"\s+")
WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")


def judged(tag: str, attributes: str, in_content: bool) -> tuple[bool, bool]:
    """``(out, against)``: whether an element is no text of the page by its tag, role or invisibility, and whether its class or id speak against it."""
    if tag in BOILERPLATE or (tag == "header" and not in_content):
        return True, False
    if not attributes or tag in ("html", "body"):
        return False, False
    against = False
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name == "role" and value.lower() in BOILERPLATE_ROLES:
            return True, False
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
            return True, False
        if name in ("class", "id"):
            if tag in CONTENT:  # an article is something else only if a whole name says so, as with a reader's comment
                said = set(value.lower().split()) & BOILERPLATE_NAMES
            else:
                said = {w.lower() for w in WORD.findall(ABOUT_OTHERS.sub(" ", value))} & BOILERPLATE_NAMES
            against = against or bool(said - {"header"} if in_content else said)
    return False, against


class Page:
    """Text nodes of a page: ``nodes`` has (path, block, text); paths are nodes of a tree."""

    def __init__(self, source: str):
        self.parent, self.tag, self.bad, self.inside, self.against = [-1], [""], [False], [False], [False]
        self.child: dict[tuple, int] = {}
        self.nodes: list[tuple[int, int, str]] = []
        self.stack: list[tuple[str, int]] = [("", 0)]
        self.open: Counter = Counter()
        self.block, self.dirty = 0, False
        at = 0
        low = None
        end = len(source)
        while at < end:
            m = TAG.search(source, at)
            if not m:
                self.text(source[at:])
                break
            if m.start() > at:
                self.text(source[at : m.start()])
            at = m.end()
            tag = (m[2] or m[5] or "").lower()
            if not tag:
                continue
            if m[1] or m[4]:
                self.end(tag)
                continue
            self.start(tag, m[3] or m[6] or "")
            if tag in RAW:
                low = source.lower() if low is None else low
                low = low if len(low) == end else re.sub("[A-Z]+", lambda x: x[0].lower(), source)
                close = low.find(f"</{tag}", at)
                at = end if close < 0 else close
                self.end(tag)
        self.block += 1

    def node(self, tag: str, attributes: str) -> int:
        up = self.stack[-1][1]
        inside = self.inside[up]
        bad, against = (True, False) if self.bad[up] else judged(tag, attributes, inside)
        against = against or self.against[up]
        named = " ".join(a or b or c for n, a, b, c in ATTRIBUTE.findall(attributes) if n.lower() == "class") if attributes and tag in SECTION else ""
        key = (up, tag, bad, against, named)
        if key not in self.child:
            self.child[key] = len(self.tag)
            self.parent.append(up)
            self.tag.append(tag)
            self.bad.append(bad)
            self.against.append(against)
            self.inside.append(inside or (tag in CONTENT and not bad and not against))
        return self.child[key]

    def start(self, tag: str, attributes: str) -> None:
        if tag in BLOCK:
            self.new_block()
            if self.open["p"] and tag != "option":
                self.end("p")
        if tag in CLOSES:
            kinds, until = CLOSES[tag]
            if any(self.open[k] for k in kinds):
                for t, _ in reversed(self.stack):
                    if t in until or not t:
                        break
                    if t in kinds:
                        self.end(t)
                        break
        if tag in CELL:
            self.text(" ")
        if tag in VOID or attributes.endswith("/"):
            return
        self.stack.append((tag, self.node(tag, attributes)))
        self.open[tag] += 1

    def end(self, tag: str) -> None:
        if tag in BLOCK:
            self.new_block()
        if tag in CELL:
            self.text(" ")
        if not self.open[tag]:
            return
        while True:
            t, _ = self.stack.pop()
            self.open[t] -= 1
            if t in BLOCK:
                self.new_block()
            if t == tag:
                return

    def blocks(self) -> list[int]:
        """Per path the path of the nearest block or cell it is in, or its own."""
        out = [0]
        for p in range(1, len(self.tag)):  # parents come before their children
            out.append(p if self.tag[p] in BLOCK or self.tag[p] in CELL else out[self.parent[p]])
        return out

    def new_block(self) -> None:
        if self.dirty:
            self.block, self.dirty = self.block + 1, False

    def text(self, raw: str) -> None:
        if raw:
            self.nodes.append((self.stack[-1][1], self.block, html.unescape(raw) if "&" in raw else raw))
            self.dirty = True


def fused_ratios(length: np.ndarray, marks: np.ndarray, count: np.ndarray, sigma: float) -> np.ndarray:
    """Smoothed and fused text and punctuation ratios of paths in their order of appearance, times the text of each."""
    reach = int(3 * sigma) or 1
    kernel = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2 * sigma * sigma)) if sigma > 0 else np.ones(1)

    def smooth(x: np.ndarray) -> np.ndarray:
        full = np.convolve(x, kernel)
        norm = np.convolve(np.ones_like(x), kernel)
        cut = len(kernel) // 2
        # A path's own ratio counts three times as much as its neighbourhood's.
        return (3 * x + full[cut : cut + len(x)] / norm[cut : cut + len(x)]) / 4

    return smooth(length / count) * (1 + smooth(marks / count)) * length


def content_node(page: Page, length: dict[int, int], passed: set[int], prose: set[int]) -> int:
    """The section whose text is the page's: ``length`` of text by path, the paths that passed, and those of other prose blocks."""
    mass, total, own = Counter(), Counter(), set()
    for p, n in length.items():
        mass[p] += n if p in passed else 0
        total[p] += n
        if p in passed or p in prose:
            own.add(page.parent[p])
    children: dict[int, list[int]] = {}
    for p in range(len(page.tag) - 1, 0, -1):  # children come after their parents
        if total[p]:
            mass[page.parent[p]] += mass[p]
            total[page.parent[p]] += total[p]
            children.setdefault(page.parent[p], []).append(p)
    root = 0
    while page.tag[root] not in CONTENT:
        best = next((c for c in children.get(root, ()) if page.tag[c] in SECTION and mass[c] == mass[0]), None)
        if best is None:
            break
        root = best
    at = found = root
    while page.tag[at] not in ("", "html", "body"):
        if page.tag[at] in CONTENT or (page.tag[at] in SECTION and at in own and 2 * mass[at] >= total[at]):
            found = at
        at = page.parent[at]
    return found


def extract(source: str | None, sigma: float = 1.0, strictness: float = 0.5) -> str:
    """The main text of a page: blocks in page order, joined by a line feed."""
    if not source:
        return ""
    page = Page(source)
    around = page.blocks()
    stats: dict[int, list[int]] = {}
    seen: set[tuple[int, int]] = set()
    for path, block, text in page.nodes:
        squeezed = len(text) if not text.isspace() else 0
        if squeezed and not page.bad[path]:
            s = stats.setdefault(around[path], [0, 0, 0])
            s[0] += squeezed
            s[1] += len(PUNCTUATION.findall(text))
            s[2] += (around[path], block) not in seen
            seen.add((around[path], block))
    if not stats:
        return ""
    paths = list(stats)
    length, marks, count = (np.array(x, float) for x in zip(*stats.values(), strict=True))
    names = np.array([(FOR if page.inside[p] else 1.0) * (AGAINST if page.against[p] else 1.0) for p in paths])
    fused = names * fused_ratios(length, marks, count, sigma)
    passed = {p for p, f in zip(paths, fused >= strictness * fused.mean(), strict=True) if f}
    # Prose beside the content: nothing speaks against it, or as little as against the content itself.
    least = min((names[i] for i, p in enumerate(paths) if p in passed), default=np.inf)
    prose = {p for p, n in zip(paths, names, strict=True) if p not in passed and n >= least and (page.tag[p] in PROSE or page.inside[p])}
    root = content_node(page, dict(zip(paths, length, strict=True)), passed, prose)
    under = [root == 0]
    for p in range(1, len(page.tag)):
        under.append(p == root or under[page.parent[p]])
    blocks: dict[int, list[str]] = {}
    for path, block, text in page.nodes:
        at = around[path]
        if not page.bad[path] and under[at] and (at in passed or at in prose or text.isspace()):
            blocks.setdefault(block, []).append(text)
    found = (SPACE.sub(" ", "".join(b)).strip() for b in blocks.values())
    return "\n".join(b for b in found if b)


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: ``page_id, url, text, n_chars``.

    A null or empty html gives an empty text. Broken markup is read as far as it goes: unclosed elements
    end with their parent or the page. ``n_chars`` counts code points. Rows that repeat, null ids and null
    urls are kept as they are; an empty table gives none; other columns are not read.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            text = [extract(h) for h in b["_html"]]
            yield pd.DataFrame({"_id": b["_id"], "_url": b["_url"], "text": text, "n_chars": [len(t) for t in text]})

    rows = pick(pages, _id=id_col, _url=url_col, _html=html_col)
    kind = dict(rows.dtypes)["_id"]
    out = rows.select(F.col("_id").cast("string").alias("_id"), "_url", "_html").mapInPandas(run, "_id string, _url string, text string, n_chars bigint")
    return out.select(F.col("_id").cast(kind).alias(id_col), F.col("_url").alias(url_col), "text", "n_chars")


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
