"""Main text of web pages: the maximum-scoring run of words and tags, with weights from labelled pages."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .arrow_text import bounded_batches

# Element names by what a parser has to know of them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template title textarea select iframe object svg math canvas audio video".split())
CONTAINERS = frozenset("html body article main section div nav header footer aside form fieldset table tbody thead tr td th ul ol dl figure blockquote details dialog center".split())
BLOCKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre address caption figcaption hr legend option summary hgroup head menu search button".split())
CLOSED_BY_BLOCKS = frozenset(("p", "h1", "h2", "h3", "h4", "h5", "h6"))
SIBLINGS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table", "tbody", "thead"), "td": ("tr",), "th": ("tr",), "option": ("fieldset",)}

# Kinds of region, with the elements, roles, and words of class and id that name them.
KINDS = ("mark", "content", "heading", "link", "item", "quote", "nav", "header", "footer", "aside", "notice", "advert", "form", "share", "comment", "hidden")
ELEMENTS = {"article": "mark", "main": "mark", "h1": "heading", "h2": "heading", "h3": "heading", "h4": "heading", "h5": "heading", "h6": "heading", "a": "link", "li": "item", "td": "item", "blockquote": "quote", "nav": "nav", "menu": "nav", "header": "header", "footer": "footer", "aside": "aside", "dialog": "notice", "form": "form", "button": "form", "fieldset": "form", "search": "form", "ins": "advert"}
ROLES = {"main": "mark", "article": "mark", "navigation": "nav", "banner": "header", "contentinfo": "footer", "complementary": "aside", "dialog": "notice", "alertdialog": "notice", "alert": "notice", "search": "form", "form": "form", "menu": "nav", "menubar": "nav", "toolbar": "share"}
WORDS = {
    "content": "article articlebody content contents entry story main body text prose maintext post",
    "nav": "nav navbar navigation menu menubar submenu breadcrumb breadcrumbs crumbs pagination pager sitemap toc skip tabs",
    "header": "header masthead topbar logo branding",
    "footer": "footer foot copyright legal colophon",
    "aside": "sidebar aside rail widget widgets related recommended recommendations trending popular teaser teasers readmore",
    "notice": "cookie cookies consent gdpr notice notices notification alert alerts popup modal overlay toast disclaimer paywall announcement",
    "advert": "ad ads adv advert adverts advertisement advertisements advertising banner promo promos promotion promoted sponsor sponsors sponsored adsbygoogle outbrain taboola",
    "form": "login signin signup subscribe subscription newsletter search register contactform",
    "share": "share sharing social follow",
    "comment": "comment comments commentlist disqus respond reply replies discussion reviews",
    "hidden": "hidden invisible offscreen",
}
BIT = {k: 1 << i for i, k in enumerate(KINDS)}
NAMED = {w: k for k, words in WORDS.items() for w in words.split()}
NOISE = sum(BIT[k] for k in ("nav", "header", "footer", "aside", "notice", "advert", "form", "share", "comment", "hidden"))
OUTSIDE, SHORT, LONG, LINKED = (1 << len(KINDS) + i for i in range(4))
FEATURES = len(KINDS) + 4
SHORT_WORDS, LONG_WORDS, LINKED_SHARE, MOST_SHARE = 6, 20, 0.5, 0.6
TAGS = tuple(sorted(BLOCKS | {"a", "b", "br", "em", "i", "img", "input", "label", "small", "span", "strong", "sup", "time", "u"}))

# Words that make a class tell of a page's state ("comments-open", "no-sidebar") and not what a region is.
QUALIFIERS = frozenset("has no with without open opened closed enabled disabled is".split())

# What a weight is worth before any page has been seen (log odds that a word is main text).
PRIOR = {"mark": 2.0, "content": 1.0, "heading": 0.0, "link": -1.5, "item": -0.3, "quote": 0.0, "nav": -3.0, "header": -2.0, "footer": -3.0, "aside": -3.0, "notice": -3.0, "advert": -3.0, "form": -2.5, "share": -3.0, "comment": -4.0, "hidden": -4.0}
PRIOR_REST = (-2.5, -0.8, 0.6, -1.5)  # outside of the marked article, short block, long block, linked block
PRIOR_BIAS, PRIOR_SPREAD = 0.4, 1.0
BOUND = 4.0
TAG_LEAST, TAG_MOST = 0.3, 1.0
PATTERNS = 20_000
"""Most kinds of context that weights are fitted on, those with most words."""

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
PIECES = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")


def kinds_of(name: str, attributes: str) -> int:
    """Bits of KINDS that an element's name, role, class and id say."""
    bits = BIT[ELEMENTS[name]] if name in ELEMENTS else 0
    if "=" not in attributes and "hidden" not in attributes:
        return bits
    for key, *values in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), "".join(values)
        if key == "role" and value.lower() in ROLES:
            bits |= BIT[ROLES[value.lower()]]
        elif key == "itemprop" and value.lower() == "articlebody":
            bits |= BIT["mark"]
        elif key in ("class", "id"):
            for token in value.split():
                words = [w.lower() for w in PIECES.findall(token)]
                if not QUALIFIERS.intersection(words):
                    for word in words:
                        bits |= BIT.get(NAMED.get(word, ""), 0)
        elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            bits |= BIT["hidden"]
    return bits


class Page:
    """Texts and tags of a page in order.

    texts: (block, element, text) of each run of text, `block` numbering runs
    between tags of block elements; parents and kinds of the elements;
    events: of each text (its number) and tag (-1 - its place in TAGS).
    """

    def __init__(self, source: str):
        self.parents, self.kinds, self.texts, self.events = [-1], [0], [], []
        self.block = 0
        stack, at, skip = [("", 0)], 0, None
        for m in TOKEN.finditer(source):
            if m.start() < at:
                continue
            if m.start() > at:
                self._text(source[at : m.start()], stack[-1][1])
            at = m.end()
            if m[2] is None:
                continue
            name = m[2].lower()
            if name in RAW:
                if not m[1] and not m[3].endswith("/"):
                    end = re.compile(rf"</{name}\s*>", re.I).search(source, at)
                    at = end.end() if end else len(source)
                continue
            if name in BLOCKS or name == "br":
                self.events.append(-1 - TAG_PLACE.get(name, 0))
                if name == "br":
                    self._text(" ", stack[-1][1])
                else:
                    self.block += 1
            elif name in TAG_PLACE:
                self.events.append(-1 - TAG_PLACE[name])
            if m[1]:
                self._close(stack, name)
            elif name not in VOID:
                if name in BLOCKS:
                    self._make_room(stack, name)
                self.parents.append(stack[-1][1])
                self.kinds.append(kinds_of(name, m[3]))
                if not m[3].endswith("/"):
                    stack.append((name, len(self.parents) - 1))
        if at < len(source):
            self._text(source[at:], stack[-1][1])

    def _text(self, raw: str, element: int) -> None:
        self.events.append(len(self.texts))
        self.texts.append((self.block, element, html.unescape(raw)))

    @staticmethod
    def _close(stack: list, name: str) -> None:
        """Ends the nearest open element of a name; the end tag of an inline element does not reach over a container."""
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] == name:
                del stack[k:]
                return
            if stack[k][0] in CONTAINERS and name not in CONTAINERS:
                return

    @staticmethod
    def _make_room(stack: list, name: str) -> None:
        """A block ends an open paragraph or heading; an item ends the item before it."""
        for k in range(len(stack) - 1, 0, -1):
            open_ = stack[k][0]
            if open_ in CLOSED_BY_BLOCKS or open_ == name and name in SIBLINGS:
                del stack[k:]
                return
            if open_ in CONTAINERS:
                return

    def measure(self) -> None:
        """words of each text; bits of its context; block and link shares."""
        self.words = np.array([len(t.split()) for _, _, t in self.texts], np.int64)
        own = np.zeros(len(self.parents), np.int64)
        marked = np.zeros(len(self.parents), np.int64)
        elements = np.array([e for _, e, _ in self.texts], np.int64)
        np.add.at(own, elements, self.words)
        for e in range(len(own) - 1, 0, -1):
            own[self.parents[e]] += own[e]
            marked[self.parents[e]] = max(marked[self.parents[e]], own[e] if self.kinds[e] & BIT["mark"] else marked[e])
        total = max(1, int(own[0]))
        bits = [0] * len(own)
        has_mark = any(k & BIT["mark"] for k in self.kinds)
        for e in range(1, len(bits)):
            kind = self.kinds[e]
            if kind & NOISE and (marked[e] > MOST_SHARE * own[e] and marked[e] > total / 2 or own[e] > MOST_SHARE * total and not kind & (BIT["comment"] | BIT["hidden"])):
                kind &= ~NOISE  # it holds the article itself, or most of the page
            if kind & BIT["header"] and kind & NOISE == BIT["header"] and bits[self.parents[e]] & BIT["mark"]:
                kind &= ~BIT["header"]  # the article's own heading
            bits[e] = bits[self.parents[e]] | kind
        self.bits = np.array(bits, np.int64)[elements] if len(elements) else np.empty(0, np.int64)
        if has_mark:
            self.bits = np.where(self.bits & BIT["mark"], self.bits, self.bits | OUTSIDE)
        blocks = np.array([b for b, _, _ in self.texts], np.int64)
        size = np.bincount(blocks, self.words, self.block + 1)
        linked = np.bincount(blocks, self.words * (self.bits & BIT["link"] > 0), self.block + 1)
        shape = np.where(size < SHORT_WORDS, SHORT, 0) | np.where(size >= LONG_WORDS, LONG, 0) | np.where(linked > LINKED_SHARE * size, LINKED, 0)
        self.bits = self.bits | shape[blocks] if len(blocks) else self.bits
        self.blocks, self.has_mark = blocks, has_mark


TAG_PLACE = {t: i for i, t in enumerate(TAGS)}
LABEL_BITS = BIT["mark"] | OUTSIDE
SHAPE_BITS = sum(BIT[k] for k in ("heading", "link", "item", "quote")) | SHORT | LONG | LINKED


def labelled(pages: Iterator[str]) -> Iterator[tuple[int, int, int]]:
    """(key, words or tags inside, of all) of pages whose source marks its article.

    A word is inside if it stands in the marked element and in no region of
    noise. Each page counts three times: with all its features, without the
    mark, and with the shape of its blocks alone, so that weights are learned
    for pages that mark nothing and name nothing. Keys under 2**32 are
    contexts of words, those above places in TAGS.
    """
    counts: dict[int, list[int]] = {}
    for source in pages:
        if not source:
            continue
        page = Page(source)
        page.measure()
        if not page.has_mark:
            continue
        inside = (page.bits & BIT["mark"] > 0) & (page.bits & NOISE == 0)
        for bits, words, good in zip(page.bits.tolist(), page.words.tolist(), inside.tolist()):
            for key in (bits, bits & ~LABEL_BITS, bits & SHAPE_BITS):
                c = counts.setdefault(key, [0, 0])
                c[0] += words * good
                c[1] += words
        good = False
        for e in page.events:
            if e >= 0:
                good = bool(inside[e]) if page.words[e] else good
            else:
                c = counts.setdefault((1 << 32) - 1 - e, [0, 0])
                c[0] += good
                c[1] += 1
    for key, (a, b) in counts.items():
        yield key, a, b


class Weights:
    """Log odds of features of words, and costs of tags.

    Logistic regression by Newton's method on counts of contexts, around
    PRIOR; a context counts by the logarithm of its words, so that a frequent
    layout does not drown the others.
    """

    def __init__(self, words: dict[int, tuple[int, int]], tags: dict[int, tuple[int, int]]):
        prior = np.array([*(PRIOR[k] for k in KINDS), *PRIOR_REST, PRIOR_BIAS])
        keys = [k for k, (_, n) in words.items() if n]
        x = np.array([[*(k >> i & 1 for i in range(FEATURES)), 1] for k in keys], float).reshape(-1, FEATURES + 1)
        share = np.array([words[k][0] / words[k][1] for k in keys])
        count = np.log1p([words[k][1] for k in keys])
        w = prior.copy()
        for _ in range(25):
            p = 1 / (1 + np.exp(-x @ w))
            gradient = x.T @ (count * (share - p)) - (w - prior) / PRIOR_SPREAD**2
            hessian = (x * (count * p * (1 - p))[:, None]).T @ x + np.eye(len(w)) / PRIOR_SPREAD**2
            step = np.linalg.solve(hessian, gradient)
            w = w + step
            if np.abs(step).max() < 1e-9:
                break
        for i in (*(KINDS.index(k) for k in KINDS if BIT[k] & NOISE), len(KINDS)):
            w[i] = min(w[i], -0.5)  # never a sign of main text
        self.features = w
        inside, outside = np.full(len(TAGS), 1.0), np.full(len(TAGS), 1.0)
        for place, (a, n) in tags.items():
            inside[place] += a
            outside[place] += n - a
        self.tags = -np.clip(np.log(outside / inside), TAG_LEAST, TAG_MOST)

    def scores(self, bits: np.ndarray) -> np.ndarray:
        """Score of one word of each context, positive for likely main text."""
        known, at = np.unique(bits, return_inverse=True)
        x = np.array([[*(k >> i & 1 for i in range(FEATURES)), 1] for k in known.tolist()], float).reshape(-1, FEATURES + 1)
        return np.clip(x @ self.features, -BOUND, BOUND)[at] if len(bits) else np.empty(0)


def fit(pages: DataFrame) -> Weights:
    """Weights from all pages that mark their article; what the driver gets is a count for each context, PATTERNS at most.

    Contexts are sets of a fixed number of features, so their number does not
    grow with the table.
    """

    def run(batches):
        for batch in batches:
            rows = list(labelled(batch.column(0).to_pylist()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], names=["key", "inside", "n"])

    counts = pages.select("html").mapInArrow(run, "key long, inside long, n long").groupBy("key").agg(F.sum("inside").alias("inside"), F.sum("n").alias("n"))
    words, tags = {}, {}
    for key, inside, n in counts.orderBy(F.desc("n"), "key").limit(PATTERNS).toPandas().itertuples(index=False):
        (tags if key >> 32 else words)[key & ((1 << 32) - 1)] = (int(inside), int(n))
    return Weights(words, tags)


def best_run(scores: np.ndarray) -> tuple[int, int]:
    """(start, end) of the consecutive scores of greatest sum, the first and shortest of equals; (0, 0) if none is positive."""
    sums = np.concatenate(([0.0], np.cumsum(scores)))
    least = np.minimum.accumulate(sums)
    end = int((sums - least).argmax())
    if sums[end] <= least[end]:
        return 0, 0
    return int(np.flatnonzero(sums[: end + 1] == least[end])[-1]), end


def main_text(source: str | None, weights: Weights) -> str:
    """The blocks that the best run reaches, without regions of noise inside it."""
    if not source:
        return ""
    page = Page(source)
    page.measure()
    if not page.words.sum():
        return ""
    each = weights.scores(page.bits) * page.words
    events = np.array(page.events)
    scores = np.where(events >= 0, each[np.maximum(events, 0)], weights.tags[np.maximum(-1 - events, 0)])
    start, end = best_run(scores)
    taken = events[start:end]
    taken = taken[taken >= 0]
    keep = set(page.blocks[taken].tolist())
    parts: dict[int, list[str]] = {}
    for (block, _, text), bits in zip(page.texts, page.bits.tolist()):
        if block in keep and not bits & NOISE:
            parts.setdefault(block, []).append(text)
    return " ".join(t for b in sorted(parts) if (t := " ".join("".join(parts[b]).split())))


def extract_main_text(pages: DataFrame, weights: Weights | None = None) -> DataFrame:
    """One row a page: page_id, url, text (its main text; empty if there is none), n_chars (code points).

    Words score by log odds of their context (elements around them, words of
    class and id, length and links of their block), tags cost; a linear scan
    finds the run of greatest sum. Its blocks, without what stands in menus,
    headers, footers, sidebars, notices, adverts, forms and comments, are the
    text: character references are decoded, white space inside a block is one
    space, blocks are joined by one. Scripts, styles and comments of the source
    are no text.

    A null or empty html, and a page without words, give an empty text. Rows
    that repeat and rows of a null page_id each keep their row. Other columns
    are ignored. An empty table gives an empty table. Without `weights` they
    are fitted on the pages themselves, and where none marks its article are
    those of PRIOR.
    """
    bounded_batches(pages.sparkSession)
    weights = weights or fit(pages)

    def run(batches):
        for batch in batches:
            texts = [main_text(h, weights) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def query(spark, sf_dir: str) -> DataFrame:
    return extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
