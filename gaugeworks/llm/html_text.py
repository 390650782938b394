"""Main text of web pages: flat text blocks, classified by a decision tree over shallow features.

A page becomes a flat sequence of text blocks (what stands between the ends of block elements). Each block
is described by its own number of words and link density, those of its neighbours, whether it is a
heading, and the kind of region its ancestors name, if any; a decision tree, trained on a small labelled
table in which most pages name nothing, tells main text from the rest.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeworks.llm.common import arrow_batches, prepare
from gaugeworks.llm.labelled_blocks import PAGES

# HTML's element names by role.
UNSEEN = "script style noscript template iframe object svg math canvas select option textarea button title audio video".split()
RAW = "script style noscript iframe textarea title".split()  # nothing but their own end tag is markup in them
BLOCKS = (
    "html body p div section article main nav header footer aside form ul ol li dl dt dd table caption thead tbody tfoot tr td th "
    "h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption address fieldset legend details summary dialog menu hr center search"
).split()
CONTAINERS = (
    "html body div section article main nav header footer aside form ul ol dl table tr td th blockquote figure fieldset details "
    "dialog menu search"
).split()
# Words in class, id and role that name the two kinds of regions.
ASIDE = (
    "nav navbar navigation menu sidebar sidebars aside footer foot header masthead topbar banner ad ads advert adverts advertisement "
    "sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert warning disclaimer newsletter subscribe signup login "
    "share sharing social related recommended recommendations more comment comments reply replies respond disqus discussion "
    "breadcrumb breadcrumbs pagination pager widget popup modal overlay toolbar tags copyright legal complementary contentinfo "
    "search form skip outbrain taboola teaser"
).split()
REGIONS = "nav aside footer menu dialog search".split()  # elements that are such regions themselves
MAIN = "article post entry story content main maincontent articlebody".split()
OWN_HEADER = "article post entry story".split()  # with these, a header is the text's own

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_QUOTE_OR_END = re.compile("[\"'>]")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}
# html.unescape turns digits into a number, whose length Python limits
_LEADING_ZEROS, _NO_CHARACTER = re.compile("&#0+(?=[0-9])"), re.compile("&#[0-9]{8,};?")
_SCRIPT_PART = re.compile(r"(?P<open><!--)|(?P<shut>-->)|<(?P<end>/?)script(?=[\s/>])", re.I)
_NAMED = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I | re.S)
_PART = re.compile(r"[a-z]+")
_UNSEEN, _BLOCKS, _CONTAINERS, _ASIDE, _REGIONS, _MAIN, _OWN_HEADER = map(
    frozenset, (UNSEEN, BLOCKS, CONTAINERS, ASIDE, REGIONS, MAIN, OWN_HEADER)
)

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "heading", "region")


class _Token(NamedTuple):
    """A tag (with a name) or a stretch of text."""

    end: int  # where it ends
    name: str = ""
    closing: bool = False
    attrs: str = ""
    text: str | None = None


def _tag_end(page: str, at: int, hopeless: set[int]) -> int | None:
    """Behind the ``>`` of a tag whose attributes begin at ``at``; None where all of them are in quotes.

    ``hopeless`` keeps the quotes from which no such end was found, so that they are tried once a page.
    """
    tried = []
    while sign := _QUOTE_OR_END.search(page, at):
        if page[sign.start()] == ">":
            return sign.end()
        if sign.start() in hopeless:
            break
        tried.append(sign.start())
        at = page.find(page[sign.start()], sign.end()) + 1
        if not at:
            break
    hopeless.update(tried)
    return None


def _tokens(page: str, at: int, hopeless: set[int]) -> Iterator[_Token]:
    """Tags and texts from ``at`` on; what does not become a tag is text. Every part is looked at a few times at most."""
    while at < len(page):
        if page[at] != "<":
            end = page.find("<", at)
            end = len(page) if end < 0 else end
            yield _Token(end, text=page[at:end])
        elif page.startswith("<!--", at):
            end = page.find("-->", at + 4) + 3
            yield _Token(len(page) if end < 3 else end)
            end = len(page) if end < 3 else end
        elif (first := page.find(">", at)) < 0:
            end = len(page)  # no tag ends any more
            yield _Token(end, text=page[at:])
        else:
            closing = page[at + 1] == "/"
            name = _NAME.match(page, at + 1 + closing)
            if name:
                # a tag whose quotes don't fit ends at its first ``>``
                end = _tag_end(page, name.end(), hopeless)
                attrs = page[name.end() : end - 1] if end else ""
                end = end or first + 1
                yield _Token(end, name[0].lower(), closing, attrs)
            elif page[at + 1] in "!?/":
                end = first + 1
                yield _Token(end)
            else:
                end = at + 1
                yield _Token(end, text="<")
        at = end


def _decoded(text: str) -> str:
    """A text with its character references replaced; a number beyond all characters is none of them."""
    if "&#" in text:
        text = _NO_CHARACTER.sub("\ufffd", _LEADING_ZEROS.sub("&#", text))
    return html.unescape(text) if "&" in text else text


class _Place(NamedTuple):
    """Where an element stands: the regions and the article that hold it."""

    aside: bool = False
    main: bool = False
    fixed: bool = False  # set aside by an element that is never a wrapper
    wrappers: tuple[int, int] = (0, 0)  # other elements that set it aside, outside any article: how many, the innermost
    article: int = 0  # the outermost one
    aside_inside: bool = False  # set aside by an element inside that article


@dataclass
class _Block:
    text: list[str] = field(default_factory=list)
    link_words: int = 0
    place: _Place = _Place()
    heading: bool = False


def _named(attrs: str) -> set[str]:
    found = set()
    for values in _NAMED.findall(attrs):
        for name in "".join(values).lower().split():
            parts = set(_PART.findall(name))
            found |= parts - {"header", "head"} if parts & _OWN_HEADER else parts
    return found


def _region(name: str, attrs: str, above: _Place, serial: int) -> _Place:
    """The place of what an element holds; ``serial`` tells elements apart."""
    main, words = above.main, _named(attrs) if attrs else set()
    named_aside, named_main = not _ASIDE.isdisjoint(words), not _MAIN.isdisjoint(words)
    sets_aside = name in _REGIONS or name == "form" or (name == "header" and not main)
    if name in ("article", "main"):
        main = True
    elif named_aside and name not in ("html", "body"):
        sets_aside = True
    elif named_main:
        main = True
    place = above._replace(main=main)
    if sets_aside:
        place = place._replace(aside=True)
        if above.article:
            return place._replace(aside_inside=True)
        return place._replace(fixed=True) if name in _REGIONS or name == "header" else place._replace(wrappers=(above.wrappers[0] + 1, serial))
    if above.fixed or above.article:
        return place
    if name == "main":
        # a page has one, so that what it stands in are wrappers
        return place._replace(aside=False, wrappers=(0, 0))
    return place._replace(article=serial) if name == "article" and (named_main or not named_aside) else place


def _lift_wrappers(found: list[_Block]) -> None:
    """Undo what wrappers set aside where the page's articles stand in them.

    Of the page's articles the ones least deep in regions set aside count, of these the ones in the region
    that holds the longest of them, if it is longer than the main text that is in no article and not set
    aside. Articles elsewhere (comments, teasers) stay set aside.
    """
    n_words: dict[int, int] = {}
    wrappers: dict[int, tuple[int, int]] = {}
    outside = 0
    for b in found:
        if b.place.article and not b.place.aside_inside:
            n_words[b.place.article] = n_words.get(b.place.article, 0) + len("".join(b.text).split())
            wrappers[b.place.article] = b.place.wrappers
        elif b.place.main and not b.place.aside and not b.place.article:
            outside += len("".join(b.text).split())
    if n_words:
        least = min(depth for depth, _ in wrappers.values())
        longest = max((k for k in n_words if wrappers[k][0] == least), key=n_words.get)
        if n_words[longest] > outside:
            for b in found:
                if b.place.article and b.place.wrappers == wrappers[longest]:
                    b.place = b.place._replace(aside=b.place.aside_inside)


def _raw_end(page: str, name: str, at: int) -> int:
    """Where an element with raw text ends that holds what follows ``at``; without an end tag, the page's end."""
    first = _RAW_END[name].search(page, at)
    behind = page.find(">", first.end()) + 1 if first else 0
    if not behind:
        return len(page)
    if name == "script" and page.find("<!--", at, first.start()) >= 0:
        # between <!-- and --> a script may hold script elements as text
        hidden = nested = False
        part = _SCRIPT_PART.search(page, at)
        while part:
            if part["open"]:
                hidden = True
            elif part["shut"]:
                hidden = nested = False
            elif not part["end"]:
                nested = hidden
            elif nested:
                nested = False
            else:
                return page.find(">", part.end()) + 1 or len(page)
            part = _SCRIPT_PART.search(page, part.start() + 2)
    return behind


def blocks(page: str) -> list[tuple[str, list[float]]]:
    """Texts of a page's blocks with words in them, in order, each with its own features."""
    found: list[_Block] = []
    now, unseen, in_link = _Block(), None, False
    opened, unclosed = 0, set()
    stack: list[tuple[str, _Place]] = [("", _Place())]
    open_names: Counter[str] = Counter()
    hopeless: set[int] = set()

    def close(heading: bool = False) -> None:
        nonlocal now
        if now.text:
            found.append(now)
        now = _Block(place=stack[-1][1], heading=heading)

    tokens = _tokens(page, 0, hopeless)
    while (token := next(tokens, None)) or unseen:
        if token is None:
            # never closed: the rest of the page is not its content
            unclosed.add(unseen)
            unseen, tokens = None, _tokens(page, opened, hopeless)
            continue
        name, end, attrs = token.name, token.closing, token.attrs
        if name:
            void = attrs.rstrip().endswith("/")
            if name in _RAW_END and not end:
                # a self-closed element has nothing to skip
                if not (void and (name == "iframe" or unseen in ("svg", "math"))):
                    tokens = _tokens(page, _raw_end(page, name, token.end), hopeless)
                if name == "title" and not unseen:
                    close()
                continue
            if unseen == "option" and (name in _BLOCKS or name in ("option", "optgroup", "select", "datalist")):
                unseen = None  # its end tag is optional
            if unseen:
                unseen = None if end and name == unseen else unseen
                continue
            if not end and name in _UNSEEN and name not in unclosed:
                if not (void and name in ("svg", "math", "object")):
                    unseen, opened = name, token.end
                continue
            if name == "head":
                close()  # what may stand in it has no text or is unseen; anything else ends it
            elif name == "a":
                in_link = not end
            elif name == "br":
                if now.text:
                    now.text.append(" ")
            elif name in _BLOCKS:
                if name == "body" and not end:
                    stack[1:] = []
                    open_names.clear()
                if name in _CONTAINERS and not attrs.rstrip().endswith("/"):
                    if not end:
                        stack.append((name, _region(name, attrs, stack[-1][1], token.end)))
                        open_names[name] += 1
                    elif open_names[name]:
                        while (shut := stack.pop()[0]) != name:
                            open_names[shut] -= 1
                        open_names[name] -= 1
                    close()
                else:
                    close(heading=not end and name[0] == "h" and name[1:].isdigit())
                    if not end and attrs:
                        now.place = _region(name, attrs, stack[-1][1], token.end)
        elif token.text is not None and not unseen:
            text = _decoded(token.text)
            now.text.append(text)
            if in_link:
                now.link_words += len(text.split())
    close()
    _lift_wrappers(found)

    out = []
    for b in found:
        words = "".join(b.text).split()
        if words:
            own = [len(words), min(1.0, b.link_words / len(words)), float(b.place.aside), float(b.place.main), float(b.heading)]
            out.append((" ".join(words), own))
    return out


def features(own: list[list[float]]) -> np.ndarray:
    """The features of a page's blocks, neighbours included; outside the page there are no words.

    Names of elements and classes are one of them, the region: 1 in a main region, -1 in one that is set aside
    or outside the main regions of a page that has any, 0 where nothing is named.
    """
    a = np.array(own, dtype=float).reshape(-1, 5)
    none = np.zeros((1, 2))
    before, after = np.vstack([none, a[:-1, :2]])[: len(a)], np.vstack([a[1:, :2], none])[: len(a)]
    aside, main = a[:, 2] > 0, a[:, 3] > 0
    region = np.where(aside, -1, np.where(main, 1, -1 if (main & ~aside).any() else 0))
    return np.hstack([a[:, :2], before, after, a[:, 4:], region[:, None]])


class DecisionTree:
    """A small classification tree: the split that lowers Gini impurity most, to a depth and a leaf size."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 9, leaf: int = 2):
        self.value = bool(y.mean() >= 0.5) if len(y) else True
        self.split = None
        if depth and 0 < y.sum() < len(y):
            before = _impurity(y.sum(), len(y))
            best = min((self._best_cut(x[:, k], y, leaf, k) for k in range(x.shape[1])), key=lambda cut: cut[:2])
            if best[0] < before - 1e-9:
                _, k, at = best
                low = x[:, k] <= at
                self.split = k, at, DecisionTree(x[low], y[low], depth - 1, leaf), DecisionTree(x[~low], y[~low], depth - 1, leaf)

    @staticmethod
    def _best_cut(values: np.ndarray, y: np.ndarray, leaf: int, k: int) -> tuple[float, int, float]:
        order = np.argsort(values, kind="stable")
        sorted_values, yes = values[order], np.cumsum(y[order])
        n = np.arange(1, len(y))
        fits = (sorted_values[1:] > sorted_values[:-1]) & (n >= leaf) & (len(y) - n >= leaf)
        if not fits.any():
            return math.inf, k, 0.0
        both = _impurity(yes[:-1], n) + _impurity(yes[-1] - yes[:-1], len(y) - n)
        at = int(np.argmin(np.where(fits, both, math.inf)))
        return float(both[at]), k, float(sorted_values[at] + sorted_values[at + 1]) / 2

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.split is None:
            return np.full(len(x), self.value)
        k, at, left, right = self.split
        low, out = x[:, k] <= at, np.empty(len(x), dtype=bool)
        out[low], out[~low] = left.predict(x[low]), right.predict(x[~low])
        return out

    def used(self) -> set[int]:
        """The features the tree asks for."""
        return set() if self.split is None else {self.split[0]} | self.split[2].used() | self.split[3].used()


def _impurity(yes, n):
    """Gini impurity of a part with ``yes`` of ``n``, weighted by its size."""
    return 2 * yes * (1 - yes / n)


def labelled(pages: tuple[str, ...] = PAGES) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of a labelled table: pages in which main text begins with ``+`` and the rest with ``-``."""
    x, y = [], []
    for page in pages:
        found = blocks(page)
        x.append(features([[own[0] - (len(text.split()[0]) == 1), *own[1:]] for text, own in found]))
        y += [text[0] == "+" for text, _ in found]
    return np.vstack(x), np.array(y, dtype=bool)


def train(pages: tuple[str, ...] = PAGES) -> DecisionTree:
    return DecisionTree(*labelled(pages))


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", tree: DecisionTree | None = None) -> DataFrame:
    """Per page: id, url, ``text`` of its main blocks joined by line ends (empty if none), and ``n_chars``.

    Null or empty html has an empty text. One row per row, repeated ones too; other columns are not read, and
    an empty table gives an empty result. Pages of any size and any broken markup take time in proportion.
    """
    prepare(pages.sparkSession)
    tree = tree or train()
    narrow = pages.select(*(F.col(f"`{c}`").alias(a) for c, a in ((id_col, "id"), (url_col, "url"), (html_col, "html"))))
    schema = T.StructType(
        [
            T.StructField(id_col, pages.schema[id_col].dataType),
            T.StructField(url_col, pages.schema[url_col].dataType),
            T.StructField("text", T.StringType()),
            T.StructField("n_chars", T.LongType()),
        ]
    )

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrow_batches(batches):
            found = [blocks(page or "") for page in batch.column("html").to_pylist()]
            main = tree.predict(np.vstack([features([own for _, own in page]) for page in found]))
            out, at = [], 0
            for page in found:
                out.append("\n".join(text for k, (text, _) in enumerate(page) if main[at + k]))
                at += len(page)
            yield pa.record_batch(
                [batch.column("id"), batch.column("url"), pa.array(out, pa.string()), pa.array(list(map(len, out)), pa.int64())], names=schema.names
            )

    return narrow.mapInArrow(texts, schema)
