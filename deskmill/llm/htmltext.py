"""Main text of web pages from flat text blocks.

A page is read once, tag by tag, into flat blocks: runs of text between block-level
tags. A block is described by its word count and link density, those of its
neighbours, and the landmarks it lies in (``article`` or ``main``, ``nav``, ``aside`` and so on,
telling class names). A decision tree, grown by Gini impurity on a small labelled
table of blocks, decides which are main text.

Character references are decoded, white space inside a block becomes one space, and
the blocks are joined by line ends in page order. Scripts, styles, comments and forms
are never text. Null and empty pages, and pages without main text, give an empty text.
Unclosed and wrongly nested tags close with what they lie in. Class words of adverts and the
like count on every tag, also inside a line. A page is read in one pass in linear time,
also where quotes, comments or tags are never closed. Repeated rows
are extracted alike; an empty table gives an empty result; further columns pass
through :func:`with_main_text`.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from deskmill.llm.common import map_text

# Fixed values of HTML: elements that interrupt a line of text, elements without content
# of their own, and elements whose content is no text.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body canvas caption center dd details dialog dir div dl dt"
    " fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html"
    " li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot"
    " th thead title tr ul".split()
)
VOID_TAGS = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
RAW_TAGS = ("script", "style", "noscript", "template", "textarea", "iframe", "svg", "math", "object", "select", "button")

MAIN_TAGS = frozenset(("article", "main"))
BOILER_TAGS = frozenset(("nav", "aside", "footer", "form", "menu", "dialog", "head", "title"))
# Class and id words that name what is no main text.
BOILER_WORDS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|cookies?|consent|notice|alert|popup|modal|"
    r"nav\w*|menu|breadcrumbs?|sidebar|side|widget|footer|header|masthead|share|sharing|social|"
    r"related|recommend\w*|comments?|replies|discussion|disqus|newsletter|subscribe|signup|login|search|"
    r"pagination|pager|toolbar|skip)(?:$|[\s_-])",
    re.I,
)
COMMENT_WORDS = re.compile(r"(?:^|[\s_-])(?:comments?|replies|discussion|disqus)(?:$|[\s_-])", re.I)
# Of tags inside a line and of headings only these words count: others, such as "header" or
# "search", often name parts of an article there.
ADVERT_WORDS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|popup|share|sharing|social|newsletter|subscribe|signup)(?:$|[\s_-])",
    re.I,
)

# What stands between tags, comments, declarations, and the name of a tag. Each alternative
# ends where it fails or moves on, so a page is read once whatever its markup.
_TOKEN = re.compile(r"[^<]+|<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)|<", re.S)
# The end of a tag, or one attribute: its name, and its value in quotes or bare.
_ATTRIBUTE = re.compile(
    r"[\s/]*(?:(>)|([^\s/>][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"'][^\s>]*)?))?)"
)
_RAW_END = {t: re.compile(rf"</{t}\s*>|\Z", re.I) for t in RAW_TAGS}


class _Tags:
    """Reads the attributes of one page's tags, each character once."""

    def __init__(self, page: str):
        self.page = page
        self.last_end = page.rfind(">")

    def read(self, at: int) -> tuple[int, str, str]:
        """The place after the tag, its class, and its class, id and role together.

        A quote opens a value only where it is closed further on, and is part of a name
        otherwise; a tag without an end takes the rest of the page.
        """
        classes, named = "", []
        while at <= self.last_end:
            m = _ATTRIBUTE.match(self.page, at)
            if m is None:
                break
            at = m.end()
            if m.group(1):
                return at, classes, " ".join(named)
            name = m.group(2).lower()
            value = next(filter(None, m.group(3, 4, 5)), "")
            if name in ("class", "id", "role"):
                named.append(value)
                if name == "class":
                    classes = value
        return len(self.page), classes, " ".join(named)


@dataclass
class Block:
    """A run of text and where it stands."""

    text: str
    words: int
    linked: int
    main: bool
    boiler: bool
    heading: bool
    item: bool


class _Open:
    """The open tags, innermost last, with what holds inside: main, boiler, unseen."""

    def __init__(self):
        self.tags: list[tuple[str, bool, bool, bool]] = [("", False, False, False)]
        self.places: dict[str, list[int]] = {}
        self.block_places: list[int] = []

    @property
    def now(self) -> tuple[str, bool, bool, bool]:
        return self.tags[-1]

    def push(self, name: str, main: bool, boiler: bool, unseen: bool) -> None:
        self.places.setdefault(name, []).append(len(self.tags))
        if name in BLOCK_TAGS:
            self.block_places.append(len(self.tags))
        self.tags.append((name, main, boiler, unseen))

    def place(self, name: str) -> int:
        """Where the innermost open ``name`` stands; 0 if there is none."""
        places = self.places.get(name)
        return places[-1] if places else 0

    def close_from(self, place: int) -> None:
        while len(self.tags) > place:
            self.places[self.tags.pop()[0]].pop()
        while self.block_places and self.block_places[-1] >= place:
            self.block_places.pop()

    def close(self, name: str) -> None:
        """The innermost ``name`` and all inside it, unless a list or table stands between."""
        place = self.place(name)
        if place and place > max((self.place(t) for t in _BOUNDS.get(name, ())), default=0):
            self.close_from(place)

    def make_way(self, name: str) -> None:
        """Close what the start of a block tag ends by itself: paragraphs, and items before an item."""
        if self.place("p"):
            self.close_from(self.place("p"))
        if name == "body":
            self.close("head")
        while self.block_places and self.tags[self.block_places[-1]][0] in _ENDS.get(name, ()):
            self.close_from(self.block_places[-1])


def blocks(page: str) -> list[Block]:
    """The flat text blocks of a page, in order."""
    found: list[Block] = []
    parts: list[str] = []
    linked = 0
    in_link = 0
    open_tags = _Open()
    tags = _Tags(page)
    last_cdata = page.rfind("]]>")
    tag_now = ""

    def close_block() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if text:
                _, main, boiler, _ = open_tags.now
                found.append(
                    Block(text, text.count(" ") + 1, linked, main, boiler, tag_now in _HEADINGS, tag_now in _ITEMS)
                )
        linked = 0

    def say(text: str) -> None:
        nonlocal linked
        if not open_tags.now[3]:
            parts.append(text)
            if in_link:
                linked += len(text.split())

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.match(page, at)
        at = m.end()
        name = m.group(2)
        if name is None:
            text = m.group()
            if text == "<![CDATA[":
                # Its text stands for itself; an open one is a mark without meaning.
                if at <= last_cdata:
                    stop = page.index("]]>", at)
                    say(html.escape(page[at:stop], quote=False))
                    at = stop + 3
            elif text[0] != "<" or text == "<":
                say(text)
            continue
        name = name.lower()
        closing = bool(m.group(1))
        at, classes, named = tags.read(at)
        if name in _RAW_END and not closing:
            stop = _RAW_END[name].search(page, at)
            at = stop.end()
            if name not in ("button", "svg", "math", "object"):
                continue
            say(" ")
            continue
        if name == "a":
            in_link = 0 if closing else 1
        if name == "br":
            say(" ")
            continue
        if name not in BLOCK_TAGS:
            if closing:
                open_tags.close(name)
            elif name not in VOID_TAGS:
                _, main, boiler, unseen = open_tags.now
                advert = bool(classes and ADVERT_WORDS.search(classes))
                # Other tags inside a line only matter where one of that name must be paired up.
                if advert or open_tags.place(name):
                    open_tags.push(name, main, boiler, unseen or advert)
            continue
        close_block()
        in_link = 0
        if closing:
            tag_now = ""
            # The end of any heading ends the open one.
            open_tags.close(open_tags.now[0] if name in _HEADINGS and open_tags.now[0] in _HEADINGS else name)
            continue
        tag_now = name
        open_tags.make_way(name)
        if name in VOID_TAGS or name in ("html", "body"):
            continue
        _, main, boiler, unseen = open_tags.now
        if name in MAIN_TAGS:
            # An article inside a comment list or a sidebar stays what surrounds it.
            main = True
            boiler = boiler or bool(named and COMMENT_WORDS.search(named))
        elif name in BOILER_TAGS or name == "header" and not main:
            boiler = True
        elif name in _HEADINGS:
            boiler = boiler or bool(classes and ADVERT_WORDS.search(classes))
        elif name in _LINES:
            boiler = boiler or bool(classes and BOILER_WORDS.search(classes))
        elif named and BOILER_WORDS.search(named):
            boiler = True
        open_tags.push(name, main, boiler, unseen)
    close_block()
    return found


_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
_ITEMS = frozenset(("li", "td", "th", "dt", "dd", "option"))
# Tags of which only the class is read: their ids are often made from an article's own words.
_LINES = _ITEMS | {"p", "tr", "thead", "tbody", "tfoot", "caption", "optgroup"}
# What the start of a tag closes where it stands innermost.
_ENDS = {
    **{h: _HEADINGS for h in _HEADINGS},
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "optgroup": {"option", "optgroup"},
    "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"td", "th", "tr"},
    **{t: {"td", "th", "tr", "thead", "tbody", "tfoot", "caption"} for t in ("thead", "tbody", "tfoot")},
}
# What the end of a tag does not reach beyond.
_BOUNDS = {
    "li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",),
    **{t: ("table",) for t in ("td", "th", "tr", "thead", "tbody", "tfoot", "caption")},
}


def features(found: list[Block]) -> np.ndarray:
    """One row per block, in the order of ``FEATURES``."""
    words = np.array([0, *(b.words for b in found), 0], float)
    linked = np.array([0, *(b.linked for b in found), 0], float)
    density = np.minimum(1.0, linked / np.maximum(words, 1))
    has_main = any(b.main for b in found)
    flags = np.array([[has_main, b.main, b.boiler, b.heading, b.item] for b in found], float)
    return np.column_stack(
        [words[1:-1], density[1:-1], words[:-2], density[:-2], words[2:], density[2:], flags]
    )


FEATURES = (
    "words", "density", "words_before", "density_before", "words_after", "density_after",
    "page_has_main", "in_main", "in_boiler", "heading", "item",
)

# The labelled table: blocks described by hand in the order of FEATURES, and
# whether they are main text.
LABELLED = (
    # Pages with a main landmark: articles of any length, with links and lists in them.
    ((10, 0.0, 12, 0.0, 80, 0.0, 1, 1, 0, 1, 0), 1),
    ((5, 0.0, 3, 1.0, 6, 0.0, 1, 1, 0, 1, 0), 1),
    ((2, 0.0, 0, 0.0, 40, 0.0, 1, 1, 0, 0, 0), 1),
    ((1, 0.0, 60, 0.0, 1, 0.0, 1, 1, 0, 0, 0), 1),
    ((80, 0.0, 10, 0.0, 60, 0.1, 1, 1, 0, 0, 0), 1),
    ((60, 0.1, 80, 0.0, 8, 0.0, 1, 1, 0, 0, 0), 1),
    ((200, 0.0, 4, 1.0, 5, 0.2, 1, 1, 0, 0, 0), 1),
    ((30, 0.5, 50, 0.0, 40, 0.0, 1, 1, 0, 0, 0), 1),
    ((4, 1.0, 50, 0.0, 40, 0.0, 1, 1, 0, 0, 0), 1),
    ((6, 0.0, 30, 0.0, 7, 0.0, 1, 1, 0, 0, 1), 1),
    ((3, 1.0, 20, 0.0, 3, 1.0, 1, 1, 0, 0, 1), 1),
    ((1, 1.0, 1, 1.0, 1, 1.0, 1, 1, 0, 0, 1), 1),
    ((900, 0.0, 300, 0.0, 2, 0.0, 1, 1, 0, 0, 0), 1),
    # Inside the landmark, but adverts, notices, forms, comments.
    ((8, 0.0, 80, 0.0, 60, 0.0, 1, 1, 1, 0, 0), 0),
    ((60, 0.0, 80, 0.0, 60, 0.0, 1, 1, 1, 0, 0), 0),
    ((5, 1.0, 80, 0.0, 5, 1.0, 1, 1, 1, 0, 1), 0),
    ((3, 0.0, 80, 0.0, 20, 0.0, 1, 1, 1, 1, 0), 0),
    ((120, 0.0, 3, 0.0, 90, 0.0, 1, 1, 1, 0, 0), 0),
    # Outside of it.
    ((7, 0.0, 6, 1.0, 10, 0.0, 1, 0, 1, 0, 0), 0),
    ((1, 1.0, 1, 1.0, 1, 1.0, 1, 0, 1, 0, 1), 0),
    ((9, 0.0, 80, 0.0, 0, 0.0, 1, 0, 1, 0, 0), 0),
    ((12, 0.0, 4, 1.0, 9, 0.0, 1, 0, 0, 0, 0), 0),
    ((40, 0.0, 90, 0.0, 6, 0.5, 1, 0, 0, 0, 0), 0),
    ((150, 0.0, 90, 0.0, 20, 0.0, 1, 0, 0, 0, 0), 0),
    ((5, 0.0, 10, 0.0, 50, 0.0, 1, 0, 0, 1, 0), 0),
    ((60, 0.0, 70, 0.0, 80, 0.0, 1, 0, 1, 0, 0), 0),
    # Pages without one: long blocks with few links, and short ones among them.
    ((80, 0.0, 8, 0.0, 60, 0.0, 0, 0, 0, 0, 0), 1),
    ((35, 0.0, 60, 0.0, 45, 0.1, 0, 0, 0, 0, 0), 1),
    ((150, 0.1, 5, 1.0, 3, 0.0, 0, 0, 0, 0, 0), 1),
    ((22, 0.0, 50, 0.0, 30, 0.0, 0, 0, 0, 0, 0), 1),
    ((8, 0.0, 60, 0.0, 70, 0.0, 0, 0, 0, 0, 0), 1),
    ((7, 0.0, 3, 1.0, 60, 0.0, 0, 0, 0, 1, 0), 1),
    ((6, 0.0, 70, 0.0, 50, 0.0, 0, 0, 0, 1, 0), 1),
    ((18, 0.0, 40, 0.0, 5, 0.0, 0, 0, 0, 0, 0), 1),
    ((9, 0.0, 40, 0.0, 12, 0.0, 0, 0, 0, 0, 1), 1),
    ((60, 0.0, 60, 0.0, 1, 0.0, 0, 0, 0, 0, 0), 1),
    ((45, 0.0, 30, 0.0, 0, 0.0, 0, 0, 0, 0, 0), 1),
    ((90, 0.0, 80, 0.0, 4, 1.0, 0, 0, 0, 0, 0), 1),
    ((28, 0.1, 70, 0.0, 3, 0.7, 0, 0, 0, 0, 0), 1),
    ((300, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 0, 0), 1),
    ((1, 0.0, 60, 0.0, 0, 0.0, 0, 0, 0, 0, 0), 0),
    ((7, 0.0, 5, 0.8, 2, 1.0, 0, 0, 0, 0, 0), 0),
    ((3, 1.0, 2, 1.0, 3, 1.0, 0, 0, 0, 0, 1), 0),
    ((5, 0.0, 4, 1.0, 3, 1.0, 0, 0, 0, 0, 0), 0),
    ((4, 0.0, 3, 0.0, 5, 0.0, 0, 0, 0, 0, 0), 0),
    ((6, 0.0, 9, 0.0, 0, 0.0, 0, 0, 0, 0, 0), 0),
    ((20, 0.8, 30, 0.0, 12, 0.9, 0, 0, 0, 0, 0), 0),
    ((40, 0.9, 10, 1.0, 30, 0.8, 0, 0, 0, 0, 0), 0),
    ((60, 0.0, 70, 0.0, 10, 0.0, 0, 0, 1, 0, 0), 0),
    ((8, 0.0, 60, 0.0, 4, 0.0, 0, 0, 1, 0, 0), 0),
    ((30, 0.0, 4, 1.0, 60, 0.0, 0, 0, 1, 0, 0), 0),
    ((7, 0.0, 60, 0.0, 70, 0.0, 0, 0, 1, 1, 0), 0),
    ((2, 1.0, 70, 0.0, 60, 0.0, 0, 0, 0, 0, 0), 0),
)


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8) -> tuple | int:
    """A decision tree by Gini impurity: ``(feature, threshold, low, high)`` or a class."""
    share = y.mean()
    if depth == 0 or share in (0.0, 1.0):
        return int(share >= 0.5)
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cut in (values[1:] + values[:-1]) / 2:
            low = x[:, f] <= cut
            impurity = sum(
                part.sum() * y[part].mean() * (1 - y[part].mean()) for part in (low, ~low)
            )
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, f, float(cut), low)
    if best is None:
        return int(share >= 0.5)
    _, f, cut, low = best
    return f, cut, grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1)


def train(table: tuple = LABELLED) -> tuple | int:
    """The tree for a labelled table of block features."""
    return grow(np.array([r for r, _ in table], float), np.array([label for _, label in table], float))


def decide(tree: tuple | int, x: np.ndarray) -> np.ndarray:
    """The tree's class of every row."""
    if isinstance(tree, int):
        return np.full(len(x), tree, bool)
    f, cut, low, high = tree
    return np.where(x[:, f] <= cut, decide(low, x), decide(high, x))


def main_text(page: str, tree: tuple | int) -> str:
    """The blocks that the tree takes for main text, one per line."""
    found = blocks(page)
    if not found:
        return ""
    chosen = decide(tree, features(found))
    return "\n".join(b.text for b, yes in zip(found, chosen) if yes)


def with_main_text(
    df: DataFrame, html_column: str = "html", name: str = "text", n_chars: str = "n_chars", table: tuple = LABELLED
) -> DataFrame:
    """``df`` with the main text of every page and its length in code points."""
    tree = train(table)

    def make():
        def step(pages):
            texts = [main_text(p, tree) for p in pages]
            return [texts, [len(t) for t in texts]]

        return step

    return map_text(df, html_column, f"`{name}` string, `{n_chars}` long", make)
