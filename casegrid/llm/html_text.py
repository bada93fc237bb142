"""Main text of web pages: flat text blocks classified by a decision tree.

A page is cut into blocks at block-level tags. Each block gets shallow features: its
word count and link density, those of its neighbours before and after, whether it is
a heading, a paragraph or list item, or a line of rights, whether the page marks it as main
content (inside ``article``, or, where the articles hold less than ``ARTICLE_SHARE`` of the marked
words, inside ``article``, ``main`` or an element named like one; unmarked page; outside the marked
part), and whether an enclosing element says what it is (a navigation, footer, aside or form
element, or a whole class word, id or role naming an advert, comment section and the like; words
such as discussion, related or notice only where the element holds links, or short text under such
a class). A decision tree fitted to the blocks of ``LABELLED`` keeps or drops it: what is named or
outside the marked part goes; in unmarked pages, and for lists of links in marked ones, the
neighbours decide. Where it keeps none of an unmarked page's, the unnamed ones of few links stay.
Kept blocks are joined by a newline.

Inside a block, character references are decoded and white space becomes one space;
``br`` counts as white space. Scripts, styles, comments and embedded objects never
enter a block.

Edge cases: null or empty html gives an empty text; broken markup is read on (an
unclosed element ends with its parent, an unclosed script with the page, a tag with an
unclosed quote at its next >); repeated pages give repeated rows; the whole of a long page is
read, in time that grows with its length at any nesting. Extra columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "heading", "prose", "rights", "main", "named")
_WORDS, _LINKS, _MAIN, _NAMED = FEATURES.index("words"), FEATURES.index("links"), FEATURES.index("main"), FEATURES.index("named")

# The blocks of labelled pages in order. A block is its kind (h heading, p paragraph or list item, c line of
# rights, d other), words, l and the share of linked words in percent, + main text or - not; ~ stands before blocks outside
# the marked content, ! before blocks named by an enclosing element.
LABELLED = """
unmarked h1+ p2+ p30+ p1+
unmarked d2l100- d2l100- d3l100- h6+ p5+ p70+ p45+ p120l5+ p22+ d2l100- d3l100- d8-
unmarked h2- d1l100- d1l100- h9+ p60+ h3+ p55+ p61+ p90l10+ p16l10+ p2l100- p3l100-
unmarked h4+ p45+ p9+ p40+ h2+ p38+ p3+
unmarked h3+ p33+ h1+ p4+
unmarked p30+ p50+ p7+
unmarked p44+ p4l100+ p52+ p28l25+ p33+ p9l100+ p40+
unmarked d5- d3- d4l100- d2l100- h4+ d60+ d45+ d8-
unmarked h3+ d45+ d70+ d20+ d2-
unmarked d3l100- d5- d4- d24l90- p30l80- d7- p60+ p70+ h3- p5l100- p6l100- p4l100- c8-
unmarked p3- p2l100- p3l100- h5+ p36+ p17+ p25+ p6+ c10-
unmarked h5+ d12+ d90+ d30+ d9+ d26+ d5+ d61+
unmarked p66+ d1- d2l100- d1l100-
unmarked p70+ p3- p4l100- p4l100- p3l100-
unmarked p50+ p8+ p4l100- p3l100- d6l50- d12l60-
unmarked p1l100- p1l100- p2- p1l100- h4+ p12+ p48+
unmarked h1+ p3+ p2+
unmarked h2+ p3+ p24+ p2+ p1+
unmarked p30l100- p12l100- d40l100- p11l100- p60+ p33+ p15l100- p20l100- d9l100- h12l100- d30l100-
unmarked p7l100- d25l100- p50+ p9l100- c8l100- d200l100- h5l100- d14l100- p300l100- p2l100-
unmarked d3l100- p40l30+ p2l100- p70l100- h2l100- h9l100- p80l20+ d2l100- d1l100- c3l100- p34+
unmarked d22l100- p3l100- p45+ d6l100- d5l100- p31+ h14l100- d7l100- h4+ p90+
unmarked p50+ p3l100+ p19+ p2l100+ p21+ p12l100+ p70+
unmarked !p12l100- p30+ !d4l100- p60+ !p90l100- p25+ !p2l100- d50+ !h5l100- !d9l100- p45+ !p40l80-
unmarked d70+ p200l100- d50l100- p30+ p13l100- h40l100- p100l100- d2l100- p60+ p5l100- d100l100- p300+
unmarked h4l100- p2l100- d6- d2l100- p8l100- d40+ p33+ d1l100- p2l100- d9l100- p51+
unmarked d3- d2- d4- d30+ d8+ d20+ d6+ d33+ d3- d2- d5-
unmarked d6- d1- d20+ d7+ d20+
unmarked d2- d1- d3- d40+ d1+ d50+ d2+ d31+ d3+ d20+ d1+ d19+ d2- d3-
unmarked p50+ c60+ p40+ c90+ p30+ c45l5+ p2l100- d3l100-
unmarked p2l100- p50l20+ p6l100- p5l100- p200+ d12l100- d30l100- p60l10+
unmarked p3+ p2+ p4+
unmarked d60+ c12-
unmarked h7+ p120+ c9- d2l100- d1l100-
unmarked h4- p2l100- p3l100- p2l100- h8+ p35+ p41+
unmarked p55l40+ p60+ p80l30+ h2- d3l100- d4l100-
unmarked p40+ p3+ p2+ p4+ p2+ p35+ p5+
unmarked d1l100- d2l100- d9- h12+ p6+ p88+ p3+ p27+ p2+
unmarked d4- d7l100- d6- p47+ d3- d5l100-
unmarked !p1l100- !d8- h5+ p29+ !p60- p31+ !h3- !p25l10- !p40- !c7-
unmarked !d2l100- !d3- p20+ p6+ !p120- !p9- !d30-
marked h9+ p60+ p45+ p80+ p2+ p1+ p12+ ~d9- ~c8-
marked p50+ h2+ p8l100+ p9l100+ p7l100+ p11l95+ ~d5- ~d2l100-
marked p50+ p4l100+ p48+ p18l55+ p66+ p2l100+ p30+
marked h3+ p2l100- p1l100- p2l100- p3l100- p40+ p90+ p70+ ~p80-
marked p60+ p2l100- p3l100- p2l100- ~h4- ~p30-
marked p80+ p3l100+ ~d3l100- ~d2l100-
marked ~h4- ~p30- ~d3- ~d1l100- h9+ p60+ p200l2+ p6+ ~d12- ~p80- ~p150- ~c9- ~d4l100-
marked ~d18l55- ~h7l100- ~d60- ~p5- d35l30+ d25+ d4+ c8+ p1+
marked h7l100+ p50+ h7l100+ p48+ d90l45+ d3+ ~h2- ~p35l30- ~p10-
marked p3+
marked d4+
marked d30+
marked d70+ ~d2-
marked c5+
marked d9+ d3+ d60+ d5+ d34+
marked p30+ d2+
marked d8+ d2+ d1+ c9+ d33+
marked d3+ p5l100+
marked d6+ d7l100+ d5+ d90+ d6l100+ p9l100+ d9+
marked p2+ p9l100+ d2+ p6+ ~d1l100- ~d1-
marked d1+ p8l100+ p9+ p8l100+ d40+ ~d70- ~p60-
marked p12l40+ d2l45+ ~p3l100-
marked d2l30+ c2l40+ p5l50+ d90l50+ p1l50+
marked c12+ ~c3- ~p200-
marked c30+ d12l100+ c40+ d5l100+
marked h1l100+ d2+ h2l100+
marked ~h60- ~d33- ~p9l100- ~p10l100- h20+ ~h1-
marked !h9- !p1- !d50- !p200l30- ~!h9- !c3-
unmarked !d40- !d200- !h30- p50+ !p90- !d70- !p5- p45+ !p1l50- !d9l100-
marked ~p70l100- ~d12l100- ~p300- ~h4l100- ~d2l100- ~d90- ~p5l100- ~p40- ~d200l100- ~h20- ~c2l100- ~p12l100-
marked p30+ !p4l100- p40+ !d12l100- p50+ !h6l100- p33+ !p90l100- d20+ !d3l100- !p7l100- !d80l100- p12+ !p2l100-
marked !d4l100- p9+ !p150l100- !p1l100- d60+ !c5l100- p70+ !p30l60- ~p9- ~d40l100-
marked p1l100+ p47+ ~p20l100- ~p40-
marked p18+ p1l100+ d1+ ~d7l100- ~p3-
marked p4+ c2l100+ p13+ p2l100+ p58+
marked p34+ p2l100+ ~d4-
marked p7+ p1l100+
marked p90+ p3l100- p1l100- p2l100- p50+ p6l100+ p7l100+ d30l100+ p5l100+ ~p2l100-
marked h2l100+ p30+ h4l100+ d9l100+ p2+ ~d5l100-
marked h1+ p1l100- p2l100- p17+ p3l100- p1l100- p2l100- d50+
marked d1l100- d3l100- h6+ p35+ d2l100- d2l100- d1l100-
marked p50+ ~p30- ~p4l100- ~p60- ~p9l100- ~d50- ~d5l100- ~p20- ~p1l100- ~p40- ~d2l100- ~d41- ~d90l100- ~p25-
marked p50+ !p30- !p4l100- !p60- !p9l100- !d50- !d5l100- !p20- !p1l100- !p40- !d2l100- !d41- !d90l100- !p25-
marked ~!p30- ~!p3l100- ~!p60- p20+ p5l100+ p30+ ~p70- ~h7l100- ~p33- ~d12l100- ~d21-
unmarked p50+ !p30- !p4l100- !p60- !p9l100- !d50- !d5l100- !p20- !p1l100- !p40- !d2l100- !d41- !d90l100- !p25-
marked p115l100+ d14l10+ p5l100+ d2+ p30l100+ d40l20+ h8l100+ d6l50+ p90l100+ c5+ p7l100+ d9l45+ p12l100+ d70+ ~d30l10-
marked d9l100+ d30l10+ d9l100+ d3l30+ d8l100+ d18+ d40l100+ d5l50+ d6l100+ d1+ d5l100+ p2+ p100l100+ p20+ p5l100+ d120l20+
marked p50+ c14+ p60+ c40+ d80+ c200l10+ d9+ p100+ c11l50+ p9l100+ c30+ p90+ c16+ ~c14-
marked h2+ d200+ d4l50+ d9+ h5+ p6l100+ ~p45- ~h9- ~d1-
marked ~!d2l100- h6+ p40+ !p30- !p120- p5+ !h5- !p60- !d3- p22+ !p3- ~!c10- ~!d8-
marked ~!p15- p70+ !d33- !p2l100- p8+ !h2- !p70- !d25l10-
"""

# Element names by their part in a page.
SKIPPED = frozenset("head script style noscript template svg iframe object canvas audio video select button textarea datalist".split())
RAW = frozenset("script style textarea title xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark math meter output q rp rt ruby s samp "
                   "small span strike strong sub sup time tt u var wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTENT = frozenset("article main".split())
# Class, id or role words that together (first with second) or alone name the content.
CONTENT_OF, CONTENT_PART, CONTENT_IDS = frozenset("article entry post main story page".split()), frozenset("body content text".split()), frozenset("content main article maincontent".split())
NAMED_TAGS = frozenset("nav footer aside form menu dialog".split())
# Class words, ids and roles that name what is not main text, alone or in a compound of names and PAGE_PARTS only.
NAMES = frozenset("ad ads adv advert adverts advertisement advertising adbox adslot banner sponsor sponsored promo promotion nav navbar navigation "
                  "menu menubar breadcrumb breadcrumbs footer sidebar aside complementary contentinfo widget widgets cookie cookies consent gdpr "
                  "alert popup modal overlay dialog comment comments disqus replies reply respond newsletter subscribe "
                  "subscription signup login pagination pager toolbar skip hidden".split())
# Names that head main text as well; the words and links under them decide.
AMBIGUOUS = frozenset("discussion notice notices related recommended search sharing share social".split())
# Names that are ambiguous as the id of a part of a text (TEXT_PARTS).
TOPICS = frozenset("advert adverts advertisement advertising banner sponsor promotion navigation menu breadcrumb widget widgets cookie cookies consent "
                   "gdpr alert dialog modal overlay reply replies subscription signup login newsletter pagination toolbar hidden".split())
TEXT_PARTS = frozenset("section p ul ol li dl dt dd table tr td th figure blockquote pre".split())
# Tags whose text is running text or an item of it.
PROSE = frozenset("p blockquote pre li dt dd figcaption".split()) | HEADINGS
# Tags that end an open one of their own kind (and a paragraph) up to the next of SCOPES.
ENDING = frozenset("p li td th tr dt dd option".split()) | HEADINGS
SCOPES = frozenset("ul ol table dl div section body article main td th li".split())
TOP_NAMES = frozenset("header masthead topbar".split())
# Words that say where or what an element of a page is, in compounds with the names above (cookie-bar, post-comments).
PAGE_PARTS = frozenset("area article articles author bar block body bottom box button buttons container content count desktop entry fb fixed form "
                       "global google icon icons inline inner item items js label leaderboard left link links list main meta mobile module news "
                       "outer page panel post posts primary right secondary section site slot sticky stories text thread title toggle top unit "
                       "wp wrap wrapper".split())
# Words that make an element named by an ambiguous class running text.
RUNNING_WORDS = 12

ARTICLE_SHARE = 0.4

_START = re.compile(r"<(?:(!--)|/?([a-zA-Z])|[!?/])")
_COMMENT = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))", re.S)
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>")
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_RIGHTS = re.compile(r"\s*(?:©|\(c\)|copyright\b)|.*\ball rights reserved\b", re.I | re.S)
_HREF = re.compile(r"\bhref\b", re.I)
_LABEL = re.compile(r"(~?)(!?)([hpcd])(\d+)(?:l(\d+))?([+-])")
_ATTRIBUTE = re.compile(r"\b(class|id|role|style|aria-hidden|hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@dataclass
class _Element:
    tag: str
    named: bool = False         # says itself that it is not main text
    by_class: bool = False      # ... by a class, id or role only
    maybe_class: bool = False   # ... by an ambiguous class, if it holds no running text
    maybe_id: bool = False      # ... by an ambiguous id, if it holds links
    top: bool = False           # a page header
    content: bool = False
    up: _Element | None = None  # the element around it


@dataclass
class _Part:
    """What holds for the blocks of an element by it and all around it."""

    named: bool = False
    top: bool = False
    content: bool = False
    unfit: bool = False         # in content that a class names as something else
    article: bool = False
    words: int = 0              # of all blocks below it
    linked: float = 0.0
    running: bool = False       # one of them is running text


@dataclass
class Block:
    text: str
    words: int
    links: float
    heading: bool
    prose: bool
    inside: _Element | None     # the innermost


def _compound(token: str, names: frozenset[str]) -> bool:
    """Whether the token is one of the names, or a compound of them and of parts of a page."""
    parts = [p for p in map(str.lower, _NAME_PARTS.findall(token)) if len(p) > 1]
    return any(p in names for p in parts) and all(p in names or p in PAGE_PARTS for p in parts)


def _name(e: _Element, key: str, token: str) -> None:
    """Note what a class word, id or role says of its element; a heading's id is its anchor."""
    if key == "id" and e.tag in HEADINGS:
        return
    if key == "role":
        e.by_class |= token.lower() in NAMES | {"search"}
    elif key == "id" and e.tag in TEXT_PARTS and token.lower() in TOPICS:
        e.maybe_id = True
    elif _compound(token, NAMES | AMBIGUOUS):
        if not _compound(token, AMBIGUOUS):
            e.by_class = True
        elif key == "id":
            e.maybe_id = True
        else:
            e.maybe_class = True
    e.top |= _compound(token, TOP_NAMES)


def _element(tag: str, attributes: str) -> _Element:
    e = _Element(tag, named=tag in NAMED_TAGS, top=tag == "header", content=tag in CONTENT)
    if attributes and tag not in ("html", "body", "main"):
        for key, *values in _ATTRIBUTE.findall(attributes):
            key, value = key.lower(), "".join(values)
            if key in ("class", "id", "role"):
                parts = {p.lower() for p in _NAME_PARTS.findall(value)}
                e.content |= bool(parts & CONTENT_OF and parts & CONTENT_PART) or (key != "class" and value.lower() in CONTENT_IDS)
                for token in value.split():
                    _name(e, key, token)
            elif key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and _HIDING.search(value)):
                e.named = True
    return e


class _Open:
    """The open elements of a page; each is entered and left once, and found in few steps."""

    def __init__(self) -> None:
        self.stack: list[_Element] = []
        self.ends: list[int] = []           # places of those in ENDING or SCOPES
        self.count: dict[str, int] = {}
        self.link: _Element | None = None
        self.all: list[_Element] = []

    def leave(self, depth: int) -> None:
        while len(self.stack) > depth:
            e = self.stack.pop()
            self.count[e.tag] -= 1
            if self.ends and self.ends[-1] == len(self.stack):
                self.ends.pop()
            if e is self.link:
                self.link = None

    def close(self, tag: str) -> None:
        if self.count.get(tag):
            depth = len(self.stack) - 1
            while self.stack[depth].tag != tag:
                depth -= 1
            self.leave(depth)

    def end_before(self, tag: str) -> None:
        """Leave what the tag's opening ends: at most one of each kind is open up to a scope."""
        for i in reversed(self.ends):
            if self.stack[i].tag in (tag, "p"):
                self.leave(i)
                return
            if self.stack[i].tag in SCOPES:
                return

    def end_link(self) -> None:
        """A link ends where the next begins; what it holds goes on."""
        if self.link is not None:
            if self.stack[-1] is self.link:
                self.leave(len(self.stack) - 1)
            else:
                self.count["a"] -= 1
                self.count[""] = self.count.get("", 0) + 1
                self.link.tag, self.link.named, self.link.by_class, self.link.maybe_class, self.link.maybe_id = "", False, False, False, False
                self.link = None

    def enter(self, e: _Element) -> None:
        e.up = self.stack[-1] if self.stack else None
        if e.tag in ENDING or e.tag in SCOPES:
            self.ends.append(len(self.stack))
        self.count[e.tag] = self.count.get(e.tag, 0) + 1
        self.stack.append(e)
        self.all.append(e)


def blocks(page: str) -> tuple[list[Block], list[_Element]]:
    """The page's flat text blocks and its elements, both in page order."""
    out: list[Block] = []
    tree = _Open()
    parts: list[str] = []
    linked = total = at = skip = 0
    seen: set[str] = set()
    skipping: str | None = None
    quoted, last, end = True, page.rfind(">"), len(page)

    def flush() -> None:
        nonlocal parts, linked, total
        if total:
            text = " ".join("".join(parts).split())
            if text:
                inner = tree.stack[-1] if tree.stack else None
                kind = inner
                while kind is not None and kind.tag in INLINE | {""}:
                    kind = kind.up
                heading = any(tree.count.get(h) for h in HEADINGS)
                out.append(Block(text, text.count(" ") + 1, min(1.0, linked / total), heading, heading or (kind is not None and kind.tag in PROSE), inner))
        parts, linked, total = [], 0, 0

    def take(raw: str) -> None:
        nonlocal linked, total
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            parts.append(text)
            n = len(text) - text.count(" ")
            total += n
            if tree.link is not None:
                linked += n

    while at < end:
        start = _START.search(page, at)
        if start is None or (start.start() > last and not start[1]):
            if skipping is None:
                take(page[at:])
            break
        if skipping is None:
            take(page[at:start.start()])
        if not start[2]:
            at = _COMMENT.match(page, start.start()).end() if start[1] else page.index(">", start.start()) + 1
            continue
        m = _TAG.match(page, start.start()) if quoted else None
        if m is None:                       # an unclosed quote: from here on, quotes mean nothing
            quoted = False
            m = _PLAIN_TAG.match(page, start.start())
        at = m.end()
        tag, closing = m[2].lower(), bool(m[1])
        if skipping is not None:
            if tag == skipping:
                skip += -1 if closing else 1
                if skip == 0:
                    skipping = None
            elif skipping == "head" and not closing and tag == "body":
                skipping = None             # an unclosed head
            if not closing and tag in RAW and skipping is not None:
                at = _after_raw(page, at, tag)
                if tag == skipping:
                    skip, skipping = 0, None
            continue
        if not closing and tag in SKIPPED | RAW:
            if tag in RAW:
                at = _after_raw(page, at, tag)
            elif not (m[3] or "").rstrip().endswith("/"):
                skipping, skip = tag, 1
            if tag not in INLINE:
                flush() if tag not in ("script", "style") else None
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag not in INLINE:
            flush()
        if closing:
            tree.close(tag)
        elif tag not in VOID:
            if tag == "a":
                tree.end_link()
            elif tag in ENDING:
                tree.end_before(tag)
            target = tag == "a" and _HREF.search(m[3]) is not None
            e = _element(tag, m[3]) if tag != "a" or target else _Element(tag)      # an anchor holds nothing
            if tag in CONTENT and not e.by_class and tag not in seen:
                seen.add(tag)
                for outer in tree.stack:    # a wrapper of the content is not what its class names
                    outer.by_class = outer.maybe_class = outer.maybe_id = False
            tree.enter(e)
            if target:
                tree.link = e
    flush()
    return out, tree.all


def _after_raw(page: str, at: int, tag: str) -> int:
    m = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
    return m.end() if m else len(page)


def _parts(found: list[Block], elements: list[_Element]) -> dict[int, _Part]:
    """What holds in each element (by its identity). Elements with an ambiguous name are named if
    half of their words are links, or if a class named them and they hold no running text."""
    parts = {id(e): _Part() for e in elements}
    for b in found:
        if b.inside is not None:
            p = parts[id(b.inside)]
            p.words, p.linked, p.running = p.words + b.words, p.linked + b.words * b.links, p.running or (b.words >= RUNNING_WORDS and b.links < 0.5)
    for e in reversed(elements):            # elements stand after those around them
        p = parts[id(e)]
        if (e.maybe_class or e.maybe_id) and not e.by_class and p.words:
            e.by_class = p.linked >= 0.5 * p.words or (e.maybe_class and not p.running)
        if e.up is not None:
            up = parts[id(e.up)]
            up.words, up.linked, up.running = up.words + p.words, up.linked + p.linked, up.running or p.running
    for e in elements:
        p, up = parts[id(e)], parts[id(e.up)] if e.up is not None else _Part()
        p.named, p.top = up.named or e.named or e.by_class, up.top or e.top
        p.content, p.unfit = up.content or e.content, up.unfit or (e.content and e.by_class)
        p.article = up.article or e.tag == "article"
    return parts


def _neighbours(rows: np.ndarray) -> np.ndarray:
    """Fill the features of the blocks before and after; beyond the page there are no words."""
    for to, of in (("words", _WORDS), ("links", _LINKS)):
        rows[1:, FEATURES.index(f"{to}_before")] = rows[:-1, of]
        rows[:-1, FEATURES.index(f"{to}_after")] = rows[1:, of]
    return rows


def features(found: list[Block], elements: list[_Element]) -> np.ndarray:
    """One row of FEATURES per block."""
    parts, nothing = _parts(found, elements), _Part()
    held = [parts[id(b.inside)] if b.inside is not None else nothing for b in found]
    named = np.array([p.named for p in held], bool)
    content = np.array([p.content and not p.unfit for p in held], bool)
    article = content & np.array([p.article for p in held], bool)
    words = np.array([b.words for b in found]) * ~named
    marked = article if words[article].sum() >= ARTICLE_SHARE * words[content].sum() and article.any() else content
    rows = np.zeros((len(found), len(FEATURES)))
    for i, (b, p) in enumerate(zip(found, held, strict=True)):
        top = p.top and not (marked[i] and b.heading)
        rows[i, [_WORDS, _LINKS]] = b.words, b.links
        rows[i, -5:] = b.heading, b.prose, _RIGHTS.match(b.text[:400]) is not None, 2 if marked[i] else 0 if marked.any() else 1, named[i] or top
    return _neighbours(rows)


@dataclass
class Tree:
    """A binary decision tree: inner nodes have a feature and a cut (below it: left)."""

    share: float
    feature: int = -1
    cut: float = 0.0
    left: Tree | None = None
    right: Tree | None = None

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.left is None or self.right is None:
            return np.full(len(x), self.share)
        below = x[:, self.feature] < self.cut
        out = np.empty(len(x))
        out[below], out[~below] = self.left.predict(x[below]), self.right.predict(x[~below])
        return out


def fit(x: np.ndarray, y: np.ndarray, depth: int = 12) -> Tree:
    """A tree by least Gini impurity; ties go to the first feature and the lowest cut."""
    node = Tree(float(y.mean()))
    if depth == 0 or node.share in (0.0, 1.0):
        return node
    best = len(y) * 2 * node.share * (1 - node.share) - 1e-9
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cut in (values[1:] + values[:-1]) / 2:
            below = x[:, f] < cut
            p, q = y[below].mean(), y[~below].mean()
            impurity = 2 * (below.sum() * p * (1 - p) + (~below).sum() * q * (1 - q))
            if impurity < best:
                best, node.feature, node.cut = impurity, f, float(cut)
    if node.feature >= 0:
        below = x[:, node.feature] < node.cut
        node.left, node.right = fit(x[below], y[below], depth - 1), fit(x[~below], y[~below], depth - 1)
    return node


def labelled_blocks() -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the blocks of LABELLED. The kinds c and d stand for paragraphs, too, where the line's rights or
    names decide; each page also stands as a named part of another page and as one outside the marked content: all not main text."""
    x, y = [], []
    for line in LABELLED.strip().splitlines():
        mark, *cells = line.split()
        found = [_LABEL.fullmatch(cell).groups() for cell in cells]
        for prose, away, part in ((0, 0, 0), (1, 0, 0), (0, 0, 1), (0, 1, 0), (0, 1, 1)):
            rows = np.zeros((len(cells), len(FEATURES)))
            for i, (outside, name, kind, words, links, label) in enumerate(found):
                rows[i, [_WORDS, _LINKS]] = int(words), int(links or 0) / 100
                main = 0 if outside or away else 2 if mark == "marked" else 1
                rows[i, -5:] = kind == "h", kind in "hp" or (kind == "c" and prose), kind == "c", main, bool(name or part)
                y.append(label == "+" and not away and not part)
            x.append(_neighbours(rows))
    return np.concatenate(x), np.array(y, float)


def labelled_tree() -> Tree:
    return fit(*labelled_blocks())


def main_text(page: str | None, tree: Tree) -> str:
    found, elements = blocks(page) if page else ([], [])
    if not found:
        return ""
    x = features(found, elements)
    kept = tree.predict(x) >= 0.5
    if not kept.any():                  # a page of short blocks only
        kept = (x[:, _MAIN] == 1) & (x[:, _NAMED] == 0) & (x[:, _LINKS] < 0.5)
    return "\n".join(b.text for b, k in zip(found, kept, strict=True) if k)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) per row of ``pages`` (page_id, url, html)."""
    tree = labelled_tree()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            text = [main_text(p, tree) for p in pdf["html"]]
            yield pd.DataFrame({"page_id": pdf["page_id"].array, "url": pdf["url"].array, "text": text, "n_chars": [len(t) for t in text]})

    return (pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
            .mapInPandas(run, "page_id long, url string, text string, n_chars long"))
