"""HTML extraction: flat text blocks, judged by a decision tree over their and their neighbours' shallow features."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Elements that end a block where they begin and end; elements whose content is no text of the page.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
SILENT_TAGS = frozenset("script style noscript template svg math textarea select button label legend object iframe canvas audio video head title".split())
#: What a reader fills in.
FIELD_TAGS = frozenset("input textarea select button".split())
#: Elements whose text is written in sentences.
PARAGRAPH_TAGS = frozenset("p blockquote dd figcaption".split())
RAW_TAGS = frozenset("script style textarea title noscript iframe".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSED_BY_BLOCKS = frozenset("p li dt dd tr td th option".split())

#: Where a block stands: in the article, nowhere known, or in what surrounds articles.
IN_ARTICLE, PLAIN, AROUND = 0, 1, 2
#: Kept on the stack inside forms and elements of a weak name, until all of them is seen.
HELD = 1.5
ARTICLE_TAGS = frozenset(["article", "main"])
AROUND_TAGS = frozenset("nav header footer aside menu dialog".split())
#: A form with fewer words than this for each of its fields isn't what a page is wrapped in.
FIELD_WORDS = 20
#: Kept on the stack for surroundings that hold articles of their own, as comments and teasers; FIRM counts as AROUND. In other surroundings an <article> is the page's.
FIRM = 3
FIRM_TAGS = AROUND_TAGS - {"dialog"}
#: A class or id names surroundings if each part of it is one of these words, or a neutral one beside them.
_FIRM_NAME = frozenset("discussion discussions thread threads kommentar kommentare commentaire commentaires comentario comentarios seitenleiste related recommend recommended recommendation recommendations comment comments commentlist reply replies respond disqus nav navbar navigation footer sidebar".split())
_AROUND_NAME = _FIRM_NAME | frozenset(
    "paywall werbung anzeige anzeigen publicite publicidad anuncio anuncios hinweis hinweise avis aviso avisos fusszeile fußzeile kopfzeile ad ads adv advert adverts advertisement advertisements advertising banner banners sponsor sponsors sponsored promo promos cookie cookies consent gdpr notice notices alert alerts popup popups modal overlay subscribe subscription signup login menu menus breadcrumb breadcrumbs pager pagination share shares sharing foot copyright masthead siteheader pageheader topbar toolbar skip skiplink".split()
)
#: Names that articles have too: what they mark is surroundings if it has a field or no sentences.
_WEAK_NAME = frozenset("newsletter newsletters widget widgets social legal search searchbar suche recherche buscar tag tags tagcloud".split())
_NEUTRAL_NAME = frozenset("slot content unit text main site page primary secondary top bottom left right global list box bar side cloud links link area section block wrapper container wrap inner items item posts articles buttons icons form header media post article entry".split())
#: A class or id made of these alone says that the element holds an article: weaker names beside it mark nothing.
_ARTICLE_NAME = frozenset("article content story post entry articlebody maincontent".split())
_ARTICLE_BESIDE = frozenset("main page site body text inner single wrapper container".split())
_PART = re.compile(r"[A-Z]?[^\W\d_A-Z]+|[A-Z]+|\d+")
_AROUND_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())

_TAG_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STOP = re.compile(r"[>\"']")
_NAMES = re.compile(r"(?<![\w-])(?:class|id)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_ROLE = re.compile(r"(?<![\w-])role\s*=\s*[\"']?([\w-]+)", re.I)
_HIDDEN = re.compile(r"type\s*=\s*[\"']?hidden", re.I)
#: What ends a sentence, and what may follow it.
_STOPS = (".", "!", "?", "…", ":", ";", "。", "！", "？", "۔", "؟", "।")
_CLOSING = "\"'”’»«)]} "
#: What a block begins with if it says whose the page is; outside articles only.
_COPYRIGHT = re.compile(r"all rights reserved\b|alle rechte vorbehalten\b|tous droits réservés\b|todos los derechos reservados\b|(?:copyright\s*)?(?:©|\(c\)\s*(?=\d{4}\b))|copyright\s+\d{4}\b", re.I)


@dataclass
class Block:
    text: str
    words: int
    linked: int
    place: int
    heading: bool
    said: bool = False
    within: Container | None = None

    @property
    def density(self) -> float:
        """Share of the words that are in links."""
        return self.linked / self.words if self.words else 0.0


@dataclass
class Container:
    """A form, or an element of a weak name: what is in it tells whether it is surroundings."""

    is_form: bool
    outside: float
    outer: Container | None
    fields: int = 0
    words: int = 0
    titled: bool = False

    def place(self, block: Block, words: int) -> int:
        """Where a block in it stands, in a page of so many words that aren't in surroundings."""
        around = self.fields > 0 or not block.said or block.density > 0.5
        if self.is_form:
            around = not self.titled and (2 * self.words < words or self.words < FIELD_WORDS * self.fields)
        if around:
            return AROUND
        return self.outer.place(block, words) if self.outside == HELD else int(self.outside)


def _named(value: str) -> float:
    """FIRM or AROUND if one of the names in a class or id is that of surroundings, HELD if it may be, PLAIN otherwise."""
    found = PLAIN
    holds_article = False
    for name in value.split():
        parts = {x.lower() for x in _PART.findall(name) if not x.isdigit()}
        holds_article |= bool(parts & _ARTICLE_NAME) and parts <= _ARTICLE_NAME | _ARTICLE_BESIDE
        if parts & _AROUND_NAME or parts == {"side", "bar"} or parts in ({"site", "header"}, {"page", "header"}):
            if parts <= _AROUND_NAME | _NEUTRAL_NAME | _WEAK_NAME:
                found = max(found, FIRM if parts & _FIRM_NAME else AROUND)
        elif parts & _WEAK_NAME and parts <= _WEAK_NAME | _NEUTRAL_NAME:
            found = max(found, HELD)
    return PLAIN if holds_article and found in (AROUND, HELD) else found


def _place_of(tag: str, attributes: str, now: float) -> float:
    """The place inside an element, from where it stands.

    Names and roles never mark <article>, <main> or <body>. <main> is the
    article wherever it stands, and <article> is unless it stands in FIRM
    surroundings, so a marked wrapper doesn't take the article with it. HELD
    says that a form or an element of a weak name begins, or goes on.
    """
    if tag in ARTICLE_TAGS:
        return IN_ARTICLE if tag == "main" or now != FIRM else now
    if tag in AROUND_TAGS and not (tag == "header" and now == IN_ARTICLE):
        return max(FIRM if tag in FIRM_TAGS else AROUND, now)
    if tag == "form":
        return max(HELD, now)
    if attributes and tag not in ("body", "html"):
        place = max((_named(m[1].strip("\"'")) for m in _NAMES.finditer(attributes)), default=PLAIN)
        if (role := _ROLE.search(attributes)) and role[1].lower() in _AROUND_ROLE:
            place = max(place, AROUND)
        if place != PLAIN:
            return max(place, now)
    return now


def _weak(attributes: str) -> bool:
    return any(_named(m[1].strip("\"'")) == HELD for m in _NAMES.finditer(attributes))


class Cursor:
    """Finds the ends of tags in one pass over a page, however they are broken."""

    def __init__(self, page: str) -> None:
        self.page = page
        self.none_after = {'"': len(page), "'": len(page)}

    def tag_end(self, at: int) -> int:
        """Where the tag whose name ends at at has its >, or -1 if there is none.

        As in browsers a quotation mark opens a value right after = only; one
        that nothing closes is a character like any other, so no text is lost.
        """
        page = self.page
        while m := _STOP.search(page, at):
            at = m.end()
            if m[0] == ">":
                return m.start()
            before = m.start() - 1
            while page[before].isspace():
                before -= 1
            if page[before] == "=" and at < self.none_after[m[0]]:
                close = page.find(m[0], at)
                if close < 0:
                    self.none_after[m[0]] = at
                else:
                    at = close + 1
        return -1


class Open:
    """The open elements: each with the place inside it, found by name or as the innermost block in constant time."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, float, Container | None]] = []
        self.at: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.links = self.silent = 0

    def place(self) -> float:
        return self.stack[-1][1] if self.stack else PLAIN

    def within(self) -> Container | None:
        return self.stack[-1][2] if self.stack else None

    def push(self, tag: str, place: float, within: Container | None) -> None:
        self.at.setdefault(tag, []).append(len(self.stack))
        if tag in BLOCK_TAGS:
            self.blocks.append(len(self.stack))
        self.stack.append((tag, place, within))
        self.links += tag == "a"
        self.silent += tag in SILENT_TAGS

    def pop(self, to: int) -> None:
        while len(self.stack) > to:
            tag = self.stack.pop()[0]
            self.at[tag].pop()
            if tag in BLOCK_TAGS:
                self.blocks.pop()
            self.links -= tag == "a"
            self.silent -= tag in SILENT_TAGS

    def close(self, tag: str) -> None:
        """Closes the innermost such element with all inside it; one that isn't a block only within the innermost block."""
        if self.at.get(tag) and (tag in BLOCK_TAGS or not self.blocks or self.at[tag][-1] > self.blocks[-1]):
            self.pop(self.at[tag][-1])

    def make_room(self, tag: str) -> None:
        """A block closes an open paragraph, and an item, row or cell its like, if that is the innermost block."""
        if self.blocks and tag not in ("body", "html") and self.stack[self.blocks[-1]][0] == (tag if tag in CLOSED_BY_BLOCKS else "p"):
            self.pop(self.blocks[-1])


def flat_blocks(page: str | None) -> list[Block]:
    """The page's text in order, cut where block elements begin or end, with white space inside made one space.

    Unclosed and stray tags are taken as browsers do for the cases that matter
    here: a block element closes an open paragraph or item, an end tag closes
    what is open inside its element, or nothing if there is no such element. A
    < that starts no tag, or one that never ends, is text. Time is linear in the
    page's length, whatever is in it.
    """
    if not page:
        return []
    out: list[Block] = []
    parts: list[str] = []
    linked: list[str] = []
    cursor, now = Cursor(page), Open()
    heading = False

    def end_block() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                inside = " ".join(html.unescape("".join(linked)).split())
                place = min(now.place(), AROUND)
                if place in (PLAIN, HELD) and _COPYRIGHT.match(text):
                    place = AROUND
                paragraph = bool(now.blocks) and now.stack[now.blocks[-1]][0] in PARAGRAPH_TAGS
                block = Block(text, len(text.split()), len(inside.split()), place, heading, paragraph and text.rstrip(_CLOSING).endswith(_STOPS), now.within() if place == HELD else None)
                out.append(block)
                held = block.within
                while held:
                    held.words += block.words
                    held = held.outer if held.outside == HELD else None
            parts.clear()
            linked.clear()

    def say(text: str) -> None:
        if text and not now.silent:
            parts.append(text)
            if now.links:
                linked.append(text)

    at, end, last = 0, len(page), page.rfind(">")
    while at < end:
        open_at = page.find("<", at)
        if open_at < 0:
            say(page[at:])
            break
        say(page[at:open_at])
        at = open_at + 1
        if page.startswith("!--", at):
            close = page.find("-->", at + 1)
            at = end if close < 0 else close + 3
            continue
        ends = page.startswith("/", at)
        name = _TAG_NAME.match(page, at + ends)
        if not name:
            if page[at : at + 1] in ("!", "?", "/") and at <= last:
                at = page.find(">", at) + 1
            else:
                say("<")
            continue
        close = cursor.tag_end(name.end())
        if close < 0:
            say(page[open_at:])
            break
        attributes, at = page[name.end() : close], close + 1
        tag = name[0].lower()
        if ends:
            if tag in BLOCK_TAGS:
                end_block()
                heading = False
            now.close(tag)
            continue
        if tag in BLOCK_TAGS:
            end_block()
            heading = tag in ("h1", "h2", "h3", "h4", "h5", "h6")
            now.make_room(tag)
        elif tag in ("br", "img"):
            say(" ")
        held = now.within()
        if held and (tag == "h1" or (tag in FIELD_TAGS and not _HIDDEN.search(attributes))):
            while held:
                held.fields += tag != "h1"
                held.titled |= tag == "h1" and now.place() == HELD
                held = held.outer
        if tag in VOID_TAGS or attributes.rstrip().endswith("/"):
            continue
        before, within = now.place(), now.within()
        place = _place_of(tag, attributes, before)
        if place == HELD and (tag == "form" or before != HELD or _weak(attributes)):
            within = Container(tag == "form", before, within if before == HELD else None)
        now.push(tag, place, within)
        if tag in RAW_TAGS:
            found = re.compile(rf"</{re.escape(tag)}\b", re.I).search(page, at)
            at = found.start() if found else end
    end_block()
    words = sum(b.words for b in out if b.place != AROUND)
    for b in out:
        if b.place == HELD:
            b.place = b.within.place(b, words)
    return out


#: The labelled table of blocks that aren't sentences of a paragraph: words, link density, words and density of the block before and of the one after, place, heading; 1 for article text.
BLOCKS = [
    # In the article: everything, lists of links too.
    (120, 0.00, 80, 0.00, 95, 0.00, 0, 0, 1), (45, 0.02, 120, 0.00, 60, 0.00, 0, 0, 1), (30, 0.20, 44, 0.00, 51, 0.01, 0, 0, 1), (200, 0.05, 10, 0.00, 12, 0.00, 0, 0, 1),
    (1, 0.00, 60, 0.00, 40, 0.00, 0, 0, 1), (3, 0.00, 2, 0.00, 30, 0.00, 0, 0, 1), (5, 0.00, 90, 0.00, 4, 0.00, 0, 0, 1), (7, 0.00, 3, 0.00, 2, 0.00, 0, 0, 1),
    (12, 0.00, 0, 0.00, 0, 0.00, 0, 0, 1), (4, 0.00, 1, 1.00, 2, 1.00, 0, 0, 1), (9, 0.00, 9, 0.00, 3, 1.00, 0, 0, 1), (2, 0.00, 1, 1.00, 1, 1.00, 0, 0, 1),
    (6, 0.00, 110, 0.00, 0, 0.00, 0, 0, 1), (8, 0.00, 1, 1.00, 70, 0.00, 0, 1, 1), (5, 0.00, 6, 0.00, 2, 0.00, 0, 1, 1), (15, 0.45, 70, 0.00, 65, 0.00, 0, 0, 1),
    (10, 0.40, 3, 0.00, 4, 0.00, 0, 0, 1), (3, 0.33, 20, 0.00, 2, 0.00, 0, 0, 1), (6, 0.50, 30, 0.00, 25, 0.05, 0, 0, 1), (22, 0.48, 1, 1.00, 40, 0.00, 0, 0, 1),
    (6, 1.00, 45, 0.00, 60, 0.00, 0, 0, 1), (12, 0.90, 30, 0.00, 25, 0.00, 0, 0, 1), (3, 1.00, 80, 0.00, 14, 0.10, 0, 0, 1), (7, 1.00, 1, 1.00, 50, 0.00, 0, 1, 1),
    (9, 1.00, 2, 1.00, 1, 1.00, 0, 1, 1), (4, 0.75, 33, 0.00, 9, 0.00, 0, 0, 1), (5, 1.00, 18, 0.05, 27, 0.00, 0, 0, 1), (2, 1.00, 66, 0.00, 41, 0.00, 0, 0, 1),
    (4, 1.00, 40, 0.00, 5, 1.00, 0, 0, 1), (3, 1.00, 3, 1.00, 2, 1.00, 0, 0, 1), (6, 0.90, 80, 0.00, 4, 1.00, 0, 0, 1), (1, 1.00, 1, 1.00, 60, 0.00, 0, 0, 1),
    (2, 1.00, 2, 1.00, 30, 0.00, 0, 0, 1), (8, 1.00, 7, 1.00, 6, 1.00, 0, 0, 1), (5, 0.80, 4, 0.90, 12, 0.00, 0, 0, 1), (4, 1.00, 25, 0.00, 3, 0.90, 0, 0, 1),
    (8, 0.00, 20, 0.00, 6, 0.60, 0, 0, 1), (3, 0.00, 1, 1.00, 5, 0.50, 0, 0, 1), (2, 0.00, 4, 0.60, 3, 0.80, 0, 0, 1), (14, 0.10, 2, 0.70, 9, 0.90, 0, 0, 1),
    (3, 1.00, 4, 0.00, 9, 0.00, 0, 0, 1), (5, 1.00, 2, 0.00, 3, 0.10, 0, 0, 1), (2, 1.00, 14, 1.00, 30, 0.00, 0, 0, 1), (9, 1.00, 30, 0.90, 8, 0.00, 0, 0, 1),
    (2, 1.00, 2, 0.00, 2, 0.00, 0, 0, 1), (9, 1.00, 9, 0.00, 2, 0.00, 0, 0, 1), (2, 1.00, 40, 0.00, 9, 0.00, 0, 0, 1), (9, 1.00, 2, 0.00, 40, 0.00, 0, 0, 1),
    (2, 0.60, 9, 0.00, 40, 0.20, 0, 0, 1), (9, 1.00, 0, 0.00, 40, 0.00, 0, 0, 1), (9, 1.00, 40, 0.20, 0, 0.00, 0, 0, 1), (2, 1.00, 1, 0.00, 1, 0.00, 0, 0, 1),
    (9, 1.00, 2, 1.00, 9, 0.00, 0, 0, 1), (2, 1.00, 9, 0.70, 2, 0.00, 0, 0, 1), (9, 1.00, 40, 1.00, 9, 0.00, 0, 0, 1), (2, 0.60, 2, 0.00, 9, 1.00, 0, 0, 1),
    (9, 1.00, 9, 0.00, 40, 1.00, 0, 0, 1), (2, 1.00, 40, 0.00, 9, 0.60, 0, 0, 1), (9, 0.70, 40, 0.00, 12, 1.00, 0, 0, 1), (2, 1.00, 9, 0.00, 2, 1.00, 0, 0, 1),
    (9, 1.00, 2, 0.00, 2, 1.00, 0, 0, 1), (2, 1.00, 9, 1.00, 12, 0.70, 0, 0, 1), (9, 1.00, 12, 1.00, 40, 1.00, 0, 0, 1), (2, 1.00, 40, 1.00, 40, 0.00, 0, 0, 1),
    (6, 0.60, 4, 0.70, 20, 0.00, 0, 0, 1), (4, 0.60, 30, 1.00, 12, 0.00, 0, 0, 1), (8, 0.55, 9, 0.60, 3, 0.00, 0, 0, 1), (2, 0.60, 1, 0.60, 1, 0.00, 0, 0, 1),
    # Nowhere known: text of some length; short blocks that text stands beside, whatever its length; links that stand alone between text; not what is short among links, nor lists of links.
    (80, 0.00, 60, 0.00, 75, 0.02, 1, 0, 1), (40, 0.05, 35, 0.00, 50, 0.00, 1, 0, 1), (25, 0.00, 50, 0.00, 40, 0.00, 1, 0, 1), (150, 0.00, 2, 1.00, 3, 1.00, 1, 0, 1),
    (18, 0.00, 40, 0.00, 60, 0.00, 1, 0, 1), (11, 0.00, 30, 0.00, 33, 0.00, 1, 0, 1), (22, 0.00, 1, 1.00, 2, 1.00, 1, 0, 1), (16, 0.00, 3, 1.00, 2, 1.00, 1, 0, 1),
    (9, 0.00, 3, 1.00, 90, 0.00, 1, 1, 1), (6, 0.00, 50, 0.00, 45, 0.00, 1, 1, 1), (3, 0.00, 60, 0.00, 0, 0.00, 1, 0, 1), (4, 0.00, 45, 0.00, 2, 1.00, 1, 0, 1),
    (5, 0.00, 6, 0.00, 7, 0.00, 1, 0, 1), (8, 0.00, 4, 0.00, 30, 0.00, 1, 0, 1), (2, 0.00, 1, 1.00, 55, 0.00, 1, 0, 1), (7, 0.00, 5, 0.00, 3, 1.00, 1, 0, 1),
    (30, 0.30, 20, 0.00, 25, 0.10, 1, 0, 1), (24, 0.25, 1, 1.00, 40, 0.00, 1, 0, 1), (1, 0.00, 12, 0.00, 14, 0.00, 1, 0, 1), (6, 0.00, 2, 0.90, 9, 0.00, 1, 0, 1),
    (2, 1.00, 2, 1.00, 1, 1.00, 1, 0, 0), (5, 0.80, 3, 1.00, 40, 0.00, 1, 0, 0), (1, 1.00, 0, 0.00, 1, 1.00, 1, 0, 0), (7, 0.50, 20, 0.00, 6, 0.60, 1, 0, 0),
    (4, 0.00, 2, 1.00, 3, 1.00, 1, 0, 0), (9, 0.00, 1, 1.00, 2, 0.60, 1, 0, 0), (3, 0.00, 1, 1.00, 1, 1.00, 1, 0, 0), (6, 0.00, 4, 1.00, 2, 0.90, 1, 0, 0),
    (20, 0.60, 10, 0.70, 12, 0.60, 1, 0, 0), (4, 1.00, 30, 0.00, 5, 1.00, 1, 0, 0), (3, 1.00, 40, 0.00, 2, 1.00, 1, 0, 0), (2, 1.00, 5, 1.00, 33, 0.00, 1, 0, 0),
    (4, 0.00, 2, 1.00, 8, 0.60, 1, 0, 0), (8, 0.00, 30, 0.00, 6, 0.60, 1, 0, 1), (5, 0.00, 3, 0.60, 2, 0.70, 1, 0, 0), (6, 0.00, 9, 0.20, 4, 0.60, 1, 0, 1),
    (9, 1.00, 45, 0.00, 60, 0.00, 1, 0, 1), (12, 0.90, 30, 0.00, 25, 0.05, 1, 0, 1), (8, 1.00, 3, 0.00, 5, 0.00, 1, 0, 1), (7, 1.00, 50, 0.00, 4, 0.00, 1, 0, 1),
    (10, 1.00, 2, 0.00, 40, 0.00, 1, 0, 1), (11, 0.00, 8, 1.00, 9, 1.00, 1, 0, 0), (8, 0.00, 12, 1.00, 7, 0.80, 1, 0, 0),
    (9, 1.00, 2, 1.00, 9, 0.00, 1, 0, 0), (2, 1.00, 9, 0.70, 40, 0.00, 1, 0, 0), (9, 1.00, 40, 1.00, 40, 0.00, 1, 0, 0), (2, 0.60, 2, 0.00, 9, 1.00, 1, 0, 0),
    (9, 1.00, 40, 0.00, 40, 1.00, 1, 0, 0), (2, 1.00, 40, 0.00, 30, 0.60, 1, 0, 0), (9, 0.70, 12, 0.00, 12, 1.00, 1, 0, 0), (2, 1.00, 2, 0.00, 2, 0.00, 1, 0, 1),
    (2, 0.80, 30, 0.00, 60, 0.00, 1, 0, 1), (6, 1.00, 3, 1.00, 40, 0.00, 1, 1, 1), (6, 1.00, 40, 0.00, 40, 0.00, 1, 1, 1), (6, 1.00, 3, 1.00, 4, 1.00, 1, 1, 0),
    (6, 0.60, 5, 0.80, 12, 0.00, 1, 0, 0), (3, 0.60, 2, 0.60, 9, 0.00, 1, 0, 0), (20, 0.60, 9, 0.90, 30, 0.10, 1, 0, 0), (2, 0.60, 1, 0.60, 0, 0.00, 1, 0, 0),
    (2, 0.00, 1, 0.00, 2, 1.00, 1, 0, 1), (3, 0.00, 4, 0.00, 6, 1.00, 1, 0, 1), (1, 0.00, 9, 0.00, 1, 0.60, 1, 0, 1), (2, 0.00, 20, 0.30, 3, 0.80, 1, 0, 1), (5, 0.00, 0, 0.00, 4, 1.00, 1, 0, 1),
    # In what surrounds articles: nothing.
    (60, 0.00, 80, 0.00, 20, 0.00, 2, 0, 0), (12, 0.00, 30, 0.00, 40, 0.00, 2, 0, 0), (1, 1.00, 1, 1.00, 1, 1.00, 2, 0, 0), (5, 0.00, 90, 0.00, 0, 0.00, 2, 0, 0),
    (25, 0.10, 40, 0.00, 0, 0.00, 2, 0, 0), (110, 0.00, 45, 0.00, 70, 0.00, 2, 0, 0), (3, 0.00, 0, 0.00, 6, 0.00, 2, 1, 0), (14, 0.90, 12, 1.00, 15, 0.80, 2, 0, 0),
    (40, 0.00, 3, 0.00, 2, 0.00, 2, 0, 0), (7, 0.00, 6, 0.00, 8, 0.00, 2, 0, 0), (9, 0.00, 1, 1.00, 100, 0.00, 2, 1, 0), (2, 0.00, 100, 0.00, 1, 1.00, 2, 0, 0),
    (5, 0.00, 20, 0.00, 4, 1.00, 2, 0, 0), (9, 0.00, 2, 0.00, 7, 0.80, 2, 1, 0), (30, 0.00, 40, 0.00, 3, 1.00, 2, 0, 0), (4, 0.00, 1, 1.00, 5, 1.00, 2, 0, 0),
    (20, 0.00, 3, 1.00, 8, 0.60, 2, 0, 0), (4, 0.00, 9, 0.00, 6, 0.60, 2, 0, 0), (6, 0.60, 8, 0.00, 9, 0.00, 2, 0, 0), (3, 1.00, 40, 0.00, 30, 0.00, 2, 0, 0),
]

#: The same of paragraphs that end as a sentence does: article text whatever is beside them, unless they are in surroundings or links among links.
SENTENCES = [
    (1, 0.00, 1, 1.00, 2, 1.00, 1, 0, 1), (3, 0.00, 2, 1.00, 1, 1.00, 1, 0, 1), (11, 0.00, 8, 1.00, 9, 1.00, 1, 0, 1), (8, 0.00, 12, 1.00, 7, 0.80, 1, 0, 1),
    (5, 0.00, 3, 0.60, 2, 0.70, 1, 0, 1), (9, 0.20, 1, 1.00, 2, 0.60, 1, 0, 1), (4, 0.30, 2, 1.00, 8, 0.60, 1, 0, 1), (12, 0.30, 30, 1.00, 40, 1.00, 1, 0, 1),
    (6, 0.00, 4, 1.00, 2, 0.90, 1, 0, 1), (2, 0.00, 40, 1.00, 100, 1.00, 1, 0, 1), (12, 0.45, 5, 0.60, 5, 0.60, 1, 0, 1), (3, 0.00, 100, 0.60, 12, 0.60, 1, 0, 1),
    (40, 0.00, 20, 0.00, 30, 0.00, 1, 0, 1), (5, 0.00, 6, 0.00, 7, 0.00, 1, 0, 1), (1, 0.00, 0, 0.00, 0, 0.00, 1, 0, 1), (7, 0.10, 0, 0.00, 4, 1.00, 1, 0, 1),
    (9, 1.00, 45, 0.00, 60, 0.00, 1, 0, 1), (3, 1.00, 4, 0.00, 9, 0.00, 1, 0, 1), (2, 0.60, 1, 0.00, 1, 0.00, 1, 0, 1), (12, 0.60, 9, 0.30, 40, 0.30, 1, 0, 1),
    (2, 1.00, 2, 1.00, 1, 1.00, 1, 0, 0), (9, 0.80, 40, 1.00, 3, 0.60, 1, 0, 0), (20, 0.60, 10, 0.70, 12, 0.60, 1, 0, 0), (5, 1.00, 3, 1.00, 40, 0.00, 1, 0, 0),
    (9, 1.00, 40, 0.00, 2, 1.00, 1, 0, 0), (2, 0.60, 2, 0.00, 9, 1.00, 1, 0, 0), (100, 0.60, 2, 0.60, 9, 0.00, 1, 0, 0), (3, 0.60, 0, 0.00, 8, 0.60, 1, 0, 0),
    (3, 0.00, 1, 1.00, 1, 1.00, 0, 0, 1), (30, 0.00, 9, 0.00, 9, 0.00, 0, 0, 1), (4, 1.00, 5, 1.00, 6, 1.00, 0, 0, 1), (6, 0.60, 4, 0.00, 5, 1.00, 0, 0, 1),
    (60, 0.00, 80, 0.00, 20, 0.00, 2, 0, 0), (5, 0.00, 9, 0.00, 0, 0.00, 2, 0, 0), (3, 0.00, 1, 1.00, 1, 1.00, 2, 0, 0), (12, 0.30, 9, 0.60, 6, 1.00, 2, 0, 0), (1, 1.00, 1, 1.00, 1, 1.00, 2, 0, 0), (110, 0.00, 45, 0.00, 70, 0.00, 2, 0, 0),
]

LABELLED = [(*r[:-1], said, r[-1]) for said, rows in enumerate((BLOCKS, SENTENCES)) for r in rows]


def _features(b: Block, before: Block | None, after: Block | None) -> tuple:
    return (b.words, b.density, before.words if before else 0, before.density if before else 0.0, after.words if after else 0, after.density if after else 0.0, b.place, int(b.heading), int(b.said))


def train(rows: list[tuple], depth: int = 10) -> tuple | float:
    """A tree of (feature, threshold, left, right) that parts rows by the least Gini impurity; a leaf is the share of 1."""
    x, y = np.array([r[:-1] for r in rows], float), np.array([r[-1] for r in rows], float)

    def grow(at: np.ndarray, left: int) -> tuple | float:
        share = float(y[at].mean())
        if left == 0 or share in (0.0, 1.0):
            return share
        best = None
        for f in range(x.shape[1]):
            levels = np.unique(x[at, f])
            for t in (levels[:-1] + levels[1:]) / 2:
                low = x[at, f] <= t
                cost = sum(n * p * (1 - p) for part in (y[at][low], y[at][~low]) for n, p in [(len(part), part.mean())])
                if best is None or cost < best[0] - 1e-12:
                    best = (cost, f, float(t), low)
        if best is None:
            return share
        _, f, t, low = best
        return f, t, grow(at[low], left - 1), grow(at[~low], left - 1)

    return grow(np.arange(len(y)), depth)


TREE = train(LABELLED)


def is_article(features: tuple, tree=None) -> bool:
    node = TREE if tree is None else tree
    while isinstance(node, tuple):
        node = node[2] if features[node[0]] <= node[1] else node[3]
    return node >= 0.5


def main_text(page: str | None) -> str:
    """The blocks that the tree takes for article text, joined by one line feed; empty if there are none."""
    blocks = flat_blocks(page)
    around = [None, *blocks, None]
    return "\n".join(b.text for i, b in enumerate(blocks) if is_article(_features(b, around[i], around[i + 2])))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars for each row of pages.

    Pages are read whole. Null and empty pages, and pages without article text,
    have an empty text. Repeated rows get equal results; other columns are
    ignored; no rows give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p.as_py()) for p in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
