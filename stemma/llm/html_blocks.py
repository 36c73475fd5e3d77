"""Leaf blocks of a web page, with the features of a block's ancestors and text."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

#: Comments, declarations, tags with attributes, text. A quote opens a value right after "=" only, and only if it is closed.
_TOKEN = r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|</?[a-zA-Z]{}>?|[^<]++|<"
TOKEN = re.compile(
    _TOKEN.format(
        r"[^\s/>]*+(?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)?+)?+)*+"
    ),
    re.S,
)
#: The same, where a tag ends at its first ">" whatever its quotes.
PLAIN = re.compile(_TOKEN.format("[^>]*+"), re.S)
TAG = re.compile(r"</?([a-zA-Z][^\s/>]*)")
ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop|aria-label|type)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
NAME = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")

#: Elements whose content is no markup and ends at their first end tag, or hides the rest of the page.
RAW = frozenset("script style noscript textarea title iframe".split())
#: Elements whose text is never shown as text of the page. The others hold elements, their own kind among them.
HIDDEN = RAW | frozenset("template object svg math select canvas audio video".split())
_ENDS = {name: re.compile(rf"</{name}(?![^\s/>])[^>]*>", re.I) for name in RAW}
_OWN = {
    name: re.compile(rf"<!--.*?(?:-->|\Z)|<(?P<raw>{'|'.join(sorted(RAW))})(?![^\s/>])[^>]*>|<(?P<end>/?){name}(?![^\s/>])[^>]*>", re.I | re.S)
    for name in HIDDEN - RAW
}
#: Elements that begin and end a block.
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure"
    " footer form h1 h2 h3 h4 h5 h6 header hgroup html label legend li main menu nav ol option p pre section summary"
    " table tbody td tfoot th thead tr ul".split()
)
#: An element of the first kind ends an open one of the second, up to the third.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dd": ({"dd", "dt"}, {"dl"}),
    "dt": ({"dd", "dt"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
#: Parts of a page that names of classes, ids and roles tell of: whole words, or beginnings if marked by a star.
PARTS = {
    "menu": "nav* menu* breadcrumb* pager paginat* toc tabs toolbar skip topbar",
    "head": "masthead banner header head logo branding hero",
    "foot": "foot* copyright* legal colophon bottom imprint",
    "side": "sidebar* side aside widget* related* recommend* popular trending rail promo* teaser* more also complementary archive",
    "notice": "cookie* consent* gdpr notice* alert* popup* modal* overlay privacy disclaimer* notification* newsletter* subscri* signup toast paywall announcement*",
    "advert": "ad ads adv advert* sponsor* dfp adsense banner* outbrain taboola commercial",
    "form": "form* search* login signin register contact input field* button* submit",
    "comment": "comment* repl* discuss* disqus respond* review* feedback* thread* guestbook",
    "share": "share* sharing social* follow* tag tags meta byline* rating* vote* print",
    "main": "main content* article* post* entry* story* text body page* copy prose",
}
_WHOLE = {w: part for part, words in PARTS.items() for w in words.split() if not w.endswith("*")}
_STEMS = [(w[:-1], part) for part, words in PARTS.items() for w in words.split() if w.endswith("*")]
#: Elements nested deeper than this are not told apart, as in browsers.
DEPTH = 512
LANDMARKS = frozenset("article main nav header footer aside form section table ul ol figure blockquote dialog".split())
PHRASES = {
    "legal": re.compile(r"©|\(c\)|copyright|all rights reserved|terms of (?:use|service)|privacy", re.I),
    "cookie": re.compile(r"\bcookies?\b|\bconsent\b", re.I),
    "call": re.compile(r"\b(?:subscribe|sign up|log in|click here|read more|share|follow us|newsletter|advert\w*|sponsored)\b", re.I),
}


def part_of(name: str) -> str | None:
    """The part of a page that one word of a class or id tells of."""
    if name in _WHOLE:
        return _WHOLE[name]
    return next((part for stem, part in _STEMS if name.startswith(stem)), None)


@dataclass
class Element:
    tag: str
    parts: frozenset[str] = frozenset()


@dataclass
class Block:
    """A run of text between block boundaries, the elements around it, and how many of its characters are links."""

    text: str
    path: list[Element]
    linked: int


_known_parts: dict[str, frozenset[str]] = {}


def _parts(token: str) -> frozenset[str]:
    if token not in _known_parts:
        if len(_known_parts) > 20_000:
            _known_parts.clear()
        names = (n.lower() for _, value in ATTRIBUTE.findall(token) for n in NAME.findall(value))
        _known_parts[token] = frozenset(p for p in map(part_of, names) if p)
    return _known_parts[token]


def hidden_ends(page: str, name: str) -> dict[int, int]:
    """Where each element of a hidden kind ends, by where it begins; those without an end are left out."""
    ends: dict[int, int] = {}
    begun: list[int] = []
    at = 0
    while found := _OWN[name].search(page, at):
        at = found.end()
        if found["raw"]:
            end = _ENDS[found["raw"].lower()].search(page, at)
            if not end:
                break
            at = end.end()
        elif found["end"]:
            if begun:
                ends[begun.pop()] = at
        elif found["end"] is not None and found.group()[-2] != "/":
            begun.append(found.start())
    return ends


def leaf_blocks(page: str) -> list[Block]:
    """The blocks of a page in order, character references decoded and white space made one space.

    Parsing is lenient: unknown end tags are skipped, ``p`` and list items end
    where the next begins, and a tag cut off by the end of the page is dropped.
    A tag whose quotes hide every end ends at its first ">", and so do the
    tags after it.
    """
    path: list[Element] = []
    blocks: list[Block] = []
    pieces: list[str] = []
    linked = links = deeper = 0

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                blocks.append(Block(text, path.copy(), linked))
            pieces.clear()
        linked = 0

    at = 0
    tokens = TOKEN
    ends_of: dict[str, dict[int, int]] = {}
    while at < len(page):
        token = tokens.match(page, at)
        piece, at = token.group(), token.end()
        if piece[0] != "<" or piece == "<":
            piece = html.unescape(piece)
            pieces.append(piece)
            if links:
                linked += len(piece.strip())
            continue
        tag = TAG.match(piece)
        if not tag:
            continue
        if piece[-1] != ">":
            if tokens is PLAIN:
                break
            tokens, at = PLAIN, token.start()
            continue
        name, closing = tag.group(1).lower(), piece[1] == "/"
        if name in HIDDEN:
            if not closing and piece[-2] != "/":
                if name in RAW:
                    end = _ENDS[name].search(page, at)
                    until = end.end() if end else None
                else:
                    if name not in ends_of:
                        ends_of[name] = hidden_ends(page, name)
                    until = ends_of[name].get(token.start())
                if until:
                    at = until
                elif name in RAW or name == "template":
                    break
        elif name == "a":
            links = max(0, links + (-1 if closing else 1))
        elif name == "br":
            pieces.append(" ")
        elif name == "hr":
            flush()
            if path and path[-1].tag == "p" and not deeper:
                path.pop()
        elif name in BLOCK:
            flush()
            if closing:
                links = 0
                if deeper:
                    deeper -= 1
                    continue
                for i in range(len(path) - 1, -1, -1):
                    if path[i].tag == name:
                        del path[i:]
                        break
                continue
            if path and path[-1].tag == "p" and not deeper:
                path.pop()
            if len(path) >= DEPTH:
                deeper += 1
                continue
            ends, upto = IMPLIED.get(name, ((), ()))
            for i in range(len(path) - 1, -1, -1) if ends else ():
                if path[i].tag in upto:
                    break
                if path[i].tag in ends:
                    del path[i:]
                    break
            path.append(Element(name, _parts(piece)))
    flush()
    return blocks
