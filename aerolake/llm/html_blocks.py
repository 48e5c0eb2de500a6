"""Leaf blocks of a page, with the features that the block labeller reads.

A block is the text between two block-level tags. Markup, comments, scripts, styles, the head, drawings and the contents of form
fields never become text. Character references are decoded once, white space within a block becomes one space.

Any page is read in time linear in its length: no pattern goes back over what it has read, a tag, comment or quoted value that
never ends reaches to the end of the page as in browsers, and a block's path is kept as a set of hashed slots that grows with the
tree, not as a list that is copied for each block.
"""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter
from collections.abc import Iterable
from functools import lru_cache

import numpy as np

#: Elements that do not end a block, that have no content, and whose content is not text of the page.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br img".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("head script style template title svg select textarea".split())
RAW = frozenset("script style textarea title".split())
#: A start tag of these ends an open element of the same group.
CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th"), "option": ("option",)}
#: Block-level starts that end an open paragraph.
ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
SCOPE = frozenset("table td th ul ol dl div section article aside nav main header footer form body".split())

TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))"  # comment
    r"|<[!?][^>]*+(?:>|\Z)|</(?![A-Za-z])[^>]*+(?:>|\Z)"  # declarations and other marks
    r"|<(/?)([A-Za-z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|))*+)(?:>|\Z)"  # tag: name, attributes
    r"|([^<]++|<)",  # text
    re.S,
)
ATTRIBUTE = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|$)", re.I) for name in RAW}
NAME_PART = re.compile(r"[a-z]+")

PATH_DIM, WORD_DIM, SHAPE_DIM = 96, 64, 8
DIM = PATH_DIM + WORD_DIM + SHAPE_DIM


class Block:
    """``path``: the slots of the tag names and of the words of class, id and role above the text, as bits."""

    __slots__ = ("path", "links", "text")

    def __init__(self, path: int, text: str, links: int):
        self.path, self.text, self.links = path, text, links


def _slot(text: str, size: int, salt: int) -> int:
    return zlib.crc32(text.encode("utf-8", "replace"), salt) % size


@lru_cache(20_000)
def _bits(part: str) -> tuple[int, int]:
    """Bits of a part of a path: anywhere in it, and as its last part."""
    anywhere = 0 if part in ("html", "body") else 1 << _slot(part, PATH_DIM, 1)
    return anywhere, 1 << _slot(part, PATH_DIM, 2)


def blocks(page: str) -> list[Block]:
    """The page's blocks in order."""
    out: list[Block] = []
    stack: list[tuple[str, int, int]] = []  # name, bits of the path down to here, bit of its last part
    open_: Counter[str] = Counter()
    hidden = anchors = 0
    parts: list[str] = []
    linked = at = 0

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                path, last = stack[-1][1:] if stack else (0, 0)
                out.append(Block(path | last, text, linked))
            parts, linked = [], 0

    def pop(k: int) -> None:
        nonlocal hidden, anchors
        for name, *_ in stack[k:]:
            open_[name] -= 1
            hidden -= name in HIDDEN
            anchors -= name == "a"
        del stack[k:]

    def push(name: str, words: Iterable[str] = ()) -> None:
        nonlocal hidden, anchors
        path, last = stack[-1][1:] if stack else (0, 0)
        if name not in INLINE:
            for part in (name, *words):
                anywhere, last = _bits(part)
                path |= anywhere
        stack.append((name, path, last))
        open_[name] += 1
        hidden += name in HIDDEN
        anchors += name == "a"

    while token := TOKEN.match(page, at):
        at = token.end()
        closing, name, attributes, text = token.groups()
        if text is not None:
            if not hidden:
                text = html.unescape(text)
                parts.append(text)
                linked += len(text) if anchors else 0
            continue
        if name is None:
            continue
        name = name.lower()
        if closing:
            if name == "br":
                parts.append(" ")
                continue
            if not open_[name]:
                if name not in INLINE:
                    flush()
                continue
            k = len(stack) - 1
            while stack[k][0] != name and (name not in INLINE or stack[k][0] in INLINE):
                k -= 1
            if name not in INLINE:
                flush()
            if stack[k][0] == name:  # an inline end does not close the blocks inside
                pop(k)
            continue
        if name in INLINE:
            if name in ("br", "wbr", "img"):
                parts.append(" " if name == "br" else "")
            else:
                push(name)
            continue
        flush()
        ends = CLOSES.get(name, ()) + (("p",) if name in ENDS_P else ())
        if any(open_[n] for n in ends):
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in ends:
                    pop(k)
                    break
                if stack[k][0] in SCOPE:
                    break
        if name == "body" and open_["head"]:
            pop(next(k for k, (n, *_) in enumerate(stack) if n == "head"))
        if name in VOID:
            continue
        words = tuple(w for a in ATTRIBUTE.finditer(attributes) for w in NAME_PART.findall((a[2] or a[3] or a[4] or "").lower()))
        if not attributes.endswith("/") or name in ("p", "div", "script", "style"):
            if name in RAW:  # no markup inside: on to its end tag, or to the end of the page
                end = RAW_END[name].search(page, at)
                at = end.end() if end else len(page)
                continue
            push(name, words)
    flush()
    return out


#: Slots of words seen, up to a bound: they save work and change no result.
_SLOTS: dict[str, int] = {}


@lru_cache(20_000)
def _path_vector(path: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(path.to_bytes(PATH_DIM // 8, "little"), np.uint8), bitorder="little").astype(np.float32)


def _word_vector(text: str) -> np.ndarray:
    """Share of the block's words in each slot; every word counts."""
    words = text.lower().split(" ")
    slots = []
    for w in words:
        slot = _SLOTS.get(w)
        if slot is None:
            slot = _slot(w, WORD_DIM, 3)
            if len(_SLOTS) < 100_000 and len(w) <= 64:
                _SLOTS[w] = slot
        slots.append(slot)
    return np.bincount(slots, minlength=WORD_DIM) / len(words)


def vectors(found: list[Block], start: int = 0, end: int | None = None) -> np.ndarray:
    """A row a block from start to end: hashed tag path, hashed words (all of them), shape. ``found`` holds the whole page."""
    n = len(found)
    end = n if end is None else min(end, n)
    out = np.zeros((end - start, DIM), np.float32)
    for i, b in enumerate(found[start:end], start):
        row = out[i - start]
        row[:PATH_DIM] = _path_vector(b.path)
        row[PATH_DIM : PATH_DIM + WORD_DIM] = _word_vector(b.text)
        size = len(b.text)
        words = b.text.count(" ") + 1
        row[-SHAPE_DIM:] = (np.log1p(words) / 5, np.log1p(size) / 7, b.links / size, size / words / 10, b.text[-1:] in ".!?", i / n, words < 5, b.text[:1] in "©")
    return out
