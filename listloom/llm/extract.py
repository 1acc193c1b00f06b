"""Main text of web pages by two-pass block rules (operator 4).

A page is cut into blocks of text at its block-level tags. The first pass decides each block by
where it stands (navigation, adverts, comments and the like are boilerplate), by the share of its
text that lies in links, by its length and by its share of stop words. Blocks too short or too
unclear for that are decided by the second pass: each takes the label of its nearest
decided neighbour, where a neighbour in the same part of the page is nearer than one outside.

Elements such as nav, aside and footer are boilerplate with all they hold. A form, or a container whose class or
id has a word such as sidebar, is so only while it is a part of the page: wrappers named after what
stands in them (``content with-sidebar``) and forms around whole pages hold most of its prose, and
their mark is ignored. Comments are boilerplate unless the page has no other prose.

Results: null, empty and textless pages have the text ''. Unclosed and crossed tags are closed by
what encloses them; an unclosed comment, script or style runs to the page's end. Repeated rows
and null ids are rows like others; an input column named like a result is replaced.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .tables import append

SHORT = 70
LONG = 200
LINKS_HIGH = 0.5
STOPS_LOW = 0.1
STOPS_HIGH = 0.2

# Frequent function words of the languages told apart by stop words.
STOP_WORDS = {
    "en": "the of and a to in is it that for was on are as with be this by an or he from at not but have had his they which you we their has been were her she will one all would there what when who so if no can more its".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man".split(),
    "fr": "le la les de des du et à en un une est que qui dans pour pas sur au aux par plus ne ce se il elle sont avec son sa ses ou mais comme on nous vous leur cette été être fait tout d l".split(),
    "es": "de la que el en y a los del se las por un para con no una su al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy hasta desde es".split(),
}
_STOPS = [frozenset(words) for words in STOP_WORDS.values()]

# Elements that begin and end a block, that hold boilerplate, and words of class and id attributes that mark it.
_PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd tr caption figcaption pre address summary option legend".split())
_CONTAINERS = frozenset(
    "html head body div section article main nav header footer aside form fieldset ul ol dl menu table thead tbody tfoot td th blockquote figure details dialog center noscript select button label iframe object svg math canvas video audio template".split()
)
_BOILERPLATE = frozenset("head nav footer aside menu dialog noscript select button iframe object svg canvas video audio template".split())
_RAW = frozenset("script style textarea title xmp".split())
_MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu submenu breadcrumb breadcrumbs footer sidebar aside "
    "widget widgets related recommended recommendations popular trending comment comments commentlist disqus respond reply replies cookie cookies consent gdpr notice notices alert popup modal overlay "
    "newsletter subscribe subscription signup login share sharing social pagination pager search toolbar masthead copyright legal disclaimer skip toc tags".split()
)
_HEADER_MARKS = frozenset("header topbar top".split())
_COMMENT_MARKS = frozenset("comment comments commentlist disqus respond reply replies".split())
_FORMS = frozenset(("form", "fieldset"))
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
_TEXT_PARTS = frozenset(("article", "main"))

_TAG = re.compile(r"<!--(?:.*?-->|.*+)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^>]*+>?)|<[!?/][^>]*+>?", re.S)
_ATTRIBUTE = re.compile(r"(?:^|[\s\"'/])(class|id|role|hidden|aria-hidden|itemprop)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_MARK_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_WORD = re.compile(r"[^\W\d_]+")

GOOD, BAD, OPEN = 1, 0, -1
#: What a container's own tag and attributes say of it.
_PLAIN, _MARKED, _COMMENTS, _NO_TEXT = range(4)
#: The share of a page's prose above which a container is no mere part of it.
MOST = 0.5


class _Part:
    """An open container."""

    __slots__ = ("tag", "up", "depth", "mark", "boilerplate", "text")

    def __init__(self, tag: str, up, mark: int):
        self.tag, self.up, self.mark = tag, up, mark
        self.depth = up.depth + 1 if up else 0
        self.boilerplate = mark != _PLAIN or bool(up and up.boilerplate)
        self.text = tag in _TEXT_PARTS or bool(up and up.text)

    def path(self):
        """The container and those around it, from the outermost one on."""
        around, part = [], self
        while part:
            around.append(part)
            part = part.up
        return around[::-1]


def _mark(tag: str, attributes: str, up) -> int:
    if tag in _BOILERPLATE or (tag == "header" and not up.text):
        return _NO_TEXT
    mark = _MARKED if tag in _FORMS else _PLAIN
    if tag in ("html", "body", "article", "main") or "=" not in attributes and "hidden" not in attributes:
        return mark
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "role" and value.lower() in _ROLES):
            return _NO_TEXT
        if name in ("class", "id"):
            words = {w.lower() for w in _MARK_WORD.findall(value)}
            if words & _COMMENT_MARKS:
                mark = _COMMENTS
            elif mark == _PLAIN and (words & _MARKS or (words & _HEADER_MARKS and not up.text)):
                mark = _MARKED
    return mark


def settle(page_blocks, shares: list[float]) -> None:
    """Ignores the marks of containers that hold most of a page's prose; ``shares``: of stop words in blocks."""
    likely = [(s, len(t), p.path()) for (t, linked, p), s in zip(page_blocks, shares) if len(t) >= SHORT and linked <= LINKS_HIGH * len(t)]
    likely = [(s, n, around) for s, n, around in likely if all(p.mark != _NO_TEXT for p in around)]
    least = STOPS_LOW if any(s >= STOPS_LOW for s, _, _ in likely) else 0.0
    prose = [(n, around) for s, n, around in likely if s >= least]
    if all(p.mark in (_PLAIN, _NO_TEXT) for _, around in prose for p in around):
        return
    counted = [(n, around) for n, around in prose if all(p.mark != _COMMENTS for p in around)] or prose
    total, held = sum(n for n, _ in counted), {}
    for n, around in counted:
        for p in around:
            if p.mark in (_MARKED, _COMMENTS):
                held[p] = held.get(p, 0) + n
    for p, n in held.items():
        if n > MOST * total:
            p.mark = _PLAIN
    for _, _, part in page_blocks:
        for p in part.path():
            p.boilerplate = p.mark != _PLAIN or bool(p.up and p.up.boilerplate)


def blocks(page: str) -> list[tuple[str, int, _Part]]:
    """(text, characters in links, container) of each block with text."""
    out: list[tuple[str, int, _Part]] = []
    part = _Part("", None, _PLAIN)
    pieces: list[str] = []
    linked, in_link, inner, at = 0, False, None, 0

    def end():
        nonlocal linked
        text = " ".join("".join(pieces).split())
        pieces.clear()
        if text:
            out.append((text, min(linked, len(text)), inner or part))
        linked = 0

    while True:
        m = _TAG.search(page, at)
        chunk = page[at : m.start()] if m else page[at:]
        if chunk:
            if "&" in chunk:
                chunk = html.unescape(chunk)
            pieces.append(chunk)
            if in_link:
                linked += len(" ".join(chunk.split()))
        if not m:
            break
        at, tag = m.end(), (m[2] or "").lower()
        if not tag:
            continue
        closing = bool(m[1])
        if tag in _RAW:
            if not closing and not m[3].endswith("/>"):
                stop = re.compile(rf"</{tag}\b[^>]*+>?", re.I).search(page, at)
                at = stop.end() if stop else len(page)
            if tag not in ("script", "style"):
                pieces.append(" ")
        elif tag in ("br", "hr", "wbr", "img", "input"):
            if tag != "wbr":
                pieces.append(" ")
        elif tag == "a":
            in_link = not closing
        elif tag in _PARAGRAPHS:
            end()
            in_link = False
            # a marked paragraph is a container of its own until the next block
            mark = _PLAIN if closing else _mark(tag, m[3] or "", part)
            inner = _Part(tag, part, mark) if mark != _PLAIN else None
        elif tag in _CONTAINERS:
            end()
            in_link, inner = False, None
            if closing:
                found = part
                while found.up and found.tag != tag:
                    found = found.up
                if found.up:
                    part = found.up
            else:
                if tag == "body":
                    while part.up and part.tag == "head":
                        part = part.up
                if not m[3].endswith("/>"):
                    part = _Part(tag, part, _mark(tag, m[3] or "", part))
    end()
    return out


def _stop_share(text: str) -> float:
    words = [w for w in _WORD.findall(text.lower())]
    return max(sum(w in stops for w in words) for stops in _STOPS) / len(words) if words else 0.0


def labels(page_blocks: list[tuple[str, int, _Part]]) -> list[int]:
    """First and second pass."""
    share = [_stop_share(t) if len(t) >= SHORT and p.mark != _NO_TEXT else 0.0 for t, _, p in page_blocks]
    settle(page_blocks, share)
    share = [0.0 if p.boilerplate else s for s, (_, _, p) in zip(share, page_blocks)]
    known_language = max(share, default=0) >= STOPS_LOW
    marked_text = any(p.text and not p.boilerplate for _, _, p in page_blocks)
    first = []
    for (text, linked, part), s in zip(page_blocks, share):
        if part.boilerplate or linked > LINKS_HIGH * len(text) or (marked_text and not part.text):
            first.append(BAD)
        elif len(text) < SHORT:
            first.append(BAD if "©" in text or "Ⓒ" in text else OPEN)
        elif not known_language or s >= STOPS_HIGH:
            first.append(GOOD)
        elif s < STOPS_LOW and len(text) >= LONG and not part.text:
            first.append(BAD)
        else:
            first.append(OPEN)
    return _inherit(first, [p for _, _, p in page_blocks])


def _inherit(first: list[int], parts: list[_Part]) -> list[int]:
    """Open blocks take the label of the nearest decided block.

    Within an article only its own blocks count, without the boilerplate set between them; if it
    has no decided block, the article itself decides.
    """
    own = [OPEN if p.boilerplate or not p.text else label for label, p in zip(first, parts)]
    outer, inner = _neighbours(first), _neighbours(own)
    out = []
    for i, label in enumerate(first):
        if label == OPEN:
            sides = inner[i] if parts[i].text else outer[i]
            near = [(c.depth, -abs(i - j), -first[j], first[j]) for j in sides if j >= 0 for c in [_common(parts[i], parts[j])] if c.text or not parts[i].text]
            label = max(near)[3] if near else GOOD
        out.append(label)
    # a page of short blocks only
    return out if GOOD in out else [GOOD if label == OPEN else BAD for label in first]


def _neighbours(decided: list[int]) -> list[tuple[int, int]]:
    """The nearest decided blocks before and after each block, -1 if there is none."""
    n = len(decided)
    before, after = [-1] * n, [-1] * n
    last = -1
    for i in range(n):
        before[i] = last
        last = i if decided[i] != OPEN else last
    last = -1
    for i in range(n - 1, -1, -1):
        after[i] = last
        last = i if decided[i] != OPEN else last
    return list(zip(before, after))


def _common(a: _Part, b: _Part) -> _Part:
    """The innermost part that holds both."""
    while a is not b:
        if a.depth >= b.depth:
            a = a.up
        else:
            b = b.up
    return a


def main_text(page: str | None) -> str:
    """The article of a page: its good blocks in order, joined by spaces."""
    if not page:
        return ""
    found = blocks(page)
    return " ".join(b[0] for b, label in zip(found, labels(found)) if label == GOOD)


def extract(pages: DataFrame) -> DataFrame:
    """``pages`` (html and others) with text and n_chars (its code points)."""

    def run(batch):
        texts = [main_text(p) for p in batch.column("html").to_pylist()]
        return [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]

    return append(pages, run, "text string, n_chars long", column="html")
