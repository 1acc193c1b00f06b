"""Business names: plausibility, extraction from markup, confidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .html import ANCHOR, unescape

# Fixed values -------------------------------------------------------------------
NOT_NAMES = (
    r"^[0-9+\-*/().]+$",
    r"^[0-9]+\s*(min|hr|hour|mile|km|ft)$",
    r"^[★☆★]",
    r"^(open|closed|closes|opens) now",
    r"^[0-9]+$",
    r"^[•·●]",
)
MIN_NAME, MAX_NAME = 2, 100
# The fifteen places a name is looked for, in order, each with a lower-case literal it
# cannot match without; a ``link`` pattern is searched within anchors that lead to a place
# page.
NAME_PLACES = (
    ("link", "maps/place", r"(?is)<h3\b[^>]*>([^<]*)"),
    ("page", "fontheadlinesmall", r'(?is)<[a-z0-9]+\s[^>]*class="[^"]*\bfontHeadlineSmall\b[^"]*"[^>]*>([^<]*)'),
    ("page", "qbf1pd", r'(?is)<[a-z0-9]+\s[^>]*class="[^"]*\bqBF1Pd\b[^"]*"[^>]*>([^<]*)'),
    ("page", "fontheadlinesmall", r'(?is)<h3\s[^>]*class="[^"]*\bfontHeadlineSmall\b[^"]*"[^>]*>([^<]*)'),
    ("page", 'role="article"', r'(?is)<div\s[^>]*role="article"[^>]*>.*?<h3\b[^>]*>([^<]*)'),
    ("page", "nv2pk", r'(?is)<[a-z0-9]+\s[^>]*class="[^"]*\bNv2PK\b[^"]*"[^>]*>.*?<h3\b[^>]*>([^<]*)'),
    ("page", "data-place-id", r"(?is)<[a-z0-9]+\s[^>]*data-place-id\b[^>]*>.*?<h3\b[^>]*>([^<]*)"),
    ("page", "headline", r'(?is)<[a-z0-9]+\s[^>]*class="[^"]*headline[^"]*"[^>]*>([^<]*)'),
    ("page", "fontheadline", r'(?is)<[a-z0-9]+\s[^>]*class="[^"]*fontHeadline[^"]*"[^>]*>([^<]*)'),
    ("page", "businessname", r'(?is)<[a-z0-9]+\s[^>]*class="[^"]*businessName[^"]*"[^>]*>([^<]*)'),
    ("link", "maps/place", r"(?is)<h3\b[^>]*>([^<]*)"),
    ("page", "headline", r'(?is)<[a-z0-9]+\s[^>]*class="[^"]*headline[^"]*"[^>]*>.*?<h3\b[^>]*>([^<]*)'),
    ("link", "maps/place", r"(?is)<h3\b[^>]*>([^<]*)"),
    ("page", "<h3", r"(?is)<h3\b[^>]*>([^<]{3,})"),
    ("page", "<", r"(?is)<[a-z0-9]+\b[^>]*>([^<·★]{3,99})<"),
)
PLACE_LINK = r'(?i)^<a\s[^>]*href="[^"]*maps/place'
ATTRIBUTE_PATTERNS = (
    r'aria-label="([^"]+)"',
    r'data-name="([^"]+)"',
    r'data-business-name="([^"]+)"',
    r'data-place-name="([^"]+)"',
    r">([^<]{3,50})</h3>",
    r"<div[^>]*>([^<]{3,50})</div>",
)
BASE_SCORE, MAX_SCORE = 80, 100
TEXT_SCORE, ATTRIBUTE_SCORE = 50, 30
UNKNOWN = "Unknown"
# --------------------------------------------------------------------------------


def plausible_name(text: Column) -> Column:
    """F8: 2 to 100 characters, at least one Latin letter, no known non-name shape."""
    ok = F.length(text).between(MIN_NAME, MAX_NAME) & text.rlike("[a-zA-Z]")
    for p in NOT_NAMES:
        ok = ok & ~text.rlike("(?i)" + p)
    return F.coalesce(ok, F.lit(False))


def place_score(place: int) -> int:
    """Base score by position in ``NAME_PLACES``."""
    return BASE_SCORE + (15 if place < 5 else 10 if place < 10 else 5)


def _with_bonus(text: Column, base: Column) -> Column:
    capitals = (F.upper(text) == text) & (F.lower(text) != text) & (F.length(text) > 3)
    marks = text.rlike(r"[&\-'.]")
    framed = text.rlike(r"^\p{Lu}") & text.rlike(r"\p{L}$")
    score = base + F.when(capitals, 5).otherwise(0) + F.when(marks, 3).otherwise(0) + F.when(framed, 2).otherwise(0)
    return F.least(score, F.lit(MAX_SCORE)).cast("int")


def name_confidence(text: Column, place: int) -> Column:
    """Score of a name found at a place, with bonuses for how it is written."""
    return _with_bonus(text, F.lit(place_score(place)))


def _first_within(links: Column, pattern: str) -> Column:
    heads = F.transform(links, lambda a: F.regexp_extract(a, pattern, 1))
    return F.coalesce(F.get(F.filter(heads, lambda h: h != ""), 0), F.lit(""))


def name_of_markup(clean: Column, low: Column, text: Column) -> Column:
    """struct(name, confidence) from a card's or page's markup.

    ``clean`` comes from ``html.markup``, ``low`` is its lower case and ``text`` comes from
    ``html.visible_text``. The first hit of each place counts if it is plausible; then the whole text; then attributes.
    """
    links = F.filter(F.regexp_extract_all(clean, F.lit(ANCHOR), 0), lambda a: a.rlike(PLACE_LINK))
    hits, seen = [], set()

    def offer(name: Column, base: int) -> None:
        hits.append(F.struct(name.alias("name"), F.lit(base).alias("base")))

    for i, (where, literal, pattern) in enumerate(NAME_PLACES):
        if (where, pattern) not in seen:
            seen.add((where, pattern))
            raw = _first_within(links, pattern) if where == "link" else F.regexp_extract(clean, pattern, 1)
            offer(F.when(low.contains(literal), F.trim(unescape(raw))), place_score(i))
    offer(F.trim(text), TEXT_SCORE)
    for pattern in ATTRIBUTE_PATTERNS:
        offer(F.regexp_extract(clean, pattern, 1), ATTRIBUTE_SCORE)
    # arrays and lambdas let every pattern run once, however often its hit is looked at
    first = F.slice(F.filter(F.array(*hits), lambda h: plausible_name(h["name"])), 1, 1)
    unknown = F.struct(F.lit(UNKNOWN).alias("name"), F.lit(ATTRIBUTE_SCORE).alias("confidence"))
    return F.coalesce(F.get(F.transform(first, _rated), 0), unknown)


def _rated(hit: Column) -> Column:
    from_place = hit["base"] >= BASE_SCORE
    name = F.when(hit["base"] == TEXT_SCORE, F.substring_index(hit["name"], "\n", 1)).otherwise(hit["name"])
    confidence = F.when(from_place, _with_bonus(hit["name"], hit["base"])).otherwise(hit["base"])
    return F.struct(name.alias("name"), confidence.cast("int").alias("confidence"))
