"""Values read from page markup with patterns that Java and RE2 both accept.

A selector is approximated by the tag's attributes and the text that leads its content.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .presence import first_present
from .text import count_in_label, number_in_label

# Fixed values -------------------------------------------------------------------
INVISIBLE = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->"
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))
HREF = r"""(?is)<a\s[^>]*?href\s*=\s*["']([^"']*)["']"""
ANCHOR = r"(?is)<a\s[^>]*>.*?</a\s*>"

DETAIL_NOT_NAMES = ("Results", "Search", "Google Maps")
# Each pattern comes with a lower-case literal it cannot match without.
DETAIL_HEADINGS = (
    ("duwdvf", r'(?is)<h1\s[^>]*class="[^"]*\bDUwDvf\b[^"]*"[^>]*>([^<]*)'),
    ("lfpiob", r'(?is)<h1\s[^>]*class="[^"]*\blfPIob\b[^"]*"[^>]*>([^<]*)'),
    ("duwdvf", r'(?is)<[a-z0-9]+\s[^>]*class="[^"]*\bDUwDvf\b[^"]*"[^>]*>([^<]*)'),
    ("lfpiob", r'(?is)<[a-z0-9]+\s[^>]*class="[^"]*\blfPIob\b[^"]*"[^>]*>([^<]*)'),
    ("fontheadlinelarge", r'(?is)<h1\s[^>]*class="[^"]*\bfontHeadlineLarge\b[^"]*"[^>]*>([^<]*)'),
    ("fontheadlinelarge", r'(?is)<[a-z0-9]+\s[^>]*class="[^"]*\bfontHeadlineLarge\b[^"]*"[^>]*>([^<]*)'),
    ("<h1", r"(?is)<h1\b[^>]*>([^<]*)"),
)
ADDRESS_TAGS = (
    ("address", r'(?is)<button\s[^>]*data-item-id="[^"]*address[^"]*"[^>]*>([^<]*)'),
    ("address", r'(?is)<button\s[^>]*aria-label="[^"]*address[^"]*"[^>]*>([^<]*)'),
    ("roga2c", r'(?is)<div\s[^>]*class="[^"]*rogA2c[^"]*"[^>]*>([^<]*)'),
)
RATING_TAGS = (
    (
        "fontbodymedium",
        r'(?is)<div\s[^>]*class="[^"]*fontBodyMedium[^"]*"[^>]*>[^<]*<span\s[^>]*aria-hidden="true"[^>]*>([^<]*)',
    ),
    ("stars", r'(?is)<[a-z0-9]+\s[^>]*role="img"[^>]*aria-label="[^"]*stars[^"]*"[^>]*>([^<]*)'),
)
REVIEW_TAGS = (
    ("review", r'(?is)<button\s[^>]*aria-label="[^"]*reviews[^"]*"[^>]*>([^<]*)'),
    ("review", r'(?is)<button\s[^>]*aria-label="[^"]*review[^"]*"[^>]*>([^<]*)'),
)
CATEGORY_TAGS = (
    ("category", r'(?is)<button\s[^>]*jsaction="[^"]*category[^"]*"[^>]*>([^<]*)'),
    ("category", r'(?is)<button\s[^>]*class="[^"]*category[^"]*"[^>]*>([^<]*)'),
)
PRICE_TAGS = (
    ("price", r'(?is)<span\s[^>]*class="[^"]*price[^"]*"[^>]*>([^<]*)'),
    ("price", r'(?is)<[a-z0-9]+\s[^>]*aria-label="[^"]*price[^"]*"[^>]*>([^<]*)'),
    ("₹", r"(?is)<span\b[^>]*>([^<]*₹[^<]*)"),
)
PHONE_BUTTON = ("phone", r'(?is)<button\s[^>]*data-item-id="[^"]*phone[^"]*"[^>]*>([^<]*)')
PHONE_LINK_TEXT = ("tel:", r'(?is)<a\s[^>]*href="tel:[^"]*"[^>]*>([^<]*)')
PHONE_LINK = ("tel:", r'(?is)<a\s[^>]*href="tel:([^"?]*)')
PHONE_LABEL = ("phone", r'(?is)<button\s[^>]*aria-label="[^"]*phone[^"]*"[^>]*>([^<]*)')
AUTHORITY_TAG = ("authority", r'(?is)<a\s[^>]*data-item-id="[^"]*authority[^"]*"[^>]*>')
WHEELCHAIR = (
    r'(?is)<[a-z0-9]+\s[^>]*aria-label="[^"]*wheelchair'
    r'|<[a-z0-9]+\s[^>]*class="[^"]*accessible'
    r"|<div\b[^>]*>[^<]*wheelchair"
)
WHEELCHAIR_WORDS = ("wheelchair", "accessible")

MIN_USABLE_CHARS = 1000
BLOCKED = ("captcha", "unusual traffic")
PAGE_LABELS = (
    ("recaptcha_v2", ("google.com/recaptcha/api2", "recaptcha", "g-recaptcha", "data-sitekey", "recaptcha-token")),
    ("recaptcha_v3", ("recaptcha/api.js", "render=explicit", "recaptcha-v3")),
    ("hcaptcha", ("hcaptcha.com", "h-captcha", "data-hcaptcha", "hcaptcha-token")),
    ("image_captcha", ("captcha.png", "captcha.jpg", "captcha-image", "security-code", "verification-code")),
    ("text_captcha", ("enter the text", "type the characters", "security question", "verification question")),
    ("funcaptcha", ("funcaptcha", "arkoselabs", "arkose labs")),
    ("geetest", ("geetest", "gt.js", "slide-captcha")),
    ("turnstile", ("turnstile", "cf-turnstile", "cloudflare turnstile")),
    ("simple_math", ("what is", "solve the", "math problem", "calculate")),
)
# --------------------------------------------------------------------------------


def markup(html: Column) -> Column:
    """Page without scripts, styles and comments."""
    return F.regexp_replace(html, INVISIBLE, "")


def unescape(text: Column) -> Column:
    """The five basic entities, ampersand last."""
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def visible_text(clean: Column) -> Column:
    """Text nodes of a page, joined without separators; ``clean`` comes from ``markup``."""
    return unescape(F.regexp_replace(clean, r"<[^>]*>", ""))


def page_text(html: Column) -> Column:
    return visible_text(markup(html))


def hrefs(clean: Column) -> Column:
    """Link targets in document order; ``clean`` is the result of ``markup``."""
    return F.regexp_extract_all(clean, F.lit(HREF), 1)


def tag_text(clean: Column, low: Column, tag: tuple[str, str]) -> Column:
    """Trimmed leading text of the first tag that matches, '' if none.

    ``low`` is the lower-case page; a cheap search for the tag's literal spares most pages
    the pattern.
    """
    literal, pattern = tag
    found = F.trim(unescape(F.regexp_extract(clean, pattern, 1)))
    return F.when(low.contains(literal), found).otherwise(F.lit(""))


def first_tag_text(clean: Column, low: Column, tags) -> Column:
    return first_present(*[tag_text(clean, low, t) for t in tags])


def _first_with(candidates: list[Column], test) -> Column:
    return F.get(F.filter(F.array(*candidates), test), 0)


def detail_name_ok(name: Column) -> Column:
    """not a caption of the page itself, longer than two characters."""
    return ~name.isin(*DETAIL_NOT_NAMES) & (F.length(name) > 2)


def _acceptable_heading(clean: Column, low: Column, literal: str, pattern: str) -> Column:
    texts = F.transform(F.regexp_extract_all(clean, F.lit(pattern), 1), lambda t: F.trim(unescape(t)))
    return F.when(low.contains(literal), F.get(F.filter(texts, detail_name_ok), 0))


def detail_name(clean: Column, low: Column) -> Column:
    """First acceptable heading of a detail page (F9 over every match of each pattern)."""
    return F.coalesce(*[_acceptable_heading(clean, low, literal, p) for literal, p in DETAIL_HEADINGS])


def phone_of_page(clean: Column, low: Column) -> Column:
    """Phone from a button's or link's text, else from the ``tel:`` target."""

    def with_digit(*tags):
        return _first_with([tag_text(clean, low, t) for t in tags], lambda t: t.rlike(r"\d"))

    target = F.when(low.contains(PHONE_LINK[0]), F.regexp_extract(clean, PHONE_LINK[1], 1))
    return F.coalesce(with_digit(PHONE_BUTTON, PHONE_LINK_TEXT), first_present(target), with_digit(PHONE_LABEL))


def website_of_page(clean: Column, low: Column) -> Column:
    """The authority link, else the first absolute link that leaves the map host."""
    literal, pattern = AUTHORITY_TAG
    marked = F.when(low.contains(literal), F.regexp_extract(F.regexp_extract(clean, pattern, 0), r'(?i)href="([^"]*)"', 1))
    outside = F.filter(hrefs(clean), lambda h: h.startswith("http") & ~h.contains("google"))
    return F.coalesce(first_present(marked), F.get(outside, 0))


def address_of_page(clean: Column, low: Column) -> Column:
    """First address tag with more than five characters."""
    return _first_with([tag_text(clean, low, t) for t in ADDRESS_TAGS], lambda t: F.length(t) > 5)


def rating_of_page(clean: Column, low: Column) -> Column:
    """First number in the text of a rating tag."""
    found = F.transform(F.array(*[tag_text(clean, low, t) for t in RATING_TAGS]), number_in_label)
    return F.get(F.array_compact(found), 0)


def review_count_of_page(clean: Column, low: Column) -> Column:
    """First whole number in the text of a review tag."""
    found = F.transform(F.array(*[tag_text(clean, low, t) for t in REVIEW_TAGS]), count_in_label)
    return F.get(F.array_compact(found), 0)


def wheelchair_of_page(clean: Column, low: Column) -> Column:
    """True if the page mentions wheelchair access, else NULL."""
    mentioned = low.contains(WHEELCHAIR_WORDS[0]) | low.contains(WHEELCHAIR_WORDS[1])
    return F.when(mentioned & clean.rlike(WHEELCHAIR), F.lit(True))


def page_usable(html: Column) -> Column:
    """has visible text, or at least a fair amount of markup."""
    return (F.trim(page_text(html)) != "") | (F.length(html) >= MIN_USABLE_CHARS)


def page_blocked(html: Column) -> Column:
    """a challenge or refusal page rather than content."""
    low = F.lower(html)
    return low.contains(BLOCKED[0]) | low.contains(BLOCKED[1])


def _holds(low: Column, pattern: str) -> Column:
    """A label pattern in lower-case text; a dot stands for any character."""
    literal = pattern.split(".")[0]
    return low.contains(pattern) if literal == pattern else low.contains(literal) & low.rlike(pattern)


def page_label(low: Column) -> Column:
    """struct(score, rank, label): the best-matching kind of challenge page, or NULL.

    ``low`` is the lower-case page. Score is the share of a kind's patterns found, in
    percent; the kind listed first wins ties.
    """
    scored = []
    for i, (label, patterns) in enumerate(PAGE_LABELS):
        hits = sum((_holds(low, p).cast("int") for p in patterns), F.lit(0))
        share = hits / F.lit(float(len(patterns))) * 100
        scored.append(F.struct(share.alias("score"), F.lit(-i).alias("rank"), F.lit(label).alias("label")))
    return F.array_max(F.filter(F.array(*scored), lambda s: s["score"] > 0))
