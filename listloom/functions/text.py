"""Identity keys and values read from plain text and URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .presence import first_present, nullify

# Fixed values -------------------------------------------------------------------
# Character classes are spelled out so that Java and RE2 agree on Unicode text.
SPACE = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]"
NOT_WORD_OR_SPACE = r"[^\p{L}\p{N}_\s\x0B\x1C-\x1F\x{85}\p{Z}]"
NOT_WORD_SPACE_OR_DASH = r"[^\p{L}\p{N}_\s\x0B\x1C-\x1F\x{85}\p{Z}-]"

PHONE_PATTERNS = (
    r"(\+?\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}",
    r"(\+?\d{1,3}[-.\s]?)?\d{10}",
    r"(\+?\d{1,3}[-.\s]?)?\d{3}[-.\s]?\d{3}[-.\s]?\d{4}",
)
RATING_PATTERNS = (r"(\d+\.\d+)", r"(\d+,\d+)")
COMPANY_SUFFIXES = ("llc", "inc", "corp", "ltd", "co", "company")
# --------------------------------------------------------------------------------

_SCHEME = r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def record_id(name, phone, address) -> Column:
    """md5 over the first 50 characters of the name, the phone and the address."""
    parts = [F.substring(_col(name), 1, 50), _col(phone), _col(address)]
    return F.md5(F.concat_ws("|", *[F.coalesce(p, F.lit("None")) for p in parts]))


def clean_phone(phone) -> Column:
    """Digits only; a leading US 1 dropped; fewer than ten digits gives NULL."""
    digits = F.regexp_replace(_col(phone), r"[^\p{Nd}]", "")
    local = F.regexp_replace(digits, r"^1(.{10})$", "$1")
    return F.when(F.length(local) >= 10, local)


def clean_string(text) -> Column:
    """No punctuation, single spaces, trimmed; NULL gives ''."""
    bare = F.regexp_replace(F.coalesce(_col(text), F.lit("")), NOT_WORD_OR_SPACE, "")
    return F.trim(F.regexp_replace(bare, SPACE + "+", " "))


def _strip_www(host: Column) -> Column:
    return F.regexp_replace(host, r"^www\.", "")


def netloc(url) -> Column:
    """Authority part of a URL, '' if it has none. Never throws, keeps the port."""
    return F.regexp_extract(_col(url), _SCHEME + r"//([^/?#]*)", 1)


def _netloc_or_path(url) -> Column:
    path = F.regexp_extract(_col(url), _SCHEME + r"([^?#]*)", 1)
    return _strip_www(F.coalesce(nullify(netloc(url)), path))


def domain_of_url(url) -> Column:
    """Authority without ``www.``; NULL if there is none."""
    return nullify(_strip_www(netloc(url)))


def domain_or_path(url) -> Column:
    """Authority, or the first path segment of a URL without scheme."""
    return F.regexp_extract(_netloc_or_path(url), r"^([^/]*)", 1)


def domain_label(url) -> Column:
    """First label of X6b, as used in profile URLs."""
    return F.regexp_extract(_netloc_or_path(url), r"^([^.]*)", 1)


def lookup_domain(url) -> Column:
    """X6d: what follows the last ``://`` up to the next slash; ``www.`` is kept."""
    return F.regexp_extract(_col(url), r"(?s)^(?:.*://)?([^/]*)", 1)


def coordinate_key(lat, lng) -> Column:
    """Both coordinates at four decimals; NULL if either is NULL or zero."""
    la, ln = _col(lat), _col(lng)
    text = F.format_string("%.4f,%.4f", F.round(la, 4), F.round(ln, 4))
    return F.when((la != 0) & (ln != 0), text)


def dedup_key(place_id, phone, name, address, website, lat, lng) -> Column:
    """The strongest identity a record has, as a prefixed key.

    Order: place id, phone, name with address, web domain, coordinates, and last the
    bare hash of whatever name and address there is.
    """
    trimmed = [F.lower(F.regexp_replace(F.coalesce(_col(c), F.lit("")), f"^{SPACE}+|{SPACE}+$", "")) for c in (name, address)]
    hashed = F.md5(F.concat_ws("|", *[clean_string(t) for t in trimmed]))
    both = (trimmed[0] != "") & (trimmed[1] != "")

    def tagged(tag, value):
        return F.concat(F.lit(tag + ":"), value)

    return F.coalesce(
        tagged("place_id", nullify(_col(place_id))),
        tagged("phone", clean_phone(phone)),
        F.when(both, tagged("name_addr", hashed)),
        tagged("domain", domain_of_url(website)),
        tagged("coords", coordinate_key(lat, lng)),
        hashed,
    )


def phone_in_text(text) -> Column:
    """First phone number in free text, patterns tried in order.

    Every pattern ends in four digits, so text without such a run is not searched.
    """
    t = _col(text)
    return F.when(t.rlike(r"\d{4}"), first_present(*[F.regexp_extract(t, p, 0) for p in PHONE_PATTERNS]))


def rating_in_text(text) -> Column:
    """First decimal number; a decimal comma counts if there is no decimal point."""
    found = first_present(*[F.regexp_extract(_col(text), p, 1) for p in RATING_PATTERNS])
    return F.replace(found, F.lit(","), F.lit(".")).try_cast("double")


def number_in_label(text) -> Column:
    """First number of a rating label."""
    return nullify(F.regexp_extract(_col(text), r"(\d+\.?\d*)", 1)).try_cast("double")


def count_in_label(text) -> Column:
    """First whole number of a review label, thousands commas removed."""
    bare = F.replace(_col(text), F.lit(","), F.lit(""))
    return nullify(F.regexp_extract(bare, r"(\d+)", 1)).try_cast("bigint")


def place_key_of_url(url) -> Column:
    """The segment after ``place/``."""
    return nullify(F.regexp_extract(_col(url), r"place/([^/]+)", 1))


def coordinates_of_url(url) -> tuple[Column, Column]:
    """X11: latitude and longitude after ``@``."""
    pattern = r"@(-?\d+\.\d+),(-?\d+\.\d+)"
    return tuple(nullify(F.regexp_extract(_col(url), pattern, g)).try_cast("double") for g in (1, 2))


def business_slug(name) -> Column:
    """Name as a URL segment, company suffixes dropped one after the other."""
    bare = F.regexp_replace(F.lower(_col(name)), NOT_WORD_SPACE_OR_DASH, "")
    slug = F.regexp_replace(bare, SPACE + "+", "-")
    for suffix in COMPANY_SUFFIXES:
        slug = F.regexp_replace(slug, f"-{suffix}$", "")
    return F.when(_col(name) != "", F.regexp_replace(slug, r"^-+|-+$", ""))


def unwrap_redirect(href) -> Column:
    """Target of a search redirect link; NULL for other links."""
    return nullify(F.regexp_extract(_col(href), r"/url\?q=([^&]*)", 1))


def follower_count(description) -> Column:
    """First number of a profile description, commas removed."""
    return nullify(F.replace(F.regexp_extract(_col(description), r"([\d,]+)", 1), F.lit(","), F.lit("")))


def elapsed_hms(seconds) -> Column:
    """Whole seconds as ``hh:mm:ss``."""
    s = F.floor(_col(seconds)).cast("bigint")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)
