"""E-mail addresses in text and markup: extraction, checks, scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .presence import nullify
from .text import netloc

# Fixed values -------------------------------------------------------------------
# Each pattern comes with a literal it cannot match without (``AT_SIGNS``, same order).
EMAIL_PATTERNS = (
    r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",
    r"[a-zA-Z0-9._%+-]+\[at\][a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",
    r"[a-zA-Z0-9._%+-]+\(at\)[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",
    r"[a-zA-Z0-9._%+-]+ @ [a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",
)
AT_SIGNS = ("@", "[at]", "(at)", " @ ")
DISGUISES = ("[at]", "(at)", " @ ")
EXCLUDED_PARTS = (
    "noreply", "no-reply", "donotreply", "info@", "support@",
    "admin@", "webmaster@", "contact@", "hello@", "care@",
    "marketing@", "sales@", "enquiries@", "query@",
)
DISPOSABLE_DOMAINS = (
    "tempmail.com", "throwaway.com", "mailinator.com", "guerrillamail.com",
    "sharklasers.com", "grr.la", "mailnesia.com", "10minutemail.com",
    "yopmail.com", "temp-mail.org", "fakeinbox.com", "maildrop.cc",
    "getnada.com", "tempemail.net", "spambox.us", "trashmail.com",
)
FREE_MAIL = ("@gmail", "@yahoo", "@hotmail", "@outlook")
GENERIC = ("info@", "contact@", "support@")
CONTACT_PATHS = (
    "/contact", "/contact-us", "/contactus", "/about", "/about-us",
    "/support", "/help", "/feedback", "/team", "/staff", "/company",
    "/contact.php", "/contact.html", "/about.php", "/about.html",
)
CONTACT_FORM = "CONTACT_FORM_FOUND"
CONTEXT_CHARS = 50
MAILTO = r"""(?is)<a\s[^>]*?href\s*=\s*["']mailto:([^"'?]*)"""
META_TAG = r'(?is)<meta\s[^>]*name="email"[^>]*>'
FORM_ACTION = r'(?is)<form\s[^>]*action="([^"]*)"'
# Our syntax check: dot-atom local part, host of dotted labels, alphabetic top level.
ADDRESS = (
    r"^[A-Za-z0-9!#$%&'*+/=?^_`{|}~-]+(\.[A-Za-z0-9!#$%&'*+/=?^_`{|}~-]+)*"
    r"@([A-Za-z0-9]([A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,63}$"
)
# --------------------------------------------------------------------------------

# The same matches, but a local part is only tried where it begins (after the last match or a
# character that can't belong to it) and never given back, so long runs cost one pass.
_LINEAR_PATTERNS = tuple(r"(?:\G|(?<![a-zA-Z0-9._%+-]))" + p.replace("+-]+", "+-]++", 1) for p in EMAIL_PATTERNS)

EMAIL_HIT = "array<struct<address:string,source:string,context:string>>"


def email_domain(address: Column) -> Column:
    return F.regexp_extract(F.lower(address), r"@([^@]*)", 1)


def well_formed(address: Column) -> Column:
    # lengths first: the pattern's repeated groups recurse
    fits = (F.length(address) <= 254) & (F.length(F.substring_index(address, "@", 1)) <= 64)
    return F.when(fits, address.rlike(ADDRESS)).when(address.isNotNull(), F.lit(False))


def usable_email(address: Column, disposable=DISPOSABLE_DOMAINS) -> Column:
    """F10 with the built-in J10 list; longer lists go through ``emails.drop_disposable``."""
    low = F.lower(address)
    ok = well_formed(address)
    for part in EXCLUDED_PARTS:
        ok = ok & ~low.contains(part)
    if disposable:
        ok = ok & ~email_domain(address).isin(*disposable)
    return F.coalesce(ok, F.lit(False))


def reveal(address: Column) -> Column:
    """Undo the usual disguises of the at sign."""
    for disguise in DISGUISES:
        address = F.replace(address, F.lit(disguise), F.lit("@"))
    return address


def _hit(address: Column, source: str, context: Column) -> Column:
    return F.struct(address.alias("address"), F.lit(source).alias("source"), context.alias("context"))


def _matches_with_context(text: Column, pattern: str) -> Column:
    """Each match with up to 50 characters on both sides."""
    found = F.regexp_extract_all(text, F.lit(pattern), 0)
    between = F.transform(F.split(text, pattern, -1), lambda p: F.length(p))
    # one pass: where each match begins, from the lengths of the pieces and matches before it
    steps = F.arrays_zip(F.slice(between, 1, F.size(found)).alias("gap"), F.transform(found, lambda m: F.length(m)).alias("length"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    placed = F.aggregate(
        steps,
        zero,
        lambda a, s: F.struct((a["at"] + s["gap"] + s["length"]).alias("at"), F.array_append(a["starts"], a["at"] + s["gap"]).alias("starts")),
        lambda a: a["starts"],
    )

    def one(match, i):
        start = F.get(placed, i)
        left = F.least(start, F.lit(CONTEXT_CHARS))
        width = left + F.length(match) + F.lit(CONTEXT_CHARS)
        return _hit(reveal(match), "text_pattern", F.substring(text, start - left + 1, width))

    return F.transform(found, one)


def text_emails(text: Column, with_context: bool = False) -> Column:
    """Addresses in plain text, by pattern and then by position, unchecked.

    A pattern is only run on text that holds its at sign, which most text does not.
    """
    hits = []
    for pattern, sign in zip(_LINEAR_PATTERNS, AT_SIGNS):
        if with_context:
            found = _matches_with_context(text, pattern)
        else:
            matches = F.regexp_extract_all(text, F.lit(pattern), 0)
            found = F.transform(matches, lambda m: _hit(reveal(m), "text_pattern", F.lit(None).cast("string")))
        hits.append(F.when(text.contains(sign), found).otherwise(F.array().cast(EMAIL_HIT)))
    return F.flatten(F.array(*hits))


def mailto_emails(clean: Column) -> Column:
    """Targets of mail links."""
    found = F.regexp_extract_all(clean, F.lit(MAILTO), 1)
    hits = F.transform(found, lambda m: _hit(F.trim(m), "mailto_link", F.lit(None).cast("string")))
    return F.when(F.lower(clean).contains("mailto:"), hits).otherwise(F.array().cast(EMAIL_HIT))


def meta_emails(clean: Column) -> Column:
    """``<meta name="email">`` contents."""
    tags = F.regexp_extract_all(clean, F.lit(META_TAG), 0)
    return F.transform(
        tags, lambda t: _hit(F.regexp_extract(t, r'(?is)content="([^"]*)"', 1), "meta_tag", F.lit("meta tag"))
    )


def contact_forms(clean: Column) -> Column:
    """A marker per form that looks like a contact form."""
    actions = F.regexp_extract_all(clean, F.lit(FORM_ACTION), 1)
    wanted = F.filter(actions, lambda a: F.lower(a).rlike("contact|email|send"))
    return F.transform(
        wanted, lambda a: _hit(F.lit(CONTACT_FORM), "contact_form", F.concat(F.lit("Form action: "), a))
    )


def page_emails(clean: Column, text: Column, with_context: bool = False) -> Column:
    """U2 for one page: mail links, text, meta tags, form markers, in that order.

    Unusable addresses are left out; form markers stay.
    """

    def checked(hits):
        return F.filter(hits, lambda h: usable_email(h["address"]))

    return F.concat(
        checked(mailto_emails(clean)),
        checked(text_emails(text, with_context)),
        checked(meta_emails(clean)),
        contact_forms(clean),
    )


def local_format(local: Column) -> Column:
    """How the part before the at sign is built."""
    return (
        F.when(local.rlike(r"^\p{L}+\.\p{L}+$"), "first.last")
        .when(local.contains("_"), "first_last")
        .when(local.rlike(r"^\p{L}+$"), "single_name")
        .when(local.rlike(r"^\p{Nd}+$"), "numeric")
        .when(local.rlike(r"^[a-z]+\p{Nd}+$"), "name_number")
        .otherwise("custom")
    )


def priority_score(address: Column, source: Column, verified: Column) -> Column:
    """Free mail +10, generic box -5, verified +20, taken from a mail link +15."""
    low = F.lower(address)

    def any_of(parts):
        test = low.contains(parts[0])
        for p in parts[1:]:
            test = test | low.contains(p)
        return test

    def points(test, n):
        return F.when(test, n).otherwise(0)

    return (
        points(any_of(FREE_MAIL), 10)
        + points(any_of(GENERIC), -5)
        + points(F.coalesce(verified, F.lit(False)), 20)
        + points(F.coalesce(source == "mailto_link", F.lit(False)), 15)
    )


def join_url(base: Column, ref: Column) -> Column:
    """A link as seen from a page: absolute, scheme-relative, root-relative or relative."""
    scheme = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.\-]*:)", 1)
    root = F.concat(scheme, F.lit("//"), netloc(base))
    folder = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.\-]*://[^?#]*/)[^/?#]*", 1)
    return (
        F.when(ref.rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*:"), ref)
        .when(ref.startswith("//"), F.concat(scheme, ref))
        .when(ref.startswith("/"), F.concat(root, ref))
        .when(ref == "", base)
        .otherwise(F.concat(F.coalesce(nullify(F.when(folder.rlike(r"//[^/]+/"), folder)), F.concat(root, F.lit("/"))), ref))
    )


def contact_page_urls(website: Column, pages: int = 5) -> Column:
    """Where a site's contact data usually is, first ``pages`` paths."""
    return F.array(*[join_url(website, F.lit(p)) for p in CONTACT_PATHS[:pages]])
