"""Registered queries over pages and free text: extraction, contacts, profiles, labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import contacts, html, names, social, text
from ..functions.html import (
    ADDRESS_TAGS, ANCHOR, AUTHORITY_TAG, CATEGORY_TAGS, DETAIL_HEADINGS, DETAIL_NOT_NAMES, ENTITIES, HREF, INVISIBLE,
    PAGE_LABELS, PHONE_BUTTON, PHONE_LABEL, PHONE_LINK, PHONE_LINK_TEXT, PRICE_TAGS, RATING_TAGS, REVIEW_TAGS, WHEELCHAIR,
)
from ..operators import emails, pages
from .registry import BIZ, d_netloc, d_netloc_or_path, joined, lit, map_text, query
from .views import businesses, duck_with, table, view

PAGES = duck_with("pages_x")


def _unescape(x: str) -> str:
    for entity, char in ENTITIES:
        x = f"replace({x}, {lit(entity)}, {lit(char)})"
    return x


CLEAN = PAGES + f", clean AS (SELECT *, regexp_replace(html, {lit(INVISIBLE)}, '', 'g') AS m FROM pages_x)\n"
_PAGE_TEXT = _unescape("regexp_replace(m, '<[^>]*>', '', 'g')")
TEXTS = CLEAN + f", texts AS (SELECT *, {_PAGE_TEXT} AS t FROM clean)\n"


def _tag(tag: tuple[str, str], m: str = "m") -> str:
    pattern = tag[1]
    return f"trim({_unescape(f'regexp_extract({m}, {lit(pattern)}, 1)')})"


def _first_tag(patterns) -> str:
    return "coalesce(" + ", ".join(f"nullif({_tag(p)}, '')" for p in patterns) + ")"


def pages_x(spark, sf):
    return view(spark, sf, "pages_x")


def _phone(x: str) -> str:
    return "coalesce(" + ", ".join(f"nullif(regexp_extract({x}, {lit(p)}, 0), '')" for p in text.PHONE_PATTERNS) + ")"


def _rating(x: str) -> str:
    found = ", ".join(f"nullif(regexp_extract({x}, {lit(p)}, 1), '')" for p in text.RATING_PATTERNS)
    return f"TRY_CAST(replace(coalesce({found}), ',', '.') AS DOUBLE)"


@query("x7_x8_phone_rating_in_documents", f"SELECT doc_id, {_phone('text')} AS phone, {_rating('text')} AS rating FROM documents")
def x7_x8(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", text.phone_in_text("text").alias("phone"), text.rating_in_text("text").alias("rating"))


@query("x7_x8_phone_rating_in_pages", TEXTS + f"SELECT page_id, {_phone('t')} AS phone, {_rating('t')} AS rating FROM texts")
def x7_x8_pages(spark, sf):
    t = pages_x(spark, sf).select("page_id", html.page_text(F.col("html")).alias("t"))
    return t.select("page_id", text.phone_in_text("t").alias("phone"), text.rating_in_text("t").alias("rating"))


_USABLE_PAGE = "(trim(t) <> '' OR length(html) >= 1000) AND NOT regexp_matches(html, '(?i)captcha|unusual traffic')"


@query("f11_f12_usable_pages", TEXTS + f"SELECT page_id FROM texts WHERE {_USABLE_PAGE}")
def f11(spark, sf):
    return pages.usable_pages(pages_x(spark, sf)).select("page_id")


@query("f12_blocked_flag", PAGES + "SELECT page_id, regexp_matches(html, '(?i)captcha|unusual traffic') AS blocked FROM pages_x")
def f12(spark, sf):
    return pages_x(spark, sf).select("page_id", html.page_blocked(F.col("html")).alias("blocked"))


def _label_sql() -> str:
    kinds = []
    for i, (label, patterns) in enumerate(PAGE_LABELS):
        hits = " + ".join(f"regexp_matches(html, {lit('(?i)' + p)})::INT" for p in patterns)
        kinds.append(f"SELECT page_id, '{label}' AS label, {i} AS pos, ({hits}) / {float(len(patterns))} * 100 AS score FROM pages_x")
    return (
        "SELECT page_id, label, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, pos) AS r FROM ("
        + " UNION ALL ".join(kinds)
        + ") k) x WHERE r = 1 AND score > 0"
    )


@query("x36_page_labels", PAGES + _label_sql())
def x36(spark, sf):
    return pages.labelled_pages(pages_x(spark, sf))


_DETAIL_NAME = "coalesce(" + ", ".join(
    f"list_filter(list_transform(regexp_extract_all(m, {lit(p)}, 1), lambda h: trim({_unescape('h')})),"
    f" lambda h: h NOT IN ({', '.join(lit(n) for n in DETAIL_NOT_NAMES)}) AND length(h) > 2)[1]"
    for _, p in DETAIL_HEADINGS
) + ")"


def _digit_text(pattern: str) -> str:
    return f"CASE WHEN regexp_matches({_tag(pattern)}, '[0-9]') THEN {_tag(pattern)} END"


_PHONE_OF_PAGE = (
    f"coalesce({_digit_text(PHONE_BUTTON)}, {_digit_text(PHONE_LINK_TEXT)}, nullif(regexp_extract(m, {lit(PHONE_LINK[1])}, 1), ''), {_digit_text(PHONE_LABEL)})"
)
_WEBSITE = (
    f"coalesce(nullif(regexp_extract(regexp_extract(m, {lit(AUTHORITY_TAG[1])}, 0), '(?i)href=\"([^\"]*)\"', 1), ''),"
    f" list_filter(regexp_extract_all(m, {lit(HREF)}, 1), lambda h: h LIKE 'http%' AND h NOT LIKE '%google%')[1])"
)
_ADDRESS = "coalesce(" + ", ".join(f"CASE WHEN length({_tag(p)}) > 5 THEN {_tag(p)} END" for p in ADDRESS_TAGS) + ")"
_LABEL_RATING = "coalesce(" + ", ".join(f"TRY_CAST(regexp_extract({_tag(p)}, '(\\d+\\.?\\d*)', 1) AS DOUBLE)" for p in RATING_TAGS) + ")"
_LABEL_COUNT = "coalesce(" + ", ".join(f"TRY_CAST(regexp_extract(replace({_tag(p)}, ',', ''), '(\\d+)', 1) AS BIGINT)" for p in REVIEW_TAGS) + ")"
_DETAIL = f"""SELECT page_id, {_DETAIL_NAME} AS name, {_PHONE_OF_PAGE} AS phone, {_WEBSITE} AS website, {_ADDRESS} AS address,
  {_first_tag(CATEGORY_TAGS)} AS category, {_LABEL_RATING} AS rating, {_LABEL_COUNT} AS reviews, {_first_tag(PRICE_TAGS)} AS price_range,
  CASE WHEN regexp_matches(m, {lit(WHEELCHAIR)}) THEN true END AS wheelchair_accessible,
  nullif(regexp_extract(place_url, 'place/([^/]+)', 1), '') AS place_id,
  TRY_CAST(regexp_extract(place_url, '@(-?\\d+\\.\\d+),(-?\\d+\\.\\d+)', 1) AS DOUBLE) AS latitude,
  TRY_CAST(regexp_extract(place_url, '@(-?\\d+\\.\\d+),(-?\\d+\\.\\d+)', 2) AS DOUBLE) AS longitude
FROM clean"""


@query("x16_detail_records", CLEAN + _DETAIL)
def x16(spark, sf):
    return pages.detail_records(pages_x(spark, sf))


@query("f9_detail_names", CLEAN + f"SELECT page_id, {_DETAIL_NAME} AS name FROM clean")
def f9(spark, sf):
    p = pages_x(spark, sf).select("page_id", html.markup(F.col("html")).alias("m")).withColumn("low", F.lower("m"))
    return p.select("page_id", html.detail_name(F.col("m"), F.col("low")).alias("name"))


@query(
    "x10_x11_url_fields",
    PAGES + """SELECT page_id, nullif(regexp_extract(place_url, 'place/([^/]+)', 1), '') AS place_id,
      TRY_CAST(regexp_extract(place_url, '@(-?\\d+\\.\\d+),(-?\\d+\\.\\d+)', 1) AS DOUBLE) AS lat,
      TRY_CAST(regexp_extract(place_url, '@(-?\\d+\\.\\d+),(-?\\d+\\.\\d+)', 2) AS DOUBLE) AS lng FROM pages_x""",
)
def x10(spark, sf):
    lat, lng = text.coordinates_of_url("place_url")
    return pages_x(spark, sf).select("page_id", text.place_key_of_url("place_url").alias("place_id"), lat.alias("lat"), lng.alias("lng"))


# -- names -----------------------------------------------------------------------


def _plausible(x: str) -> str:
    bad = " OR ".join(f"regexp_matches({x}, {lit('(?i)' + p)})" for p in names.NOT_NAMES)
    return f"coalesce(length({x}) BETWEEN 2 AND 100 AND regexp_matches({x}, '[a-zA-Z]') AND NOT ({bad}), false)"


def _confidence(x: str, place: int) -> str:
    bonus = 15 if place < 5 else 10 if place < 10 else 5
    return (
        f"least(100, {80 + bonus} + CASE WHEN upper({x}) = {x} AND lower({x}) <> {x} AND length({x}) > 3 THEN 5 ELSE 0 END"
        f" + CASE WHEN regexp_matches({x}, '[&\\-''.]') THEN 3 ELSE 0 END"
        f" + CASE WHEN regexp_matches({x}, '^\\p{{Lu}}') AND regexp_matches({x}, '\\p{{L}}$') THEN 2 ELSE 0 END)"
    )


def _names_sql() -> str:
    links = f"list_filter(regexp_extract_all(m, {lit(ANCHOR)}, 0), lambda a: regexp_matches(a, {lit(names.PLACE_LINK)}))"
    cols, cases, scores = [], [], []
    for i, (where, _, pattern) in enumerate(names.NAME_PLACES):
        if where == "link":
            raw = f"coalesce(list_filter(list_transform({links}, lambda a: regexp_extract(a, {lit(pattern)}, 1)), lambda h: h <> '')[1], '')"
        else:
            raw = f"regexp_extract(m, {lit(pattern)}, 1)"
        cols.append(f"trim({_unescape(raw)}) AS n{i}")
        cases.append(f"WHEN {_plausible(f'n{i}')} THEN n{i}")
        scores.append(f"WHEN {_plausible(f'n{i}')} THEN {_confidence(f'n{i}', i)}")
    cols.append("trim(t) AS w")
    cases.append(f"WHEN {_plausible('w')} THEN split_part(w, chr(10), 1)")
    scores.append(f"WHEN {_plausible('w')} THEN 50")
    for j, pattern in enumerate(names.ATTRIBUTE_PATTERNS):
        cols.append(f"nullif(regexp_extract(m, {lit(pattern)}, 1), '') AS a{j}")
        cases.append(f"WHEN {_plausible(f'a{j}')} THEN a{j}")
        scores.append(f"WHEN {_plausible(f'a{j}')} THEN 30")
    return (
        f"SELECT page_id, CASE {' '.join(cases)} ELSE 'Unknown' END AS name, CAST(CASE {' '.join(scores)} ELSE 30 END AS INT) AS confidence"
        f" FROM (SELECT page_id, {', '.join(cols)} FROM texts) x"
    )


@query("x17_x19_page_names", TEXTS + _names_sql())
def x17(spark, sf):
    return pages.page_names(pages_x(spark, sf))


@query("f8_plausible_names", BIZ + f"SELECT seq, {_plausible('name')} AS plausible, {_plausible('address')} AS address_plausible FROM biz")
def f8(spark, sf):
    b = view(spark, sf, "biz")
    return b.select("seq", names.plausible_name(F.col("name")).alias("plausible"), names.plausible_name(F.col("address")).alias("address_plausible"))


@query("x18_name_confidence", BIZ + f"SELECT seq, CAST({_confidence('name', 0)} AS INT) AS first_place, CAST({_confidence('name', 7)} AS INT) AS later_place FROM biz")
def x18(spark, sf):
    b = view(spark, sf, "biz")
    return b.select("seq", names.name_confidence(F.col("name"), 0).alias("first_place"), names.name_confidence(F.col("name"), 7).alias("later_place"))


# -- e-mail ----------------------------------------------------------------------


def _usable(x: str) -> str:
    parts = " AND ".join(f"NOT contains(lower({x}), {lit(p)})" for p in contacts.EXCLUDED_PARTS)
    domains = ", ".join(lit(d) for d in contacts.DISPOSABLE_DOMAINS)
    return (
        f"(regexp_matches({x}, {lit(contacts.ADDRESS)}) AND length({x}) <= 254 AND length(split_part({x}, '@', 1)) <= 64"
        f" AND {parts} AND split_part(lower({x}), '@', 2) NOT IN ({domains}))"
    )


def _hits(source: str, values: str, method: int, key: str, frm: str, extra: str = "") -> str:
    """Rows (key, method, pos, address, source) from a list expression."""
    return (
        f"SELECT {key}, {method} AS method, unnest(generate_series(1, len(vals))) AS pos, unnest(vals) AS address, '{source}' AS source{extra}"
        f" FROM (SELECT *, {values} AS vals FROM {frm}) v"
    )


def _reveal(x: str) -> str:
    for d in contacts.DISGUISES:
        x = f"replace({x}, {lit(d)}, '@')"
    return x


_FORMS = (
    f"list_transform(list_filter(regexp_extract_all(m, {lit(contacts.FORM_ACTION)}, 1), lambda a: regexp_matches(lower(a), 'contact|email|send')),"
    f" lambda a: '{contacts.CONTACT_FORM}')"
)
_MAILTOS = f"list_transform(regexp_extract_all(m, {lit(contacts.MAILTO)}, 1), lambda a: trim(a))"
_METAS = f"list_transform(regexp_extract_all(m, {lit(contacts.META_TAG)}, 0), lambda a: regexp_extract(a, '(?is)content=\"([^\"]*)\"', 1))"


def _text_matches(pattern: str, t: str) -> str:
    return f"list_transform(regexp_extract_all({t}, {lit(pattern)}, 0), lambda a: {_reveal('a')})"


_HITS = TEXTS + ", hits AS (SELECT * FROM (" + " UNION ALL ".join(
    [_hits("mailto_link", _MAILTOS, 1, "host AS site, page_id", "texts")]
    + [_hits("text_pattern", _text_matches(p, "t"), 2 + i, "host AS site, page_id", "texts") for i, p in enumerate(contacts.EMAIL_PATTERNS)]
    + [_hits("meta_tag", _METAS, 8, "host AS site, page_id", "texts")]
) + f") h WHERE {_usable('address')} UNION ALL " + _hits("contact_form", _FORMS, 9, "host AS site, page_id", "texts") + ")\n"


@query("u2_x22_page_emails", _HITS + "SELECT site, page_id, address, source, row_number() OVER (PARTITION BY page_id ORDER BY method, pos) - 1 AS pos FROM hits")
def u2(spark, sf):
    hits = emails.emails_of_pages(pages_x(spark, sf))
    return hits.select("site", "page_id", "address", "source", F.col("pos").cast("bigint").alias("pos"))


_FIRST = _HITS + """, firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site, lower(address) ORDER BY page_id, method, pos) AS r
  FROM hits WHERE address <> 'CONTACT_FORM_FOUND') x WHERE r = 1)
"""


@query("u1_distinct_emails", _FIRST + "SELECT site, address, source, page_id FROM firsts")
def u1(spark, sf):
    return emails.distinct_emails(emails.emails_of_pages(pages_x(spark, sf))).select("site", "address", "source", "page_id")


_SCORE = """CASE WHEN regexp_matches(lower(address), '@gmail|@yahoo|@hotmail|@outlook') THEN 10 ELSE 0 END
  - CASE WHEN regexp_matches(lower(address), 'info@|contact@|support@') THEN 5 ELSE 0 END
  + CASE WHEN page_id % 2 = 0 THEN 20 ELSE 0 END + CASE WHEN source = 'mailto_link' THEN 15 ELSE 0 END"""


@query(
    "l1_w8_ranked_emails",
    _FIRST + f"""SELECT site, address, source, priority_score, rank FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY priority_score DESC, page_id, method, pos) AS rank
    FROM (SELECT *, {_SCORE} AS priority_score FROM firsts) s) r WHERE rank <= 10""",
)
def l1_w8(spark, sf):
    found = emails.distinct_emails(emails.emails_of_pages(pages_x(spark, sf)))
    ranked = emails.ranked_emails(found.withColumn("verified", F.col("page_id") % 2 == 0))
    return ranked.select("site", "address", "source", "priority_score", "rank")


_DOC_HITS = "WITH hits AS (" + " UNION ALL ".join(
    _hits("text_pattern", _text_matches(p, "text"), i, "doc_id", "documents") for i, p in enumerate(contacts.EMAIL_PATTERNS)
) + ")\n"


@query("x20_document_emails", _DOC_HITS + "SELECT doc_id, address, row_number() OVER (PARTITION BY doc_id ORDER BY method, pos) - 1 AS pos FROM hits")
def x20(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.posexplode(contacts.text_emails(F.col("text"))).alias("pos", "hit"))
    return d.select("doc_id", "hit.address", F.col("pos").cast("bigint").alias("pos"))


def _context_sql() -> str:
    """Each match with its surroundings, by walking the pieces between matches."""
    parts = []
    for i, p in enumerate(contacts.EMAIL_PATTERNS):
        parts.append(
            f"""SELECT doc_id, {i} AS method, j AS pos, {_reveal('f[j]')} AS address,
              substr(text, greatest(s - 50, 0) + 1, least(s, 50) + length(f[j]) + 50) AS context
            FROM (SELECT doc_id, text, f, j, CAST(list_sum(list_transform(g[1:j], lambda x: length(x))) + coalesce(list_sum(list_transform(f[1:j - 1], lambda x: length(x))), 0) AS BIGINT) AS s
              FROM (SELECT doc_id, text, f, g, unnest(generate_series(1, len(f))) AS j
                FROM (SELECT doc_id, text, regexp_extract_all(text, {lit(p)}, 0) AS f, string_split_regex(text, {lit(p)}) AS g FROM documents) a) b) c"""
        )
    return " UNION ALL ".join(parts)


@query("x21_email_context", f"SELECT doc_id, address, context FROM ({_context_sql()}) x")
def x21(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.inline(contacts.text_emails(F.col("text"), with_context=True))).drop("source")


@query("f10_usable_emails", _DOC_HITS + f"SELECT doc_id, address, {_usable('address')} AS usable FROM hits")
def f10(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.inline(contacts.text_emails(F.col("text"))))
    return d.select("doc_id", "address", contacts.usable_email(F.col("address")).alias("usable"))


def _format(x: str) -> str:
    return (
        f"CASE WHEN regexp_matches({x}, '^\\p{{L}}+\\.\\p{{L}}+$') THEN 'first.last' WHEN contains({x}, '_') THEN 'first_last'"
        f" WHEN regexp_matches({x}, '^\\p{{L}}+$') THEN 'single_name' WHEN regexp_matches({x}, '^\\p{{Nd}}+$') THEN 'numeric'"
        f" WHEN regexp_matches({x}, '^[a-z]+\\p{{Nd}}+$') THEN 'name_number' ELSE 'custom' END"
    )


@query("x23_local_format", _DOC_HITS + f"SELECT doc_id, address, {_format(chr(115) + 'plit_part(address, ' + lit('@') + ', 1)')} AS email_format FROM hits")
def x23(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.inline(contacts.text_emails(F.col("text"))))
    return d.select("doc_id", "address", contacts.local_format(F.split_part("address", F.lit("@"), F.lit(1))).alias("email_format"))


@query(
    "x24_email_priority",
    BIZ + """SELECT seq, address, CASE WHEN regexp_matches(lower(address), '@gmail|@yahoo|@hotmail|@outlook') THEN 10 ELSE 0 END
      - CASE WHEN regexp_matches(lower(address), 'info@|contact@|support@') THEN 5 ELSE 0 END
      + CASE WHEN verified THEN 20 ELSE 0 END + CASE WHEN claimed THEN 15 ELSE 0 END AS priority_score
    FROM (SELECT seq, verified, claimed, unnest(string_split(emails, ',')) AS address FROM biz WHERE emails <> '') x""",
)
def x24(spark, sf):
    b = businesses(spark, sf).select("seq", "verified", "claimed", F.explode("emails").alias("address"))
    source = F.when(F.col("claimed"), "mailto_link").otherwise("text_pattern")
    return b.select("seq", "address", contacts.priority_score(F.col("address"), source, F.col("verified")).alias("priority_score"))


@query(
    "x25_contact_urls",
    f"""SELECT page_id, regexp_extract(url, '^([a-zA-Z]+:)', 1) || '//' || {d_netloc('url')} || p AS contact_url
    FROM pages, unnest(['/contact', '/contact-us', '/contactus', '/about', '/about-us']) t(p)""",
)
def x25(spark, sf):
    p = table(spark, sf, "pages")
    return p.select("page_id", F.explode(contacts.contact_page_urls(F.col("url"))).alias("contact_url"))


_ADDR = BIZ + f""", addr AS (SELECT split_part({d_netloc_or_path('website')}, '/', 1) AS site, split_part(a, '@', 2) AS dom, split_part(a, '@', 1) AS loc
  FROM (SELECT website, unnest(string_split(emails, ',')) AS a FROM biz WHERE website <> '' AND emails <> '') x WHERE contains(a, '@'))
"""


@query("a6_email_domains", _ADDR + "SELECT dom AS email_domain, count(*) AS n FROM addr GROUP BY dom")
def a6(spark, sf):
    return emails.email_domains(businesses(spark, sf))


@query("a7_email_formats", _ADDR + f"SELECT {_format('loc')} AS email_format, count(*) AS n FROM addr WHERE dom = site AND site <> '' GROUP BY 1")
def a7(spark, sf):
    return emails.email_formats(businesses(spark, sf))


# -- social profiles -------------------------------------------------------------


def _join_url(base: str, ref: str) -> str:
    root = f"regexp_extract({base}, '^([a-zA-Z]+:)', 1) || '//' || {d_netloc(base)}"
    return f"CASE WHEN regexp_matches({ref}, '^[a-zA-Z][a-zA-Z0-9+.\\-]*:') THEN {ref} WHEN {ref} LIKE '/%' THEN {root} || {ref} END"


def _social_sql() -> str:
    links = {
        p: "coalesce(" + ", ".join(f"list_filter(regexp_extract_all(m, {lit(HREF)}, 1), lambda h: regexp_matches(h, {lit(r)}))[1]" for r in rs) + ")"
        for p, rs in social.PLATFORM_LINKS.items()
    }
    icons = {}
    for p, classes in social.ICON_CLASSES.items():
        anchors = f"regexp_extract_all(m, {lit(ANCHOR)}, 0)"
        options = []
        for c in classes:
            wrap = f"list_filter({anchors}, lambda a: regexp_matches(a, {lit('(?is)class=' + chr(34) + '[^' + chr(34) + ']*' + c)}))[1]"
            href = f"nullif(regexp_extract({wrap}, '(?is)href\\s*=\\s*\"([^\"]*)\"', 1), '')"
            options.append(_join_url("url", href))
        icons[p] = f"coalesce({', '.join(options)})"
    meta = []
    for p in social.PLATFORM_LINKS:
        tag = f"regexp_extract(m, {lit('(?is)<meta' + chr(92) + 's[^>]*property=' + chr(34) + f'al:{p}:url' + chr(34) + '[^>]*>')}, 0)"
        meta.append(f"WHEN {tag} <> '' THEN '{p}=' || regexp_extract({tag}, '(?is)content=\"([^\"]*)\"', 1)")

    def text_of(d):
        return "concat_ws('|', " + ", ".join(f"'{p}=' || {d[p]}" for p in sorted(d)) + ")"

    return f"""SELECT page_id, CASE WHEN l <> '' THEN l WHEN i <> '' THEN i ELSE coalesce(x, '') END AS social_media FROM (
      SELECT page_id, {text_of(links)} AS l, {text_of(icons)} AS i, CASE {' '.join(meta)} END AS x FROM clean) s"""


@query("x26_x27_page_social", CLEAN + _social_sql())
def x26(spark, sf):
    return pages.page_social(pages_x(spark, sf)).withColumn("social_media", map_text("social_media"))


def _contacts_sql() -> str:
    """The rows of U2 and of X26 and X27 together."""
    entry = "string_split(p, '=')[1]"
    mails = "SELECT page_id, CASE WHEN source = 'contact_form' THEN 'contact_form' ELSE 'email' END AS kind, address AS value, source FROM hits"
    links = f"SELECT page_id, 'social' AS kind, substr(p, length({entry}) + 2) AS value, {entry} AS source FROM (SELECT page_id, unnest(string_split(social_media, '|')) AS p FROM profiles WHERE social_media <> '')"
    return _HITS + f", profiles AS (SELECT * FROM ({CLEAN + _social_sql()})) {mails} UNION ALL {links}"


@query("extract_contacts", _contacts_sql())
def all_contacts(spark, sf):
    return pages.extract_contacts(pages_x(spark, sf)).select("page_id", "kind", "value", "source")


@query(
    "x28_profile_candidates",
    BIZ + f"""SELECT seq, p AS platform, u || CASE WHEN w = 'name' THEN slug ELSE dom END AS url FROM (
      SELECT seq, regexp_replace(regexp_replace(regexp_replace(lower(name), '[^\\p{{L}}\\p{{N}}_\\s-]', '', 'g'), '\\s+', '-', 'g'), '^-+|-+$', '', 'g') AS slug,
        split_part({d_netloc_or_path('website')}, '.', 1) AS dom FROM biz WHERE name <> '' AND website <> '') b,
      (VALUES {', '.join(f"({lit(p)}, {lit(u)}, {lit(w)})" for p, u, w in social.PROFILE_URLS)}) t(p, u, w)""",
)
def x28(spark, sf):
    b = view(spark, sf, "biz")
    return b.select("seq", F.inline(social.profile_candidates(F.col("name"), F.col("website"))))


@query(
    "x30_u3_social_presence",
    BIZ + """SELECT seq, (facebook IS NOT NULL)::BIGINT + (instagram IS NOT NULL)::BIGINT AS platforms_count,
      concat_ws('|', CASE WHEN facebook IS NOT NULL THEN 'facebook' END, CASE WHEN instagram IS NOT NULL THEN 'instagram' END) AS platforms,
      CAST(least(100, 3 * (CASE WHEN facebook IS NOT NULL THEN 8 ELSE 0 END + CASE WHEN instagram IS NOT NULL THEN 10 ELSE 0 END)) AS INT) AS engagement_score,
      concat_ws('|', CASE WHEN instagram IS NULL THEN 'instagram' END, CASE WHEN facebook IS NULL THEN 'facebook' END, 'linkedin', 'youtube') AS missing,
      (facebook IS NULL)::BIGINT + (instagram IS NULL)::BIGINT + 1 AS recommendations
    FROM biz""",
)
def x30(spark, sf):
    out = pages.social_presence(businesses(spark, sf), "seq")
    return out.select(
        "seq", "platforms_count", joined("platforms").alias("platforms"), "engagement_score", joined("missing").alias("missing"),
        F.size("recommendations").cast("bigint").alias("recommendations"),
    )


@query(
    "x31_redirect_followers",
    """SELECT page_id, url AS target, CAST(page_id AS VARCHAR) || '234' AS followers FROM (SELECT page_id, split_part(url, '&', 1) AS url FROM pages) x""",
)
def x31(spark, sf):
    p = table(spark, sf, "pages")
    link = F.concat(F.lit("https://search.example/url?q="), "url", F.lit("&sa=U"))
    text_ = F.concat(F.col("page_id").cast("string"), F.lit(",234 Followers, 12 Following"))
    return p.select("page_id", text.unwrap_redirect(link).alias("target"), text.follower_count(text_).alias("followers"))
