"""Detail records, names and profiles from collected pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import contacts, social
from ..functions import html as h
from ..functions.names import name_of_markup
from ..functions.text import coordinates_of_url, place_key_of_url


def usable_pages(pages: DataFrame) -> DataFrame:
    """drops empty pages and challenge pages."""
    html = F.col("html")
    return pages.filter(h.page_usable(html) & ~h.page_blocked(html))


def labelled_pages(pages: DataFrame) -> DataFrame:
    """(page_id, label, score) of pages that look like a challenge."""
    low = pages.select("page_id", F.lower("html").alias("low"))
    # inline, not a filter: a filter would be pushed below and compute the label twice
    best = F.array_compact(F.array(h.page_label(F.col("low"))))
    found = low.select("page_id", F.inline(best))
    return found.select("page_id", "label", F.round("score", 4).alias("score"))


def _clean(pages: DataFrame, *cols: str) -> DataFrame:
    """Pages without scripts, styles and comments (``clean``), also in lower case (``low``)."""
    clean = pages.select("page_id", *cols, h.markup(F.col("html")).alias("clean"))
    return clean.withColumn("low", F.lower("clean"))


def detail_records(pages: DataFrame) -> DataFrame:
    """One record per place page from its markup (X9, X12-X15) and URL.

    Pages that are not place pages give a record of NULLs.
    """
    c, low, url = F.col("clean"), F.col("low"), F.col("place_url")
    lat, lng = coordinates_of_url(url)
    fields = {
        "name": h.detail_name(c, low),
        "phone": h.phone_of_page(c, low),
        "website": h.website_of_page(c, low),
        "address": h.address_of_page(c, low),
        "category": h.first_tag_text(c, low, h.CATEGORY_TAGS),
        "rating": h.rating_of_page(c, low),
        "reviews": h.review_count_of_page(c, low),
        "price_range": h.first_tag_text(c, low, h.PRICE_TAGS),
        "wheelchair_accessible": h.wheelchair_of_page(c, low),
        "place_id": place_key_of_url(url),
        "latitude": lat,
        "longitude": lng,
    }
    on_place = url.contains("/maps/place/")
    return _clean(pages, "place_url").select("page_id", *[F.when(on_place, v).alias(k) for k, v in fields.items()])


def extract_contacts(pages: DataFrame, with_context: bool = True) -> DataFrame:
    """Everything that reaches a business, from one reading of each page: (page_id, kind, value, source, context).

    ``email`` and ``contact_form`` rows are those of U2 and X22 with the text around them (X21), ``social`` rows the profiles of
    X26 and X27, whose ``source`` is the platform.
    """
    read = _clean(pages, "url").withColumn("text", h.visible_text(F.col("clean")))
    profiles = _profiles(read).select("page_id", "clean", "text", "found")

    def row(kind, value, source, context):
        return F.struct(kind.alias("kind"), value.alias("value"), source.alias("source"), context.alias("context"))

    hits = contacts.page_emails(F.col("clean"), F.col("text"), with_context)
    form = F.lit(contacts.CONTACT_FORM)
    mails = F.transform(hits, lambda e: row(F.when(e.address == form, "contact_form").otherwise("email"), e.address, e.source, e.context))
    links = F.transform(F.map_entries("found"), lambda e: row(F.lit("social"), e.value, e.key, F.lit(None).cast("string")))
    return profiles.select("page_id", F.inline(F.concat(mails, links)))


def page_names(pages: DataFrame) -> DataFrame:
    """(page_id, name, confidence)."""
    texts = _clean(pages).withColumn("text", h.visible_text(F.col("clean")))
    named = texts.select("page_id", name_of_markup(F.col("clean"), F.col("low"), F.col("text")).alias("n"))
    return named.select("page_id", "n.*")


def page_social(pages: DataFrame) -> DataFrame:
    """(page_id, social_media); each fallback runs only where nothing was found so far."""
    return _profiles(_clean(pages, "url")).select("page_id", F.col("found").alias("social_media"))


def _profiles(clean: DataFrame) -> DataFrame:
    """Adds ``found``, the profiles of pages (clean, low, url)."""
    found = clean.withColumn("links", h.hrefs(F.col("clean")))
    found = found.withColumn("found", social.linked_profiles(F.col("links")))
    missing = F.size("found") == 0
    with_icons = missing & social.mentions_icon(F.col("low"))
    found = found.withColumn("anchors", F.when(with_icons, F.regexp_extract_all("clean", F.lit(h.ANCHOR), 0)))
    icons = F.when(F.col("anchors").isNotNull(), social.icon_profiles(F.col("anchors"), F.col("url")))
    found = found.withColumn("found", F.when(missing, F.coalesce(icons, F.col("found"))).otherwise(F.col("found")))
    meta = F.when(F.col("low").contains(social.META_MARK), social.meta_profile(F.col("clean")))
    return found.withColumn("found", F.when(missing, F.coalesce(meta, F.col("found"))).otherwise(F.col("found")))


def social_presence(df: DataFrame, key: str, profiles: str = "social_media") -> DataFrame:
    """Platforms, their count, score and recommendations."""
    p = F.col(profiles)
    return df.select(
        key,
        F.size(p).cast("bigint").alias("platforms_count"),
        F.map_keys(p).alias("platforms"),
        social.social_score(p).alias("engagement_score"),
        social.missing_platforms(p).alias("missing"),
        social.advice(p).alias("recommendations"),
    )
