"""Enrichment of businesses from lookup tables.

Lookup tables hold one row per key after ``one_per_key``, so a hot key on the business
side never multiplies rows, and AQE may split it. A side is broadcast only if the
optimizer's estimate proves it small (``session.small_side``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.contacts import email_domain
from ..functions.presence import has, present
from ..functions.text import lookup_domain
from ..session import small_side

CLOSED_OK_STATUS = 200  # fixed value


def one_per_key(lookup: DataFrame, key: str) -> DataFrame:
    """One row per key: the smallest by its columns, so the choice is repeatable."""
    rest = [c for c in lookup.columns if c != key]
    best = lookup.groupBy(key).agg(F.min(F.struct(*rest)).alias("__row"))
    return best.select(key, *[F.col(f"__row.{c}").alias(c) for c in rest])


def _with_domain(df: DataFrame) -> DataFrame:
    return df.withColumn("__domain", F.when(has(df, "website"), lookup_domain("website")))


def _prefixed(lookup: DataFrame, key: str, new_key: str) -> DataFrame:
    return lookup.select(F.col(key).alias(new_key), *[F.col(c).alias("__l_" + c) for c in lookup.columns if c != key])


def enrich_places(df: DataFrame, places: DataFrame) -> DataFrame:
    """Phone and website only if absent; opening hours and price level if the place has them."""
    p = _prefixed(one_per_key(places, "place_id"), "place_id", "place_id")
    j = df.join(small_side(p), "place_id", "left")

    def keep_own(c):
        return F.when(has(df, c), F.col(c)).otherwise(F.coalesce("__l_" + c, c))

    level_given = F.coalesce(F.col("__l_price_level") != 0, F.lit(False))
    out = {
        "phone": keep_own("phone"),
        "website": keep_own("website"),
        "opening_hours": F.coalesce("__l_opening_hours", "opening_hours") if "opening_hours" in df.columns else F.col("__l_opening_hours"),
        "price_level": F.when(level_given, F.col("__l_price_level")),
        "enriched_places": F.col("__l_website").isNotNull() | F.col("__l_phone").isNotNull(),
    }
    own = [c for c in df.columns if c not in out]
    return j.select(*own, *[v.alias(k) for k, v in out.items()])


def enrich_registry(df: DataFrame, registry: DataFrame) -> DataFrame:
    """A ``whois`` struct, and the registered address only if there is no e-mail yet."""
    r = _prefixed(one_per_key(registry, "domain"), "domain", "__domain")
    j = _with_domain(df).join(small_side(r), "__domain", "left")
    fields = ("registrar", "creation_date", "expiration_date", "name_servers")
    known = F.col("__l_registrar").isNotNull()
    whois = F.when(known, F.struct(*[F.col("__l_" + f).alias(f) for f in fields]))
    fill = ~has(df, "emails") & present("__l_email", registry.schema["email"].dataType)
    emails = F.when(fill, F.array("__l_email")).otherwise(F.col("emails"))
    return j.select(*[c for c in df.columns if c != "emails"], emails.alias("emails"), whois.alias("whois"))


def enrich_company(df: DataFrame, companies: DataFrame) -> DataFrame:
    """A ``company`` struct of eight fields."""
    c = _prefixed(one_per_key(companies, "domain"), "domain", "__domain")
    j = _with_domain(df).join(small_side(c), "__domain", "left")
    fields = ("name", "description", "industry", "employees", "market_cap", "founded_year", "phone", "email_provider")
    company = F.when(F.col("__l_name").isNotNull(), F.struct(*[F.col("__l_" + f).alias(f) for f in fields]))
    return j.select(*df.columns, company.alias("company"))


def enrich_contacts(df: DataFrame, contacts: DataFrame) -> DataFrame:
    """All addresses of a business: its own, then those known for its domain.

    One row per address (seq, email, origin, type, confidence), since a domain's list has
    no bound; nothing is collected per business or per domain.
    """
    own = df.select("seq", F.explode("emails").alias("email"))
    own = own.select("seq", "email", F.lit("own").alias("origin"), F.lit(None).cast("string").alias("type"), F.lit(None).cast("int").alias("confidence"))
    sites = _with_domain(df).filter("__domain is not null").select("seq", F.col("__domain").alias("domain"))
    found = sites.join(small_side(contacts), "domain").select("seq", "email", F.lit("directory").alias("origin"), "type", "confidence")
    return own.unionByName(found)


def active_flag(df: DataFrame, site_status: DataFrame, places: DataFrame) -> DataFrame:
    """Reachable site -> active; else closed place -> inactive; else active."""
    s = one_per_key(site_status.select("website", "http_status"), "website")
    p = one_per_key(places.select("place_id", "permanently_closed"), "place_id")
    j = df.join(small_side(s), "website", "left").join(small_side(p), "place_id", "left")
    reachable = F.coalesce(F.col("http_status") == CLOSED_OK_STATUS, F.lit(False))
    closed = F.coalesce(F.col("permanently_closed"), F.lit(False))
    return j.select(*df.columns, (reachable | ~closed).alias("is_active"))


def drop_disposable(emails: DataFrame, domains: DataFrame, address: str = "address") -> DataFrame:
    """Drops addresses whose domain is on a block list of any length."""
    block = domains.select(F.lower("domain").alias("__d")).distinct()
    return emails.withColumn("__d", email_domain(F.col(address))).join(small_side(block), "__d", "left_anti").drop("__d")


def business_tags(links: DataFrame, tags: DataFrame) -> DataFrame:
    """Sorted tag names per business; the set is no longer than the tag vocabulary."""
    pairs = links.select("business_id", "tag_id").distinct().join(small_side(tags), "tag_id")
    return pairs.groupBy("business_id").agg(F.array_sort(F.collect_set("tag")).alias("tags"))
