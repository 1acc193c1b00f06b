"""E-mail lists per site and statistics over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.contacts import CONTACT_FORM, local_format, page_emails, priority_score
from ..functions.html import markup, visible_text
from ..functions.presence import has
from ..functions.text import domain_or_path

SITE_LIMIT = 10  # fixed value


def emails_of_pages(pages: DataFrame, site: str = "host", with_context: bool = False) -> DataFrame:
    """Every address found on each page, one row per hit, in reading order."""
    clean = pages.select(site, "page_id", markup(F.col("html")).alias("clean"))
    text = clean.withColumn("text", visible_text(F.col("clean")))
    hits = text.select(site, "page_id", F.posexplode(page_emails(F.col("clean"), F.col("text"), with_context)).alias("pos", "hit"))
    return hits.select(F.col(site).alias("site"), "page_id", "pos", "hit.*")


def distinct_emails(hits: DataFrame) -> DataFrame:
    """First hit of each address per site, any case; form markers left out.

    A plain aggregation, so copies of one address are combined before the shuffle.
    """
    real = hits.filter(F.lower("address").isNotNull() & (F.col("address") != "") & (F.lower("address") != CONTACT_FORM.lower()))
    others = [c for c in hits.columns if c not in ("site", "page_id", "pos")]
    first = real.groupBy("site", F.lower("address").alias("__low")).agg(F.min(F.struct("page_id", "pos", *others)).alias("h"))
    return first.select("site", "h.*")


def ranked_emails(emails: DataFrame, limit: int | None = SITE_LIMIT) -> DataFrame:
    """Addresses by priority score, then as found; at most ``limit`` per site."""
    verified = F.col("verified") if "verified" in emails.columns else F.lit(False)
    scored = emails.withColumn("priority_score", priority_score(F.col("address"), F.col("source"), verified))
    order = Window.partitionBy("site").orderBy(F.col("priority_score").desc(), "page_id", "pos")
    ranked = scored.withColumn("rank", F.row_number().over(order))
    return ranked if limit is None else ranked.filter(F.col("rank") <= limit)


def _addresses(df: DataFrame) -> DataFrame:
    rows = df.filter(has(df, "website")).select("website", F.explode("emails").alias("address"))
    return rows.filter(F.col("address").contains("@")).select(
        domain_or_path("website").alias("site_domain"),
        F.split_part("address", F.lit("@"), F.lit(2)).alias("email_domain"),
        F.split_part("address", F.lit("@"), F.lit(1)).alias("local"),
    )


def email_domains(df: DataFrame) -> DataFrame:
    """How often each mail domain occurs among businesses with a website."""
    return _addresses(df).groupBy("email_domain").agg(F.count("*").alias("n"))


def email_formats(df: DataFrame) -> DataFrame:
    """Formats of the local part where the mail domain is the site's own."""
    own = _addresses(df).filter((F.col("site_domain") != "") & (F.col("email_domain") == F.col("site_domain")))
    return own.groupBy(local_format(F.col("local")).alias("email_format")).agg(F.count("*").alias("n"))
