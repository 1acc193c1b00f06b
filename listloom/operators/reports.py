"""Summaries and report rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.presence import has
from ..functions.text import elapsed_hms
from .ordering import first_rows

# Fixed values -------------------------------------------------------------------
REPORT_ROWS = 100
SUMMARY_ROWS = 10
NO_VALUE = "N/A"
MAX_FAILURES = 3
# --------------------------------------------------------------------------------


def _count(test: Column) -> Column:
    return F.count(F.when(test, 1))


def _percent(part: Column, digits: int) -> Column:
    share = F.try_divide(part * F.lit(100.0), F.count("*"))
    return F.coalesce(F.round(share, digits), F.lit(0.0))


def coverage_summary(df: DataFrame) -> DataFrame:
    """A1: total, percent with phone, e-mail and website, mean of the ratings above zero."""
    rated = F.avg(F.when(has(df, "rating"), F.col("rating")))
    return df.agg(
        F.count("*").alias("total_businesses"),
        _percent(_count(has(df, "phone_numbers")), 2).alias("with_phone"),
        _percent(_count(has(df, "emails")), 2).alias("with_email"),
        _percent(_count(has(df, "website")), 2).alias("with_website"),
        F.coalesce(F.round(rated, 2), F.lit(0.0)).alias("avg_rating"),
    )


def contact_counts(df: DataFrame) -> DataFrame:
    """A2: counts, and percents at one digit, with phone, website and address."""
    out = [F.count("*").alias("total")]
    for c in ("phone", "website", "address"):
        out.append(_count(has(df, c)).alias(f"with_{c}"))
        out.append(_percent(_count(has(df, c)), 1).alias(f"{c}_pct"))
    return df.agg(*out)


def store_statistics(df: DataFrame) -> DataFrame:
    """A3: counts over the stored table; the rating mean includes zeros, a website counts if not NULL."""
    return df.agg(
        F.count("*").alias("total_businesses"),
        _count(has(df, "phone_numbers")).alias("with_phone"),
        _count(has(df, "emails")).alias("with_email"),
        F.count("website").alias("with_website"),
        F.coalesce(F.round(F.avg("rating"), 2), F.lit(0.0)).alias("avg_rating"),
    )


def report_rows(df: DataFrame, n: int = REPORT_ROWS) -> DataFrame:
    """The first ``n`` records, numbered, with a placeholder for missing values."""
    rows = first_rows(df.select("seq", "name", "phone", "website", "address", "rating"), n)
    cells = [F.coalesce(F.col(c).cast("string"), F.lit(NO_VALUE)).alias(c) for c in ("name", "phone", "website", "address", "rating")]
    return rows.select("row_no", *cells)


def summary_rows(df: DataFrame, n: int = SUMMARY_ROWS) -> DataFrame:
    """A2 totals next to each of the first ``n`` records."""
    totals = contact_counts(df)
    cells = [F.coalesce(F.col(c), F.lit(NO_VALUE)).alias(c) for c in ("name", "phone", "website", "address")]
    rows = first_rows(df.select("seq", "name", "phone", "website", "address"), n).select("row_no", *cells)
    # both sides are bounded: one row of totals, at most n rows of records
    return rows.withColumn("__one", F.lit(1)).join(F.broadcast(totals.withColumn("__one", F.lit(1))), "__one").drop("__one")


def run_metrics(log: DataFrame) -> DataFrame:
    """Per job, records by outcome, elapsed time and rate."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    per_job = log.groupBy("job_id").agg(
        F.count("*").alias("found"),
        _count(F.col("outcome") == "new").alias("new_records"),
        _count(F.col("outcome") == "updated").alias("updated_records"),
        _count(F.col("outcome") == "failed").alias("failed_records"),
        F.min("ts").alias("start_time"),
        F.max("ts").alias("end_time"),
        ((F.max(micros) - F.min(micros)) / 1e6).alias("duration_s"),
    )
    return per_job.withColumns(
        {
            "duration_s": F.round("duration_s", 3),
            "rate_per_s": F.round(F.try_divide(F.col("found"), F.col("duration_s")), 6),
            "elapsed": elapsed_hms("duration_s"),
        }
    )


def endpoint_health(requests: DataFrame, max_failures: int = MAX_FAILURES) -> DataFrame:
    """A10: per endpoint, successes, failures, last use, mean response, banned or not."""
    return requests.groupBy("req_key").agg(
        _count(F.col("ok")).alias("success_count"),
        _count(~F.col("ok")).alias("fail_count"),
        F.max("ts").alias("last_used"),
        F.round(F.avg("response_s"), 4).alias("response_time_avg"),
        (_count(~F.col("ok")) >= max_failures).alias("banned"),
    )


def campaign_funnel(events: DataFrame) -> DataFrame:
    """Sent, opened and replied counts per campaign, with rates."""

    def rate(action, base):
        return F.round(F.try_divide(_count(F.col("action") == action) * F.lit(1.0), _count(F.col("action") == base)), 4)

    return events.groupBy("campaign_id").agg(
        _count(F.col("action") == "sent").alias("emails_sent"),
        _count(F.col("action") == "opened").alias("emails_opened"),
        _count(F.col("action") == "replied").alias("emails_replied"),
        rate("opened", "sent").alias("open_rate"),
        rate("replied", "sent").alias("reply_rate"),
    )


def rating_distribution(reviews: DataFrame) -> DataFrame:
    """Review count and rating -> count map per business, over all ratings there are.

    Reviews without a rating count, but have no entry.
    """
    per = reviews.groupBy("business_id", "rating").agg(F.count("*").alias("n"))
    entry = F.when(F.col("rating").isNotNull(), F.struct("rating", "n"))
    return per.groupBy("business_id").agg(
        F.sum("n").alias("reviews_count"),
        F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("rating_distribution"),
    )


def recent_reviews(reviews: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` latest reviews of each business; the rank limit also runs before the shuffle."""
    from pyspark.sql import Window

    order = Window.partitionBy("business_id").orderBy(F.col("review_date").desc(), F.col("review_id").desc())
    return reviews.withColumn("recency", F.row_number().over(order)).filter(F.col("recency") <= k)


def usage_count(links: DataFrame, key: str) -> DataFrame:
    """How many businesses carry each tag or category."""
    pairs = links.select("business_id", key).distinct()
    return pairs.groupBy(key).agg(F.count("*").alias("usage_count"))


def market_density(df: DataFrame) -> DataFrame:
    """Businesses and mean rating by city and category, with all subtotals."""
    return df.cube("city", "category").agg(
        F.grouping_id().cast("bigint").alias("level"),
        F.count("*").alias("businesses"),
        F.round(F.avg(F.when(F.col("rating") != 0, F.col("rating"))), 4).alias("avg_rating"),
    )
