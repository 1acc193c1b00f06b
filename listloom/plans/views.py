"""Business data derived from the given tables, as SQL that Spark and DuckDB both run.

``{table}`` marks a base table. ``{copies}`` is the one engine-specific part: it yields
the column ``dup``, 0 for every customer and also 1 for every seventh.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
).split()

_COPIES_SPARK = (
    "LATERAL VIEW explode(CASE WHEN c_custkey % 7 = 0 THEN array(0, 1) ELSE array(0) END) d AS dup"
)
_COPIES_DUCK = ", unnest(CASE WHEN c_custkey % 7 = 0 THEN [0, 1] ELSE [0] END) d(dup)"

BIZ = """
SELECT k * 2 + dup AS seq, k, dup,
  CASE WHEN dup = 0 THEN 'Acme & ' || seg || ' No. ' || CAST(k AS STRING)
       ELSE 'ACME ' || seg || ' No ' || CAST(k AS STRING) || '!' END AS name,
  CASE WHEN k % 6 = 0 THEN 'ChIJ' || CAST(k AS STRING) END AS place_id,
  CASE WHEN k % 6 <> 1 THEN NULL
       WHEN dup = 0 THEN '+1 (212) 555-' || lpad(CAST(k % 10000 AS STRING), 4, '0')
       ELSE '212.555.' || lpad(CAST(k % 10000 AS STRING), 4, '0') END AS phone,
  CASE WHEN k % 6 IN (0, 1, 2) THEN CAST(k AS STRING) || ' Main St., ' || n_name ELSE '' END AS address,
  CASE WHEN k % 6 = 3 AND dup = 0 THEN 'https://www.site' || CAST(k AS STRING) || '.example.com/home'
       WHEN k % 6 = 3 THEN 'http://site' || CAST(k AS STRING) || '.example.com' END AS website,
  CASE WHEN k % 6 = 4 THEN 10 + CAST(k % 400 AS DOUBLE) / 8 END AS lat,
  CASE WHEN k % 6 = 4 THEN 20 + CAST(k % 300 AS DOUBLE) / 16 END AS lng,
  CASE WHEN k % 4 = 0 THEN 'jane.doe@site' || CAST(k AS STRING) || '.example.com,owner' || CAST(k AS STRING) || '@gmail.com'
       WHEN k % 4 = 3 AND dup = 1 THEN 'sam_roe@site' || CAST(k AS STRING) || '.example.com'
       WHEN k % 4 = 1 THEN '' END AS emails,
  lower(seg) AS category, n_name AS city,
  CASE WHEN k % 9 = 0 THEN CAST(0 AS DOUBLE) WHEN k % 11 <> 0 THEN 1 + CAST((k + dup) % 33 AS DOUBLE) / 8 END AS rating,
  (k * 13) % 200 AS reviews,
  CASE WHEN k % 5 = 0 THEN NULL WHEN dup = 1 THEN seg || ' goods from ' || n_name ELSE seg || ' goods' END AS description,
  CASE (k + dup) % 4 WHEN 1 THEN '$' WHEN 2 THEN '$$' WHEN 3 THEN '$$$' END AS price_range,
  CASE WHEN k % 3 = 0 AND dup = 0 THEN 'wifi,parking,bar,garden,ramp,toilet,atm'
       WHEN k % 3 = 0 THEN 'sauna,wifi,gym,pool,lift,taxi,cafe' WHEN k % 3 = 1 THEN 'wifi' END AS amenities,
  CASE WHEN k % 2 = 0 THEN 'https://facebook.com/b' || CAST(k AS STRING) || 'd' || CAST(dup AS STRING) END AS facebook,
  CASE WHEN dup = 1 OR k % 5 = 1 THEN 'https://instagram.com/i' || CAST(k AS STRING) END AS instagram,
  CASE WHEN k % 3 <> 2 THEN 'p' || CAST(k AS STRING) || 'a.jpg,p' || CAST(k AS STRING) || CASE WHEN dup = 0 THEN 'b.jpg' ELSE 'c.jpg' END END AS photos,
  CASE WHEN k % 2 = 1 THEN 'Mo-Fr 9-17' END AS opening_hours,
  k % 5 = 0 AS verified, k % 8 = 0 AS claimed,
  CASE WHEN k % 3 = 1 THEN CAST(1950 + k % 70 AS INT) END AS year_established,
  CASE WHEN k % 7 = 2 THEN 'cash,card' END AS payment_methods,
  scraped_at
FROM (SELECT c_custkey AS k, dup, c_mktsegment AS seg, n_name, scraped_at
      FROM (SELECT c_custkey, c_mktsegment, c_nationkey, dup FROM {customer} {copies}) c
      JOIN {nation} n ON n.n_nationkey = c.c_nationkey
      LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS scraped_at FROM {orders} GROUP BY o_custkey) o
        ON o.o_custkey = c.c_custkey) t
"""

PAGES_X = """
SELECT page_id, url, regexp_extract(url, '://([^/]+)', 1) AS host,
  html ||
  CASE WHEN page_id % 3 = 0 THEN '<a href="mailto:jane.roe' || CAST(page_id AS STRING) || '@shop.example.com?subject=x">Mail</a>' ELSE '' END ||
  CASE WHEN page_id % 4 = 0 THEN '<p>bob' || CAST(page_id AS STRING) || '[at]shop.example.com or amy(at)gmail.com or info@shop.example.com or t@mailinator.com or kim @ shop.example.com</p>' ELSE '' END ||
  CASE WHEN page_id % 5 = 0 THEN '<meta name="email" content="meta_' || CAST(page_id AS STRING) || '@shop.example.com">' ELSE '' END ||
  CASE WHEN page_id % 6 = 0 THEN '<form action="/Contact/send"></form>' ELSE '' END ||
  CASE WHEN page_id % 2 = 0 THEN '<a href="https://www.facebook.com/shop' || CAST(page_id AS STRING) || '">f</a><a href="https://x.com/shop_x">x</a>' ELSE '' END ||
  CASE WHEN page_id % 7 = 0 THEN '<a href="/s" ><i class="fab fa-yelp"></i></a>' ELSE '' END ||
  CASE WHEN page_id % 11 = 3 THEN '<meta property="al:twitter:url" content="app://t/' || CAST(page_id AS STRING) || '">' ELSE '' END ||
  CASE WHEN page_id % 8 = 1 THEN '<div class="g-recaptcha" data-sitekey="k"></div>' ELSE '' END ||
  CASE WHEN page_id % 16 = 2 THEN '<p>Our systems have detected unusual traffic. Solve the math problem: what is 2 and 2</p>' ELSE '' END ||
  CASE WHEN page_id % 9 = 0 THEN '<button data-item-id="phone:tel">(212) 555-0' || lpad(CAST(page_id % 1000 AS STRING), 3, '0') || '</button>' ELSE '' END ||
  CASE WHEN page_id % 5 = 1 THEN '<button data-item-id="address">' || CAST(page_id AS STRING) || ' High St, Springfield</button>' ELSE '' END ||
  CASE WHEN page_id % 5 = 2 THEN '<a data-item-id="authority" href="https://shop' || CAST(page_id AS STRING) || '.example.com/">Site</a>' ELSE '' END ||
  CASE WHEN page_id % 3 = 1 THEN '<button jsaction="pane.category">Bakery &amp; Cafe</button>' ELSE '' END ||
  CASE WHEN page_id % 4 = 1 THEN '<span class="price-tag">$$</span>' ELSE '' END ||
  CASE WHEN page_id % 10 = 7 THEN '<div aria-label="wheelchair entrance"></div>' ELSE '' END ||
  CASE WHEN page_id % 6 = 1 THEN '<a href="https://m.example/maps/place/P"><h3>Chez ' || CAST(page_id AS STRING) || ' - Bistro</h3></a>' ELSE '' END ||
  CASE WHEN page_id % 6 = 5 THEN '<div class="qBF1Pd">DINER ' || CAST(page_id AS STRING) || '</div>' ELSE '' END ||
  CASE WHEN page_id % 2 = 1 THEN '<button aria-label="reviews">1,' || lpad(CAST(page_id % 1000 AS STRING), 3, '0') || ' reviews</button>' ELSE '' END ||
  '<h3>Shop ' || CAST(page_id AS STRING) || ' & Sons</h3><a href="tel:+12125550' || lpad(CAST(page_id % 1000 AS STRING), 3, '0') || '?x">Call</a><span role="img" aria-label="4,5 stars">4.5</span>' AS html,
  'https://m.example/maps/place/P' || CAST(page_id AS STRING) || '/@-12.5,' || CAST(page_id % 90 AS STRING) || '.25,17z' AS place_url
FROM {pages}
"""

REVIEWS = """
SELECT o_orderkey AS review_id, o_custkey AS business_id, CAST(o_orderkey % 5 + 1 AS INT) AS rating, o_orderdate AS review_date
FROM {orders}
"""

REQUESTS = """
SELECT event_id AS seq, ts, user_id AS req_key, event_type <> 'error' AS ok, value / 64 AS response_s
FROM {events}
"""

SNAP_OLD = """
SELECT c_custkey AS id, c_name AS name, c_acctbal AS rating, c_mktsegment AS category FROM {customer} WHERE c_custkey % 10 <> 9
"""

SNAP_NEW = """
SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_name END AS name,
  CASE WHEN c_custkey % 5 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS rating, c_mktsegment AS category
FROM {customer} WHERE c_custkey % 10 <> 8
"""

CATEGORIES = """
SELECT r_regionkey AS id, CAST(NULL AS INT) AS parent_id, r_name AS name FROM {region}
UNION ALL SELECT 100 + n_nationkey, n_regionkey, n_name FROM {nation}
"""

PLACES = """
SELECT 'ChIJ' || CAST(c_custkey AS STRING) AS place_id, '+1 646 555 0100' AS phone,
  'https://p' || CAST(c_custkey AS STRING) || '.example.org' AS website, 'Sa-Su 10-12' AS opening_hours,
  CAST(c_custkey % 5 AS INT) AS price_level, c_custkey % 36 = 0 AS permanently_closed
FROM {customer} WHERE c_custkey % 12 = 0
"""

REGISTRY = """
SELECT CASE WHEN c_custkey % 2 = 0 THEN 'www.' ELSE '' END || 'site' || CAST(c_custkey AS STRING) || '.example.com' AS domain,
  c_mktsegment AS registrar, CAST(2000 + c_custkey % 20 AS STRING) || '-01-02' AS creation_date,
  '2030-01-02' AS expiration_date, 'ns1.example.net' AS name_servers,
  CASE WHEN c_custkey % 9 = 0 THEN 'reg' || CAST(c_custkey AS STRING) || '@example.net' END AS email
FROM {customer} WHERE c_custkey % 3 = 0
"""

COMPANIES = """
SELECT 'www.site' || CAST(c_custkey AS STRING) || '.example.com' AS domain, c_name AS name,
  c_name || ' trades' AS description, c_mktsegment AS industry, CAST(c_custkey % 500 AS INT) AS employees,
  c_acctbal AS market_cap, CAST(1980 + c_custkey % 40 AS INT) AS founded_year, '+1 212 555 0199' AS phone,
  'mx.example.net' AS email_provider
FROM {customer} WHERE c_custkey % 3 = 0
"""

CONTACTS = """
SELECT CASE WHEN c_custkey % 2 = 0 THEN '' ELSE 'www.' END || 'site' || CAST(c_custkey AS STRING) || '.example.com' AS domain,
  'c' || CAST(c_custkey AS STRING) || '@example.com' AS email,
  CASE WHEN c_custkey % 2 = 0 THEN 'personal' ELSE 'generic' END AS type, CAST(c_custkey % 100 AS INT) AS confidence
FROM {customer} WHERE c_custkey % 3 = 0
"""

SITE_STATUS = """
SELECT 'http://site' || CAST(c_custkey AS STRING) || '.example.com' AS website,
  CASE WHEN c_custkey % 2 = 0 THEN 200 ELSE 503 END AS http_status
FROM {customer} WHERE c_custkey % 3 = 0
"""

TAG_LINKS = """
SELECT o_custkey AS business_id, p_partkey % 25 AS tag_id
FROM {lineitem} JOIN {orders} ON o_orderkey = l_orderkey JOIN {part} ON p_partkey = l_partkey
"""

TAGS = """
SELECT DISTINCT p_partkey % 25 AS tag_id, 'tag-' || CAST(p_partkey % 25 AS STRING) AS tag FROM {part}
"""

JOBS = """
SELECT seq, req_key % 20 AS job_id, ts, ok,
  CASE WHEN NOT ok THEN 'failed' WHEN seq % 3 = 0 THEN 'updated' ELSE 'new' END AS outcome
FROM (SELECT event_id AS seq, ts, user_id AS req_key, event_type <> 'error' AS ok FROM {events}) r
"""

CAMPAIGN_EVENTS = """
SELECT event_id AS seq, user_id % 12 AS campaign_id,
  CASE event_type WHEN 'view' THEN 'sent' WHEN 'click' THEN 'opened' WHEN 'purchase' THEN 'replied' ELSE 'other' END AS action
FROM {events}
"""

VIEWS = {
    "biz": BIZ,
    "pages_x": PAGES_X,
    "reviews": REVIEWS,
    "requests": REQUESTS,
    "snap_old": SNAP_OLD,
    "snap_new": SNAP_NEW,
    "categories": CATEGORIES,
    "places": PLACES,
    "registry": REGISTRY,
    "companies": COMPANIES,
    "contacts": CONTACTS,
    "site_status": SITE_STATUS,
    "tag_links": TAG_LINKS,
    "tags": TAGS,
    "jobs": JOBS,
    "campaign_events": CAMPAIGN_EVENTS,
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One derived table as a DataFrame."""
    text = VIEWS[name]
    used = {t: table(spark, sf_dir, t) for t in BASE_TABLES if "{" + t + "}" in text}
    return spark.sql(text.replace("{copies}", _COPIES_SPARK), **used)


def duck_with(*names: str) -> str:
    """``WITH`` prefix that defines the named derived tables for DuckDB."""
    parts = []
    for name in names:
        text = VIEWS[name].replace("{copies}", _COPIES_DUCK)
        for base in BASE_TABLES:
            text = text.replace("{" + base + "}", base)
        parts.append(f"{name} AS ({text.strip()})")
    return "WITH " + ",\n".join(parts) + "\n"


def _items(col: str) -> F.Column:
    """Comma string to array; NULL stays NULL, '' gives an empty array."""
    return F.when(F.col(col) == "", F.array().cast("array<string>")).otherwise(F.split(col, ","))


def businesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``biz`` in the canonical shape of ``schema.BUSINESS``, with nested columns."""
    b = view(spark, sf_dir, "biz")
    return b.select(
        "seq", "name", "place_id", "phone",
        F.array_compact(F.array("phone")).alias("phone_numbers"),
        F.col("phone").alias("primary_phone"),
        "address", "website",
        F.when(F.col("lat").isNotNull(), F.struct("lat", "lng")).alias("coordinates"),
        _items("emails").alias("emails"),
        "category", "city", "rating", "reviews", "description", "price_range",
        _items("amenities").alias("amenities"),
        F.map_filter(
            F.create_map(F.lit("facebook"), F.col("facebook"), F.lit("instagram"), F.col("instagram")),
            lambda _, v: v.isNotNull(),
        ).alias("social_media"),
        _items("photos").alias("photos"),
        "opening_hours", "verified", "claimed", "year_established",
        _items("payment_methods").alias("payment_methods"),
        "scraped_at",
    )
