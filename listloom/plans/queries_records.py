"""Registered queries over business records: identity, dedup, filters, store, exports, reports."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import quality, text
from ..functions.presence import has
from ..functions.similarity import similarity_ratio
from ..operators import dedup, enrich, ordering, reports, similar, store, taxonomy
from ..schema import RECORD, canonical
from ..session import work_path
from ..sources import records
from .registry import (
    BIZ, KEYED, ORACLES, d_clean, d_domain, d_key, d_lookup_domain, d_netloc_or_path, d_phone, d_record_id,
    joined, map_text, query,
)
from .views import businesses, duck_with, table, view

RECORD_COLS = ["seq", "name", "phone", "website", "address", "rating", "reviews", "category"]
_RECORD_SQL = ", ".join(RECORD_COLS)


def biz(spark, sf):
    return view(spark, sf, "biz")


# -- sources and sinks -----------------------------------------------------------


def write_record_log(spark, sf, path):
    """The business records as a JSON-lines log with some blank and broken lines."""
    rows = records.with_record_id(biz(spark, sf).select(*RECORD_COLS))
    line = F.to_json(F.struct(*rows.columns))
    noise = F.when(F.col("seq") % 10 == 0, F.array(line, F.lit(""), F.lit('{"seq": broken'))).otherwise(F.array(line))
    rows.select(F.explode(noise).alias("value")).write.text(path)


@query("s1_read_log", BIZ + f"SELECT {_RECORD_SQL} FROM biz")
def s1(spark, sf):
    path = work_path(spark, "log")
    write_record_log(spark, sf, path)
    return records.read_log(spark, path).select(*RECORD_COLS)


@query("s1_unreadable_lines", BIZ + "SELECT '{\"seq\": broken' AS line, count(*) AS n FROM biz WHERE seq % 10 = 0")
def s1_bad(spark, sf):
    path = work_path(spark, "log")
    write_record_log(spark, sf, path)
    return records.unreadable_lines(spark, path).groupBy("line").agg(F.count("*").alias("n"))


#: A log as a plain collector leaves it: no ``seq``, keys of its own, several files in order.
_PLAIN = [c for c in RECORD_COLS if c != "seq"]
_EXTRA_SQL = """place_id, CASE WHEN dup = 0 THEN k END AS k, CASE WHEN dup = 1 THEN upper(name) END AS name_2,
  CASE WHEN dup = 1 THEN 'second' ELSE CAST(k AS VARCHAR) END AS mixed"""


def write_plain_log(spark, sf, path):
    """In the order of ``seq``, which is left out; blank and broken lines between."""
    rows = biz(spark, sf).orderBy("seq")
    own = F.to_json(F.struct(*_PLAIN, "place_id", F.when(F.col("dup") == 0, F.col("k")).alias("k")))
    odd = F.when(F.col("dup") == 1, F.concat(F.lit(',"Name":'), F.to_json(F.to_variant_object(F.array(F.upper("name")))), F.lit(',"mixed":"second"}')))
    odd = F.regexp_replace(odd, r'"Name":\[(.*)\],"mixed"', '"Name":$1,"mixed"')
    line = F.concat(F.expr("left(own, length(own) - 1)"), F.coalesce(odd, F.concat(F.lit(',"mixed":'), F.col("k").cast("string"), F.lit("}"))))
    rows = rows.withColumn("own", own).withColumn("line", line)
    noise = F.when(F.col("seq") % 10 == 0, F.array(F.lit(" \t"), F.col("line"), F.lit(""))).otherwise(F.array("line"))
    rows.select(F.explode(noise).alias("value")).write.text(path)


@query("s1_unnumbered_log", BIZ + f"SELECT row_number() OVER (ORDER BY seq) AS seq, {', '.join(_PLAIN)} FROM biz")
def s1_unnumbered(spark, sf):
    path = work_path(spark, "log")
    write_plain_log(spark, sf, path)
    return records.read_log(spark, path).select(*RECORD_COLS)


@query("u4_unknown_keys", BIZ + f"SELECT row_number() OVER (ORDER BY seq) AS seq, {_EXTRA_SQL} FROM biz")
def u4_unknown(spark, sf):
    path = work_path(spark, "log")
    write_plain_log(spark, sf, path)
    wide = records.widened(records.read_log(spark, path))
    return wide.select("seq", "place_id", "k", F.col("Name_2").alias("name_2"), F.try_variant_get("mixed", "$", "string").alias("mixed"))


@query("u4_unknown_keys_csv", BIZ + f"""SELECT CAST(row_number() OVER (ORDER BY seq) AS VARCHAR) AS seq, coalesce(place_id, '') AS place_id,
  coalesce(nullif(CAST(k AS VARCHAR), '0'), '') AS k, coalesce(name_2, '') AS name_2, coalesce(mixed, '') AS mixed FROM (SELECT seq, {_EXTRA_SQL} FROM biz)""")  # fmt: skip
def u4_unknown_csv(spark, sf):
    path = work_path(spark, "log")
    write_plain_log(spark, sf, path)
    records.write_csv(records.read_log(spark, path), f"{path}-csv")
    cols = spark.read.options(header="true", quote='"', escape='"', multiLine="true").csv(f"{path}-csv").fillna("")
    return cols.select("seq", "place_id", "k", F.col("Name_2").alias("name_2"), "mixed")


@query("u4_unknown_keys_json", BIZ + f"SELECT row_number() OVER (ORDER BY seq) AS seq, {_EXTRA_SQL} FROM biz")
def u4_unknown_json(spark, sf):
    path = work_path(spark, "log")
    write_plain_log(spark, sf, path)
    records.write_json(records.read_log(spark, path), f"{path}-json")
    back = spark.read.schema("seq long, place_id string, k long, Name_2 string, mixed string").json(f"{path}-json")
    return back.withColumnRenamed("Name_2", "name_2")


@query(
    "s2_merge_checkpoints",
    BIZ + f"""SELECT {d_record_id()} AS _id, seq,
      CASE WHEN k % 2 = 0 THEN category WHEN k % 3 = 0 THEN 'delta 20' ELSE 'delta 10' END AS category
    FROM biz""",
)
def s2(spark, sf):
    folder = work_path(spark, "checkpoints")
    rows = records.with_record_id(biz(spark, sf).select("k", *RECORD_COLS))

    def save(df, n):
        df.drop("k").write.json(f"{folder}/run_checkpoint_{n}.jsonl")

    save(rows.withColumn("category", F.lit("delta 10")), 10)
    save(rows.filter("k % 3 = 0").withColumn("category", F.lit("delta 20")), 20)
    save(rows.filter("k % 2 = 0"), 100)
    return records.merge_checkpoints(spark, folder).select("_id", "seq", "category")


@query("s3_read_store", BIZ + f"SELECT {_RECORD_SQL} FROM biz WHERE rating >= 4 AND category = 'building'")
def s3(spark, sf):
    path = work_path(spark, "store")
    biz(spark, sf).select(*RECORD_COLS).write.parquet(path)
    return records.read_store(spark, path=path, where="rating >= 4 AND category = 'building'")


_FLAT_COLS = ["seq", "name", "phone", "address", "coordinates_lat", "coordinates_lng", "emails", "amenities",
              "rating", "reviews", "social_media_facebook", "social_media_instagram", "verified"]
_FLAT_SQL = """SELECT CAST(seq AS VARCHAR) AS seq_text, name, coalesce(phone, '') AS phone, address,
  coalesce(CAST(lat AS VARCHAR), '') AS coordinates_lat, coalesce(CAST(lng AS VARCHAR), '') AS coordinates_lng,
  coalesce(replace(emails, ',', ', '), '') AS emails, coalesce(replace(amenities, ',', ', '), '') AS amenities,
  CASE WHEN rating <> 0 THEN CAST(rating AS VARCHAR) ELSE '' END AS rating,
  CASE WHEN reviews <> 0 THEN CAST(reviews AS VARCHAR) ELSE '' END AS reviews,
  coalesce(facebook, '') AS social_media_facebook, coalesce(instagram, '') AS social_media_instagram,
  CASE WHEN verified THEN 'True' ELSE '' END AS verified
FROM biz"""
_MAP_KEYS = {"social_media": ["facebook", "instagram"]}


def _flat_input(spark, sf):
    cols = ["seq", "name", "phone", "address", "coordinates", "emails", "amenities", "rating", "reviews", "social_media", "verified"]
    # every seq is truthy text but 0, which the flattening rule would blank
    return businesses(spark, sf).select(*cols).withColumn("seq", F.col("seq").cast("string"))


@query("x40_flatten", BIZ + _FLAT_SQL)
def x40(spark, sf):
    return quality.flatten(_flat_input(spark, sf), _MAP_KEYS).withColumnRenamed("seq", "seq_text")


@query("s4_csv_flattened", BIZ + _FLAT_SQL)
def s4(spark, sf):
    path = work_path(spark, "csv")
    records.write_csv(_flat_input(spark, sf), path, _MAP_KEYS)
    return records.read_csv(spark, path, _FLAT_COLS).withColumnRenamed("seq", "seq_text")


@query(
    "s5_csv_nested_json",
    BIZ + """SELECT CAST(seq AS VARCHAR) AS seq_text, name, coalesce(CAST(rating AS VARCHAR), '') AS rating,
      CASE WHEN emails IS NULL THEN '' WHEN emails = '' THEN '[]' ELSE '["' || replace(emails, ',', '","') || '"]' END AS emails,
      CASE WHEN lat IS NULL THEN '' ELSE '{"lat":' || CAST(lat AS VARCHAR) || ',"lng":' || CAST(lng AS VARCHAR) || '}' END AS coordinates,
      '{' || concat_ws(',', '"facebook":"' || facebook || '"', '"instagram":"' || instagram || '"') || '}' AS social_media
    FROM biz""",
)
def s5(spark, sf):
    path = work_path(spark, "csvjson")
    cols = ["seq", "name", "rating", "emails", "coordinates", "social_media"]
    records.write_csv_json(businesses(spark, sf).select(*cols), path)
    return records.read_csv(spark, path, cols).withColumnRenamed("seq", "seq_text")


@query(
    "s6_json_export",
    BIZ + """SELECT seq, name, rating, CAST(scraped_at AS VARCHAR) AS scraped_at,
      CASE WHEN emails = '' THEN '' ELSE replace(emails, ',', '|') END AS emails FROM biz""",
)
def s6(spark, sf):
    path = work_path(spark, "json")
    records.write_json(businesses(spark, sf).select("seq", "name", "rating", "scraped_at", "emails"), path)
    back = spark.read.schema("seq bigint, name string, rating double, scraped_at string, emails array<string>").json(path)
    return back.withColumn("emails", joined("emails"))


@query("s7_table_replace", BIZ + _FLAT_SQL)
def s7(spark, sf):
    name = f"listloom_{uuid.uuid4().hex[:12]}"
    data = _flat_input(spark, sf)
    path = work_path(spark, "table")
    records.write_table(data.limit(1), name, path, map_keys=_MAP_KEYS)  # replaced by the next line
    records.write_table(data, name, path, buckets=4, map_keys=_MAP_KEYS)
    return records.read_store(spark, table=name).withColumnRenamed("seq", "seq_text")


@query("s8_append", BIZ + f"SELECT {_RECORD_SQL} FROM biz")
def s8(spark, sf):
    path = work_path(spark, "append")
    rows = biz(spark, sf).select("dup", *RECORD_COLS)
    records.append_table(rows.filter("dup = 0").drop("dup"), path)
    records.append_table(rows.filter("dup = 1").drop("dup"), path)
    return records.read_store(spark, path=path)


@query(
    "s9_export_all",
    BIZ + """SELECT f AS format, count(*) AS rows_written, CAST(sum(seq) AS BIGINT) AS seq_sum
    FROM biz, unnest(['csv', 'json', 'table']) t(f) GROUP BY f
    UNION ALL SELECT 'report', least(count(*), 100), CAST(least(count(*), 100) * (least(count(*), 100) + 1) // 2 AS BIGINT) FROM biz""",
)
def s9(spark, sf):
    data = businesses(spark, sf).select("seq", "name", "phone", "website", "address", "rating", "emails", "social_media")
    paths = records.export_all(data, work_path(spark, "export"), map_keys=_MAP_KEYS)
    number = F.when(F.col("seq") == "", 0).otherwise(F.col("seq")).cast("bigint").alias("seq")
    back = {
        "csv": records.read_csv(spark, paths["csv"], ["seq"]).select(number),
        "json": spark.read.schema("seq bigint").json(paths["json"]),
        "table": spark.read.parquet(paths["table"]).select(number),
        "report": records.read_csv(spark, paths["report"], ["row_no"]).select(F.col("row_no").cast("bigint").alias("seq")),
    }
    parts = [d.agg(F.lit(f).alias("format"), F.count("*").alias("rows_written"), F.sum("seq").alias("seq_sum")) for f, d in back.items()]
    return store.union_records(*parts)


@query("s10_snapshot", BIZ + f"SELECT {_RECORD_SQL}, '2024-01-31' AS snapshot FROM biz WHERE dup = 0")
def s10(spark, sf):
    path, folder = work_path(spark, "store"), work_path(spark, "snapshots")
    rows = biz(spark, sf).select("dup", *RECORD_COLS)
    records.append_table(rows.filter("dup = 0").drop("dup"), path)
    records.snapshot(spark, path, folder, "2024-01-31")
    records.append_table(rows.filter("dup = 1").drop("dup"), path)
    saved = spark.read.parquet(folder)
    return saved.withColumn("snapshot", F.col("snapshot").cast("string"))


@query(
    "s11_report_rows",
    BIZ + """SELECT row_number() OVER (ORDER BY seq) AS row_no, name, coalesce(phone, 'N/A') AS phone,
      coalesce(website, 'N/A') AS website, coalesce(address, 'N/A') AS address, coalesce(CAST(rating AS VARCHAR), 'N/A') AS rating
    FROM (SELECT * FROM biz ORDER BY seq LIMIT 100) b""",
)
def s11(spark, sf):
    return reports.report_rows(biz(spark, sf))


_A2_SQL = """SELECT count(*) AS total,
  count(*) FILTER (phone <> '') AS with_phone, coalesce(round(100.0 * count(*) FILTER (phone <> '') / count(*), 1), 0.0) AS phone_pct,
  count(*) FILTER (website <> '') AS with_website, coalesce(round(100.0 * count(*) FILTER (website <> '') / count(*), 1), 0.0) AS website_pct,
  count(*) FILTER (address <> '') AS with_address, coalesce(round(100.0 * count(*) FILTER (address <> '') / count(*), 1), 0.0) AS address_pct
FROM biz"""


@query(
    "s12_summary_rows",
    BIZ + f"""SELECT row_number() OVER (ORDER BY seq) AS row_no, name, coalesce(phone, 'N/A') AS phone,
      coalesce(website, 'N/A') AS website, coalesce(address, 'N/A') AS address, t.*
    FROM (SELECT * FROM biz ORDER BY seq LIMIT 10) b, ({_A2_SQL}) t""",
)
def s12(spark, sf):
    return reports.summary_rows(biz(spark, sf))


# -- filters ---------------------------------------------------------------------


@query("f1_query", BIZ + "SELECT seq, name, category, city FROM biz WHERE category = 'building' AND city = 'NATION_11' ORDER BY seq LIMIT 100")
def f1(spark, sf):
    wanted = {"category": "building", "city": "NATION_11", "no_such_column": 1}
    return store.query_records(biz(spark, sf), wanted).select("seq", "name", "category", "city")


@query("f2_high_rated", BIZ + "SELECT seq, name, rating FROM biz WHERE rating >= 4.5")
def f2(spark, sf):
    return store.high_rated(biz(spark, sf)).select("seq", "name", "rating")


@query("f3_with_email", BIZ + "SELECT seq, replace(emails, ',', '|') AS emails FROM biz WHERE emails <> ''")
def f3(spark, sf):
    return store.with_email(businesses(spark, sf)).select("seq", joined("emails").alias("emails"))


@query(
    "f4_search_filter",
    BIZ + "SELECT seq, rating, reviews, category FROM biz WHERE rating >= 4.0 AND reviews >= 10 AND category IN ('building', 'furniture') ORDER BY seq LIMIT 200",
)
def f4(spark, sf):
    found = store.search_filter(biz(spark, sf), 4.0, 10, ["Building", "Furniture"], 200)
    return found.select("seq", "rating", "reviews", "category")


@query("f5_exclude_keywords", BIZ + "SELECT seq, description FROM biz WHERE NOT coalesce(regexp_matches(description, '(?i)nation_1|machinery'), false)")
def f5(spark, sf):
    return store.without_keywords(biz(spark, sf), "description", ["Nation_1", "Machinery"]).select("seq", "description")


@query(
    "f5_keyword_table",
    BIZ + """, words AS (SELECT lower(n_name) AS w FROM nation UNION SELECT 'no. ' || c_custkey FROM customer WHERE c_acctbal < 0 UNION SELECT lower(p_name) FROM part)
    SELECT seq, name FROM biz WHERE NOT EXISTS (SELECT 1 FROM words WHERE contains(lower(coalesce(name, '')), w))""",
)
def f5_table(spark, sf):
    words = table(spark, sf, "nation").select(F.col("n_name").alias("w")).unionByName(table(spark, sf, "part").select(F.col("p_name").alias("w")))
    debtors = table(spark, sf, "customer").filter("c_acctbal < 0").select(F.concat(F.lit("NO. "), F.col("c_custkey").cast("string")).alias("w"))
    return store.without_keywords(biz(spark, sf), "name", words.unionByName(debtors)).select("seq", "name")


@query(
    "f6_contactable",
    BIZ + """SELECT 'phone' AS by_field, seq FROM biz WHERE phone <> '' UNION ALL SELECT 'website', seq FROM biz WHERE website <> ''
    UNION ALL SELECT 'rating', seq FROM biz WHERE rating <> 0""",
)
def f6(spark, sf):
    b = biz(spark, sf).select("seq", "phone", "website", "rating")
    return store.union_records(*[store.contactable(b, c).select(F.lit(c).alias("by_field"), "seq") for c in ("phone", "website", "rating")])


@query(
    "f7_presence",
    BIZ + """SELECT seq, coalesce(phone <> '', false) AS phone, coalesce(emails <> '', false) AS emails, coalesce(rating <> 0, false) AS rating,
      coalesce(facebook IS NOT NULL OR instagram IS NOT NULL, false) AS social_media, verified, reviews <> 0 AS reviews, lat IS NOT NULL AS coordinates
    FROM biz""",
)
def f7(spark, sf):
    b = businesses(spark, sf)
    return b.select("seq", *[has(b, c).alias(c) for c in ("phone", "emails", "rating", "social_media", "verified", "reviews", "coordinates")])


@query("f13_retention", BIZ + "SELECT seq, scraped_at FROM biz WHERE scraped_at >= TIMESTAMP '1999-06-30 12:00:00' - INTERVAL 30 DAY")
def f13(spark, sf):
    return store.retained(biz(spark, sf), "1999-06-30 12:00:00").select("seq", "scraped_at")


@query("f14_known_columns", BIZ + "SELECT seq, name, rating, category, website FROM biz")
def f14(spark, sf):
    return store.known_columns(biz(spark, sf), ["seq", "name", "rating", "category", "website", "zip_code"])


@query(
    "u4_union_records",
    BIZ + "SELECT seq, phone, CAST(NULL AS DOUBLE) AS rating FROM biz WHERE dup = 0 UNION ALL SELECT seq, NULL, rating FROM biz WHERE dup = 1",
)
def u4(spark, sf):
    b = biz(spark, sf)
    return store.union_records(b.filter("dup = 0").select("seq", "phone"), b.filter("dup = 1").select("seq", "rating"))


@query("l2_limit", BIZ + "SELECT seq, name FROM biz ORDER BY seq LIMIT 25")
def l2(spark, sf):
    return store.query_records(biz(spark, sf), None, 25).select("seq", "name")


# -- identity and dedup ----------------------------------------------------------


@query("x1_record_id", BIZ + f"SELECT seq, {d_record_id()} AS record_id FROM biz")
def x1(spark, sf):
    return biz(spark, sf).select("seq", text.record_id("name", "phone", "address").alias("record_id"))


@query("x2_dedup_key", BIZ + f"SELECT seq, {d_key()} AS dedup_key FROM biz")
def x2(spark, sf):
    return dedup.with_dedup_key(businesses(spark, sf)).select("seq", "dedup_key")


@query(
    "x3_x4_cleaning",
    BIZ + f"SELECT seq, {d_phone('phone')} AS phone, {d_clean('name')} AS name, {d_clean('address')} AS address FROM biz",
)
def x3_x4(spark, sf):
    return biz(spark, sf).select(
        "seq", text.clean_phone("phone").alias("phone"), text.clean_string("name").alias("name"), text.clean_string("address").alias("address")
    )


@query("x4_clean_documents", f"SELECT doc_id, md5({d_clean('text')}) AS cleaned FROM documents")
def x4(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return docs.select("doc_id", F.md5(text.clean_string("text")).alias("cleaned"))


@query(
    "x5_coordinate_key",
    BIZ + "SELECT seq, CASE WHEN lat <> 0 AND lng <> 0 THEN printf('%.4f,%.4f', round(lat, 4), round(lng, 4)) END AS coord_key FROM biz",
)
def x5(spark, sf):
    return biz(spark, sf).select("seq", text.coordinate_key("lat", "lng").alias("coord_key"))


@query(
    "x6_domains",
    f"""SELECT page_id, {d_domain('url')} AS a, split_part({d_netloc_or_path('url')}, '/', 1) AS b,
      split_part({d_netloc_or_path('url')}, '.', 1) AS c, {d_lookup_domain('url')} AS d FROM pages""",
)
def x6(spark, sf):
    p = spark.read.parquet(f"{sf}/pages.parquet")
    fns = {"a": text.domain_of_url, "b": text.domain_or_path, "c": text.domain_label, "d": text.lookup_domain}
    return p.select("page_id", *[f("url").alias(k) for k, f in fns.items()])


@query("d1_exact_dedup", KEYED + "SELECT dedup_key, min(seq) AS seq, arg_min(name, seq) AS name FROM keyed GROUP BY dedup_key")
def d1(spark, sf):
    return dedup.first_per_key(dedup.with_dedup_key(businesses(spark, sf))).select("dedup_key", "seq", "name")


def _d_list(field: str) -> str:
    return f"""SELECT dedup_key, '{field}' AS field, string_agg(v, '|' ORDER BY s, p) AS vals FROM (
      SELECT dedup_key, v, s, p, row_number() OVER (PARTITION BY dedup_key ORDER BY s, p) AS r FROM (
        SELECT dedup_key, v, min(s) AS s, arg_min(p, s * 1000 + p) AS p FROM (
          SELECT dedup_key, seq AS s, unnest(string_split({field}, ',')) AS v, generate_subscripts(string_split({field}, ','), 1) AS p
          FROM keyed WHERE {field} <> '') x GROUP BY dedup_key, v) y) z WHERE r <= 10 GROUP BY dedup_key"""


_MERGED_SQL = f""", lists AS ({_d_list('phone')} UNION ALL {_d_list('emails')} UNION ALL {_d_list('amenities')}),
sized AS (SELECT dedup_key, count(*) AS copies FROM keyed GROUP BY dedup_key),
social AS (SELECT dedup_key, concat_ws('|', 'facebook=' || arg_max(facebook, seq) FILTER (facebook IS NOT NULL),
  'instagram=' || arg_max(instagram, seq) FILTER (instagram IS NOT NULL)) AS social_media FROM keyed GROUP BY dedup_key)
"""
_A4_SELECT = """SELECT s.dedup_key, s.copies, coalesce(p.vals, '') AS phone_numbers, coalesce(e.vals, '') AS emails,
  coalesce(a.vals, '') AS amenities, m.social_media
FROM sized s JOIN social m USING (dedup_key)
LEFT JOIN lists p ON p.dedup_key = s.dedup_key AND p.field = 'phone'
LEFT JOIN lists e ON e.dedup_key = s.dedup_key AND e.field = 'emails'
LEFT JOIN lists a ON a.dedup_key = s.dedup_key AND a.field = 'amenities'"""


@query("a4_merge_lists", KEYED + _MERGED_SQL + _A4_SELECT)
def a4(spark, sf):
    m = dedup.merged_fields(dedup.with_dedup_key(businesses(spark, sf)))
    return m.select(
        "dedup_key", "copies", *[joined(c).alias(c) for c in dedup.LIST_FIELDS], map_text("social_media").alias("social_media")
    )


@query(
    "a4_merge_media",
    KEYED + """SELECT dedup_key, v AS value, min(seq) AS first_seq, arg_min(p, seq * 1000 + p) AS first_pos FROM (
      SELECT dedup_key, seq, unnest(string_split(photos, ',')) AS v, CAST(generate_subscripts(string_split(photos, ','), 1) - 1 AS INT) AS p
      FROM keyed WHERE photos IS NOT NULL) x GROUP BY dedup_key, v""",
)
def a4_media(spark, sf):
    return dedup.merged_media(dedup.with_dedup_key(businesses(spark, sf)), "photos")


def _d_common(field: str) -> str:
    return f"""SELECT dedup_key, arg_max({field}, n * 100000000 - f) AS {field} FROM (
      SELECT dedup_key, {field}, count(*) AS n, min(seq) AS f FROM keyed WHERE {field} <> '' GROUP BY dedup_key, {field}) x GROUP BY dedup_key"""


_BEST_SQL = f""", web AS ({_d_common('website')}), price AS ({_d_common('price_range')}),
best AS (SELECT dedup_key, max(rating) FILTER (rating <> 0) AS rating,
  arg_max(description, length(description) * 100000000 - seq) FILTER (description <> '') AS description FROM keyed GROUP BY dedup_key)
"""


@query("a5_best_values", KEYED + _BEST_SQL + "SELECT best.*, website, price_range FROM best LEFT JOIN web USING (dedup_key) LEFT JOIN price USING (dedup_key)")
def a5(spark, sf):
    m = dedup.merged_fields(dedup.with_dedup_key(businesses(spark, sf)))
    return m.select("dedup_key", "rating", "description", "website", "price_range")


@query(
    "e3_remove_duplicates",
    KEYED + _MERGED_SQL + _BEST_SQL + f""", merged AS ({_A4_SELECT}),
    firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dedup_key ORDER BY seq) AS r FROM keyed) x WHERE r = 1)
    SELECT f.dedup_key, g.copies, f.seq, f.name,
      CASE WHEN g.copies > 1 THEN g.phone_numbers ELSE coalesce(f.phone, '') END AS phone_numbers,
      CASE WHEN g.copies > 1 THEN g.emails ELSE replace(f.emails, ',', '|') END AS emails,
      CASE WHEN g.copies > 1 THEN g.social_media ELSE concat_ws('|', 'facebook=' || f.facebook, 'instagram=' || f.instagram) END AS social_media,
      CASE WHEN g.copies > 1 THEN coalesce(b.rating, f.rating) ELSE f.rating END AS rating,
      CASE WHEN g.copies > 1 THEN coalesce(b.description, f.description) ELSE f.description END AS description,
      CASE WHEN g.copies > 1 THEN coalesce(w.website, f.website) ELSE f.website END AS website
    FROM firsts f JOIN merged g USING (dedup_key) JOIN best b USING (dedup_key) LEFT JOIN web w USING (dedup_key)""",
)
def e3(spark, sf):
    out = dedup.remove_duplicates(businesses(spark, sf))
    return out.select(
        "dedup_key", "copies", "seq", "name", joined("phone_numbers").alias("phone_numbers"), joined("emails").alias("emails"),
        map_text("social_media").alias("social_media"), "rating", "description", "website",
    )


@query(
    "a8_dedup_report",
    KEYED + "SELECT count(*) AS input_rows, count(DISTINCT dedup_key) AS kept_rows, count(*) - count(DISTINCT dedup_key) AS removed_rows FROM keyed",
)
def a8(spark, sf):
    return dedup.dedup_report(dedup.with_dedup_key(businesses(spark, sf)))


@query(
    "l4_most_common",
    BIZ + """SELECT city, arg_max(category, n * 100000000 - f) AS category, max(n) AS n FROM (
      SELECT city, category, count(*) AS n, min(seq) AS f FROM biz WHERE category <> '' GROUP BY city, category) x GROUP BY city""",
)
def l4(spark, sf):
    return dedup.most_common(biz(spark, sf), "city", "category")


@query("j11_not_processed", BIZ + f"SELECT seq, {d_record_id()} AS _id FROM biz WHERE {d_record_id()} NOT IN (SELECT {d_record_id()} FROM biz WHERE k % 4 = 1)")
def j11(spark, sf):
    rows = records.with_record_id(biz(spark, sf).select("seq", "k", "name", "phone", "address"))
    return dedup.not_processed(rows, rows.filter("k % 4 = 1")).select("seq", "_id")


@query("w2_serial_number", BIZ + "SELECT seq, row_number() OVER (ORDER BY seq) AS s_no FROM biz")
def w2(spark, sf):
    return ordering.with_serial(biz(spark, sf).select("seq"), span=1000)


@query("x29_slug", BIZ + """SELECT seq, regexp_replace(s7, '^-+|-+$', '', 'g') AS slug FROM (
      SELECT seq, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
        regexp_replace(regexp_replace(lower(name || ' Corp LLC'), '[^\\p{L}\\p{N}_\\s-]', '', 'g'), '\\s+', '-', 'g'),
        '-llc$', ''), '-inc$', ''), '-corp$', ''), '-ltd$', ''), '-co$', ''), '-company$', '') AS s7 FROM biz) x""")
def x29(spark, sf):
    return biz(spark, sf).select("seq", text.business_slug(F.concat("name", F.lit(" Corp LLC"))).alias("slug"))


# -- similarity ------------------------------------------------------------------


def _d_ratio(a: str, b: str) -> str:
    """Indel ratio in DuckDB: the LCS table folded row by row over the letters of ``a``.

    A row is a running maximum, taken over list slices.
    """
    letters = f"string_split({a}, '')"
    n = f"length({b})"
    start = f"list_transform(range(0, {n} + 1), lambda z: 0)"
    hits = f"list_transform({letters}, lambda ch: list_transform(range(1, {n} + 1), lambda j: CASE WHEN substr({b}, j, 1) = ch THEN 1 ELSE 0 END))"
    step = (
        "list_transform(range(1, len(acc) + 1), lambda i: list_max(list_transform(range(1, i + 1), lambda t:"
        " CASE WHEN t = 1 THEN 0 ELSE greatest(acc[t], acc[t - 1] + m[t - 1]) END)))"
    )
    lcs = f"list_last(list_reduce({hits}, lambda acc, m: {step}, {start}))"
    return (
        f"CASE WHEN coalesce({a}, '') = '' OR coalesce({b}, '') = '' THEN NULL WHEN {a} = {b} THEN 100"
        f" ELSE CAST(floor(200.0 * ({lcs}) / (length({a}) + length({b})) + 0.5) AS INT) END"
    )


_NORM = f""", norm AS (SELECT seq, nullif(lower(name), '') AS n, nullif({d_clean('address')}, '') AS a,
  nullif(lower(category), '') AS c, {d_phone('phone')} AS p FROM biz),
prof AS (SELECT n, a, c, p, min(seq) AS rep, count(*) AS members FROM norm GROUP BY n, a, c, p),
cand AS (SELECT x.rep AS a, y.rep AS b, x.n AS xn, y.n AS yn, x.a AS xa, y.a AS ya, x.c AS xc, y.c AS yc
  FROM prof x JOIN prof y ON x.p = y.p AND x.rep < y.rep),
rated AS (SELECT a, b, coalesce(0.4 * ({_d_ratio('xn', 'yn')}), 0) + coalesce(0.3 * ({_d_ratio('xa', 'ya')}), 0) + 20
  + coalesce(0.1 * ({_d_ratio('xc', 'yc')}), 0) AS score FROM cand),
heads AS (SELECT n, a, c, min(rep) AS head FROM prof WHERE n IS NOT NULL AND a IS NOT NULL AND c IS NOT NULL GROUP BY n, a, c),
links AS (
  SELECT a, b, CAST(round(score, 4) AS DOUBLE) AS score, 'pair' AS kind FROM rated WHERE round(score, 4) >= 80
  UNION ALL SELECT head, rep, 80.0, 'same_text' FROM prof JOIN heads USING (n, a, c) WHERE rep > head
  UNION ALL SELECT rep, seq, s, 'same_profile' FROM (SELECT f.rep, m.seq,
      CASE WHEN m.n IS NULL THEN 0.0 ELSE 40.0 END + CASE WHEN m.a IS NULL THEN 0.0 ELSE 30.0 END
      + CASE WHEN m.p IS NULL THEN 0.0 ELSE 20.0 END + CASE WHEN m.c IS NULL THEN 0.0 ELSE 10.0 END AS s
    FROM norm m JOIN prof f ON m.n IS NOT DISTINCT FROM f.n AND m.a IS NOT DISTINCT FROM f.a
      AND m.c IS NOT DISTINCT FROM f.c AND m.p IS NOT DISTINCT FROM f.p WHERE m.seq > f.rep) z WHERE s >= 80)
"""


@query("j3_similar_links", BIZ + _NORM + "SELECT a, b, score, kind FROM links")
def j3(spark, sf):
    return similar.similar_links(businesses(spark, sf))


@query(
    "x33_similarity_score",
    BIZ + _NORM + "SELECT a, b, CAST(round(score, 4) AS DOUBLE) AS score FROM rated",
)
def x33(spark, sf):
    """Scores of all profiles that share a phone, whatever their level."""
    return similar.scores_by_phone(businesses(spark, sf))


@query("x32_string_ratio", BIZ + f"SELECT seq, {_d_ratio('name', 'description')} AS ratio FROM biz")
def x32(spark, sf):
    return biz(spark, sf).select("seq", similarity_ratio("name", "description").alias("ratio"))


@query(
    "j3_similar_pairs",
    BIZ + _NORM + """, matched AS (SELECT a, b, round(score, 4) AS score FROM rated WHERE round(score, 4) >= 80
      UNION ALL SELECT x.rep, y.rep, 80.0 FROM prof x JOIN prof y ON x.n = y.n AND x.a = y.a AND x.c = y.c AND x.rep < y.rep AND x.p IS DISTINCT FROM y.p)
    SELECT a, b, CAST(score AS DOUBLE) AS score FROM matched""",
)
def j3_pairs(spark, sf):
    """The test records hold no two rows with equal compared fields, so profiles are records."""
    return similar.expand_links(similar.similar_links(businesses(spark, sf)))


# The suppliers as records with similar names and addresses; some lack a field. The twin compares all pairs.
_SHOPS = """SELECT s_suppkey AS seq, CASE WHEN s_suppkey % 5 = 4 THEN NULL ELSE s_name || ' ' || r_name END AS name,
  CASE WHEN s_suppkey % 3 = 2 THEN '' ELSE CAST(s_suppkey % 40 AS STRING) || ' Main St., ' || n_name END AS address,
  CASE WHEN s_suppkey % 2 = 0 THEN '212555' || lpad(CAST(s_suppkey % 9 AS STRING), 4, '0') END AS phone, r_name AS category
FROM {supplier} JOIN {nation} ON n_nationkey = s_nationkey JOIN {region} ON r_regionkey = n_regionkey"""


def _shops(spark, sf):
    return spark.sql(_SHOPS.format(**{t: f"parquet.`{sf}/{t}.parquet`" for t in ("supplier", "nation", "region")})).withColumnRenamed("phone", "primary_phone")


def _d_all_pairs(threshold: float, normalize: bool) -> str:
    weight = "coalesce(0.4 * (rn >= 0)::INT, 0) + coalesce(0.3 * (ra >= 0)::INT, 0) + coalesce(0.2 * (xp = yp OR xp <> yp)::INT, 0) + coalesce(0.1 * (rc >= 0)::INT, 0)"
    return f"""
WITH shops AS ({_SHOPS.format(supplier="supplier", nation="nation", region="region")}),
norm AS (SELECT seq, nullif(lower(name), '') AS n, nullif({d_clean('address')}, '') AS a, nullif(lower(category), '') AS c, {d_phone('phone')} AS p FROM shops),
cand AS (SELECT x.seq AS a, y.seq AS b, x.n AS xn, y.n AS yn, x.a AS xa, y.a AS ya, x.c AS xc, y.c AS yc, x.p AS xp, y.p AS yp FROM norm x JOIN norm y ON x.seq < y.seq),
texts AS (SELECT DISTINCT xc, yc FROM cand), ratios AS (SELECT xc, yc, {_d_ratio('xc', 'yc')} AS rc FROM texts),
rated AS (SELECT a, b, xp, yp, {_d_ratio('xn', 'yn')} AS rn, {_d_ratio('xa', 'ya')} AS ra, rc FROM cand LEFT JOIN ratios USING (xc, yc)),
scored AS (SELECT a, b, (coalesce(0.4 * rn, 0) + coalesce(0.3 * ra, 0) + CASE WHEN xp = yp THEN 20 ELSE 0 END + coalesce(0.1 * rc, 0)) / ({weight if normalize else 1.0}) AS score FROM rated)
SELECT a, b, CAST(round(score, 4) AS DOUBLE) AS score FROM scored WHERE round(score, 4) >= {threshold}"""


@query("j3_similar_pairs_at_65", _d_all_pairs(65, False))
def j3_at_65(spark, sf):
    return similar.expand_links(similar.similar_links(_shops(spark, sf), 65.0))


@query("j3_similar_pairs_normalized", _d_all_pairs(85, True))
def j3_normalized(spark, sf):
    return similar.expand_links(similar.similar_links(_shops(spark, sf), 85.0, normalize=True))


@query(
    "c4_duplicate_groups",
    (BIZ + _NORM).replace("WITH ", "WITH RECURSIVE ", 1) + """, e AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
    reach AS (SELECT DISTINCT a AS node, a AS other FROM e UNION SELECT r.node, e.b FROM reach r JOIN e ON e.a = r.other)
    SELECT node AS seq, min(other) AS group_id FROM reach GROUP BY node""",
)
def c4(spark, sf):
    return similar.duplicate_groups(businesses(spark, sf))


# -- reports ---------------------------------------------------------------------


@query(
    "a1_coverage_summary",
    BIZ + """SELECT count(*) AS total_businesses, coalesce(round(100.0 * count(*) FILTER (phone <> '') / count(*), 2), 0.0) AS with_phone,
      coalesce(round(100.0 * count(*) FILTER (emails <> '') / count(*), 2), 0.0) AS with_email,
      coalesce(round(100.0 * count(*) FILTER (website <> '') / count(*), 2), 0.0) AS with_website,
      coalesce(round(avg(rating) FILTER (rating <> 0), 2), 0.0) AS avg_rating FROM biz""",
)
def a1(spark, sf):
    return reports.coverage_summary(businesses(spark, sf))


@query("a2_contact_counts", BIZ + _A2_SQL)
def a2(spark, sf):
    return reports.contact_counts(biz(spark, sf))


@query(
    "a3_store_statistics",
    BIZ + """SELECT count(*) AS total_businesses, count(*) FILTER (phone <> '') AS with_phone, count(*) FILTER (emails <> '') AS with_email,
      count(website) AS with_website, coalesce(round(avg(rating), 2), 0.0) AS avg_rating FROM biz""",
)
def a3(spark, sf):
    return reports.store_statistics(businesses(spark, sf))


_QUALITY_SQL = """SELECT seq, score / 20.0 * 100 AS completeness,
  CASE WHEN score / 20.0 * 100 >= 90 THEN 'A' WHEN score / 20.0 * 100 >= 80 THEN 'B' WHEN score / 20.0 * 100 >= 70 THEN 'C'
       WHEN score / 20.0 * 100 >= 60 THEN 'D' ELSE 'F' END AS grade
FROM (SELECT seq, CAST((name <> '')::INT + coalesce((phone <> '')::INT, 0) + coalesce((emails <> '')::INT, 0) + coalesce((website <> '')::INT, 0)
  + (address <> '')::INT + (lat IS NOT NULL)::INT + (opening_hours IS NOT NULL)::INT + coalesce((rating <> 0)::INT, 0) + (reviews > 10)::INT
  + (facebook IS NOT NULL OR instagram IS NOT NULL)::INT + (price_range IS NOT NULL)::INT + 2 * verified::INT + claimed::INT
  + (description IS NOT NULL)::INT + (amenities IS NOT NULL)::INT + (year_established IS NOT NULL)::INT + (payment_methods IS NOT NULL)::INT AS DOUBLE) AS score
  FROM biz) x"""


@query("x34_x35_quality", BIZ + _QUALITY_SQL)
def x34(spark, sf):
    b = canonical(businesses(spark, sf)).withColumns({"latitude": F.col("coordinates.lat"), "longitude": F.col("coordinates.lng")})
    return b.withColumn("completeness", quality.completeness(b)).select("seq", "completeness", quality.grade(F.col("completeness")).alias("grade"))


@query(
    "x37_attributes",
    BIZ + """SELECT seq, concat_ws('|', CASE WHEN claimed THEN 'claimed' END, CASE WHEN reviews > 100 THEN 'popular' END,
      CASE WHEN verified THEN 'verified' END) AS attributes FROM biz""",
)
def x37(spark, sf):
    flags = F.create_map(F.lit("verified"), F.col("verified"), F.lit("claimed"), F.col("claimed"), F.lit("popular"), F.col("reviews") > 100)
    return biz(spark, sf).select("seq", joined(quality.true_attributes(flags)).alias("attributes"))


@query("x38_point_wkt", BIZ + "SELECT seq, CASE WHEN lat IS NOT NULL THEN printf('POINT (%.6f %.6f)', lng, lat) END AS point FROM biz")
def x38(spark, sf):
    return biz(spark, sf).select("seq", quality.point_wkt(F.col("lng"), F.col("lat")).alias("point"))


_HAVERSINE = """2 * 6371000.0 * asin(sqrt(least(1.0, pow(sin(radians({b}lat - {a}lat) / 2), 2)
  + cos(radians({a}lat)) * cos(radians({b}lat)) * pow(sin(radians({b}lng - {a}lng) / 2), 2))))"""


@query("x39_distance", BIZ + f"SELECT seq, round({_HAVERSINE.replace('{a}lat', '40.0').replace('{a}lng', '-74.0').replace('{b}', '')}, 1) AS distance_m FROM biz WHERE lat IS NOT NULL")
def x39(spark, sf):
    d = quality.haversine_m(F.lit(40.0), F.lit(-74.0), F.col("lat"), F.col("lng"))
    return biz(spark, sf).filter("lat is not null").select("seq", F.round(d, 1).alias("distance_m"))


@query(
    "a12_rating_distribution",
    duck_with("reviews") + """SELECT business_id, CAST(sum(n) AS BIGINT) AS reviews_count, string_agg(rating || '=' || n, '|' ORDER BY rating) AS rating_distribution
    FROM (SELECT business_id, rating, count(*) AS n FROM reviews GROUP BY business_id, rating) x GROUP BY business_id""",
)
def a12(spark, sf):
    out = reports.rating_distribution(view(spark, sf, "reviews"))
    return out.withColumn("rating_distribution", map_text("rating_distribution"))


@query(
    "w9_recent_reviews",
    duck_with("reviews") + """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY business_id ORDER BY review_date DESC, review_id DESC) AS recency FROM reviews) x
    WHERE recency <= 10""",
)
def w9(spark, sf):
    return reports.recent_reviews(view(spark, sf, "reviews"))


@query(
    "a13_tag_usage",
    duck_with("tag_links") + "SELECT tag_id, count(DISTINCT business_id) AS usage_count FROM tag_links GROUP BY tag_id",
)
def a13(spark, sf):
    return reports.usage_count(view(spark, sf, "tag_links"), "tag_id")


@query(
    "a14_market_density",
    BIZ + """SELECT city, category, grouping(city) * 2 + grouping(category) AS level, count(*) AS businesses,
      round(avg(rating) FILTER (rating <> 0), 4) AS avg_rating FROM biz GROUP BY CUBE (city, category)""",
)
def a14(spark, sf):
    return reports.market_density(biz(spark, sf).select("city", "category", "rating"))


# -- joins -----------------------------------------------------------------------

_STAMP = "2024-02-01 00:00:00"
_FULL = """FROM snap_old o FULL JOIN snap_new n ON o.id = n.id"""


@query(
    "j1_upsert_overwrite",
    duck_with("snap_old", "snap_new") + f"""SELECT coalesce(n.id, o.id) AS id, CASE WHEN n.id IS NOT NULL THEN n.name ELSE o.name END AS name,
      CASE WHEN n.id IS NOT NULL THEN n.rating ELSE o.rating END AS rating, CASE WHEN n.id IS NOT NULL THEN n.category ELSE o.category END AS category,
      CASE WHEN n.id IS NOT NULL THEN TIMESTAMP '{_STAMP}' END AS updated_at {_FULL}""",
)
def j1(spark, sf):
    new = view(spark, sf, "snap_new")
    twice = new.withColumn("name", F.lit("stale")).withColumn("at", F.lit(1)).unionByName(new.withColumn("at", F.lit(2)))
    batch = store.last_per_id(twice, "id", "at").drop("at")
    return store.upsert_overwrite(view(spark, sf, "snap_old"), batch, as_of=_STAMP)


@query("j1_upsert_store", ORACLES["j1_upsert_overwrite"])
def j1_store(spark, sf):
    path = work_path(spark, "upsert-store")
    store.create_store(view(spark, sf, "snap_old").withColumn("updated_at", F.lit(None).cast("timestamp_ntz")), path, buckets=8)
    store.upsert_store(view(spark, sf, "snap_new"), path, as_of=_STAMP)
    return store.open_store(spark, path)


@query(
    "j2_upsert_fill",
    duck_with("snap_old", "snap_new") + f"""SELECT coalesce(n.id, o.id) AS id, coalesce(n.name, o.name) AS name, coalesce(n.rating, o.rating) AS rating,
      coalesce(n.category, o.category) AS category, CASE WHEN n.id IS NOT NULL THEN TIMESTAMP '{_STAMP}' END AS last_scraped {_FULL}""",
)
def j2(spark, sf):
    return store.upsert_fill(view(spark, sf, "snap_old"), view(spark, sf, "snap_new"), as_of=_STAMP)


def _d_change(field: str) -> str:
    return f"""SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NULL THEN 'create' WHEN n.id IS NULL THEN 'delete' ELSE 'update' END AS change_type,
      '{field}' AS field_name, CAST(o.{field} AS VARCHAR) AS old_value, CAST(n.{field} AS VARCHAR) AS new_value {_FULL} WHERE o.{field} IS DISTINCT FROM n.{field}"""


@query("j14_change_log", duck_with("snap_old", "snap_new") + " UNION ALL ".join(_d_change(f) for f in ("name", "rating", "category")))
def j14(spark, sf):
    return store.change_log(view(spark, sf, "snap_old"), view(spark, sf, "snap_new"))


@query(
    "j4_enrich_places",
    duck_with("biz", "places") + """SELECT b.seq, CASE WHEN b.phone <> '' THEN b.phone ELSE coalesce(p.phone, b.phone) END AS phone,
      CASE WHEN b.website <> '' THEN b.website ELSE coalesce(p.website, b.website) END AS website,
      coalesce(p.opening_hours, b.opening_hours) AS opening_hours, CASE WHEN p.price_level <> 0 THEN p.price_level END AS price_level,
      p.place_id IS NOT NULL AS enriched_places FROM biz b LEFT JOIN places p ON p.place_id = b.place_id""",
)
def j4(spark, sf):
    out = enrich.enrich_places(biz(spark, sf), view(spark, sf, "places"))
    return out.select("seq", "phone", "website", "opening_hours", "price_level", "enriched_places")


@query(
    "j5_enrich_registry",
    duck_with("biz", "registry") + f"""SELECT b.seq, r.registrar, r.creation_date,
      CASE WHEN coalesce(b.emails, '') = '' AND r.email <> '' THEN r.email WHEN b.emails = '' THEN '' ELSE replace(b.emails, ',', '|') END AS emails
    FROM biz b LEFT JOIN registry r ON r.domain = {d_lookup_domain('b.website')}""",
)
def j5(spark, sf):
    out = enrich.enrich_registry(businesses(spark, sf), view(spark, sf, "registry"))
    return out.select("seq", "whois.registrar", "whois.creation_date", joined("emails").alias("emails"))


@query(
    "j6_enrich_company",
    duck_with("biz", "companies") + f"""SELECT b.seq, c.name, c.description, c.industry, c.employees, c.market_cap, c.founded_year, c.phone, c.email_provider
    FROM biz b LEFT JOIN companies c ON c.domain = {d_lookup_domain('b.website')}""",
)
def j6(spark, sf):
    return enrich.enrich_company(businesses(spark, sf), view(spark, sf, "companies")).select("seq", "company.*")


@query(
    "j7_enrich_contacts",
    duck_with("biz", "contacts") + f"""SELECT seq, unnest(string_split(emails, ',')) AS email, 'own' AS origin, CAST(NULL AS VARCHAR) AS type, CAST(NULL AS INT) AS confidence
    FROM biz WHERE emails <> '' UNION ALL
    SELECT b.seq, c.email, 'directory', c.type, c.confidence FROM biz b JOIN contacts c ON c.domain = {d_lookup_domain('b.website')}""",
)
def j7(spark, sf):
    return enrich.enrich_contacts(businesses(spark, sf), view(spark, sf, "contacts"))


@query(
    "j9_active_flag",
    duck_with("biz", "site_status", "places") + """SELECT b.seq, coalesce(s.http_status = 200, false) OR NOT coalesce(p.permanently_closed, false) AS is_active
    FROM biz b LEFT JOIN site_status s ON s.website = b.website LEFT JOIN places p ON p.place_id = b.place_id""",
)
def j9(spark, sf):
    return enrich.active_flag(biz(spark, sf), view(spark, sf, "site_status"), view(spark, sf, "places")).select("seq", "is_active")


@query(
    "j10_drop_disposable",
    BIZ + """SELECT seq, address FROM (SELECT seq, unnest(string_split(emails, ',')) AS address FROM biz WHERE emails <> '') x
    WHERE lower(split_part(address, '@', 2)) NOT IN (SELECT 'site' || CAST(c_custkey AS VARCHAR) || '.example.com' FROM customer WHERE c_acctbal < 0)""",
)
def j10(spark, sf):
    emails = businesses(spark, sf).select("seq", F.explode("emails").alias("address"))
    block = spark.read.parquet(f"{sf}/customer.parquet").filter("c_acctbal < 0")
    return enrich.drop_disposable(emails, block.select(F.format_string("SITE%d.example.com", "c_custkey").alias("domain")))


@query(
    "j12_business_tags",
    duck_with("tag_links", "tags") + """SELECT business_id, string_agg(DISTINCT tag, '|' ORDER BY tag) AS tags FROM tag_links JOIN tags USING (tag_id) GROUP BY business_id""",
)
def j12(spark, sf):
    out = enrich.business_tags(view(spark, sf, "tag_links"), view(spark, sf, "tags"))
    return out.select("business_id", joined("tags").alias("tags"))


@query(
    "j13_category_paths",
    duck_with("categories").replace("WITH ", "WITH RECURSIVE ", 1) + """, tree AS (SELECT id, parent_id, name, 0 AS level, name AS path FROM categories WHERE parent_id IS NULL
    UNION ALL SELECT c.id, c.parent_id, c.name, t.level + 1, t.path || '/' || c.name FROM categories c JOIN tree t ON c.parent_id = t.id) SELECT * FROM tree""",
)
def j13(spark, sf):
    return taxonomy.category_paths(view(spark, sf, "categories"))


_J8_RADIUS = 60_000.0


@query(
    "j8_competitors",
    BIZ + f"""SELECT seq, rank, competitor_seq, competitor_name, competitor_rating, distance_m, round(1 - distance_m / {_J8_RADIUS}, 4) AS similarity
    FROM (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY distance_m, competitor_seq) AS rank FROM (
      SELECT a.seq, b.seq AS competitor_seq, b.name AS competitor_name, b.rating AS competitor_rating,
        round({_HAVERSINE.replace('{a}', 'a.').replace('{b}', 'b.')}, 2) AS distance_m
      FROM biz a JOIN biz b ON a.category = b.category AND a.seq <> b.seq AND a.lat IS NOT NULL AND b.lat IS NOT NULL) p
      WHERE distance_m <= {_J8_RADIUS}) r WHERE rank <= 10""",
)
def j8(spark, sf):
    from ..operators.competitors import find_competitors

    return find_competitors(businesses(spark, sf), radius_m=_J8_RADIUS)


__all__ = ["RECORD"]
