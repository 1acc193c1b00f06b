"""Queries, upserts and change logs over business tables."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.presence import has

HIGH_RATING = 4.5  # fixed value
#: Keywords that are tested one after the other, and characters by which more of them are looked up.
FEW_KEYWORDS, PIECE, STRETCH = 64, 16, 256
BUCKET = "store_bucket"


def query_records(df: DataFrame, filters: dict | None = None, limit: int | None = 100, order: str = "seq") -> DataFrame:
    """F1, L2: equality filters on known columns, unknown names ignored, first ``limit`` rows."""
    tests = [F.col(k) == F.lit(v) for k, v in (filters or {}).items() if k in df.columns]
    found = df.filter(reduce(lambda a, b: a & b, tests)) if tests else df
    return found if limit is None else found.orderBy(order).limit(limit)


def high_rated(df: DataFrame) -> DataFrame:
    """F2."""
    return df.filter(F.col("rating") >= HIGH_RATING)


def with_email(df: DataFrame) -> DataFrame:
    """F3."""
    return df.filter(has(df, "emails"))


def search_filter(df, min_rating=None, min_reviews=None, categories=None, max_results=None, order="seq") -> DataFrame:
    """the search limits of a job."""
    if min_rating is not None:
        df = df.filter(F.col("rating") >= min_rating)
    if min_reviews is not None:
        df = df.filter(F.col("reviews") >= min_reviews)
    if categories:
        df = df.filter(F.lower("category").isin(*[c.lower() for c in categories]))
    return df if max_results is None else df.orderBy(order).limit(max_results)


def without_keywords(df: DataFrame, column: str, keywords: list[str] | DataFrame) -> DataFrame:
    """drops rows whose text holds any keyword, in any case; NULL text stays, NULL keywords count for nothing.

    ``keywords`` is a list or a table of one column, of any length. For more than ``FEW_KEYWORDS`` the pieces of each different
    text are looked up among the first pieces of the keywords, of 1, 2, 4, 8 or ``PIECE`` characters, as many as a keyword has.
    Where one is found, the text is cut to each length of the keywords that begin so, and what is cut out is joined
    with the keywords as a whole. So a text meets no more keywords of a beginning than these have lengths, however many they are.
    """
    text = F.lower(F.coalesce(F.col(column), F.lit("")))
    if not isinstance(keywords, DataFrame):
        known = sorted({k.lower() for k in keywords if k is not None})
        if len(known) <= FEW_KEYWORDS:
            return df.filter(~reduce(lambda a, b: a | b, [text.contains(k) for k in known], F.lit(False)))
        keywords = df.sparkSession.createDataFrame([(k,) for k in known], "keyword string")
    table = keywords.select(F.lower(F.col(keywords.columns[0])).alias("keyword")).filter("keyword is not null").distinct()
    size = F.expr(f"least({PIECE}, shiftleft(1, length(bin(length(keyword))) - 1))")
    table = table.select("keyword", size.alias("size"))
    sizes = sorted(r[0] for r in table.select("size").distinct().collect())  # a few powers of two
    begun = table.groupBy(F.expr("substring(keyword, 1, size)").alias("piece")).agg(F.collect_set(F.length("keyword")).alias("lengths"))
    texts = df.select(text.alias("text")).distinct()
    stretches = F.transform(F.sequence(F.lit(0), F.floor(F.length("text") / STRETCH)), lambda n: F.substring("text", n * STRETCH + 1, F.lit(STRETCH + PIECE - 1)))

    def pieces(n: int) -> Column:
        """Where each piece of ``n`` characters lies, taken from short stretches of the text."""

        def of(stretch: Column, number: Column) -> Column:
            last = F.least(F.length(stretch) - n + 1, F.lit(STRETCH))
            places = F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
            return F.transform(places, lambda i: F.struct((number * STRETCH + i).alias("at"), F.substring(stretch, i, F.lit(n)).alias("piece")))

        return F.flatten(F.transform(stretches, of))

    none = F.array(F.struct(F.lit(1).alias("at"), F.lit("").alias("piece")))
    placed = texts.select("text", F.inline(F.concat(none, *[pieces(n) for n in sizes])))
    cut_out = placed.join(begun, "piece").select("text", "at", F.explode("lengths").alias("n")).filter(F.col("at") + F.col("n") - 1 <= F.length("text"))
    met = cut_out.select("text", F.substring("text", F.col("at"), F.col("n")).alias("keyword")).distinct().join(table, "keyword", "left_semi")
    return df.join(met.select(F.col("text").alias("__held")).distinct(), text == F.col("__held"), "left_anti")


def contactable(df: DataFrame, by: str) -> DataFrame:
    """rows that have a phone, a website or a rating (``by`` names the column)."""
    return df.filter(has(df, by))


def retained(df: DataFrame, as_of: str, days: int = 30, column: str = "scraped_at") -> DataFrame:
    """rows not older than ``days`` at ``as_of``."""
    return df.filter(F.col(column) >= F.expr(f"timestamp_ntz'{as_of}' - interval {int(days)} days"))


def known_columns(df: DataFrame, known: list[str]) -> DataFrame:
    """projection to the columns a table knows."""
    return df.select(*[c for c in df.columns if c in known])


def union_records(*frames: DataFrame) -> DataFrame:
    """U4: records with differing columns, missing ones NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def last_per_id(batch: DataFrame, id_col: str, seq: str) -> DataFrame:
    """The batch as if applied row by row: its last row for each id."""
    rank = F.row_number().over(Window.partitionBy(id_col).orderBy(F.col(seq).desc()))
    return batch.withColumn("__rank", rank).filter("__rank = 1").drop("__rank")


def _upsert(target: DataFrame, batch: DataFrame, id_col: str, pick, stamp: str, as_of) -> DataFrame:
    t = target.withColumn("__t", F.lit(True)).alias("t")
    s = batch.withColumn("__s", F.lit(True)).alias("s")
    joined = t.join(s, F.col(f"t.{id_col}") == F.col(f"s.{id_col}"), "full_outer")
    touched = F.col("s.__s").isNotNull()
    out = [F.coalesce(f"s.{id_col}", f"t.{id_col}").alias(id_col)]
    for c in target.columns:
        if c in (id_col, stamp):
            continue
        out.append((pick(touched, F.col(f"s.{c}"), F.col(f"t.{c}")) if c in batch.columns else F.col(f"t.{c}")).alias(c))
    old_stamp = F.col(f"t.{stamp}") if stamp in target.columns else F.lit(None)
    out.append(F.when(touched, F.lit(as_of)).otherwise(old_stamp).cast("timestamp_ntz").alias(stamp))
    return joined.select(*out)


def upsert_overwrite(target, batch, id_col="id", as_of=None) -> DataFrame:
    """Supplied columns overwrite, even with NULL; new ids are added; unknown columns ignored.

    ``batch`` holds one row per id (see ``last_per_id``).
    """
    return _upsert(target, batch, id_col, lambda hit, s, t: F.when(hit, s).otherwise(t), "updated_at", as_of)


def upsert_fill(target, batch, id_col="id", as_of=None) -> DataFrame:
    """Only non-NULL values overwrite; stamps ``last_scraped``."""
    return _upsert(target, batch, id_col, lambda hit, s, t: F.coalesce(s, t), "last_scraped", as_of)


def _bucket(id_col: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(buckets)).cast("int")


def _write_buckets(df: DataFrame, path: str, how: str) -> None:
    """``how``: "dynamic" replaces only the folders that ``df`` has rows for."""
    df.repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", how).partitionBy(BUCKET).parquet(path)


def create_store(df: DataFrame, path: str, id_col: str = "id", buckets: int = 64) -> None:
    """A table that ``upsert_store`` can change in place: files in folders by a hash of the id.

    A batch of m ids rewrites m folders at most, so there should be many more of them than a usual batch has ids, each still of some megabytes.
    """
    spark = df.sparkSession
    _write_buckets(df.withColumn(BUCKET, _bucket(id_col, buckets)), path, "static")
    layout = spark.createDataFrame([(id_col, buckets, df.schema.json())], "id_col string, buckets int, schema string")
    layout.coalesce(1).write.mode("overwrite").parquet(f"{path}/_layout")


def _exists(spark, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _finish(spark, path: str) -> None:
    """Puts in place what an upsert has staged whole; does nothing twice."""
    staged = f"{path}/_staged"
    if not _exists(spark, staged):
        return
    if _exists(spark, f"{staged}/_SUCCESS"):
        layout = spark.read.parquet(f"{path}/_layout").first()
        schema = T.StructType.fromJson(json.loads(layout.schema)).add(BUCKET, T.IntegerType())
        _write_buckets(spark.read.schema(schema).parquet(staged), path, "dynamic")
    p = spark._jvm.org.apache.hadoop.fs.Path(staged)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def open_store(spark, path: str) -> DataFrame:
    """The rows of a store, after finishing an upsert that was cut off."""
    _finish(spark, path)
    return _stored(spark, path).drop(BUCKET)


def _stored(spark, path: str) -> DataFrame:
    layout = spark.read.parquet(f"{path}/_layout").first()
    return spark.read.schema(T.StructType.fromJson(json.loads(layout.schema)).add(BUCKET, T.IntegerType())).parquet(path)


def upsert_store(batch: DataFrame, path: str, as_of=None, fill: bool = False) -> list[int]:
    """J1, or J2 with ``fill``, on a store: only the folders of ids that the batch holds are read and rewritten.

    Their new contents are first staged whole beside the store, then put in place folder by folder; if that is
    cut off, the next upsert or ``open_store`` does it again. ``batch`` holds one row per id and no NULL id; one writer at a time.
    The store must have the column of the time stamp. Returns the numbers of the folders.
    """
    spark = batch.sparkSession
    _finish(spark, path)
    layout = spark.read.parquet(f"{path}/_layout").first()
    id_col, buckets = layout.id_col, layout.buckets
    touched = sorted(r[0] for r in batch.select(_bucket(id_col, buckets)).distinct().collect())  # numbers below ``buckets``
    if not touched:
        return []
    old = _stored(spark, path).filter(F.col(BUCKET).isin(touched)).drop(BUCKET)
    new = (upsert_fill if fill else upsert_overwrite)(old, batch, id_col, as_of)
    types = {f.name: f.dataType for f in old.schema}
    rows = new.select(*[F.col(c).cast(types[c]).alias(c) for c in old.columns])
    _write_buckets(rows.withColumn(BUCKET, _bucket(id_col, buckets)), f"{path}/_staged", "static")
    _finish(spark, path)
    return touched


def change_log(old: DataFrame, new: DataFrame, id_col: str = "id", columns: list[str] | None = None) -> DataFrame:
    """One row per changed field: (id, field, old_value, new_value, change_type)."""
    cols = columns or [c for c in old.columns if c != id_col and c in new.columns]
    o = old.withColumn("__o", F.lit(True)).alias("o")
    n = new.withColumn("__n", F.lit(True)).alias("n")
    joined = o.join(n, F.col(f"o.{id_col}") == F.col(f"n.{id_col}"), "full_outer")
    kind: Column = F.when(F.col("__o").isNull(), "create").when(F.col("__n").isNull(), "delete").otherwise("update")
    fields = F.array(
        *[
            F.struct(
                F.lit(c).alias("field_name"),
                F.col(f"o.{c}").cast("string").alias("old_value"),
                F.col(f"n.{c}").cast("string").alias("new_value"),
            )
            for c in cols
        ]
    )
    changed = F.filter(fields, lambda f: ~f["old_value"].eqNullSafe(f["new_value"]))
    return joined.select(
        F.coalesce(f"o.{id_col}", f"n.{id_col}").alias(id_col), kind.alias("change_type"), F.inline(changed)
    )
