"""Exact deduplication by identity key, and merging of duplicates."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.presence import present
from ..functions.text import dedup_key
from ..session import cut

# Fixed values -------------------------------------------------------------------
LIST_FIELDS = ("phone_numbers", "emails", "amenities")
LIST_LIMIT = 10
MEDIA_FIELDS = ("photos", "recent_reviews")
MAP_FIELD = "social_media"
MOST_COMMON_FIELDS = ("website", "price_range")
LONGEST_FIELD, LARGEST_FIELD = "description", "rating"
# --------------------------------------------------------------------------------

#: Records a task of a merge takes, and slots a task: a record makes some ten values, so tasks are counted by records, not bytes.
TASK_RECORDS, _SLOTS = 50_000, 8

_ITEM = "array<struct<field:string,sub:string,value:string,pos:int>>"


def with_dedup_key(df: DataFrame, name: str = "dedup_key") -> DataFrame:
    """Adds the X2 key from the canonical columns."""
    key = dedup_key(
        "place_id", F.get("phone_numbers", 0), "name", "address", "website",
        F.col("coordinates.lat"), F.col("coordinates.lng"),
    )
    return df.withColumn(name, key)


def first_per_key(df: DataFrame, key: str = "dedup_key", seq: str = "seq") -> DataFrame:
    """The row with the lowest ``seq`` of each key.

    The rank filter is applied before the shuffle as well, so a hot key sends one row
    per task.
    """
    rank = F.row_number().over(Window.partitionBy(key).orderBy(seq))
    return df.withColumn("__rank", rank).filter("__rank = 1").drop("__rank")


def _item(field: str, sub, value, pos):
    return F.struct(F.lit(field).alias("field"), sub.alias("sub"), value.alias("value"), pos.alias("pos"))


def _list_items(field: str):
    # one position per value and row, so that the lowest seq also settles the position
    values = F.array_distinct(F.coalesce(F.col(field), F.array().cast("array<string>")))
    return F.transform(values, lambda v, i: _item(field, F.lit(""), v, i))


def _tasks(keyed: DataFrame) -> int:
    """How many tasks a merge has: as the session states, or more if there are many records."""
    return max(int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(keyed.count() / TASK_RECORDS))


def _slotted(keyed: DataFrame, tasks: int) -> DataFrame:
    """Records dealt to ``tasks`` tasks by their ``slot``, so that values of a key can be combined there before they are sent to it."""
    return keyed.withColumn("slot", F.pmod(F.xxhash64("seq"), F.lit(tasks * _SLOTS)).cast("int")).repartition(tasks, "slot")


def _items(df: DataFrame) -> DataFrame:
    """All values of the merged lists, maps and most common fields as rows (key, slot, seq, field, sub, value, pos)."""
    nothing, zero = F.lit(""), F.lit(0)
    parts = [_list_items(f) for f in LIST_FIELDS if f in df.columns]
    for f in MOST_COMMON_FIELDS:
        if f in df.columns:
            one = F.array(_item(f, nothing, F.col(f).cast("string"), zero))
            parts.append(F.when(present(f, df.schema[f].dataType), one).otherwise(F.array().cast(_ITEM)))
    if MAP_FIELD in df.columns:
        entries = F.coalesce(F.map_entries(MAP_FIELD), F.array().cast("array<struct<key:string,value:string>>"))
        parts.append(F.transform(entries, lambda e: _item(MAP_FIELD, e["key"], e["value"], zero)))
    items = F.filter(F.concat(F.array().cast(_ITEM), *[p.cast(_ITEM) for p in parts]), lambda x: x["value"].isNotNull())
    return df.select("dedup_key", "slot", "seq", F.inline(items))


def _best(slotted: DataFrame, tasks: int) -> DataFrame:
    """A5 for the fields with a largest or longest value: one row a key, of which a task keeps one value at a time."""
    best, order = [F.count("*").alias("copies")], F.lit(None).cast("struct<length:int,first:bigint>")
    if LARGEST_FIELD in slotted.columns:
        largest = F.when(present(LARGEST_FIELD, slotted.schema[LARGEST_FIELD].dataType), F.col(LARGEST_FIELD).try_cast("double"))
    else:
        largest = F.lit(None).cast("double")
    text = F.lit(None).cast("string")
    if LONGEST_FIELD in slotted.columns:
        text = F.when(present(LONGEST_FIELD, slotted.schema[LONGEST_FIELD].dataType), F.col(LONGEST_FIELD).cast("string"))
        # the length is the order; of the longest the first in input order
        order = F.when(text.isNotNull(), F.struct(F.length(text).alias("length"), (-F.col("seq")).alias("first")))
    best += [F.max(largest).alias(LARGEST_FIELD), F.max_by(text, order).alias(LONGEST_FIELD), F.max(order).alias("order")]
    of_slot = slotted.groupBy("dedup_key", "slot").agg(*best).repartition(tasks, "dedup_key")
    longest = F.max_by(LONGEST_FIELD, "order").alias(LONGEST_FIELD)
    return of_slot.groupBy("dedup_key").agg(F.sum("copies").alias("copies"), F.max(LARGEST_FIELD).alias(LARGEST_FIELD), longest)


def merged_fields(keyed: DataFrame) -> DataFrame:
    """A4 and A5 for every key: one row with ``copies`` and the merged fields.

    Largest and longest values are plain aggregates. For the others values of a (key, field) are combined in the slot of their
    records, then over all slots in portions of the key's values, of which at most ten are ranked on; so no group is ever
    collected whole, and the number of tasks grows with that of the records.
    """
    tasks = _tasks(keyed)
    slotted = _slotted(keyed, tasks)
    # the portion settles nothing but where values of a key with very many of them meet
    portion = F.pmod(F.xxhash64("value"), F.lit(64)).cast("int")
    values = (
        _items(slotted)
        .groupBy("dedup_key", "field", "sub", "value", "slot")
        .agg(F.count("*").alias("n"), F.min("seq").alias("first"), F.min_by("pos", "seq").alias("pos"), F.max("seq").alias("last"))
        .withColumn("portion", portion)
        .repartition(tasks, "dedup_key", "field", "sub", "portion")
        .groupBy("dedup_key", "field", "sub", "portion", "value")
        .agg(F.sum("n").alias("n"), F.min_by("pos", "first").alias("pos"), F.min("first").alias("first"), F.max("last").alias("last"))
    )
    weight = F.when(F.col("field").isin(*MOST_COMMON_FIELDS), F.col("n")).otherwise(F.lit(0))
    newest = F.when(F.col("field") == MAP_FIELD, F.col("last"))
    order = [F.col("weight").desc(), F.col("newest").desc(), F.col("first"), F.col("pos")]

    def leading(df: DataFrame, *group: str) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
        few = F.when(F.col("field").isin(*LIST_FIELDS), F.lit(LIST_LIMIT)).otherwise(F.lit(1))
        return df.withColumn("rank", rank).filter(F.col("rank") <= LIST_LIMIT).filter(F.col("rank") <= few)

    of_portion = leading(values.withColumns({"weight": weight, "newest": newest}), "dedup_key", "field", "sub", "portion")
    top = leading(of_portion.drop("rank").repartition(tasks, "dedup_key"), "dedup_key", "field", "sub")

    def one(field):
        return F.max(F.when(F.col("field") == field, F.col("value"))).alias(field)

    def many(field):
        ranked = F.collect_list(F.when(F.col("field") == field, F.struct("rank", "value")))
        return F.transform(F.array_sort(ranked), lambda x: x["value"]).alias(field)

    platforms = F.collect_list(F.when(F.col("field") == MAP_FIELD, F.struct("sub", "value")))
    lists = top.groupBy("dedup_key").agg(
        *[many(f) for f in LIST_FIELDS], F.map_from_entries(F.array_sort(platforms)).alias(MAP_FIELD), *[one(f) for f in MOST_COMMON_FIELDS]
    )
    none = {f: F.array().cast("array<string>") for f in LIST_FIELDS} | {MAP_FIELD: F.create_map().cast("map<string,string>")}
    return _best(slotted, tasks).join(lists, "dedup_key", "left").select(
        "dedup_key", "copies", *[F.coalesce(F.col(f), empty).alias(f) for f, empty in none.items()], LARGEST_FIELD, LONGEST_FIELD, *MOST_COMMON_FIELDS
    )


def merged_media(keyed: DataFrame, field: str) -> DataFrame:
    """A4 for the unlimited lists: (key, value, first_seq, first_pos), one row per value.

    Kept in long form since a group's list has no bound; order by the last two columns.
    """
    return (
        keyed.select("dedup_key", "seq", F.posexplode(F.array_distinct(field)).alias("pos", "value"))
        .groupBy("dedup_key", "value")
        .agg(F.min("seq").alias("first_seq"), F.min_by("pos", "seq").alias("first_pos"))
    )


def remove_duplicates(df: DataFrame) -> DataFrame:
    """D1 with A4 and A5: survivors in which merged values replace those of the first copy.

    Records without a duplicate stay as they are, and only the others are taken apart. Keyed
    records are written once, so that keys are made once and each step reads its own columns.
    """
    keyed = cut(with_dedup_key(df), "keyed")
    repeated = keyed.groupBy("dedup_key").count().filter("count > 1").select("dedup_key")
    merged = merged_fields(keyed.join(repeated, "dedup_key", "left_semi"))
    fields = [c for c in merged.columns if c not in ("dedup_key", "copies") and c in df.columns]
    m = merged.select("dedup_key", "copies", *[F.col(c).alias("m_" + c) for c in fields])
    joined = first_per_key(keyed).join(m, "dedup_key", "left")
    has_copies = F.col("copies").isNotNull()
    out = []
    for c in df.columns:
        if c in LIST_FIELDS or c == MAP_FIELD:
            out.append(F.when(has_copies, F.col("m_" + c)).otherwise(F.col(c)).alias(c))
        elif c in fields:
            out.append(F.coalesce("m_" + c, c).alias(c))
        else:
            out.append(F.col(c))
    return joined.select("dedup_key", F.coalesce("copies", F.lit(1)).cast("bigint").alias("copies"), *out)


def dedup_report(keyed: DataFrame) -> DataFrame:
    """Rows in, rows kept, rows removed."""
    per_key = keyed.groupBy("dedup_key").agg(F.count("*").alias("n"))
    return per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("input_rows"),
        F.count("*").alias("kept_rows"),
        (F.coalesce(F.sum("n"), F.lit(0)) - F.count("*")).alias("removed_rows"),
    )


def most_common(df: DataFrame, key: str, value: str, seq: str = "seq") -> DataFrame:
    """L4: most frequent non-empty value per key, ties to the one seen first."""
    counted = (
        df.filter(present(value, df.schema[value].dataType))
        .groupBy(key, value)
        .agg(F.count("*").alias("n"), F.min(seq).alias("first"))
    )
    best = F.max_by(value, F.struct("n", (-F.col("first")).alias("neg_first")))
    return counted.groupBy(key).agg(best.alias(value), F.max("n").alias("n"))


def not_processed(df: DataFrame, processed: DataFrame, id_col: str = "_id") -> DataFrame:
    """Rows whose record id is not among the processed ones."""
    return df.join(processed.select(id_col).distinct(), id_col, "left_anti")
