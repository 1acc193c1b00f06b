"""Completeness score and grade (X34, X35), and small column helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .presence import has

# Fixed values -------------------------------------------------------------------
POINTS_TOTAL = 20
ONE_POINT = (
    "name", "phone_numbers", "emails", "primary_website", "address",
    "opening_hours", "rating", "social_media", "price_range",
    "claimed", "description", "amenities",
    "year_established", "business_type", "payment_methods",
)
TWO_POINTS = ("verified",)
MORE_THAN = (("reviews_count", 10), ("photos_count", 5))
# Our grade limits; the source of the column names none.
GRADES = ((90, "A"), (80, "B"), (70, "C"), (60, "D"))
EARTH_RADIUS_M = 6371000.0
# --------------------------------------------------------------------------------


def completeness(df: DataFrame) -> Column:
    """0-100 over nineteen checks; columns ``df`` lacks count as empty."""
    points = sum((has(df, c).cast("int") for c in ONE_POINT), F.lit(0))
    points = points + sum((has(df, c).cast("int") * 2 for c in TWO_POINTS), F.lit(0))
    points = points + (has(df, "latitude") & has(df, "longitude")).cast("int")
    for name, floor in MORE_THAN:
        if name in df.columns:
            points = points + F.coalesce(df[name] > floor, F.lit(False)).cast("int")
    return points / F.lit(float(POINTS_TOTAL)) * 100


def grade(score: Column) -> Column:
    """A to F."""
    out = F.lit("F")
    for limit, letter in reversed(GRADES):
        out = F.when(score >= limit, letter).otherwise(out)
    return out


def true_attributes(attributes: Column) -> Column:
    """Names of the flags set in an attribute map."""
    return F.array_sort(F.map_keys(F.map_filter(attributes, lambda _, v: v)))


def point_wkt(lng: Column, lat: Column) -> Column:
    """Location as WKT, longitude first."""
    return F.when(lng.isNotNull() & lat.isNotNull(), F.format_string("POINT (%.6f %.6f)", lng, lat))


def haversine_m(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle distance in metres."""
    half_lat = F.radians(lat2 - lat1) / 2
    half_lng = F.radians(lng2 - lng1) / 2
    a = F.pow(F.sin(half_lat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(half_lng), 2)
    return 2 * EARTH_RADIUS_M * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def _as_text(col: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, (T.StructType, T.MapType)):
        return F.to_json(col)
    if isinstance(dtype, T.VariantType):
        return F.try_variant_get(col, "$", "string")
    if isinstance(dtype, T.ArrayType):
        return F.array_join(F.transform(col, lambda v: _as_text(v, dtype.elementType)), ", ")
    if isinstance(dtype, T.BooleanType):
        return F.when(col, "True")
    if isinstance(dtype, T.NumericType):
        return F.when(col != 0, col.cast("string"))
    return col.cast("string")


def named_column(name: str) -> Column:
    """A top-level column whatever characters its name holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def flatten(df: DataFrame, map_keys: dict[str, list[str]] | None = None) -> DataFrame:
    """One text column per leaf; structs become ``column_field``, lists joined text.

    Empty values become ''. A map becomes ``column_key`` for the keys in
    ``map_keys[column]``; the keys of a map are data, so they must be named to become
    columns, and a map without named keys is kept whole as JSON text.
    """
    named = map_keys or {}
    out = []
    for field in df.schema.fields:
        col, dtype = named_column(field.name), field.dataType
        if isinstance(dtype, T.StructType):
            leaves = [(f"{field.name}_{f.name}", col[f.name], f.dataType) for f in dtype.fields]
        elif isinstance(dtype, T.MapType) and field.name in named:
            leaves = [(f"{field.name}_{k}", F.try_element_at(col, F.lit(k)), dtype.valueType) for k in named[field.name]]
        else:
            leaves = [(field.name, col, dtype)]
        out += [F.coalesce(_as_text(c, t), F.lit("")).alias(n) for n, c, t in leaves]
    return df.select(*out)


def nested_as_json(df: DataFrame) -> DataFrame:
    """Complex columns as JSON text, everything else unchanged."""
    nested = (T.ArrayType, T.MapType, T.StructType)

    def one(field: T.StructField) -> Column:
        if isinstance(field.dataType, T.VariantType):
            return _as_text(named_column(field.name), field.dataType).alias(field.name)
        return F.to_json(named_column(field.name)).alias(field.name) if isinstance(field.dataType, nested) else named_column(field.name)

    return df.select(*[one(f) for f in df.schema.fields])
