"""Canonical shapes of the business data; missing keys are NULL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _L, _I, _D, _B = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType()
_LIST, _MAP = T.ArrayType(_S), T.MapType(_S, _S)

COORDINATES = T.StructType([T.StructField("lat", _D), T.StructField("lng", _D)])


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


#: A record as collected: one JSON object per line of a record log.
RECORD = _struct(
    _id=_S, seq=_L, name=_S, phone=_S, website=_S, address=_S, rating=_D, reviews=_L,
    category=_S, scraped_at=_D, mode=_S,
)

#: The stored business table.
BUSINESS = _struct(
    id=_S, seq=_L, name=_S, rating=_D, reviews=_L, category=_S, description=_S,
    phone_numbers=_LIST, primary_phone=_S, emails=_LIST, primary_email=_S, website=_S,
    social_media=_MAP, address=_S, coordinates=COORDINATES, place_id=_S, zip_code=_S,
    opening_hours=_S, price_range=_S, amenities=_LIST, verified=_B, claimed=_B,
    data_completeness=_D, confidence_score=_D, search_query=_S, search_location=_S,
    scraped_at=T.TimestampNTZType(), updated_at=T.TimestampNTZType(), is_active=_B,
    enrichment_data=_MAP, tags=_LIST,
)


def canonical(df: DataFrame) -> DataFrame:
    """Bridges the two spellings in use: ``phone`` fills ``phone_numbers``/``primary_phone``,
    ``reviews`` fills ``reviews_count``, ``website`` fills ``primary_website``; epoch times
    become timestamps."""
    have, out = set(df.columns), {}
    if "phone" in have and "phone_numbers" not in have:
        out["phone_numbers"] = F.array_compact(F.array("phone"))
    if "phone" in have and "primary_phone" not in have:
        out["primary_phone"] = F.col("phone")
    if "reviews" in have and "reviews_count" not in have:
        out["reviews_count"] = F.col("reviews")
    if "website" in have and "primary_website" not in have:
        out["primary_website"] = F.col("website")
    if "scraped_at" in have and isinstance(df.schema["scraped_at"].dataType, T.DoubleType):
        out["scraped_at"] = F.timestamp_micros((F.col("scraped_at") * 1_000_000).cast("bigint")).cast("timestamp_ntz")
    return df.withColumns(out) if out else df
