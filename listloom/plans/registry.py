"""Where queries and their SQL twins are registered, and SQL fragments the twins share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import NOT_WORD_OR_SPACE, SPACE
from .views import duck_with

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query; without ``sql`` it is checked by row count and by the tests."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def joined(col: Column | str, sep: str = "|") -> Column:
    """Array as text, so that result hashes compare."""
    return F.array_join(F.transform(col, lambda v: v.cast("string")), sep)


def map_text(col: Column | str) -> Column:
    """Map as sorted ``key=value`` text."""
    entries = F.transform(F.map_entries(col), lambda e: F.concat(e["key"].cast("string"), F.lit("="), e["value"].cast("string")))
    return F.array_join(F.array_sort(entries), "|")


# DuckDB fragments ---------------------------------------------------------------


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def d_clean(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(coalesce({x}, ''), {lit(NOT_WORD_OR_SPACE)}, '', 'g'), {lit(SPACE + '+')}, ' ', 'g'))"


def d_phone(x: str) -> str:
    digits = f"regexp_replace({x}, '[^0-9]', '', 'g')"
    local = f"CASE WHEN length({digits}) = 11 AND {digits} LIKE '1%' THEN substr({digits}, 2) ELSE {digits} END"
    return f"CASE WHEN length({local}) >= 10 THEN {local} END"


def d_netloc(x: str) -> str:
    return f"regexp_extract({x}, '^(?:[a-zA-Z][a-zA-Z0-9+.\\-]*:)?//([^/?#]*)', 1)"


def d_domain(x: str) -> str:
    return f"nullif(regexp_replace({d_netloc(x)}, '^www\\.', ''), '')"


def d_netloc_or_path(x: str) -> str:
    path = f"regexp_extract({x}, '^(?:[a-zA-Z][a-zA-Z0-9+.\\-]*:)?([^?#]*)', 1)"
    return f"regexp_replace(coalesce(nullif({d_netloc(x)}, ''), {path}), '^www\\.', '')"


def d_lookup_domain(x: str) -> str:
    return f"split_part(list_last(string_split({x}, '://')), '/', 1)"


def d_key() -> str:
    name, addr = "lower(trim(coalesce(name, '')))", "lower(trim(coalesce(address, '')))"
    hashed = f"md5({d_clean(name)} || '|' || {d_clean(addr)})"
    return (
        f"coalesce('place_id:' || nullif(place_id, ''), 'phone:' || ({d_phone('phone')}),"
        f" CASE WHEN {name} <> '' AND {addr} <> '' THEN 'name_addr:' || {hashed} END,"
        f" 'domain:' || {d_domain('website')},"
        f" CASE WHEN lat <> 0 AND lng <> 0 THEN 'coords:' || printf('%.4f,%.4f', round(lat, 4), round(lng, 4)) END,"
        f" {hashed})"
    )


def d_record_id() -> str:
    return "md5(concat_ws('|', substr(coalesce(name, 'None'), 1, 50), coalesce(phone, 'None'), coalesce(address, 'None')))"


KEYED = duck_with("biz") + f", keyed AS (SELECT *, {d_key()} AS dedup_key FROM biz)\n"
BIZ = duck_with("biz")
