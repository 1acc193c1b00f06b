"""the "has a value" test that every report and merge rests on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def present(col: Column | str, dtype: T.DataType) -> Column:
    """True unless the value is NULL, '', 0, false, or an empty list or map."""
    c = F.col(col) if isinstance(col, str) else col
    if isinstance(dtype, (T.StringType, T.VarcharType, T.CharType)):
        test = c != ""
    elif isinstance(dtype, T.BooleanType):
        test = c
    elif isinstance(dtype, T.NumericType):
        test = c != 0
    elif isinstance(dtype, (T.ArrayType, T.MapType)):
        test = F.size(c) > 0
    else:
        test = c.isNotNull()
    return F.coalesce(test, F.lit(False))


def has(df: DataFrame, name: str) -> Column:
    """``present`` for a column of ``df``, typed by its schema; false if it has none."""
    if name not in df.columns:
        return F.lit(False)
    return present(df[name], df.schema[name].dataType)


def nullify(col: Column) -> Column:
    """Empty string to NULL, as ``regexp_extract`` gives '' for no match."""
    return F.when(col != "", col)


def first_present(*cols: Column) -> Column:
    """L3: the first non-empty of several string candidates, in order.

    Each candidate is evaluated once, where ``coalesce`` over ``nullify`` would repeat it.
    """
    return F.get(F.filter(F.array(*cols), lambda c: c != ""), 0)
