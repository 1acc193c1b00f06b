"""Positions in an order, without sorting a whole table or a whole key in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi join in which NULL keys meet; the keys appear once."""
    other = right.select(*[F.col(k).alias(f"__r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    same = [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys]
    return left.join(other, same, how).drop(*[f"__r_{k}" for k in keys])


def with_position(df: DataFrame, order: list, bucket: Column, by: list[str] = (), name: str = "position") -> DataFrame:
    """Adds the 1-based position of each row in ``order``, per ``by`` key or overall.

    ``bucket`` must never fall as ``order`` rises (a day, a range of ids). Rows are
    numbered within (key, bucket) and shifted by the size of the buckets before, so a
    hot key is spread over its buckets. Only bucket counts are summed per key. NULL is a key
    and a bucket like any other; the NULL bucket comes first.
    """
    keys = [*by, "__bucket"]
    rows = df.withColumn("__bucket", bucket)
    before = Window.partitionBy(*by).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        rows.groupBy(*keys)
        .agg(F.count("*").alias("__n"))
        .select(*keys, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__shift"))
    )
    joined = join_null_safe(rows, shifts, keys)
    within = Window.partitionBy(*keys).orderBy(*order)
    return joined.withColumn(name, F.col("__shift") + F.row_number().over(within)).drop("__bucket", "__shift")


def with_serial(df: DataFrame, seq: str = "seq", span: int = 1_000_000, name: str = "s_no", most: int = 1_000_000) -> DataFrame:
    """Serial number from 1 in ``seq`` order over a whole table of any size.

    Buckets span ``span`` numbers; where numbers are so sparse that there would be more than about
    ``most`` buckets, whose counts one task adds up, they span a thousand times as many, and so on.
    """
    wider = [span * 1000**i for i in range(5)]
    counts = df.agg(*[F.approx_count_distinct(F.floor(F.col(seq) / w)) for w in wider]).first()
    fits = [w for w, n in zip(wider, counts) if n <= most]
    return with_position(df, [F.col(seq)], F.floor(F.col(seq) / (fits or wider[-1:])[0]), name=name)


def with_chunks(df: DataFrame, position: str, size: int, halo: int = 0) -> DataFrame:
    """Adds ``chunk``, and repeats the last ``halo`` rows of a chunk in the next one.

    Repeated rows have ``is_halo`` set; drop them after the window over the chunk.
    """
    own = F.floor((F.col(position) - 1) / size)
    if not halo:
        return df.withColumn("chunk", own).withColumn("is_halo", F.lit(False))
    if halo > size:
        raise ValueError("halo must not exceed the chunk size")
    tail = (F.col(position) - 1) % size >= size - halo
    spread = F.when(tail, F.array(own, own + 1)).otherwise(F.array(own))
    out = df.withColumn("__own", own).withColumn("chunk", F.explode(spread))
    return out.withColumn("is_halo", F.col("chunk") != F.col("__own")).drop("__own")


def first_rows(df: DataFrame, n: int, seq: str = "seq", name: str = "row_no") -> DataFrame:
    """The first ``n`` rows by ``seq``, numbered; a top-n, not a full sort."""
    top = df.orderBy(seq).limit(n)
    return top.withColumn(name, F.row_number().over(Window.orderBy(seq)))
