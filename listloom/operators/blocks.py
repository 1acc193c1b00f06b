"""Comparing all rows of a block with each other in tasks of bounded size.

Blocks of up to ``small`` rows are left to a plain equi join. A larger block is cut into
parts of about ``part`` rows, and each two parts meet in one cell that holds no other
rows; cells return matches only. A block of any size thus never sits in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_block_size(df: DataFrame, block: list[str]) -> DataFrame:
    """Adds ``block_n``; drops rows alone in their block or with a NULL block."""
    sizes = df.groupBy(*block).agg(F.count("*").alias("block_n")).filter("block_n > 1")
    return df.join(sizes, block)


def spread(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows hashed by ``keys`` over a stated number of tasks, for steps that turn little data
    into much work: AQE merges tasks by their bytes, but leaves a stated number alone."""
    spark = df.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(4 * tasks, *keys)


def by_cell(df: DataFrame, keys: list[str]):
    """Rows grouped by cell, the cells spread over many tasks."""
    return spread(df, keys).groupBy(*keys)


def to_cells(big: DataFrame, id_col: str, part: int) -> DataFrame:
    """Repeats each row once per part of its block: adds ``part_no``, ``part_a``, ``part_b``.

    Group by (block, part_a, part_b); the two parts are told apart by ``part_no``.
    """
    parts = F.ceil(F.col("block_n") / part).cast("int")
    own = F.pmod(F.xxhash64(id_col), parts).cast("int")
    return (
        big.withColumn("part_no", own)
        .withColumn("__other", F.explode(F.sequence(F.lit(0), parts - 1)))
        .withColumn("part_a", F.least("part_no", "__other"))
        .withColumn("part_b", F.greatest("part_no", "__other"))
        .drop("__other")
    )
