"""Category trees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


def _climbed(walk: DataFrame, path: bool, sep: str) -> DataFrame:
    """Every row's climb joined with that of the category it has reached; ``moved`` says whether there is one."""
    step = walk.select(F.col("id").alias("up"), F.col("up").alias("up2"), F.col("level").alias("level2"), *([F.col("path").alias("path2")] if path else []))
    joined = walk.join(step, "up", "left")
    moved = F.col("level2").isNotNull()
    columns = [
        "id",
        F.when(moved, F.col("up2")).otherwise(F.col("up")).alias("up"),
        F.when(moved, F.col("level") + F.col("level2") + 1).otherwise(F.col("level")).alias("level"),
    ]
    if path:
        columns += ["parent_id", "name", F.when(moved, F.concat("path2", F.lit(sep), "path")).otherwise(F.col("path")).alias("path")]
    return joined.select(*columns, moved.alias("moved"))


def _below_roots(categories: DataFrame) -> DataFrame:
    """Ids that reach a root. Each round doubles the height climbed, so a chain of n takes log2(n) rounds;
    who still climbs after that is in or below a cycle."""
    walk = cut(categories.select("id", F.col("parent_id").alias("up"), F.lit(0).cast("long").alias("level")), "tree")
    for _ in range(max(1, walk.count()).bit_length()):
        walk = cut(_climbed(walk, False, ""), "tree")
        if walk.filter("moved").isEmpty():
            break
    return walk.filter("up is null").select("id").distinct()


def category_paths(categories: DataFrame, sep: str = "/") -> DataFrame:
    """(id, parent_id, name, level, path) for every category below a root, at any depth.

    Members of a cycle, or of a branch whose root is missing, never reach a root and are left
    out; ``unrooted`` lists them. Each round is written and read back.
    """
    rooted = categories.join(_below_roots(categories), "id", "left_semi")
    start = rooted.select("id", F.col("parent_id").alias("up"), F.lit(0).cast("long").alias("level"), "parent_id", "name", F.col("name").alias("path"))
    walk = cut(start, "tree")
    while not walk.filter("up is not null").isEmpty():
        walk = cut(_climbed(walk, True, sep).drop("moved"), "tree")
    return walk.select("id", "parent_id", "name", F.col("level").cast("int").alias("level"), "path")


def unrooted(categories: DataFrame) -> DataFrame:
    """The categories ``category_paths`` leaves out."""
    return categories.join(_below_roots(categories), "id", "left_anti")
