"""Nearest businesses of the same category."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quality import EARTH_RADIUS_M, haversine_m
from ..session import cut

COMPETITORS = 10  # fixed value
_AXES = ("cx", "cy", "cz")
_PLACE = ["category", "lat", "lng"]
_FINEST_M = 0.5
_ROUNDING_M = 0.02


def find_competitors(df: DataFrame, radius_m: float = 5000.0, k: int = COMPETITORS, levels: int = 14) -> DataFrame:
    """Up to ``k`` nearest others of the same category within ``radius_m``.

    Returns (seq, rank, competitor_seq, competitor_name, competitor_rating, distance_m,
    similarity); ties in distance go to the lower seq, similarity falls linearly to 0 at
    the radius. Coordinates count to six decimals (0.1 m).

    Points lie in cubes around the globe, whose edge starts at the radius and halves with
    each level. A point whose own cube at some level holds ``k`` others has its ``k``
    nearest within two edges, so it searches the 27 cubes of the next coarser level; the
    finest such level is used. Only few points per cube search coarser than their
    neighbourhood is dense, so the pairs examined grow with the points, not their square.
    Businesses at one spot are searched once and offer their first ``k + 1`` members. Spots are
    written once; the join of queries and spots is left to AQE, which splits crowded cubes.
    """
    rows = (
        df.filter("coordinates.lat <> 0 and coordinates.lng <> 0 and category is not null")
        .select("seq", "name", "rating", "category", F.round("coordinates.lat", 6).alias("lat"), F.round("coordinates.lng", 6).alias("lng"))
    )
    by_spot = Window.partitionBy(*_PLACE).orderBy("seq")
    members = rows.withColumn("at", F.row_number().over(by_spot)).filter(F.col("at") <= k + 1)
    while levels > 1 and radius_m / 2 ** (levels - 1) < _FINEST_M:
        levels -= 1
    edge = radius_m / 2 ** (levels - 1)
    la, ln = F.radians("lat"), F.radians("lng")
    spots = (
        rows.groupBy(*_PLACE)
        .agg(F.count("*").alias("n"), F.min("seq").alias("first"))
        .withColumns(
            {
                "x": EARTH_RADIUS_M * F.cos(la) * F.cos(ln),
                "y": EARTH_RADIUS_M * F.cos(la) * F.sin(ln),
                "z": EARTH_RADIUS_M * F.sin(la),
            }
        )
        .withColumns({f"c{a}": F.floor(F.col(a) / edge) for a in "xyz"})
    )

    spots = cut(spots, "spots")

    def at_all_levels(d: DataFrame) -> DataFrame:
        each = d.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))))
        return each.withColumns({a: F.expr(f"shiftright({a}, {levels - 1} - level)") for a in _AXES})

    cubes = spots.groupBy("category", *_AXES).agg(F.sum("n").alias("n"))
    dense = at_all_levels(cubes).groupBy("category", "level", *_AXES).agg(F.sum("n").alias("n")).filter(F.col("n") > k)
    leveled = at_all_levels(spots.drop("n"))
    finest = (
        leveled.join(dense.drop("n"), ["category", "level", *_AXES], "left_semi")
        .groupBy(*_PLACE)
        .agg(F.max("level").alias("finest"))
    )
    # the cube of the finest level holds k others, none farther than its diagonal
    diagonal = F.sqrt(F.lit(3.0)) * radius_m / F.pow(F.lit(2.0), F.col("finest")) + _ROUNDING_M
    search = (
        spots.drop("n")
        .join(finest, _PLACE, "left")
        .withColumn("level", F.greatest(F.coalesce("finest", F.lit(0)) - 1, F.lit(0)))
        .select(
            "category", F.col("lat").alias("q_lat"), F.col("lng").alias("q_lng"), "level",
            F.least(F.coalesce(diagonal, F.lit(radius_m)), F.lit(radius_m)).alias("reach"),
            *[F.col(a).alias("q_" + a) for a in "xyz"],
            *[F.expr(f"shiftright({a}, {levels - 1} - level)").alias(a) for a in _AXES],
        )
    )
    near = F.array(F.lit(-1), F.lit(0), F.lit(1))
    for a in _AXES:
        search = search.withColumn("d", F.explode(near)).withColumn(a, F.col(a) + F.col("d")).drop("d")
    # straight-line distance, never above the one along the ground: cheap, and drops most pairs
    chord = sum(((F.col("q_" + a) - F.col(a)) * (F.col("q_" + a) - F.col(a)) for a in "xyz"), F.lit(0.0))
    distance = haversine_m(F.col("q_lat"), F.col("q_lng"), F.col("lat"), F.col("lng"))
    pairs = (
        search.join(leveled, ["category", "level", *_AXES])
        .filter(chord <= (F.col("reach") + _ROUNDING_M) * (F.col("reach") + _ROUNDING_M))
        .select("category", "q_lat", "q_lng", "lat", "lng", "first", F.round(distance, 2).alias("distance_m"))
        .filter(F.col("distance_m") <= radius_m)
    )
    # the nearest k + 1 spots hold the nearest k + 1 members; cut before anything is shuffled
    by_query = Window.partitionBy("category", "q_lat", "q_lng")
    near_spots = (
        pairs.withColumn("spot_rank", F.row_number().over(by_query.orderBy("distance_m", "first")))
        .filter(F.col("spot_rank") <= k + 1)
        .drop("spot_rank", "first")
    )
    offered = near_spots.join(members, _PLACE).withColumn(
        "rank", F.row_number().over(by_query.orderBy("distance_m", "seq"))
    )
    best = (
        offered.filter(F.col("rank") <= k + 1)
        .groupBy("category", F.col("q_lat").alias("lat"), F.col("q_lng").alias("lng"))
        .agg(F.array_sort(F.collect_list(F.struct("rank", "seq", "name", "rating", "distance_m"))).alias("best"))
    )
    others = F.slice(F.filter("best", lambda b: b["seq"] != F.col("seq")), 1, k)
    return (
        rows.select("seq", *_PLACE)
        .join(best, _PLACE)
        .select("seq", F.posexplode(others).alias("pos", "c"))
        .select(
            "seq",
            (F.col("pos") + 1).alias("rank"),
            F.col("c.seq").alias("competitor_seq"),
            F.col("c.name").alias("competitor_name"),
            F.col("c.rating").alias("competitor_rating"),
            F.col("c.distance_m").alias("distance_m"),
            F.round(1 - F.col("c.distance_m") / radius_m, 4).alias("similarity"),
        )
    )
