"""Clustering of vectors around centroids, with equal-average equal-variance search (operator 13).

Components are integers, ``floor(scale * x)``, so sums, distances and centroids are exact whatever the order of
the work. Each round is one pass: tasks assign their vectors and add them up by cluster; Spark sums these
sums, a row a cluster, component and task; the new centroids, ``k * dims`` integers, go out with the next round's tasks. No vector
is shuffled, and nothing of the table's size reaches the driver.

A vector's nearest centroid is searched in an order of component sums (equal to that of means): centroids
are sorted by theirs, and the search goes outward from where the vector's own lies. For a vector x and a centroid c of n
components, with sums S and deviations D (the root of n times the sum of squares less S squared),

    n * distance(x, c) >= (S_x - S_c)**2 + (D_x - D_c)**2.

The first term alone ends the search in both directions once it exceeds n times the best distance so far; both
together reject single centroids; those left are computed exactly in integers. Bounds
reject only what is surely farther, so that ties still go to the smaller number.

Results: rows whose vector is null, has another number of components, or holds a null, NaN or infinite one are
left out. Repeated rows are rows of one place each. A null id is kept; as a seed it comes last. With fewer vectors than
clusters there are as many clusters as vectors. Equal centroids: the smaller number takes all. An empty table gives an
empty result. Only the id and the vector are read. A distance or sum beyond 64 bits is null, its cluster still exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CLUSTERS = 16
ROUNDS = 3
DIMS = 64
SCALE = 64
#: With components up to this size and up to ``MOST_DIMS`` of them, all sums and bounds stay within 64 bits.
SMALL, MOST_DIMS = 1 << 20, 1024
#: Rows a task computes with at a time.
ROWS = 4096
_LONG = 1 << 63


def integers(column, dims: int = DIMS, scale: float = SCALE) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a list column that are kept, and their components as integers (Python's own if large)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(column), dims), False).to_numpy(zero_copy_only=False))
    flat = pc.list_flatten(column.take(pa.array(rows))).cast(pa.float64())
    x = flat.to_numpy(zero_copy_only=False).reshape(len(rows), dims)
    whole = np.isfinite(x).all(axis=1)
    rows, x = rows[whole], x[whole]
    with np.errstate(over="ignore"):
        scaled = np.floor(x * scale)
    if np.abs(scaled).max(initial=0) <= SMALL and dims <= MOST_DIMS:
        return rows, scaled.astype(np.int64)
    # a product beyond the range of doubles is taken exactly
    exact = [[int(s) if np.isfinite(s) else int(v) * int(scale) for s, v in zip(a, b)] for a, b in zip(scaled.tolist(), x.tolist())]
    return rows, np.array(exact, dtype=object).reshape(len(rows), dims)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows."""
    d = x - c
    return (d * d).sum(axis=1)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Each row's nearest centroid, its squared distance, and how many distances were computed."""
    n, k = len(x), len(centroids)
    if x.dtype == object or centroids.dtype == object or np.abs(centroids).max(initial=0) > SMALL:
        x, centroids = x.astype(object), centroids.astype(object)
        far = np.stack([squared(x, c) for c in centroids], axis=1).reshape(n, k)
        best = far.argmin(axis=1) if n else np.zeros(0, dtype=np.int64)
        return best, far[np.arange(n), best], n * k
    dims = x.shape[1]
    order = np.argsort(centroids.sum(axis=1), kind="stable")
    sorted_by_mean = centroids[order]
    sums, own = sorted_by_mean.sum(axis=1), x.sum(axis=1)
    spread_c = np.sqrt((dims * (sorted_by_mean**2).sum(axis=1) - sums**2).astype(np.float64))
    spread_x = np.sqrt((dims * (x**2).sum(axis=1) - own**2).astype(np.float64))
    # roots are off by a few units of their last place at most
    slack = 1e-6 * (spread_x + spread_c.max(initial=0)) + 1.0

    up = np.searchsorted(sums, own)
    down = up - 1
    best = np.full(n, -1, dtype=np.int64)
    least = np.full(n, np.iinfo(np.int64).max // dims, dtype=np.int64)
    left, computed = np.arange(n), 0
    for _ in range(k):
        # the next centroid outward: of the two sides that whose sum is nearer
        u, d, s = up[left], down[left], own[left]
        gap_up = np.where(u < k, sums[np.minimum(u, k - 1)] - s, np.iinfo(np.int64).max)
        gap_down = np.where(d >= 0, s - sums[np.maximum(d, 0)], np.iinfo(np.int64).max)
        upward = gap_up <= gap_down
        at, gap = np.where(upward, u, d), np.where(upward, gap_up, gap_down)
        up[left] += upward
        down[left] -= ~upward
        limit = dims * least[left]
        within = gap**2 <= limit
        left, at, gap, limit = left[within], at[within], gap[within], limit[within]
        if not len(left):
            break
        apart = np.maximum(np.abs(spread_x[left] - spread_c[at]) - slack[left], 0.0)
        close = gap.astype(np.float64) ** 2 + apart**2 <= limit * (1 + 1e-9)
        rows, number = left[close], order[at[close]]
        distance = squared(x[rows], centroids[number])
        computed += len(rows)
        nearer = (distance < least[rows]) | ((distance == least[rows]) & ((number < best[rows]) | (best[rows] < 0)))
        best[rows[nearer]], least[rows[nearer]] = number[nearer], distance[nearer]
    return best, least, computed


def with_inertia(assigned: DataFrame) -> DataFrame:
    """``assigned`` (cluster, distance; written) with the distance summed over its cluster and over all.

    A sum that holds a null distance, or is beyond 64 bits, is null.
    """
    total = F.sum(F.col("distance").cast("decimal(38,0)"))
    of = assigned.groupBy("cluster").agg(F.when(F.count("distance") == F.count("*"), total).alias("own"))
    of_all = assigned.agg(F.when(F.count("distance") == F.count("*"), total).alias("all"))
    fits = of.crossJoin(F.broadcast(of_all)).select("cluster", F.expr("try_cast(own AS long)").alias("cluster_inertia"), F.expr("try_cast(`all` AS long)").alias("inertia"))
    return assigned.join(F.broadcast(fits), "cluster")


def _assigned(batches, dims: int, scale: float, centroids: np.ndarray):
    """(batch slice, kept rows, integers, cluster, distance) of Arrow batches of (id, vector)."""
    for batch in batches:
        for lo in range(0, batch.num_rows, ROWS):
            part = batch.slice(lo, ROWS)
            rows, x = integers(part.column(1), dims, scale)
            if len(rows):
                yield part, rows, x, *nearest(x, centroids)[:2]


def _seeds(vectors: DataFrame, k: int, dims: int, scale: float, seed: int) -> np.ndarray:
    """The k kept vectors whose ids hash lowest, in that order; ties by components."""
    named = vectors.withColumn("hash", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256))
    whole = F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    kept = named.filter((F.size("vector") == dims) & whole)
    first = kept.orderBy(F.col("hash").asc_nulls_last(), "vector").limit(k).select("vector").toArrow()
    return integers(first.column(0), dims, scale)[1]


def _moved(vectors: DataFrame, centroids: np.ndarray, dims: int, scale: float) -> np.ndarray:
    """The centroids after one round; clusters without vectors stay."""

    def add(batches):
        sums: dict[int, list] = {}
        for _, _, x, cluster, _ in _assigned(batches, dims, scale, centroids):
            for c in np.unique(cluster).tolist():
                mine = x[cluster == c]
                old = sums.get(c, [0, [0] * dims])
                sums[c] = [old[0] + len(mine), [a + b for a, b in zip(old[1], mine.sum(axis=0).tolist())]]
        rows = [(c, place, str(total), n) for c, (n, own) in sums.items() for place, total in enumerate(own)]
        columns = list(zip(*rows)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.int64())], names=["cluster", "place", "total", "n"]
        )

    sums = vectors.mapInArrow(add, "cluster int, place int, total string, n long")
    if centroids.dtype == object:
        # totals beyond what a decimal holds are added as Python integers, by a task a component
        def whole(pdf):
            return pdf.iloc[:1].assign(total=str(sum(map(int, pdf["total"]))), n=pdf["n"].sum())

        rows = sums.groupBy("cluster", "place").applyInPandas(whole, "cluster int, place int, total string, n long").collect()
    else:
        rows = sums.groupBy("cluster", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).collect()
    moved = centroids.astype(object)
    for row in rows:
        moved[row["cluster"], row["place"]] = int(row["total"]) // row["n"]
    small = not len(moved) or max(abs(v) for v in moved.flat) <= SMALL
    return moved.astype(np.int64) if small and centroids.dtype != object else moved


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, scale: float = SCALE, seed: int = 1) -> tuple[DataFrame, np.ndarray]:
    """(id, cluster, distance) of every kept vector, and the final centroids (k rows of integers).

    ``distance`` is the squared Euclidean one in scaled integers. ``rounds`` times all vectors are assigned to
    their nearest centroids and these moved to the floor of their vectors' means; then all are assigned once more.
    """
    of = vectors.schema[id_col].dataType
    slim = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    centroids = _seeds(slim, k, dims, scale, seed)
    large = slim.filter(F.exists("vector", lambda c: (F.abs(c) * float(scale) > SMALL) & (F.abs(c) < float("inf")))).limit(1).count() if len(centroids) else 0
    if large or dims > MOST_DIMS:
        centroids = centroids.astype(object)
    for _ in range(rounds if len(centroids) else 0):
        centroids = _moved(slim, centroids, dims, scale)

    def assign(batches):
        for part, rows, _, number, distance in _assigned(batches, dims, scale, centroids):
            ids = part.column(0).take(pa.array(rows))
            fits = pa.array([int(d) if d < _LONG else None for d in distance.tolist()], pa.int64())
            yield pa.RecordBatch.from_arrays([ids, pa.array(number.astype(np.int32)), fits], names=[id_col, "cluster", "distance"])

    schema = T.StructType([T.StructField(id_col, of), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    if not len(centroids):
        return slim.sparkSession.createDataFrame([], schema), centroids
    return slim.mapInArrow(assign, schema), centroids
