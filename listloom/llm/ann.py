"""Nearest neighbours by vantage-point trees (operator 2).

Vectors are dealt by a seeded hash to shards of a fixed size; a task builds the tree of one shard
and searches it for one block of queries. Nearness is the largest inner product: with
one more coordinate that gives every vector the greatest norm, it becomes Euclidean distance,
for which the triangle inequality holds. A node keeps the least and greatest distance of each child's
points to its vantage point, so a child can be left out when the bound they give, times a factor,
exceeds the distance of the worst neighbour found so far. Factor 1, the default, is exact search. Larger
ones leave out more, and how many neighbours they lose depends on how the vectors lie: at factor 4 few
where they hardly cluster, most where they do or where they fill few dimensions. Scores are computed anew from the vectors in double precision, and the best
of all shards are kept.

Every row is indexed, and every query meets every shard, in blocks: work is the product of both
sides less what pruning saves, in tasks of bounded size.

Results: vectors that are null, empty, zero, or hold null or non-finite components take no part,
nor do rows without an id. Vectors of other lengths are not compared with each other. Of rows that
share an id the one with the least vector counts. Equal scores go to the smaller id. Extra columns
are ignored. An empty table gives no row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.blocks import by_cell
from ..session import cut

K = 20
FACTOR = 1.0
SHARD_ROWS = 4096
QUERY_BLOCK = 2048
LEAF = 64


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding as doubles, dim) of the rows that take part, written and read back."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).filter("vec_id is not null and embedding is not null")
    finite = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))
    v = v.filter(F.coalesce(finite, F.lit(False)) & F.exists("embedding", lambda x: x != 0))
    return cut(v.groupBy("vec_id").agg(F.min("embedding").alias("embedding")).withColumn("dim", F.size("embedding")), "vectors")


class Tree:
    """A vantage-point tree over the rows of ``points`` (n x d), whose norms are at most ``top``."""

    def __init__(self, points: np.ndarray, top: float, leaf: int = LEAF, seed: int = 2):
        self.points, self.leaf = points, leaf
        self.square = top * top
        self.lift = np.sqrt(np.maximum(0.0, self.square - (points * points).sum(axis=1)))
        self.rng = np.random.default_rng(seed)
        self.root = self._build(np.arange(len(points)))

    def _build(self, rows: np.ndarray):
        if len(rows) <= self.leaf:
            return rows
        at = int(rows[self.rng.integers(len(rows))])
        inner = self.points[rows] @ self.points[at] + self.lift[rows] * self.lift[at]
        far = np.sqrt(np.maximum(0.0, 2 * (self.square - inner)))
        order = np.argsort(far, kind="stable")
        rows, far, half = rows[order], far[order], len(rows) // 2
        return at, (far[0], far[half - 1]), (far[half], far[-1]), self._build(rows[:half]), self._build(rows[half:])


class Search:
    """The ``k`` nearest of a tree's points for many queries at once."""

    def __init__(self, tree: Tree, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int, factor: float):
        self.tree, self.ids, self.queries, self.query_ids, self.k, self.factor = tree, ids, queries, query_ids, k, factor
        n = len(queries)
        self.norm = (queries * queries).sum(axis=1)
        self.slack = 1e-9 * (1 + np.sqrt(self.norm * tree.square))
        self.best = np.full((n, k), -np.inf)
        self.found = np.full((n, k), np.iinfo(np.int64).max)
        self.compared = 0
        self._visit(tree.root, np.arange(n))

    def _worst(self, q: np.ndarray) -> np.ndarray:
        """Distance of the k-th neighbour found so far."""
        return np.sqrt(np.maximum(0.0, self.norm[q] + self.tree.square - 2 * self.best[q, -1]) + 2 * self.slack[q])

    def _visit(self, node, q: np.ndarray) -> None:
        if not len(q):
            return
        if isinstance(node, np.ndarray):
            return self._leaf(node, q)
        at, near, far, left, right = node
        d = np.sqrt(np.maximum(0.0, self.norm[q] + self.tree.square - 2 * (self.queries[q] @ self.tree.points[at])))
        first = d <= (near[1] + far[0]) / 2
        for child, bounds, own in ((left, near, first), (right, far, ~first)):
            self._visit(child, q[own & self._open(q, d, bounds)])
        for child, bounds, own in ((right, far, first), (left, near, ~first)):
            self._visit(child, q[own & self._open(q, d, bounds)])

    def _open(self, q: np.ndarray, d: np.ndarray, bounds: tuple[float, float]) -> np.ndarray:
        return self.factor * np.maximum(bounds[0] - d, d - bounds[1]) <= self._worst(q)

    def _leaf(self, rows: np.ndarray, q: np.ndarray) -> None:
        points = self.tree.points[rows]
        self.compared += len(q) * len(rows)
        near = self.queries[q] @ points.T
        likely = (near >= (self.best[q, -1] - self.slack[q])[:, None]) & (self.ids[rows][None, :] != self.query_ids[q][:, None])
        line, column = np.nonzero(likely)
        if not len(line):
            return
        # the same sum for the same two vectors wherever they meet
        exact = (self.queries[q[line]] * points[column]).sum(axis=1)
        scores = np.full(near.shape, -np.inf)
        scores[line, column] = exact
        hit = np.unique(line)
        scores = np.concatenate((self.best[q[hit]], scores[hit]), axis=1)
        names = np.concatenate((self.found[q[hit]], np.broadcast_to(self.ids[rows], (len(hit), len(rows)))), axis=1)
        order = np.lexsort((names, -scores), axis=1)[:, : self.k]
        self.best[q[hit]] = np.take_along_axis(scores, order, axis=1)
        self.found[q[hit]] = np.take_along_axis(names, order, axis=1)


def nearest(vectors: DataFrame, queries_where: str = "vec_id % 20 = 0", k: int = K, factor: float = FACTOR, shard_rows: int = SHARD_ROWS, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``vectors`` (vec_id, embedding) that meets
    ``queries_where``, its ``k`` nearest among all other rows, as far as the search finds them."""
    rows = usable(vectors)
    sizes = rows.groupBy("dim").agg(F.count("*").alias("n"), F.max(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)).alias("top")).filter("n > 1")
    # one row for each length of vectors
    asked = rows.filter(queries_where)
    wanted = asked.groupBy("dim").agg(F.count("*").alias("m"))
    plan = sizes.join(wanted, "dim").select("dim", F.sqrt("top").alias("top"), F.ceil(F.col("n") / shard_rows).alias("shards"), F.ceil(F.col("m") / query_block).alias("blocks"))

    def dealt(df: DataFrame, own: str, other: str, n_own: str, n_other: str, seed: int) -> DataFrame:
        df = df.join(F.broadcast(plan), "dim").withColumn(own, F.pmod(F.xxhash64(F.lit(seed), "vec_id"), F.col(n_own)))
        return df.withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.col(n_other) - 1)))

    points = dealt(rows, "shard", "block", "shards", "blocks", 2).withColumn("query", F.lit(False))
    queries = dealt(asked, "block", "shard", "blocks", "shards", 3).withColumn("query", F.lit(True))
    columns = ["dim", "shard", "block", "query", "vec_id", "embedding", "top"]

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        asked, points = pdf[pdf["query"]], pdf[~pdf["query"]]
        if not len(asked) or not len(points):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        points = points.sort_values("vec_id")
        tree = Tree(np.stack(points["embedding"].to_numpy()), float(points["top"].iloc[0]) * (1 + 1e-12))
        query_ids = asked["vec_id"].to_numpy()
        s = Search(tree, points["vec_id"].to_numpy(), np.stack(asked["embedding"].to_numpy()), query_ids, k, factor)
        good = np.isfinite(s.best)
        return pd.DataFrame({"query_id": np.repeat(query_ids, k)[good.ravel()], "vec_id": s.found[good], "score": s.best[good]})

    cells = by_cell(points.select(columns).unionByName(queries.select(columns)), ["dim", "shard", "block"])
    found = cells.applyInPandas(search, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
