"""Neighbours and clusters of record vectors."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut, work_path
from . import balls as ball_tree
from .balls import SLACK as _SLACK
from .balls import distances, unit
from .blocks import by_cell, spread
from .components import connected_components

# Fixed values -------------------------------------------------------------------
EPS = 0.3
MIN_SAMPLES = 2
NOISE = -1
# --------------------------------------------------------------------------------
#: Vectors of one side of a cell: each vector is sent to about as many cells as a table has parts.
PART = 8192
#: Pivots of a single level; for more than so many times ``PART`` vectors a tree of balls takes its place.
MAX_PIVOTS = 256
#: Rows a task of ``_cells`` makes at a time, cosines ``_compare`` holds at a time, and links it gives back at a time.
SENT, HELD, GIVEN = 16_384, 1 << 20, 1 << 16
#: Bytes of vectors a task of ``_meet`` holds to compare them with blocks read one at a time; blocks it reads in all;
#: pairs whose cosine it takes one by one at a time.
TILE_BYTES, READ, SETTLED = 32 << 20, 16, 1 << 14


def feature_text(name, category, description) -> Column:
    """The text a record's vector is made from; missing parts count as ''."""
    return F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in (name, category, description)])


def with_direction(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """The rows whose vector has a cosine with others: not null, not zero, all components finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.filter(F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda x: x != 0))


def distinct_vectors(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row per distinct vector that has an id: its lowest id (``rep``) and number of copies."""
    vectors = with_direction(vectors, vector)
    found = vectors.groupBy(F.col(vector).alias("v")).agg(F.min(id_col).alias("rep"), F.count("*").alias("copies"))
    return found.filter("rep IS NOT NULL")


def copy_links(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Links (a, b) from the first row of a vector to each exact copy."""
    d = distinct_vectors(vectors, id_col, vector).filter("copies > 1").select("v", "rep")
    joined = vectors.select(F.col(vector).alias("v"), F.col(id_col).alias("id")).join(d, "v")
    return joined.filter("id > rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))


@dataclass
class _Balls:
    """Pivots and, per ball, its size, radius and lowest id: at most ``MAX_PIVOTS`` of each."""

    pivots: Any  # broadcast
    size: dict[int, int]
    radius: dict[int, float]
    first: dict[int, Any]


def _nearest(balls_pivots):
    @F.pandas_udf("struct<ball:int,dist:double>")
    def nearest(v: pd.Series) -> pd.DataFrame:
        dist = distances(unit(v), balls_pivots.value)
        ball = dist.argmin(axis=1)
        return pd.DataFrame({"ball": ball.astype("int32"), "dist": dist[np.arange(len(ball)), ball]})

    return nearest


def _by_length(d: DataFrame) -> list[DataFrame]:
    """Distinct vectors by their number of components: those of unequal length have no cosine and are apart."""
    lengths = sorted(r[0] for r in d.select(F.size("v")).distinct().collect())  # a model gives vectors of one length, or of a few
    return [d.filter(F.size("v") == n) for n in lengths]


def _balls(d: DataFrame, part: int) -> _Balls | None:
    """Vectors go to their nearest pivot; pivots are picked by hash, so dense regions get more."""
    wanted = max(1, min(MAX_PIVOTS, math.ceil(d.count() / part)))
    chosen = d.orderBy(F.xxhash64("rep"), "rep").limit(wanted).select("v").collect()
    if not chosen:
        return None
    pivots = d.sparkSession.sparkContext.broadcast(unit(pd.Series([list(r.v) for r in chosen])))
    near = d.select("rep", _nearest(pivots)("v").alias("p"))
    stats = near.groupBy("p.ball").agg(F.count("*").alias("n"), F.max("p.dist").alias("r"), F.min("rep").alias("first")).collect()
    return _Balls(pivots, {r.ball: r.n for r in stats}, {r.ball: r.r for r in stats}, {r.ball: r["first"] for r in stats})


def _sure_pairs(balls: _Balls, eps: float) -> set[tuple[int, int]]:
    """Pairs of balls (a <= b) so close that any two of their vectors are neighbours."""
    reach = math.sqrt(2.0 * eps) - _SLACK
    apart = distances(balls.pivots.value, balls.pivots.value)
    r = balls.radius
    return {(a, b) for a in r for b in r if a <= b and (apart[a, b] if a != b else 0.0) + r[a] + r[b] <= reach}


def _sure_links(d: DataFrame, balls: _Balls, sure: set[tuple[int, int]]) -> DataFrame:
    """Links that hold the vectors of sure pairs together: one per vector, one per ball pair."""
    rep_type = d.schema["rep"].dataType
    between = [(balls.first[a], balls.first[b]) for a, b in sure if a != b]
    schema = T.StructType([T.StructField("a", rep_type), T.StructField("b", rep_type)])
    of_balls = d.sparkSession.createDataFrame(between, schema)
    starred = sorted({x for pair in sure for x in pair})
    if not starred:
        return of_balls
    firsts = F.create_map(*[F.lit(x) for ball in starred for x in (ball, balls.first[ball])])
    near = d.select("rep", _nearest(balls.pivots)("v").alias("p"))
    members = near.select("rep", F.try_element_at(firsts, "p.ball").alias("first")).filter("first <> rep")
    return members.select(F.col("first").cast(rep_type).alias("a"), F.col("rep").alias("b")).unionByName(of_balls)


def _sender(balls: _Balls, eps: float, part: int, skip: set[tuple[int, int]]):
    """The step of ``_cells``: what a vector is sent to grows with the table, so few vectors are taken at a time."""
    pivots, n_balls = balls.pivots, len(balls.pivots.value)
    parts, bound, apart = np.zeros(n_balls, dtype=np.int64), np.full(n_balls, -np.inf), np.ones((n_balls, n_balls), dtype=bool)
    for ball, n in balls.size.items():
        parts[ball] = max(1, math.ceil(n / part))
        bound[ball] = balls.radius[ball] + math.sqrt(2.0 * eps) + _SLACK
    for one, other in skip:
        apart[one, other] = apart[other, one] = False
    step = max(1, SENT // max(1, int(parts.sum())))

    def sent(pdf: pd.DataFrame) -> pd.DataFrame:
        dist = distances(unit(pdf["v"]), pivots.value)
        home = dist.argmin(axis=1)
        near = dist <= bound
        near[np.arange(len(home)), home] = True
        row, ball = np.nonzero(near & apart[home])
        # once for each part of the ball
        n = parts[ball]
        other = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        row, ball = np.repeat(row, n), np.repeat(ball, n)
        h = home[row]
        own = pdf["mark"].to_numpy()[row] % parts[h]
        same, first = h == ball, h < ball
        ia = np.where(same, np.minimum(own, other), np.where(first, own, other))
        ib = np.where(same, np.maximum(own, other), np.where(first, other, own))
        side = np.where(same, own, ~first)
        rep, v = pdf["rep"].to_numpy()[row], pdf["v"].to_numpy()[row]
        return pd.DataFrame({"ca": np.minimum(h, ball), "cb": np.maximum(h, ball), "ia": ia, "ib": ib, "side": side, "rep": rep, "v": v})

    def spread(batches):
        for pdf in batches:
            for lo in range(0, len(pdf), step):
                yield sent(pdf.iloc[lo : lo + step])

    return spread


def _cells(d: DataFrame, balls: _Balls, eps: float, part: int, skip: set[tuple[int, int]]) -> DataFrame:
    """Rows (ca, cb, ia, ib, side, rep, v): every two vectors within ``eps`` meet in one cell,
    but for the pairs of balls in ``skip``.

    By the triangle inequality a vector can only have a neighbour in another pivot's ball
    if its distance to that pivot is at most the ball's radius plus the search radius; all
    other pairs of balls are never compared. A ball of any size is cut into parts of about
    ``part`` rows.
    """
    rep_type = d.schema["rep"].dataType.simpleString()
    vec_type = d.schema["v"].dataType.simpleString()
    marked = d.select("rep", "v", F.pmod(F.xxhash64("v"), F.lit(2**31 - 1)).alias("mark"))
    return marked.mapInPandas(_sender(balls, eps, part, skip), f"ca long, cb long, ia int, ib int, side int, rep {rep_type}, v {vec_type}")


def _compare(cells: DataFrame, eps: float, forest: bool) -> DataFrame:
    rep_type = cells.schema["rep"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = [(pdf[["ca", "cb", "ia", "ib"]].iloc[0], pdf["side"].to_numpy(), pdf["rep"].to_numpy(), unit(pdf["v"])) for pdf in batches if len(pdf)]
        ca, cb, ia, ib = (int(n) for n in read[0][0])
        side, ids, x = (np.concatenate(of) for of in list(zip(*read))[1:])
        del read
        among = ca == cb and ia == ib
        low, high = (ia, ib) if ca == cb else (0, 1)
        left = np.arange(len(ids)) if among else np.flatnonzero(side == low)
        right = left if among else np.flatnonzero(side == high)
        xl, xr = x[left], x[right]
        parts, found, given = _Parts(len(ids)), [], 0
        step = max(1, HELD // max(1, len(right)))
        for lo in range(0, len(left), step):
            # within one part every two are compared once
            skip = lo if among else 0
            sim = xl[lo : lo + step] @ xr[skip:].T
            i, j = np.nonzero(np.triu(sim >= 1.0 - eps, 1) if among else sim >= 1.0 - eps)
            s, i, j = sim[i, j], left[lo + i], right[skip + j]
            if forest:
                kept = parts.join(i, j)
                i, j, s = i[kept], j[kept], s[kept]
            # vectors may share an id
            apart = ids[i] != ids[j]
            a, b, s = ids[i[apart]], ids[j[apart]], s[apart]
            found.append(pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "cosine": np.round(s, 6)}))
            given += len(a)
            if given >= GIVEN:
                yield pd.concat(found, ignore_index=True)
                found, given = [], 0
        if found:
            yield pd.concat(found, ignore_index=True)

    return by_cell(cells, ["ca", "cb", "ia", "ib"]).applyInPandas(run, f"a {rep_type}, b {rep_type}, cosine double")


class _Parts:
    """Which of ``n`` vectors are joined by the links so far."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Positions of links that join two parts not yet joined; over all calls at most one a vector."""
        _, one = np.unique(j, return_index=True)
        first = one[self._spanning(i[one], j[one])]
        rest = np.flatnonzero(self.of[i] != self.of[j])
        return np.concatenate((first, rest[self._spanning(i[rest], j[rest])])).astype(np.int64)

    def _spanning(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        low, high = np.minimum(self.of[i], self.of[j]), np.maximum(self.of[i], self.of[j])
        _, one = np.unique(low * len(self.of) + high, return_index=True)
        one = one[low[one] != high[one]]
        root: dict = {}

        def find(n):
            while root.setdefault(n, n) != n:
                root[n] = root[root[n]]
                n = root[n]
            return n

        kept = []
        for k, x, y in zip(one.tolist(), low[one].tolist(), high[one].tolist()):
            rx, ry = find(x), find(y)
            if rx != ry:
                root[rx] = ry
                kept.append(k)
        now = np.arange(len(self.of))
        for n in list(root):
            now[n] = find(n)
        self.of = now[self.of]
        return np.array(kept, dtype=np.int64)


@dataclass
class _Blocks:
    """Vectors as files of about ``part`` rows (rep, unit) each, below a folder all tasks can read."""

    path: str
    ball: np.ndarray
    part: np.ndarray
    radius: np.ndarray  # about the pivot of the ball, of the vectors of the block

    def read(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of a block, and its unit vectors in double and single precision."""
        files, root = fs.FileSystem.from_uri(self.path)
        at = f"{root}/ball={self.ball[k]}/part={self.part[k]}"
        rows = pq.read_table(at, columns=["rep", "unit"], filesystem=files, partitioning=None, use_threads=False)
        x = np.frombuffer(b"".join(rows["unit"].to_pylist()), dtype=np.float64).reshape(rows.num_rows, -1)
        return rows["rep"].to_pandas().to_numpy(), x, x.astype(np.float32)


def _blocks(d: DataFrame, balls: _Balls, part: int) -> _Blocks:
    """Each vector written once, to a block of the ball of its nearest pivot."""
    pivots, kind = balls.pivots, d.schema["rep"].dataType.simpleString()
    parts = np.ones(len(pivots.value), dtype=np.int64)
    for ball, n in balls.size.items():
        parts[ball] = max(1, math.ceil(n / part))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = unit(pdf["v"])
            dist = distances(x, pivots.value)
            ball = dist.argmin(axis=1)
            own = {"ball": ball, "part": pdf["mark"].to_numpy() % parts[ball], "dist": dist[np.arange(len(ball)), ball]}
            yield pd.DataFrame(own | {"rep": pdf["rep"], "unit": [row.tobytes() for row in x]})

    marked = d.select("rep", "v", F.pmod(F.xxhash64("v"), F.lit(2**31 - 1)).alias("mark"))
    placed = marked.mapInPandas(place, f"ball int, part int, dist double, rep {kind}, unit binary")
    path = work_path(d.sparkSession, "blocks")
    spread(placed, ["ball", "part"]).write.partitionBy("ball", "part").parquet(path)
    written = d.sparkSession.read.schema("dist double, ball int, part int").parquet(path)
    found = written.groupBy("ball", "part").agg(F.max("dist").alias("radius")).orderBy("ball", "part").collect()
    return _Blocks(path, *(np.array([r[c] for r in found]) for c in ("ball", "part", "radius")))


def _matches(left: tuple, right: tuple, eps: float, among: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, cosine) of the vectors within ``eps``, a strip at a time; ``among``: of one block, every two once.

    Cosines are taken in single precision and, if they reach the bound within its error, again in double.
    """
    (_, xl, fl), (_, xr, fr) = left, right
    least, slack = 1.0 - eps, (xl.shape[1] + 8) * 2.0**-23
    step = max(1, HELD // max(1, len(xr)))
    for lo in range(0, len(xl), step):
        skip = lo if among else 0
        at = np.flatnonzero(fl[lo : lo + step] @ fr[skip:].T >= least - slack)
        many = len(at) > step * (len(xr) - skip) // 8
        every = (xl[lo : lo + step] @ xr[skip:].T).ravel() if many else None
        for part in range(0, len(at), len(at) if many else SETTLED):
            i, j = np.divmod(at[part : part + (len(at) if many else SETTLED)], len(xr) - skip)
            s = every[at] if many else np.einsum("ij,ij->i", xl[lo + i], xr[skip + j])
            good = (s >= least) & (i < j if among else True)
            if good.any():
                yield lo + i[good], skip + j[good], s[good]


def _meet(d: DataFrame, balls: _Balls, eps: float, part: int) -> DataFrame:
    """(a, b, cosine) of all vectors within ``eps``: every two blocks that the triangle inequality does not keep apart meet.

    Vectors are not sent to where they are compared: a task holds a tile of some blocks and reads those it is
    to be compared with one after the other, so that what is written is in proportion to the vectors.
    """
    blocks, pivots, reach = _blocks(d, balls, part), balls.pivots, math.sqrt(2.0 * eps) + _SLACK
    n, ball, radius = len(blocks.ball), blocks.ball, blocks.radius
    apart = distances(pivots.value, pivots.value)[np.ix_(ball, ball)]
    meets = np.triu((apart <= radius[:, None] + radius[None, :] + reach) | (ball[:, None] == ball[None, :]))
    wide = max(1, TILE_BYTES // (12 * part * pivots.value.shape[1]))
    turns = [(tile, k) for tile in range(0, n, wide) for k in range(n) if meets[tile : tile + wide, k].any()]

    def facing(own: tuple, k: int, other: int) -> tuple:
        """The vectors of block ``k`` that may have a neighbour in the block ``other``."""
        near = distances(own[1], pivots.value[ball[other]][None, :])[:, 0] <= radius[other] + reach
        return own if ball[k] == ball[other] or near.all() else tuple(of[near] for of in own)

    def found(no: Iterator[int]) -> Iterator[pd.DataFrame]:
        held, tile = {}, None
        for start, k in (turns[t] for t in no):
            if start != tile:
                held.clear()
                held, tile = {i: blocks.read(i) for i in range(start, min(n, start + wide))}, start
            met = held[k] if k in held else blocks.read(k)
            for i, own in held.items():
                if meets[i, k]:
                    left, right = facing(own, i, k), facing(met, k, i)
                    for x, y, cosine in _matches(left, right, eps, i == k):
                        a, b = left[0][x], right[0][y]
                        # vectors may share an id
                        other = a != b
                        a, b = a[other], b[other]
                        yield pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "cosine": np.round(cosine[other], 6)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting, rows = [], 0
        for pdf in found(t for batch in batches for t in batch["id"]):
            waiting.append(pdf)
            rows += len(pdf)
            if rows >= GIVEN:
                yield pd.concat(waiting, ignore_index=True)
                waiting, rows = [], 0
        if waiting:
            yield pd.concat(waiting, ignore_index=True)

    spark, kind = d.sparkSession, d.schema["rep"].dataType.simpleString()
    tasks = min(len(turns), max(4 * spark.sparkContext.defaultParallelism, math.ceil(len(turns) / READ)))
    return spark.range(0, len(turns), 1, tasks).mapInPandas(run, f"a {kind}, b {kind}, cosine double")


def neighbour_pairs(vectors: DataFrame, eps: float = EPS, part: int = PART, id_col="vec_id", vector="embedding") -> DataFrame:
    """(a, b, cosine), a < b, for distinct vectors within cosine distance ``eps``.

    Exact: no pair is missed. Copies are represented by their first row (``copy_links``).
    """
    every = cut(distinct_vectors(vectors, id_col, vector), "distinct")
    found = every.select(F.col("rep").alias("a"), F.col("rep").alias("b"), F.lit(1.0).alias("cosine")).limit(0)
    for d in _by_length(every):
        if d.count() > MAX_PIVOTS * part:
            cells = ball_tree.cells(*ball_tree.leaves(d, eps, part), part)
            found = found.unionByName(_compare(cells, eps, forest=False))
        elif (balls := _balls(d, part)) is not None:
            found = found.unionByName(_meet(d, balls, eps, part))
    return found


def _tree_links(d: DataFrame, eps: float, part: int) -> DataFrame:
    """Links (a, b) that hold all neighbours together, by the tree. Balls so tight that all their vectors are
    neighbours are not split, and their vectors linked to the first of them without any comparison."""
    sure = (math.sqrt(2.0 * eps) - _SLACK) / 2
    rows, balls = ball_tree.leaves(d, eps, part, close=sure)
    compared = _compare(ball_tree.cells(rows, balls, part, sure), eps, forest=True).select("a", "b")
    tight = balls.filter(F.col("radius") <= sure).select("node", "first")
    stars = rows.filter("home").join(tight, "node").filter("rep <> first").select(F.col("first").alias("a"), F.col("rep").alias("b"))
    return compared.unionByName(stars)


def cluster(vectors: DataFrame, eps: float = EPS, part: int = PART, id_col="vec_id", vector="embedding") -> DataFrame:
    """(id, cluster) as DBSCAN with two samples gives it; -1 is noise.

    With two samples every vector that has a neighbour is a core point, so clusters are
    the connected components of the neighbour graph; a cluster is named by its lowest id.
    Balls so tight or close that all their vectors must be neighbours are linked without
    any comparison; other cells return a spanning forest of their links. A dense group thus
    yields about as many links as it has members.
    """
    links = copy_links(vectors, id_col, vector)
    for d in _by_length(cut(distinct_vectors(vectors, id_col, vector), "distinct")):
        if d.count() > MAX_PIVOTS * part:
            links = links.unionByName(_tree_links(d, eps, part))
        elif (balls := _balls(d, part)) is not None:
            sure = _sure_pairs(balls, eps)
            compared = _compare(_cells(d, balls, eps, part, sure), eps, forest=True)
            links = links.unionByName(compared.select("a", "b")).unionByName(_sure_links(d, balls, sure))
    groups = connected_components(links)
    labels = groups.select(F.col("node").alias(id_col), F.col("component").alias("cluster"))
    return vectors.select(id_col).join(labels, id_col, "left").select(id_col, F.coalesce("cluster", F.lit(NOISE)).alias("cluster"))
