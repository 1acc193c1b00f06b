"""A tree of balls over vectors, built level by level on Spark, for tables of any size.

A ball of more than ``part`` vectors is split by pivots of its own: some of its vectors, picked by hash, so that dense
regions get more. Every vector goes to the ball of its nearest pivot, its *home*. It also *visits* the balls before its own
among these in which it may have a neighbour: those whose pivot is no farther than the ball's radius plus the search
radius. As a visitor of a ball it goes on to all of the ball's parts that this bound allows. So every two
vectors that may be neighbours meet in exactly one leaf, as two that live there or as one that visits the other's home.

Pivots are joined to the vectors of their ball, a bounded number of both at a time; neither they nor any vector
pass through the driver, which sees only how many balls are left to split.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .blocks import spread

#: Balls a ball is split into at most, and vectors that meet its pivots in one task.
FAN = 64
TASK_ROWS = 4_000
SLACK = 1e-6


def unit(column: pd.Series) -> np.ndarray:
    x = np.array(column.to_list(), dtype=np.float64)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm == 0, 1.0, norm)


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (x @ pivots.T)))


def _met(rows: DataFrame, nodes: DataFrame, pivots: DataFrame, task_rows: int):
    """The rows and the pivots of each ball, side by side, in tasks of about ``task_rows`` rows."""
    tasks = F.ceil(F.col("held") / task_rows).cast("int")
    of = nodes.select("node", tasks.alias("tasks"))
    left = rows.join(of, "node").withColumn("task", F.pmod(F.xxhash64("v"), F.col("tasks")).cast("int")).drop("tasks")
    right = pivots.join(of, "node").withColumn("task", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1))).drop("tasks")
    keys = ["node", "task"]
    return spread(left, keys).groupBy(*keys).cogroup(spread(right, keys).groupBy(*keys))


def split(rows: DataFrame, nodes: DataFrame, reach: float, part: int, fan: int, task_rows: int) -> tuple[DataFrame, DataFrame]:
    """One level: the rows of the balls ``nodes`` (node, n, held) in their parts, and these parts (node, n, radius, first)."""
    kind, vec = rows.schema["rep"].dataType.simpleString(), rows.schema["v"].dataType.simpleString()
    wanted = F.least(F.lit(fan), F.greatest(F.lit(2), F.ceil(2 * F.col("n") / part))).cast("int")
    order = Window.partitionBy("node").orderBy(F.xxhash64("rep", "node"), "rep")
    picked = rows.filter("home").withColumn("child", F.row_number().over(order) - 1).filter(F.col("child") < fan)
    picked = picked.join(nodes.select("node", wanted.alias("wanted")), "node").filter("child < wanted")
    pivots = cut(picked.select("node", "child", F.col("v").alias("pivot")), "pivots")

    def sizes(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"node": [], "child": [], "n": [], "radius": [], "first": []})
        right = right.sort_values("child").reset_index(drop=True)
        dist = distances(unit(left["v"]), unit(right["pivot"]))
        best = dist.argmin(axis=1)
        child = right["child"].to_numpy()
        out = pd.DataFrame({"child": child[best], "first": left["rep"].to_numpy()}).groupby("child").agg(n=("first", "size"), first=("first", "min"))
        # another task may round otherwise: of pivots as near as the nearest, any may become the home
        i, j = np.nonzero(dist <= dist.min(axis=1)[:, None] + SLACK / 2)
        out["radius"] = pd.Series(dist[i, j]).groupby(child[j]).max() + SLACK / 2
        out = out.reset_index()
        out["node"] = left["node"].iloc[0]
        return out[["node", "child", "n", "radius", "first"]]

    stats = _met(rows.filter("home"), nodes, pivots, task_rows).applyInPandas(sizes, f"node long, child int, n long, radius double, first {kind}")
    stats = stats.groupBy("node", "child").agg(F.sum("n").alias("n"), F.max("radius").alias("radius"), F.min("first").alias("first"))
    balls = cut(pivots.join(stats, ["node", "child"]).withColumn("ball", F.xxhash64("node", "child")), "balls")

    def move(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"node": [], "rep": [], "v": [], "home": []})
        # with the balls in the order of their numbers, "before" is the same in every task
        right = right.sort_values("child").reset_index(drop=True)
        dist = distances(unit(left["v"]), unit(right["pivot"]))
        home = left["home"].to_numpy(dtype=bool)
        own = dist.argmin(axis=1)
        near = dist <= right["radius"].to_numpy() + reach + SLACK
        near &= ~home[:, None] | (np.arange(len(right)) < own[:, None])
        i, j = np.nonzero(near)
        i, j = np.concatenate((np.flatnonzero(home), i)), np.concatenate((own[home], j))
        flags = np.arange(len(i)) < int(home.sum())
        return pd.DataFrame({"node": right["ball"].to_numpy()[j], "rep": left["rep"].to_numpy()[i], "v": left["v"].to_numpy()[i], "home": flags})

    moved = _met(rows, nodes, balls.select("node", "child", "pivot", "radius", "ball"), task_rows).applyInPandas(move, f"node long, rep {kind}, v {vec}, home boolean")
    return cut(moved, "moved"), balls.select(F.col("ball").alias("node"), "n", "radius", "first")


def leaves(d: DataFrame, eps: float, part: int, close: float | None = None, fan: int = FAN, task_rows: int = TASK_ROWS) -> tuple[DataFrame, DataFrame]:
    """(node, rep, v, home) of all leaves, and the leaves (node, n, radius, first).

    Balls whose radius is at most ``close`` are not split, whatever their size.
    """
    reach = math.sqrt(2.0 * eps)
    rows = cut(d.select(F.lit(0).cast("long").alias("node"), "rep", "v", F.lit(True).alias("home")), "root")
    balls = rows.groupBy("node").agg(F.count("*").alias("n"), F.lit(2.0).alias("radius"), F.min("rep").alias("first"))
    done_rows, done = [], []
    for _ in range(64):
        open_ball = (F.col("n") > part) & (F.col("radius") > (close if close is not None else -1.0))
        split_next = balls.filter(open_ball)
        if split_next.isEmpty():
            break
        done.append(balls.filter(~open_ball))
        held = rows.groupBy("node").agg(F.count("*").alias("held"))
        nodes = cut(split_next.join(held, "node").select("node", "n", "held"), "nodes")
        done_rows.append(rows.join(nodes.select("node"), "node", "left_anti"))
        rows, balls = split(rows.join(nodes.select("node"), "node", "left_semi"), nodes, reach, part, fan, task_rows)
    done_rows.append(rows)
    done.append(balls)
    out, every = done_rows[0], done[0]
    for r, b in zip(done_rows[1:], done[1:]):
        out, every = out.unionByName(r), every.unionByName(b)
    return out, every


def cells(rows: DataFrame, balls: DataFrame, part: int, sure: float | None = None) -> DataFrame:
    """Rows (ca, cb, ia, ib, side, rep, v): those that live in a leaf with each other, and with its visitors, in bounded cells.

    In leaves whose radius is at most ``sure`` those that live there are not compared with each other.
    """
    sizes = rows.groupBy("node").agg(F.count_if("home").alias("n0"), F.count_if(~F.col("home")).alias("n1"))
    known = sizes.join(balls.select("node", "radius"), "node").select(
        "node", F.ceil(F.col("n0") / part).cast("int").alias("p0"), F.ceil(F.col("n1") / part).cast("int").alias("p1"),
        (F.col("radius") <= (sure if sure is not None else -1.0)).alias("sure"),
    )
    own = F.pmod(F.xxhash64("v"), F.when(F.col("home"), F.col("p0")).otherwise(F.col("p1"))).cast("int")
    placed = rows.join(known, "node").withColumn("own", own)

    def numbers(n):
        return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

    def cell(cb, ia, ib, side):
        return F.struct(F.col("node").alias("ca"), cb.alias("cb"), ia.alias("ia"), ib.alias("ib"), side.alias("side"))

    me, other = F.col("own"), F.bitwise_not(F.col("node"))
    among = F.when(F.col("sure"), F.array().cast("array<int>")).otherwise(numbers(F.col("p0")))
    at_home = F.transform(among, lambda q: cell(F.col("node"), F.least(me, q), F.greatest(me, q), me))
    hosting = F.transform(numbers(F.col("p1")), lambda q: cell(other, me, q, F.lit(0)))
    visiting = F.transform(numbers(F.col("p0")), lambda q: cell(other, q, me, F.lit(1)))
    return placed.select(F.inline(F.when(F.col("home"), F.concat(at_home, hosting)).otherwise(visiting)), "rep", "v")
