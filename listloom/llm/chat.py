"""Cumulative-snapshot collapse and chat formatting (operator 10).

A conversation that is logged after every turn appears once for each of its prefixes. Each turn
gets a rolling hash of all turns up to it: two 64-bit XORs of hashes of (place, role, text), so
it depends on their order and can be made in parts. A conversation whose full hash is the hash of
a longer one's prefix goes by an anti-join; of conversations with exactly the same turns that with
the least id stays. The rest is rendered.

Places and hashes are computed within spans of turn numbers and then over the spans of a
conversation, so a long conversation is not one task; it is rendered in segments of a fixed
number of turns. Spans that are crowded (many rows with one turn number) are cut further by
the hash of their content.

Results: turns are ordered by turn number, null first, and those with the same number by a hash
of their content. Null roles and texts read as empty. Repeated rows count once. Rows with a null
conversation id are one conversation without an id. An empty table gives no row. Extra columns
are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .tables import checked_broadcast

#: Turn numbers in a span; rows of a span beyond which it is cut further; turns in a rendered segment.
SPAN = 1024
CROWD = 8 * SPAN
SEGMENT = 256
_CONV = ["known", "conv"]
_PART = [*_CONV, "span", "number", "slice"]


def _same(left: DataFrame, right: DataFrame, columns: list[str]):
    return reduce(lambda a, b: a & b, [left[c].eqNullSafe(right[c]) for c in columns])


def _distinct_turns(turns: DataFrame, span: int, crowd: int) -> DataFrame:
    """Distinct turns with the part they are counted in."""
    rows = turns.select(
        F.col("conv_id").isNotNull().alias("known"), F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("conv"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    ).distinct()
    rows = rows.withColumn("span", F.floor(F.col("turn") / span)).withColumn("mark", F.xxhash64("role", "text"))
    rows = cut(rows, "turns")
    crowded = cut(rows.groupBy(*_CONV, "span").agg(F.count("*").alias("m")).filter(F.col("m") > crowd), "crowded")
    none = F.lit(None).cast("long")
    if crowded.isEmpty():
        return rows.withColumn("number", none).withColumn("slice", none)
    marked = rows.join(checked_broadcast(crowded), _same(rows, crowded, [*_CONV, "span"]), "left")
    marked = marked.select(*[rows[c] for c in rows.columns], F.col("m").isNotNull().alias("many"))
    # the mark's leading bits, in the order of the marks
    return marked.withColumn("number", F.when(F.col("many"), F.col("turn"))).withColumn("slice", F.when(F.col("many"), F.shiftright("mark", 54))).drop("many")


def rolling(turns: DataFrame, span: int = SPAN, crowd: int = CROWD) -> tuple[DataFrame, DataFrame]:
    """Hashes (known, conv, place, n, h1, h2) and the distinct turns (known, conv, place, role, text, ...).

    ``conv`` is the id, 0 if it is null and ``known`` false; ``place`` counts from 1 to ``n``;
    the hashes are those of the conversation up to this turn.
    """
    rows = _distinct_turns(turns, span, crowd)
    inner = Window.partitionBy(*_PART).orderBy(F.col("turn").asc_nulls_first(), "mark", "role", "text")
    over = Window.partitionBy(*_CONV).orderBy(*[F.col(c).asc_nulls_first() for c in _PART[2:]])
    parts = rows.groupBy(*_PART).agg(F.count("*").alias("m"))
    parts = parts.withColumn("before", F.sum("m").over(over) - F.col("m")).withColumn("n", F.sum("m").over(Window.partitionBy(*_CONV)))
    numbered = rows.withColumn("at", F.row_number().over(inner))
    placed = numbered.join(parts, _same(numbered, parts, _PART)).select(*[numbered[c] for c in numbered.columns], "n", (F.col("before") + F.col("at")).alias("place"))
    salted = placed.withColumn("x1", F.xxhash64("place", "role", "text")).withColumn("x2", F.xxhash64(F.lit("second"), "text", "role", "place"))
    salted = cut(salted.drop("mark"), "places")
    upto = Window.partitionBy(*_PART).orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*_CONV).orderBy(*[F.col(c).asc_nulls_first() for c in _PART[2:]]).rowsBetween(Window.unboundedPreceding, -1)
    sums = salted.groupBy(*_PART).agg(F.bit_xor("x1").alias("p1"), F.bit_xor("x2").alias("p2"))
    sums = sums.select(*_PART, *[F.coalesce(F.bit_xor(p).over(earlier), F.lit(0)).alias(b) for p, b in (("p1", "b1"), ("p2", "b2"))])
    slim = salted.select(*_PART, "place", "n", F.bit_xor("x1").over(upto).alias("i1"), F.bit_xor("x2").over(upto).alias("i2"))
    hashed = slim.join(sums, _same(slim, sums, _PART))
    return hashed.select(*[slim[c] for c in _CONV], "place", "n", F.col("i1").bitwiseXOR(F.col("b1")).alias("h1"), F.col("i2").bitwiseXOR(F.col("b2")).alias("h2")), salted


def maximal(hashes: DataFrame) -> DataFrame:
    """(known, conv, copies) of the conversations that stay; ``copies`` have exactly the same turns."""
    whole = hashes.filter("place = n").groupBy("place", "h1", "h2").agg(F.max(F.struct("known", (-F.col("conv")).alias("minus"))).alias("first"), F.count("*").alias("copies"))
    prefixes = hashes.filter("place < n").select("place", "h1", "h2").distinct()
    stay = whole.join(prefixes, ["place", "h1", "h2"], "left_anti")
    return stay.select(F.col("first.known").alias("known"), (-F.col("first.minus")).alias("conv"), "copies")


def format_chats(turns: DataFrame, segment: int = SEGMENT, span: int = SPAN, crowd: int = CROWD) -> DataFrame:
    """(conv_id, segment, n_turns, copies, text) of the maximal conversations of ``turns`` (conv_id, turn, role, text).

    A turn is rendered as ``<|role|>``, a line feed, its text, ``<|end|>`` and a line feed.
    """
    hashes, places = rolling(turns, span, crowd)
    stay = cut(maximal(hashes), "maximal")
    rows = places.select(*_CONV, "place", "role", "text").join(checked_broadcast(stay), _CONV)
    line = F.concat(F.lit("<|"), "role", F.lit("|>\n"), "text", F.lit("<|end|>\n"))
    rows = rows.select(*_CONV, "copies", F.floor((F.col("place") - 1) / segment).cast("long").alias("segment"), F.struct("place", line.alias("line")).alias("turn"))
    made = rows.groupBy(*_CONV, "segment", "copies").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    conv = F.when(F.col("known"), F.col("conv")).alias("conv_id")
    return made.select(conv, "segment", F.size("turns").cast("long").alias("n_turns"), "copies", F.array_join("turns.line", "").alias("text"))
