"""Global shuffle into shards by a two-pass external shuffle (operator 1).

Pass one scatters the records over buckets by a seeded hash; there are as many buckets as keep
one in memory. Pass two permutes each bucket by Fisher-Yates (Spark's ``shuffle`` of an array,
seeded by the bucket's number) and writes it. Bucket b's records follow those of bucket b - 1,
so every record has a position in one uniform permutation of the whole table, and shards are
cut from it by position: their counts differ by one at most. Everything is DataFrame code.

The hash covers all columns of a record, so only records equal in every column share one. Where those of
one hash would fill a good part of a bucket, each is numbered where it is read and hashed again with
its number: being equal, they may stand for each other. Each bucket is one task; its number, and so its seed,
does not depend on the cluster.

Results: null and empty texts count as no bytes. Repeated rows are rows of their own. An empty
table gives no row. Extra columns, whatever their names, are shuffled and written along; columns named ``shard`` or
``slot`` are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, work_path

SHARDS = 24
BUCKET_BYTES = 64 << 20
#: Offsets are one row of 16 bytes a bucket; up to this many buckets (64 TB) they are broadcast.
BROADCAST_BUCKETS = 1_000_000


def record_bytes(text: str = "text") -> Column:
    """UTF-8 bytes of the text and eight for the id."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8


def shuffle_into_shards(docs: DataFrame, shards: int = SHARDS, bucket_bytes: int = BUCKET_BYTES, seed: int = 1) -> DataFrame:
    """``docs`` (doc_id, text and others) with ``shard`` and ``slot``, its place there, written and read back."""
    spark = docs.sparkSession
    docs = docs.drop("shard", "slot")
    total = docs.agg(F.sum(record_bytes()), F.count("*")).first()
    size, rows = total[0] or 0, total[1]
    buckets = max(1, -(-size // bucket_bytes))
    hashed = F.xxhash64(F.lit(seed), *[f.name for f in docs.schema if "map<" not in f.dataType.simpleString()])
    sized = docs.select(F.struct(*docs.columns).alias("record"), hashed.alias("order"), record_bytes().alias("size"))
    keyed = _apart(sized, bucket_bytes, seed).select("record", F.pmod("order", F.lit(buckets)).cast("int").alias("bucket"), "order")
    # a bucket a task, its records in an order of their own before the permutation
    scattered = keyed.repartitionById(buckets, "bucket").sortWithinPartitions("bucket", "order")
    permuted = scattered.groupBy("bucket").agg(F.shuffle(F.collect_list("record"), seed).alias("records"))
    path = work_path(spark, "buckets")
    permuted.select("bucket", F.posexplode("records").alias("at", "record")).write.parquet(path)
    written = spark.read.schema(permuted.select("bucket", F.lit(0).alias("at"), F.element_at("records", 1).alias("record")).schema).parquet(path)
    counts = written.groupBy("bucket").agg(F.count("*").alias("n"))
    offsets = cut(counts.select("bucket", "n"), "counts")
    before = _running(offsets)
    side = F.broadcast(before) if buckets <= BROADCAST_BUCKETS else before
    placed = written.join(side, "bucket").withColumn("position", F.col("before") + F.col("at"))
    # shard s holds the positions p with floor(p * shards / rows) = s
    n = max(1, rows)
    placed = placed.withColumn("shard", F.expr(f"cast(position * {shards} div {n} as int)"))
    placed = placed.withColumn("slot", F.expr(f"position - (shard * {n}L + {shards - 1}) div {shards}"))
    return placed.select("record.*", "shard", "slot")


def _apart(sized: DataFrame, bucket_bytes: int, seed: int) -> DataFrame:
    """``sized`` (order, size) with a new ``order`` for each record of a hash that holds over a quarter of a bucket."""
    heavy = sized.groupBy("order").agg(F.sum("size").alias("held")).filter(F.col("held") > bucket_bytes // 4).select("order", F.lit(True).alias("heavy"))
    heavy = cut(heavy, "heavy")  # four rows a bucket at most
    side = F.broadcast(heavy) if heavy.limit(BROADCAST_BUCKETS + 1).count() <= BROADCAST_BUCKETS else heavy
    numbered = sized.withColumn("number", F.monotonically_increasing_id()).join(side, "order", "left")
    return numbered.withColumn("order", F.when(F.col("heavy"), F.xxhash64(F.lit(seed), "order", "number")).otherwise(F.col("order")))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder a shard, its records in the order of their slots within each file."""
    sharded.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def _running(counts: DataFrame, span: int = 4096) -> DataFrame:
    """(bucket, before): records in earlier buckets; sums within spans of buckets, then over spans."""
    part = F.floor(F.col("bucket") / span).cast("long").alias("part")
    rows = counts.select("bucket", "n", part)
    within = rows.withColumn("inner", F.sum("n").over(Window.partitionBy("part").orderBy("bucket")) - F.col("n"))
    spans = rows.groupBy("part").agg(F.sum("n").alias("m"))
    outer = spans.withColumn("outer", F.sum("m").over(Window.orderBy("part")) - F.col("m")).select("part", "outer")
    return within.join(outer, "part").select("bucket", (F.col("inner") + F.col("outer")).alias("before"))
