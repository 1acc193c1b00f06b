"""Request-log analytics per key (W3-W7, T8-T10 on stored logs).

A key may hold a third of the log, so no window here spans a whole key: rows are cut
into time buckets, as narrow as the busiest key demands, or position chunks, and what a bucket needs from its past is either
repeated (a halo) or carried through a table with one row per bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, discard
from .ordering import join_null_safe, with_chunks, with_position

# Fixed values -------------------------------------------------------------------
WINDOW_S = 60
REQUESTS_PER_MINUTE = 30
RESPONSE_SAMPLES = 50
MIN_SAMPLES_RATE, MIN_SAMPLES_DELAY = 10, 5
TARGET_RESPONSE_S = 2.0
SLOW_FACTOR, FAST_FACTOR = 1.5, 0.7
MIN_DELAY_S, MAX_DELAY_S, MAX_BACKOFF = 1.0, 5.0, 10.0
RATE_UP, RATE_DOWN, MIN_RATE = 1.05, 0.9, 5.0
FAILURE_EXPIRY_S = 3600
BUCKET_WIDTHS_S = (86_400, 3600, 300, 60)
BUCKET_ROWS = 1_000_000
# --------------------------------------------------------------------------------

#: Requests, or steps made of them, that are gone through in one array.
TRACE_CHUNK = 1024


def _micros(ts="ts"):
    return F.unix_micros(F.col(ts).cast("timestamp"))


def _time_bucket(seconds: int):
    return F.floor(_micros() / (seconds * 1_000_000))


def _at_most(log: DataFrame, rows: int) -> bool:
    """Whether a log cannot hold more than ``rows`` requests, by the optimizer's estimate of its bytes."""
    return int(str(log._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= rows * 8 * len(log.columns)


def bucket_seconds(log: DataFrame, rows: int = BUCKET_ROWS) -> int:
    """The widest of a few bucket widths in which no key has more than ``rows`` requests, or the least.

    Any width gives the same result; it decides how much of a hot key one task gets. A log that cannot hold more than ``rows``
    requests, by the optimizer's estimate of its bytes, is not read for that; a larger one is counted once, by key
    and least bucket, and all widths are judged from these counts.
    """
    if _at_most(log, rows):
        return BUCKET_WIDTHS_S[0]
    least = BUCKET_WIDTHS_S[-1]
    counts = cut(log.groupBy("req_key", _time_bucket(least).alias("t")).agg(F.count("*").alias("n")), "bucket-counts")
    # F.floor gives whole numbers, so wider buckets are made of the least ones
    found = least
    for width in BUCKET_WIDTHS_S[:-1]:
        wide = counts.groupBy("req_key", F.floor(F.col("t") * least / width).alias("t")).agg(F.sum("n").alias("n"))
        if (wide.agg(F.max("n")).first()[0] or 0) <= rows:
            found = width
            break
    discard(counts)
    return found


def trailing_requests(
    log: DataFrame, limit: int = REQUESTS_PER_MINUTE, window_s: int = WINDOW_S, bucket_s: int | None = None
) -> DataFrame:
    """Requests of the key in the trailing window, over the limit or not, and the wait it causes.

    Requests at the same instant count together.
    """
    bucket_s = max(bucket_s or bucket_seconds(log), window_s)
    width, span = window_s * 1_000_000, bucket_s * 1_000_000
    own = F.floor(F.col("us") / span)
    needed_next = F.col("us") >= (own + 1) * span - width
    rows = (
        log.withColumn("us", _micros())
        .withColumn("own", own)
        .withColumn("bucket", F.explode(F.when(needed_next, F.array("own", F.col("own") + 1)).otherwise(F.array("own"))))
    )
    frame = Window.partitionBy("req_key", "bucket").orderBy("us").rangeBetween(-width, 0)
    out = rows.withColumns({"in_window": F.count("*").over(frame), "oldest": F.min("us").over(frame)})
    over = F.col("in_window") > limit
    wait = F.when(over, (F.col("oldest") + width - F.col("us")) / 1e6).otherwise(F.lit(0.0))
    return out.filter("bucket = own").select("seq", "req_key", "ts", "in_window", over.alias("over_limit"), F.round(wait, 6).alias("wait_s"))


def response_trend(
    log: DataFrame, target_s: float = TARGET_RESPONSE_S, bucket_s: int | None = None, chunk: int = 100_000
) -> DataFrame:
    """Mean of the last 50 response times, its verdict, and the factor it puts on the delay.

    Times are summed in whole microseconds, so the mean does not depend on how rows are split.
    """
    order = [F.col("ts"), F.col("seq")]
    timed = log.withColumn("response_us", F.round(F.col("response_s") * 1e6).cast("bigint"))
    placed = with_position(timed, order, _time_bucket(bucket_s or bucket_seconds(log)), by=["req_key"])
    rows = with_chunks(placed, "position", chunk, halo=RESPONSE_SAMPLES - 1)
    frame = Window.partitionBy("req_key", "chunk").orderBy("position").rowsBetween(1 - RESPONSE_SAMPLES, 0)
    mean = F.sum("response_us").over(frame) / F.count("*").over(frame) / F.lit(1e6)
    out = rows.withColumns({"samples": F.count("*").over(frame), "mean_s": mean}).filter("not is_halo")
    verdict = (
        F.when(F.col("samples") <= MIN_SAMPLES_RATE, "few")
        .when(F.col("mean_s") > target_s * SLOW_FACTOR, "slow")
        .when(F.col("mean_s") < target_s * FAST_FACTOR, "fast")
        .otherwise("ok")
    )
    scaled = (F.col("samples") > MIN_SAMPLES_DELAY) & (F.col("mean_s") > target_s)
    factor = F.when(scaled, F.col("mean_s") / target_s).otherwise(F.lit(1.0))
    return out.select("seq", "req_key", "samples", "mean_s", verdict.alias("verdict"), factor.alias("delay_factor"))


def failure_runs(log: DataFrame, bucket_s: int | None = None) -> DataFrame:
    """Consecutive failures of the key up to and including each request."""
    bucket_s = bucket_s or bucket_seconds(log)
    order = [F.col("ts"), F.col("seq")]
    per = Window.partitionBy("req_key", "bucket")
    fail = F.when(~F.col("ok"), 1).otherwise(0)
    rows = log.withColumn("bucket", _time_bucket(bucket_s)).withColumn(
        "island", F.sum(F.when(F.col("ok"), 1).otherwise(0)).over(per.orderBy(*order))
    )
    rows = rows.withColumn(
        "run", F.sum(fail).over(Window.partitionBy("req_key", "bucket", "island").orderBy(*order))
    )
    ends = rows.groupBy("req_key", "bucket").agg(
        F.max(F.when(F.col("ok"), 1).otherwise(0)).alias("reset"),
        F.max_by("run", F.struct("ts", "seq")).alias("tail"),
    )
    by_bucket = Window.partitionBy("req_key").orderBy("bucket")
    carry = ends.withColumn("grp", F.sum("reset").over(by_bucket))
    upto = Window.partitionBy("req_key", "grp").orderBy("bucket")
    carry = carry.withColumn("out", F.sum("tail").over(upto))
    carry = carry.select("req_key", "bucket", F.coalesce(F.lag("out").over(by_bucket), F.lit(0)).alias("carried"))
    joined = join_null_safe(rows, carry, ["req_key", "bucket"])
    streak = F.col("run") + F.when(F.col("island") == 0, F.col("carried")).otherwise(0)
    return joined.select("seq", "req_key", "ts", "ok", streak.cast("bigint").alias("failures"))


def suggested_delay(runs: DataFrame, min_s: float = MIN_DELAY_S, max_s: float = MAX_DELAY_S) -> DataFrame:
    """Delay that doubles with each failure in a row, within its limits."""
    backoff = F.least(F.pow(F.lit(2.0), F.col("failures")), F.lit(MAX_BACKOFF))
    delay = F.greatest(F.lit(min_s), F.least(min_s * backoff, F.lit(max_s)))
    return runs.withColumn("delay_s", delay)


def _applied(step, rate):
    """A step (scale, low, high) on a rate."""
    return F.least(step["high"], F.greatest(step["low"], step["scale"] * rate))


def _step(scale, low, high):
    return F.struct(scale.alias("scale"), low.alias("low"), high.alias("high"))


def _one_step(parts, min_rate: float, max_rate: float):
    """The step that an array of steps makes one after the other."""
    first = _step(F.lit(1.0), F.lit(min_rate), F.lit(max_rate))
    return F.aggregate(parts, first, lambda a, p: _step(a["scale"] * p["step"]["scale"], _applied(p["step"], a["low"]), _applied(p["step"], a["high"])))


def _starts(steps: DataFrame, most: int, chunk: int, min_rate: float, max_rate: float) -> DataFrame:
    """(req_key, chunk, start): the rate before each step of (req_key, chunk, step), of which a key has ``most``.

    Up to ``chunk`` steps are gone through in one array; more are first made one step for each so many.
    """
    parted = steps.withColumn("parent", F.floor(F.col("chunk") / chunk))
    groups = parted.groupBy("req_key", "parent").agg(F.array_sort(F.collect_list(F.struct("chunk", "step"))).alias("parts"))
    if most <= chunk:
        begun = groups.withColumn("start", F.lit(max_rate))
    else:
        whole = groups.select("req_key", F.col("parent").alias("chunk"), _one_step(F.col("parts"), min_rate, max_rate).alias("step"))
        above = _starts(whole, -(-most // chunk), chunk, min_rate, max_rate)
        begun = join_null_safe(groups, above.withColumnRenamed("chunk", "parent"), ["req_key", "parent"])
    none = F.array().cast("array<struct<chunk:bigint,start:double>>")
    run = F.aggregate(
        "parts",
        F.struct(F.col("start").alias("rate"), none.alias("out")),
        lambda a, p: F.struct(_applied(p["step"], a["rate"]).alias("rate"), F.array_append(a["out"], F.struct(p["chunk"].alias("chunk"), a["rate"].alias("start"))).alias("out")),
        lambda a: a["out"],
    )
    return begun.select("req_key", F.inline(run))


def _most_per_key(log: DataFrame) -> int:
    """A bound on the requests of a key; short logs are not read for it."""
    if _at_most(log, BUCKET_ROWS):
        return BUCKET_ROWS
    return log.groupBy("req_key").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0


def rate_trace(
    log: DataFrame, max_rate: float = REQUESTS_PER_MINUTE, min_rate: float = MIN_RATE, bucket_s: int | None = None, chunk: int = TRACE_CHUNK
) -> DataFrame:
    """Allowed rate after each request: up 5% on success, down 10% on failure, clamped.

    Each step is a clamped multiplication (scale, low, high), and so is any run of steps. Requests are taken in arrays of ``chunk``;
    each array is made one step, these give the rate before each array, then all arrays are gone through on their own. No
    array is longer, whatever the key.
    """
    max_rate, min_rate = float(max_rate), float(min_rate)
    placed = with_position(log.select("seq", "req_key", "ts", "ok"), [F.col("ts"), F.col("seq")], _time_bucket(bucket_s or bucket_seconds(log)), by=["req_key"])
    up = _step(F.lit(RATE_UP), F.lit(min_rate), F.lit(max_rate))
    down = _step(F.lit(RATE_DOWN), F.lit(min_rate), F.lit(max_rate))
    same = _step(F.lit(1.0), F.lit(min_rate), F.lit(max_rate))

    def step(ok):
        return F.when(ok, up).when(~ok, down).otherwise(same)

    rows = placed.select("req_key", F.floor((F.col("position") - 1) / chunk).alias("chunk"), F.struct("position", "seq", "ok").alias("row"))
    arrays = cut(rows.groupBy("req_key", "chunk").agg(F.array_sort(F.collect_list("row")).alias("rows")), "trace")
    steps = arrays.select("req_key", "chunk", _one_step(F.transform("rows", lambda r: F.struct(step(r["ok"]).alias("step"))), min_rate, max_rate).alias("step"))
    starts = _starts(steps, -(-_most_per_key(log) // chunk), chunk, min_rate, max_rate)
    none = F.array().cast("array<struct<seq:bigint,rate:double>>")
    traced = F.aggregate(
        "rows",
        F.struct(F.col("start").alias("rate"), none.alias("out")),
        lambda a, r: F.struct(_applied(step(r["ok"]), a["rate"]).alias("rate"), F.array_append(a["out"], F.struct(r["seq"].cast("bigint").alias("seq"), _applied(step(r["ok"]), a["rate"]).alias("rate"))).alias("out")),
        lambda a: a["out"],
    )
    return join_null_safe(arrays, starts, ["req_key", "chunk"]).select("req_key", F.inline(traced)).select("seq", "req_key", F.round("rate", 6).alias("rate"))


def tumbling_counts(log: DataFrame, width: str = "60 seconds") -> DataFrame:
    """Requests per key and aligned window."""
    w = F.window("ts", width)
    return log.groupBy("req_key", w.alias("w")).agg(F.count("*").alias("requests")).select("req_key", F.col("w.start").alias("window_start"), "requests")


def failure_sessions(log: DataFrame, gap_s: int = FAILURE_EXPIRY_S, bucket_s: int | None = None) -> DataFrame:
    """Failure counter that lives until no failure came for ``gap_s``.

    Failures are first joined into segments within time buckets; segments, of which a key
    has no more than buckets and sessions together, are then joined across buckets.
    """
    gap, bucket_s = gap_s * 1_000_000, bucket_s or bucket_seconds(log)

    def numbered(df: DataFrame, part: list[str], start: str, end: str, name: str) -> DataFrame:
        order = Window.partitionBy(*part).orderBy(start)
        joins = F.coalesce(F.col(start) - F.lag(end).over(order) < gap, F.lit(False))
        fresh = df.withColumn("fresh", F.when(joins, 0).otherwise(1))
        return fresh.withColumn(name, F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))

    failures = log.filter(~F.col("ok")).select("req_key", "ts", _micros().alias("us"), _time_bucket(bucket_s).alias("bucket"))
    segments = (
        numbered(failures, ["req_key", "bucket"], "us", "us", "segment")
        .groupBy("req_key", "bucket", "segment")
        .agg(F.min("us").alias("start"), F.max("us").alias("end"), F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("n"))
    )
    return (
        numbered(segments, ["req_key"], "start", "end", "session")
        .groupBy("req_key", "session")
        .agg(F.min("first").alias("first_failure"), F.max("last").alias("last_failure"), F.sum("n").alias("failures"))
        .drop("session")
    )


def totals_per_key(log: DataFrame) -> DataFrame:
    """T10."""
    return log.groupBy("req_key").agg(F.count("*").alias("requests"))
