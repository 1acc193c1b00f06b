"""Record and request logs as streams.

Sinks write one folder per batch and replace it if the batch is repeated, so a restart
from the checkpoint neither loses nor doubles rows.
"""

from __future__ import annotations

import time
from collections.abc import Iterable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener

from ..functions.quality import nested_as_json
from ..operators.ordering import with_serial
from ..schema import RECORD
from ..sources import records

# Fixed values -------------------------------------------------------------------
FLUSH_SECONDS = 5
SAMPLE_EVERY = 10
WINDOW_S = 60
REQUESTS_PER_MINUTE = 30
FILES_PER_BATCH = 1000
ONE_TASK_ROWS = 100_000
OBSERVED = "live_counts"
#: Request times of a key that are sorted in memory, 8 bytes each; more go through the state store, by cells.
HELD_TIMES = 1_000_000
CELL_S = 1.0
COUNTER_ROWS = 10_000
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# --------------------------------------------------------------------------------

_CSV = {"header": "true", "quote": '"', "escape": '"', "emptyValue": ""}


def log_stream(
    spark: SparkSession, path: str, schema: T.StructType = RECORD, files_per_batch: int | None = None, rest: str | None = records.REST
) -> DataFrame:
    """The record log as it grows; unreadable lines are left out and unknown keys kept in ``rest``,
    as ``records.read_log`` does. Lines are not numbered: files arrive in an order of their own."""
    reader = spark.readStream
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    lines = reader.text(path).filter(F.col("value").rlike(r"\S")).select(F.col("value").alias("line"))
    good = records.parsed(lines, schema).filter("readable")
    kept = [records.rest_of("line", schema).alias(rest)] if rest else []
    return good.select(*[F.col(f"record.`{name}`").alias(name) for name in schema.names], *kept)


def request_stream(spark: SparkSession, path: str, schema: T.StructType, delay: str = "10 minutes", files_per_batch: int = FILES_PER_BATCH) -> DataFrame:
    """The request log as a stream with event time ``ts``; rows later than ``delay`` are dropped.

    A backlog is read in batches of at most ``files_per_batch`` files.
    """
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return raw.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)


def distinct_records(stream: DataFrame, within: str | None = None, event_time: str = "scraped_at") -> DataFrame:
    """T5: first record of each ``_id``.

    Without ``within`` every id is remembered for good; with it, only as long as a copy
    can still arrive, which bounds the state.
    """
    if within is None:
        return stream.dropDuplicates(["_id"])
    return stream.withWatermark(event_time, within).dropDuplicatesWithinWatermark(["_id"])


def every_nth(df: DataFrame, before: int = 0, n: int = SAMPLE_EVERY, seq: str = "seq") -> DataFrame:
    """T4: the first, (n + 1)-th, (2n + 1)-th, ... record to arrive, ``before`` having arrived earlier.

    Records of one batch arrive in ``seq`` order. Batches of up to ``ONE_TASK_ROWS`` are numbered
    in one task, larger ones in buckets, with the same result.
    """
    if df.count() <= ONE_TASK_ROWS:
        numbered = df.withColumn("__arrival", F.row_number().over(Window.orderBy(seq)))
    else:
        numbered = with_serial(df, seq, name="__arrival")
    return numbered.filter(F.pmod(F.col("__arrival") + (before - 1), F.lit(n)) == 0).drop("__arrival")


def _arrived(spark: SparkSession, folder: str, before_batch: int) -> int:
    """Records of all batches before a given one; a repeated batch finds the same number."""
    if before_batch == 0:
        return 0
    done = spark.read.schema("upto long").parquet(f"{folder}/arrivals/batch={before_batch - 1}")
    return done.first().upto


def saved_count(spark: SparkSession, folder: str) -> int:
    """Records saved so far by ``save_live``, exactly."""
    return spark.read.schema("upto long, batch long").parquet(f"{folder}/arrivals").agg(F.coalesce(F.max("upto"), F.lit(0))).first()[0]


def counted(stream: DataFrame) -> DataFrame:
    """The stream, its records counted as they pass; ``LiveCounts`` hears of them after each batch."""
    return stream.observe(OBSERVED, F.count(F.lit(1)).alias("received"), F.approx_count_distinct("_id").alias("distinct"))


class LiveCounts(StreamingQueryListener):
    """Records received and saved so far by a run of ``save_live`` over a ``counted`` stream, kept up to date by Spark's
    progress reports; no query reads the sink again.

    Counts are kept by batch, and begin with what the folder holds, so a batch that is repeated after a restart counts once.
    Add it with ``spark.streams.addListener`` before the run starts.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.batches: dict[int, int] = {}
        self.runs: set[str] = set()
        self.finished: set[str] = set()
        if _has(spark, f"{folder}/arrivals"):
            upto = spark.read.schema("upto long, batch long").parquet(f"{folder}/arrivals").orderBy("batch").collect()  # a row a batch
            self.batches = {r.batch: r.upto - (upto[i - 1].upto if i else 0) for i, r in enumerate(upto)}

    @property
    def received(self) -> int:
        return sum(self.batches.values())

    def settle(self, run, seconds: float = 60.0) -> int:
        """Waits until an ended run has been reported whole; the records received."""
        until = time.monotonic() + seconds
        while str(run.runId) not in self.finished and time.monotonic() < until:
            time.sleep(0.05)
        return self.received

    def onQueryStarted(self, event) -> None:
        self.runs.add(str(event.runId))

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get(OBSERVED)
        if row is not None and row["received"] is not None:
            self.batches[event.progress.batchId] = row["received"]

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.finished.add(str(event.runId))


def _has(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _start(stream: DataFrame, write, checkpoint: str, available_now: bool, mode: str = "append"):
    w = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime=f"{FLUSH_SECONDS} seconds")).start()


def save_live(
    stream: DataFrame, folder: str, checkpoint: str, formats=("csv", "json", "table"), sample: bool = True, available_now: bool = False
):
    """Each micro-batch to all formats at once, plus the every-tenth snapshot."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            part = f"batch={batch_id}"
            # each batch has columns for its own unknown keys; the table, which has one schema, keeps them as VARIANT
            wide = records.widened(batch)
            if "csv" in formats:
                nested_as_json(wide).write.mode("overwrite").options(**_CSV).csv(f"{folder}/csv/{part}")
            if "json" in formats:
                wide.write.mode("overwrite").json(f"{folder}/json/{part}")
            if "table" in formats:
                batch.write.mode("overwrite").parquet(f"{folder}/table/{part}")
            before = _arrived(batch.sparkSession, folder, batch_id)
            if sample:
                every_nth(batch, before).write.mode("overwrite").parquet(f"{folder}/sample/{part}")
            # last, so that what is counted has been saved
            batch.agg((F.count("*") + before).alias("upto")).write.mode("overwrite").parquet(f"{folder}/arrivals/{part}")
        finally:
            batch.unpersist()

    return _start(stream, write, checkpoint, available_now)


def save_results(result: DataFrame, folder: str, checkpoint: str, mode: str = "append", available_now: bool = False):
    """Writes each batch of a streaming result to ``folder/batch=<id>``."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    return _start(result, write, checkpoint, available_now, mode)


def latest(results: DataFrame, keys: list[str]) -> DataFrame:
    """The newest version of each row of an update-mode result written by ``save_results``."""
    rest = [c for c in results.columns if c not in (*keys, "batch")]
    newest = results.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("__row"))
    return newest.select(*keys, "__row.*")


def running_counters(stream: DataFrame) -> DataFrame:
    """Records received so far, and about how many different ones; use ``update`` mode.

    ``saved_count`` is the exact number of those saved.
    """
    return stream.groupBy(F.lit("all").alias("scope")).agg(
        F.count("*").alias("received"), F.approx_count_distinct("_id").alias("approx_distinct")
    )


def sliding_rate(requests: DataFrame, width: str = "60 seconds", step: str = "10 seconds") -> DataFrame:
    """Requests per key in each sliding window."""
    w = F.window("ts", width, step)
    counts = requests.groupBy(w.alias("w"), "req_key").agg(F.count("*").alias("requests"))
    return counts.select("req_key", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "requests")


def failure_session_stream(requests: DataFrame, gap: str = "1 hour") -> DataFrame:
    """T9 as a stream: a failure counter per key that each failure keeps alive for ``gap``."""
    s = F.session_window("ts", gap)
    sessions = requests.filter(~F.col("ok")).groupBy(s.alias("s"), "req_key").agg(F.count("*").alias("failures"))
    return sessions.select("req_key", F.col("s.start").alias("first_failure"), F.col("s.end").alias("expires"), "failures")


class OpenedCounters(StatefulProcessor):
    """The counters of one key: the state is the open one, dropped by a timer when the watermark passes its end.

    Requests come in Arrow slices, in no order. Up to ``held`` times of a key are sorted in memory; those of a busier key
    are put into the state store by cells of ``cell`` microseconds, and taken out cell by cell in order. So a task holds
    one slice, ``held`` times or one cell of one key, however many requests a batch brings.
    """

    def __init__(self, width: int, limit: int, held: int, cell: int):
        self.width, self.limit, self.held, self.cell = width, limit, held, cell

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counter = handle.getValueState("counter", "opened long, n long")
        self.waiting = handle.getMapState("waiting", "cell long, part long", "times binary")

    def _put(self, times: np.ndarray, parts: dict[int, int]) -> None:
        cells = times // self.cell
        for some in np.split(times, np.flatnonzero(np.diff(cells)) + 1):
            cell = int(some[0]) // self.cell
            part = parts.get(cell, 0)
            self.waiting.updateValue((cell, part), (some.tobytes(),))
            parts[cell] = part + 1

    def _ordered(self, frames: Iterable[pd.DataFrame]) -> Iterator[np.ndarray]:
        """All times of the batch, in ascending pieces."""
        kept: list[np.ndarray] = []
        parts: dict[int, int] = {}
        for frame in frames:
            kept.append(frame["us"].to_numpy(dtype=np.int64))
            if sum(map(len, kept)) > self.held:
                self._put(np.sort(np.concatenate(kept)), parts)
                kept = []
        if parts and kept:
            self._put(np.sort(np.concatenate(kept)), parts)
            kept = []
        if kept:
            yield np.sort(np.concatenate(kept))
        for cell in sorted(parts):
            stored = []
            for part in range(parts[cell]):
                stored.append(np.frombuffer(self.waiting.getValue((cell, part))[0], dtype=np.int64))
                self.waiting.removeKey((cell, part))
            yield np.sort(np.concatenate(stored))

    def _due(self, opened: int) -> int:
        """The millisecond by which a counter has ended."""
        return -(-(opened + self.width) // 1000)

    def handleInputRows(self, key: tuple[Any, ...], rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = opened = n = None
        if self.counter.exists():
            before, n = self.counter.get()
            opened = before
        done: list[tuple] = []
        for times in self._ordered(rows):
            at = 0
            while at < len(times):
                if opened is None or times[at] >= opened + self.width:
                    if opened is not None and n > 0:
                        done.append((key[0], opened, n))
                    opened, n = int(times[at]), 0
                end = int(np.searchsorted(times, opened + self.width, side="left"))
                n += end - at
                at = end
                if len(done) >= COUNTER_ROWS:
                    yield self._rows(done)
                    done = []
        done.append((key[0], opened, n))
        self.counter.update((opened, n))
        if opened != before:
            if before is not None:
                self.handle.deleteTimer(self._due(before))
            self.handle.registerTimer(self._due(opened))
        yield self._rows(done)

    def _rows(self, done: list[tuple]) -> pd.DataFrame:
        key, opened, n = zip(*done)
        counts = np.array(n, dtype=np.int64)
        return pd.DataFrame(
            {"name": list(key), "opened": pd.to_datetime(opened, unit="us"), "requests": counts, "over_limit": np.maximum(0, counts - self.limit)}
        )

    def handleExpiredTimer(self, key: tuple[Any, ...], timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.counter.exists() and self._due(self.counter.get()[0]) <= expiredTimerInfo.getExpiryTimeInMs():
            self.counter.clear()
        return iter([])


def opened_counters(
    requests: DataFrame, window_s: int = WINDOW_S, limit: int = REQUESTS_PER_MINUTE, held: int = HELD_TIMES, cell_s: float = CELL_S
) -> DataFrame:
    """Per key, a counter that opens at the first request and lives ``window_s``.

    Emits (req_key, opened, requests, over_limit) for each counter a batch touched; use ``update`` mode and ``latest``.
    A stream begins with the watermark 1970-01-01 00:00:00, so requests of that very moment or before count as late.
    The state lies in RocksDB, which this call chooses for streams that the session starts from now on; streams
    restarted from a checkpoint keep the store they began with.
    """
    requests.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKSDB)
    key = requests.schema["req_key"].dataType
    counters = OpenedCounters(window_s * 1_000_000, limit, held, max(1, int(cell_s * 1_000_000)))
    # pandas has no NULL among whole numbers, so keys travel as text, and NULL as a text of its own
    named = F.coalesce(F.concat(F.lit("="), F.col("req_key").cast("string")), F.lit("")).alias("name")
    timed = requests.select(named, "ts", F.unix_micros("ts").alias("us"))
    out = timed.groupBy("name").transformWithStateInPandas(
        counters, "name string, opened timestamp, requests long, over_limit long", "update", "EventTime"
    )
    req_key = F.when(F.col("name") != "", F.substring("name", 2, 2**31 - 1).cast(key)).alias("req_key")
    return out.select(req_key, "opened", "requests", "over_limit")
