"""Registered queries over request logs, jobs, streams and record vectors."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import cluster, rate, reports
from ..session import work_path
from ..sources import records
from ..streaming import jobs
from .registry import BIZ, d_record_id, query
from .views import businesses, duck_with, table, view

REQ = duck_with("requests")
# Test data has about one request per key and eight hours, so windows are hours wide here.
_HOURS_12 = 43_200


def requests(spark, sf):
    return view(spark, sf, "requests")


# -- request-log analytics -------------------------------------------------------


@query(
    "w3_trailing_requests",
    REQ + f"""SELECT seq, req_key, ts, n AS in_window, n > 3 AS over_limit,
      CASE WHEN n > 3 THEN round((oldest + {_HOURS_12}000000 - epoch_us(ts)) / 1e6, 6) ELSE 0.0 END AS wait_s
    FROM (SELECT *, count(*) OVER w AS n, min(epoch_us(ts)) OVER w AS oldest FROM requests
      WINDOW w AS (PARTITION BY req_key ORDER BY epoch_us(ts) RANGE BETWEEN {_HOURS_12}000000 PRECEDING AND CURRENT ROW)) x""",
)
def w3(spark, sf):
    return rate.trailing_requests(requests(spark, sf), limit=3, window_s=_HOURS_12)


@query(
    "w4_response_trend",
    REQ + """SELECT seq, req_key, samples, mean AS mean_s,
      CASE WHEN samples <= 10 THEN 'few' WHEN mean > 0.3 * 1.5 THEN 'slow' WHEN mean < 0.3 * 0.7 THEN 'fast' ELSE 'ok' END AS verdict,
      CASE WHEN samples > 5 AND mean > 0.3::DOUBLE THEN mean / 0.3::DOUBLE ELSE 1.0 END AS delay_factor
    FROM (SELECT *, count(*) OVER w AS samples, CAST(sum(CAST(round(response_s * 1e6) AS BIGINT)) OVER w AS BIGINT) / count(*) OVER w / 1e6 AS mean FROM requests
      WINDOW w AS (PARTITION BY req_key ORDER BY ts, seq ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)) x""",
)
def w4(spark, sf):
    return rate.response_trend(requests(spark, sf), target_s=0.3)


_RUNS = REQ + """, islands AS (SELECT *, sum(ok::INT) OVER (PARTITION BY req_key ORDER BY ts, seq) AS island FROM requests),
runs AS (SELECT seq, req_key, ts, ok, CAST(sum((NOT ok)::INT) OVER (PARTITION BY req_key, island ORDER BY ts, seq) AS BIGINT) AS failures FROM islands)
"""


@query("w5_failure_runs", _RUNS + "SELECT * FROM runs")
def w5(spark, sf):
    return rate.failure_runs(requests(spark, sf))


@query("w6_suggested_delay", _RUNS + "SELECT seq, failures, greatest(1.0, least(1.0 * least(pow(2.0, failures), 10.0), 5.0)) AS delay_s FROM runs")
def w6(spark, sf):
    return rate.suggested_delay(rate.failure_runs(requests(spark, sf))).select("seq", "failures", "delay_s")


@query(
    "w7_rate_trace",
    REQ.replace("WITH ", "WITH RECURSIVE ", 1) + """, numbered AS (SELECT seq, req_key, ok, row_number() OVER (PARTITION BY req_key ORDER BY ts, seq) AS i FROM requests),
    trace AS (SELECT seq, req_key, i, CASE WHEN ok THEN least(30.0::DOUBLE * 1.05, 30.0) ELSE greatest(30.0::DOUBLE * 0.9, 5.0) END AS rate FROM numbered WHERE i = 1
      UNION ALL SELECT n.seq, n.req_key, n.i, CASE WHEN n.ok THEN least(t.rate * 1.05, 30.0) ELSE greatest(t.rate * 0.9, 5.0) END
      FROM trace t JOIN numbered n ON n.req_key = t.req_key AND n.i = t.i + 1)
    SELECT seq, req_key, round(rate, 6) AS rate FROM trace""",
)
def w7(spark, sf):
    return rate.rate_trace(requests(spark, sf))


@query(
    "t8_tumbling_counts",
    REQ + "SELECT req_key, date_trunc('hour', ts) AS window_start, count(*) AS requests FROM requests GROUP BY ALL",
)
def t8(spark, sf):
    return rate.tumbling_counts(requests(spark, sf), "1 hour")


_SESSIONS = REQ + """, gaps AS (SELECT req_key, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY req_key ORDER BY ts) < INTERVAL {gap} THEN 0 ELSE 1 END AS fresh
  FROM requests WHERE NOT ok),
named AS (SELECT *, sum(fresh) OVER (PARTITION BY req_key ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM gaps),
sessions AS (SELECT req_key, min(ts) AS first_failure, max(ts) AS last_failure, count(*) AS failures FROM named GROUP BY req_key, s)
"""


@query("t9_failure_sessions", _SESSIONS.format(gap="12 HOUR") + "SELECT * FROM sessions")
def t9(spark, sf):
    return rate.failure_sessions(requests(spark, sf), _HOURS_12)


@query("t10_totals", REQ + "SELECT req_key, count(*) AS requests FROM requests GROUP BY req_key")
def t10(spark, sf):
    return rate.totals_per_key(requests(spark, sf))


@query(
    "a9_run_metrics",
    duck_with("jobs") + """SELECT job_id, found, new_records, updated_records, failed_records, start_time, end_time, duration_s,
      round(found / nullif(duration_s, 0), 6) AS rate_per_s,
      printf('%02d:%02d:%02d', CAST(floor(duration_s / 3600) AS BIGINT), CAST(floor(floor(duration_s) % 3600 / 60) AS BIGINT), CAST(floor(duration_s) % 60 AS BIGINT)) AS elapsed
    FROM (SELECT job_id, count(*) AS found, count(*) FILTER (outcome = 'new') AS new_records, count(*) FILTER (outcome = 'updated') AS updated_records,
      count(*) FILTER (outcome = 'failed') AS failed_records, min(ts) AS start_time, max(ts) AS end_time,
      round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 3) AS duration_s FROM jobs GROUP BY job_id) x""",
)
def a9(spark, sf):
    return reports.run_metrics(view(spark, sf, "jobs"))


@query(
    "a10_endpoint_health",
    REQ + """SELECT req_key, count(*) FILTER (ok) AS success_count, count(*) FILTER (NOT ok) AS fail_count, max(ts) AS last_used,
      round(avg(response_s), 4) AS response_time_avg, count(*) FILTER (NOT ok) >= 3 AS banned FROM requests GROUP BY req_key""",
)
def a10(spark, sf):
    return reports.endpoint_health(requests(spark, sf))


@query(
    "a11_campaign_funnel",
    duck_with("campaign_events") + """SELECT campaign_id, sent AS emails_sent, opened AS emails_opened, replied AS emails_replied,
      round(1.0 * opened / nullif(sent, 0), 4) AS open_rate, round(1.0 * replied / nullif(sent, 0), 4) AS reply_rate
    FROM (SELECT campaign_id, count(*) FILTER (action = 'sent') AS sent, count(*) FILTER (action = 'opened') AS opened,
      count(*) FILTER (action = 'replied') AS replied FROM campaign_events GROUP BY campaign_id) x""",
)
def a11(spark, sf):
    return reports.campaign_funnel(view(spark, sf, "campaign_events"))


# -- streams ---------------------------------------------------------------------

_STREAM_COLS = ["_id", "seq", "name", "phone", "category"]
_STREAM_SCHEMA = T.StructType(
    [T.StructField(c, T.LongType() if c == "seq" else T.StringType()) for c in _STREAM_COLS]
)


def _record_log(spark, sf, twice: bool = False) -> str:
    """The business records as a folder of log files to stream."""
    path = work_path(spark, "stream-log")
    rows = records.with_record_id(view(spark, sf, "biz").select("seq", "name", "phone", "address", "category"))
    rows = rows.select(*_STREAM_COLS)
    rows.write.mode("append").json(path)
    if twice:
        rows.write.mode("append").json(path)
    return path


def _drained(run) -> None:
    run.awaitTermination()
    if run.exception():
        raise run.exception()


def _saved(spark, sf, kind: str):
    stream = jobs.log_stream(spark, _record_log(spark, sf), _STREAM_SCHEMA)
    out = work_path(spark, "live")
    _drained(jobs.save_live(stream, out, out + "-progress", available_now=True))
    schema = _STREAM_SCHEMA
    if kind == "csv":
        return spark.read.schema(schema).option("header", "true").csv(f"{out}/csv").drop("batch")
    if kind == "json":
        return spark.read.schema(schema).json(f"{out}/json").drop("batch")
    return spark.read.schema(schema).parquet(f"{out}/{kind}").drop("batch")


_STREAM_SQL = BIZ + f"SELECT {d_record_id()} AS _id, seq, name, phone, category FROM biz"


@query("t1_t3_stream_to_table", _STREAM_SQL)
def t1(spark, sf):
    return _saved(spark, sf, "table")


@query("t3_stream_to_csv", _STREAM_SQL)
def t3_csv(spark, sf):
    return _saved(spark, sf, "csv")


@query("t3_stream_to_json", _STREAM_SQL)
def t3_json(spark, sf):
    return _saved(spark, sf, "json")


@query("t4_every_tenth", BIZ + "SELECT seq, name FROM (SELECT *, row_number() OVER (ORDER BY seq) AS arrival FROM biz) x WHERE arrival % 10 = 1")
def t4(spark, sf):
    return _saved(spark, sf, "sample").select("seq", "name")


@query("t5_stream_dedup", BIZ + f"SELECT DISTINCT {d_record_id()} AS _id, name, phone FROM biz")
def t5(spark, sf):
    stream = jobs.log_stream(spark, _record_log(spark, sf, twice=True), _STREAM_SCHEMA, files_per_batch=2)
    out = work_path(spark, "distinct")
    _drained(jobs.save_results(jobs.distinct_records(stream), out, out + "-progress", available_now=True))
    return spark.read.parquet(out).select("_id", "name", "phone")


@query("t6_resume", _STREAM_SQL)
def t6(spark, sf):
    """The log is read in two runs of one checkpoint; the second sees only what is new."""
    path, out = work_path(spark, "stream-log"), work_path(spark, "live")
    rows = records.with_record_id(view(spark, sf, "biz").select("seq", "name", "phone", "address", "category")).select(*_STREAM_COLS)
    for part in (rows.filter("seq % 2 = 0"), rows.filter("seq % 2 = 1")):
        part.write.mode("append").json(path)
        stream = jobs.log_stream(spark, path, _STREAM_SCHEMA)
        _drained(jobs.save_live(stream, out, out + "-progress", formats=("table",), sample=False, available_now=True))
    return spark.read.schema(_STREAM_SCHEMA).parquet(f"{out}/table").drop("batch")


@query("t7_running_counters", BIZ + "SELECT 'all' AS scope, count(*) AS received, count(*) AS saved FROM biz")
def t7(spark, sf):
    stream = jobs.log_stream(spark, _record_log(spark, sf), _STREAM_SCHEMA, files_per_batch=1)
    out, live = work_path(spark, "counters"), work_path(spark, "live")
    _drained(jobs.save_results(jobs.running_counters(stream), out, out + "-progress", "update", available_now=True))
    _drained(jobs.save_live(stream, live, live + "-progress", formats=("table",), sample=False, available_now=True))
    saved = F.lit(jobs.saved_count(spark, live)).alias("saved")
    return jobs.latest(spark.read.parquet(out), ["scope"]).select("scope", "received", saved)


@query("t7_live_counts", BIZ + "SELECT count(*) AS received, count(*) AS saved FROM biz")
def t7_live(spark, sf):
    """Counted as the records pass, by Spark's progress reports; over two runs."""
    path, live = _record_log(spark, sf), work_path(spark, "live")
    for _ in range(2):
        counts = jobs.LiveCounts(spark, live)
        spark.streams.addListener(counts)
        try:
            run = jobs.save_live(jobs.counted(jobs.log_stream(spark, path, _STREAM_SCHEMA, files_per_batch=1)), live, live + "-progress", formats=("table",), sample=False, available_now=True)
            _drained(run)
            received = counts.settle(run)
        finally:
            spark.streams.removeListener(counts)
    saved = spark.read.schema(_STREAM_SCHEMA).parquet(f"{live}/table").agg(F.count("*").alias("saved"))
    return saved.select(F.lit(received).cast("long").alias("received"), "saved")


@query("t2_timed_flush", _STREAM_SQL)
def t2(spark, sf):
    """The stream runs on its own five-second trigger until it has caught up."""
    stream = jobs.log_stream(spark, _record_log(spark, sf), _STREAM_SCHEMA, files_per_batch=4)
    out = work_path(spark, "live")
    run = jobs.save_live(stream, out, out + "-progress", formats=("table",))
    try:
        run.processAllAvailable()
    finally:
        run.stop()
    return spark.read.schema(_STREAM_SCHEMA).parquet(f"{out}/table").drop("batch")


def _request_stream(spark, sf):
    """The event table as a request stream; its one file arrives in one batch."""
    schema = table(spark, sf, "events").schema
    raw = jobs.request_stream(spark, f"{sf}/events*.parquet", schema)
    return raw.select(F.col("ts"), F.col("user_id").alias("req_key"), (F.col("event_type") != "error").alias("ok"))


def _ntz(df, *cols):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in cols})


@query(
    "t8_opened_counters",
    REQ.replace("WITH ", "WITH RECURSIVE ", 1) + f""", opens AS (SELECT req_key, min(ts) AS opened FROM requests GROUP BY req_key
      UNION ALL SELECT o.req_key, (SELECT min(r.ts) FROM requests r WHERE r.req_key = o.req_key AND r.ts >= o.opened + INTERVAL {_HOURS_12} SECOND) AS opened
      FROM opens o WHERE o.opened IS NOT NULL)
    SELECT o.req_key, o.opened, count(*) AS requests, greatest(count(*) - 2, 0) AS over_limit FROM opens o JOIN requests r
      ON r.req_key = o.req_key AND r.ts >= o.opened AND r.ts < o.opened + INTERVAL {_HOURS_12} SECOND GROUP BY o.req_key, o.opened""",
)
def t8_opened(spark, sf):
    out = work_path(spark, "opened")
    counters = jobs.opened_counters(_request_stream(spark, sf), window_s=_HOURS_12, limit=2)
    _drained(jobs.save_results(counters, out, out + "-progress", "update", available_now=True))
    return _ntz(jobs.latest(spark.read.parquet(out), ["req_key", "opened"]), "opened")


_CLOSED = "(SELECT max(ts) - INTERVAL 10 MINUTE FROM requests)"
# the failure filter is pushed below the watermark, so failures alone move it
_CLOSED_FAILURES = "(SELECT max(ts) - INTERVAL 10 MINUTE FROM requests WHERE NOT ok)"


@query(
    "t9_failure_session_stream",
    _SESSIONS.format(gap="12 HOUR") + f"""SELECT req_key, first_failure, last_failure + INTERVAL 12 HOUR AS expires, failures FROM sessions
    WHERE last_failure + INTERVAL 12 HOUR <= {_CLOSED_FAILURES}""",
)
def t9_stream(spark, sf):
    """Counters already expired at the watermark, ten minutes before the latest failure."""
    out = work_path(spark, "sessions")
    sessions = jobs.failure_session_stream(_request_stream(spark, sf), "12 hours")
    _drained(jobs.save_results(sessions, out, out + "-progress", available_now=True))
    return _ntz(spark.read.parquet(out).drop("batch"), "first_failure", "expires")


@query(
    "t11_sliding_rate",
    REQ + f"""SELECT req_key, w AS window_start, w + INTERVAL 2 HOUR AS window_end, count(*) AS requests
    FROM (SELECT req_key, unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS w FROM requests) x
    WHERE w + INTERVAL 2 HOUR <= {_CLOSED} GROUP BY req_key, w""",
)
def t11(spark, sf):
    """Windows closed at the watermark, ten minutes before the latest request."""
    out = work_path(spark, "sliding")
    counts = jobs.sliding_rate(_request_stream(spark, sf), "2 hours", "1 hour")
    _drained(jobs.save_results(counts, out, out + "-progress", available_now=True))
    return _ntz(spark.read.parquet(out).drop("batch"), "window_start", "window_end")


# -- vectors ---------------------------------------------------------------------

_COSINE = "list_cosine_similarity(x.v, y.v)"


def _pairs_sql(eps: float) -> str:
    return f"""WITH d AS (SELECT embedding::DOUBLE[] AS v, min(vec_id) AS rep FROM embeddings GROUP BY embedding)
    SELECT x.rep AS a, y.rep AS b, round({_COSINE}, 6) AS cosine FROM d x JOIN d y ON x.rep < y.rep WHERE {_COSINE} >= {1 - eps}"""


@query("c2_feature_text", BIZ + "SELECT seq, name || ' ' || category || ' ' || coalesce(description, '') AS feature_text FROM biz")
def c2(spark, sf):
    return businesses(spark, sf).select("seq", cluster.feature_text("name", "category", "description").alias("feature_text"))


@query("c3_neighbour_pairs", _pairs_sql(0.3))
def c3(spark, sf):
    return cluster.neighbour_pairs(table(spark, sf, "embeddings"))


# The vectors and a shifted copy of each, which is its neighbour
_SHIFTED = """WITH shifted AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings UNION ALL
  SELECT vec_id + 100000000, list_transform(embedding, lambda x, i: x::DOUBLE + ((vec_id + i) % 3 - 1) * 0.03125) FROM embeddings)"""


@query(
    "c3_neighbours_of_copies",
    _SHIFTED + """SELECT x.vec_id AS a, y.vec_id AS b FROM shifted x JOIN shifted y ON x.vec_id < y.vec_id
    WHERE list_cosine_similarity(x.v, y.v) >= 0.7""",
)
def c3_copies(spark, sf):
    vectors = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    shift = F.transform("embedding", lambda x, i: x + ((F.col("vec_id") + i + 1) % 3 - 1) * F.lit(0.03125))
    both = vectors.unionByName(vectors.select((F.col("vec_id") + 100_000_000).alias("vec_id"), shift.alias("embedding")))
    return cluster.neighbour_pairs(both).select("a", "b")


@query("c3_neighbour_pairs_wide", _pairs_sql(0.6))
def c3_wide(spark, sf):
    return cluster.neighbour_pairs(table(spark, sf, "embeddings"), eps=0.6)


def _clusters_sql(eps: float) -> str:
    return f"""WITH RECURSIVE e AS (SELECT x.vec_id AS a, y.vec_id AS b FROM embeddings x JOIN embeddings y ON x.vec_id <> y.vec_id
      WHERE list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) >= {1 - eps}),
    reach AS (SELECT DISTINCT a AS node, a AS other FROM e UNION SELECT r.node, e.b FROM reach r JOIN e ON e.a = r.other)
    SELECT v.vec_id, coalesce(min(r.other), -1) AS cluster FROM embeddings v LEFT JOIN reach r ON r.node = v.vec_id GROUP BY v.vec_id"""


@query("c1_clusters", _clusters_sql(0.3))
def c1(spark, sf):
    return cluster.cluster(table(spark, sf, "embeddings"))


@query("c1_clusters_wide", _clusters_sql(0.6))
def c1_wide(spark, sf):
    return cluster.cluster(table(spark, sf, "embeddings"), eps=0.6)
