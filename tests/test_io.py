"""Sources, sinks and streams: odd input, restarts, late rows."""

import datetime as dt
import json
import os
import random
import shutil

import pytest
from pyspark.sql import functions as F

from listloom.schema import RECORD, canonical
from listloom.session import shared_dir, small_side, work_path
from listloom.sources import records
from listloom.streaming import jobs


def line(**kw):
    return json.dumps(kw)


def write(folder, name, lines):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}", "w", encoding="utf-8") as f:
        f.write("\n".join(lines) + "\n")


def test_read_log_skips_blank_and_broken(spark, tmp_path):
    write(f"{tmp_path}/log", "a.jsonl", [line(seq=1, name="é"), "", "   ", "{broken", line(seq=2, name=None, extra=1), '{"seq": "text"}'])
    rows = records.read_log(spark, f"{tmp_path}/log").select("seq", "name").orderBy("seq").collect()
    assert [tuple(r) for r in rows] == [(1, "é"), (2, None)]
    bad = sorted(r.line for r in records.unreadable_lines(spark, f"{tmp_path}/log").collect())
    assert bad == ["{broken", '{"seq": "text"}'] or bad == ['{"seq": "text"}', "{broken"]


def test_lines_are_numbered_in_file_order(spark, tmp_path):
    """Several files in many blocks: the number follows the paths and the lines, and no task numbers them all."""
    for n, lines in enumerate((3000, 0, 1, 2500)):
        rows = [line(name=f"{n}-{i}", pad="p" * (i % 90)) if i % 11 else ("", " \t", "{broken")[i % 3] for i in range(lines)]
        write(f"{tmp_path}/log", f"f{n}.jsonl", rows)
    expected = [f"{n}-{i}" for n, lines in enumerate((3000, 0, 1, 2500)) for i in range(lines) if i % 11]
    read = "spark.sql.files.maxPartitionBytes"
    for size in ("10000", "777", "128m"):
        spark.conf.set(read, size)
        try:
            df = records.read_log(spark, f"{tmp_path}/log")
            rows = df.select("seq", "name").collect()
            assert size == "128m" or df.rdd.getNumPartitions() > 20
            kept = df.filter("name = '0-1000' or rest is null").select("seq", "name").collect()
        finally:
            spark.conf.unset(read)
        assert [r.name for r in sorted(rows)] == expected
        assert len({r.seq for r in rows}) == len(rows)
        assert [(r.seq, r.name) for r in kept] == [(r.seq, r.name) for r in rows if r.name == "0-1000"]
    # every line that is not blank has a number, the unreadable ones too
    numbers = [r.seq for r in rows] + [r.line_no for r in records.unreadable_lines(spark, f"{tmp_path}/log").collect()]
    assert sorted(numbers) == list(range(1, len(numbers) + 1))


def test_counts_of_many_blocks_are_not_broadcast(spark, tmp_path, monkeypatch):
    write(f"{tmp_path}/log", "a.jsonl", [line(name=str(i)) for i in range(50)])
    monkeypatch.setattr(records, "BLOCKS_BROADCAST", 0)
    rows = records.read_log(spark, f"{tmp_path}/log")
    assert [r.name for r in sorted(rows.select("seq", "name").collect())] == [str(i) for i in range(50)]


def test_unknown_keys_are_kept(spark, tmp_path):
    write(f"{tmp_path}/log", "a.jsonl", [
        line(name="a", place_id="p1", open={"mo": [1, 2], "x y": None}, Name="A", none=None),
        line(name="b", **{"x.y`'\"[0]": 1.5, "mixed": 1, "OBJECT<a": True}),
        line(name="c", mixed={"deep": "v"}, open=None), line(name="d"),
    ])
    df = records.read_log(spark, f"{tmp_path}/log")
    assert [r.none for r in df.select(F.col("rest").isNull().alias("none")).collect()] == [False, False, False, True]
    wide = records.widened(df)
    rows = {r.name: r.asDict(True) for r in wide.collect()}
    assert rows["a"]["place_id"] == "p1" and rows["a"]["open"]["mo"] == [1, 2] and rows["a"]["Name_2"] == "A" and rows["a"]["none"] is None
    assert float(rows["b"]["x.y`'\"[0]"]) == 1.5 and rows["b"]["OBJECT<a"] is True and rows["b"]["place_id"] is None
    assert rows["c"]["mixed"].toPython() == {"deep": "v"} and rows["b"]["mixed"].toPython() == 1
    assert set(rows["d"]) == set(wide.columns) and "rest" not in wide.columns
    records.write_json(df, f"{tmp_path}/json")
    back = [json.loads(r.value) for r in spark.read.text(f"{tmp_path}/json").collect()]
    assert {r["name"]: r["mixed"] for r in back} == {"a": None, "b": 1, "c": {"deep": "v"}, "d": None}
    paths = records.export_all(df, f"{tmp_path}/all")
    for kind in ("csv", "table"):
        got = spark.read.options(header="true", quote='"', escape='"').csv(paths["csv"]) if kind == "csv" else spark.read.parquet(paths["table"])
        assert {r.name: r.mixed or "" for r in got.collect()} == {"a": "", "b": "1", "c": '{"deep":"v"}', "d": ""}
    # a log without unknown keys has none to open
    write(f"{tmp_path}/plain", "a.jsonl", [line(name="a"), "null", "5", "[]"])
    assert records.widened(records.read_log(spark, f"{tmp_path}/plain")).columns == RECORD.names


def test_merge_checkpoints_newest_wins(spark, tmp_path):
    d = f"{tmp_path}/cp"
    write(d, "x_checkpoint_9.jsonl", [line(_id="a", seq=1, name="old"), line(_id="b", seq=2, name="b9")])
    write(d, "x_checkpoint_10.jsonl", [line(_id="a", seq=1, name="new"), "", line(_id="c", seq=3, name="first"), line(_id="c", seq=4, name="second")])
    write(d, "other.jsonl", [line(_id="z", seq=9, name="not a checkpoint")])
    write(d, "x_checkpoint_8.jsonl", [line(_id="e", name="1st", key=1), line(_id="e", name="2nd", key=2)])
    rows = records.merge_checkpoints(spark, d)
    got = {r._id: r.name for r in rows.collect()}
    assert got == {"a": "new", "b": "b9", "c": "second", "e": "2nd"}
    assert {r._id: r.key for r in records.widened(rows).collect()}["e"] == 2


def test_csv_round_trip_with_quotes_and_lines(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "hi", all', ["a,b", "c"]), (2, "two\nlines", None), (3, "", [])], "seq int, name string, tags array<string>")
    records.write_csv(df, f"{tmp_path}/csv")
    got = sorted(tuple(r) for r in records.read_csv(spark, f"{tmp_path}/csv", ["seq", "name", "tags"]).collect())
    assert got == [("1", 'say "hi", all', "a,b, c"), ("2", "two\nlines", ""), ("3", "", "")]


def test_export_all_rejects_unknown_format(spark, tmp_path):
    with pytest.raises(ValueError):
        records.export_all(spark.range(1), f"{tmp_path}/x", ["excel"])


def test_snapshot_is_not_overwritten(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/s")
    records.snapshot(spark, f"{tmp_path}/s", f"{tmp_path}/snap", "1")
    with pytest.raises(Exception, match="already exists"):
        records.snapshot(spark, f"{tmp_path}/s", f"{tmp_path}/snap", "1")


def test_store_filter_is_pushed_to_the_scan(spark, tmp_path):
    spark.range(10).withColumn("rating", F.col("id") / 2).withColumn("wide", F.lit("x")).write.parquet(f"{tmp_path}/s")
    plan = plan_of(records.read_store(spark, path=f"{tmp_path}/s", where="rating >= 4").select("id"))
    assert "GreaterThanOrEqual(rating,4.0)" in plan and "wide" not in plan.split("ReadSchema")[1]


def rows_scanned(df):
    df.collect()
    leaf = df._jdf.queryExecution().executedPlan().collectLeaves().head()
    return leaf.metrics().apply("numOutputRows").value()


def test_lookups_leave_out_row_groups(spark, tmp_path):
    n = 40_000
    rows = spark.range(n).select("id", F.md5(F.col("id").cast("string")).alias("name"), F.md5((F.col("id") % 5000 + 9).cast("string")).alias("zip"), F.lit("x").alias("other"))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    for table, lookups in (("plain_lookup", []), ("fast_lookup", ["name", "zip"])):
        spark.sql(f"DROP TABLE IF EXISTS {table}")
        records.write_table(rows, table, f"{tmp_path}/{table}", lookups=lookups, group_bytes=64 * 1024)
    one, some = rows.filter("id = 777").first(), lambda t, where: records.read_store(spark, path=f"{tmp_path}/{t}", where=where)
    for column, value, found in (("name", one.name, 1), ("zip", one.zip, 8), ("zip", "missing", 0)):
        where = f"{column} = '{value}'"
        assert some("fast_lookup", where).count() == some("plain_lookup", where).count() == found
        slow, fast = (rows_scanned(some(t, where)) for t in ("plain_lookup", "fast_lookup"))
        assert fast <= slow / (10 if column == "name" else 2), (column, slow, fast)
    for table in ("plain_lookup", "fast_lookup"):
        spark.sql(f"DROP TABLE {table}")
    with pytest.raises(ValueError):
        records.write_table(rows, "t", f"{tmp_path}/t", lookups=["nothing"])


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_canonical_fills_both_spellings(spark):
    df = spark.createDataFrame([("1", 5, 1700000000.5, "w")], "phone string, reviews int, scraped_at double, website string")
    r = canonical(df).first()
    assert (r.phone_numbers, r.primary_phone, r.reviews_count, r.primary_website) == (["1"], "1", 5, "w")
    assert r.scraped_at == dt.datetime(2023, 11, 14, 22, 13, 20, 500000)


def test_shared_dir_and_small_side(spark):
    assert work_path(spark, "a") != work_path(spark, "a")
    assert work_path(spark, "a").startswith(shared_dir(spark))
    assert "broadcast" in small_side(spark.range(5))._jdf.queryExecution().analyzed().toString()
    assert "broadcast" not in small_side(spark.range(10**9), 1000)._jdf.queryExecution().analyzed().toString()


# -- streams ---------------------------------------------------------------------


def drain(q):
    q.awaitTermination()
    assert q.exception() is None


def test_stream_sinks_keep_unknown_keys(spark, tmp_path):
    src, out, cp = (f"{tmp_path}/{n}" for n in ("src", "out", "cp"))
    write(src, "a.jsonl", [line(_id="1", seq=1, name="a", place_id="p1"), "", "{broken", line(_id="2", seq=2, name="b", extra=[1])])
    drain(jobs.save_live(jobs.log_stream(spark, src, files_per_batch=1), out, cp, available_now=True))
    write(src, "b.jsonl", [line(_id="3", seq=3, name="c", other=2.5)])
    drain(jobs.save_live(jobs.log_stream(spark, src, files_per_batch=1), out, cp, available_now=True))
    found = [json.loads(r.value) for r in spark.read.text(f"{out}/json/*").collect()]
    assert {r["_id"]: {k: v for k, v in r.items() if k in ("place_id", "extra", "other")} for r in found} == {"1": {"place_id": "p1"}, "2": {"extra": [1]}, "3": {"other": 2.5}}
    table = {r._id: r.rest and r.rest.toPython() for r in spark.read.parquet(f"{out}/table").collect()}
    assert table == {"1": {"place_id": "p1"}, "2": {"extra": [1]}, "3": {"other": 2.5}}
    csv = spark.read.options(header="true", quote='"', escape='"').csv(f"{out}/csv/batch=0")
    assert {r._id: (r.place_id, r.extra) for r in csv.collect()} == {"1": ("p1", None), "2": (None, "[1]")}


def test_live_counts_follow_the_sink_over_a_restart(spark, tmp_path):
    src, out, cp = (f"{tmp_path}/{n}" for n in ("src", "out", "cp"))
    for n in range(3):
        write(src, f"a{n}.jsonl", [record(100 * n + i) for i in range(10 + n)] + ["", "{broken"])

    def run():
        counts = jobs.LiveCounts(spark, out)
        before = counts.received
        spark.streams.addListener(counts)
        try:
            q = jobs.save_live(jobs.counted(jobs.log_stream(spark, src, files_per_batch=1)), out, cp, available_now=True)
            drain(q)
            counts.settle(q)
        finally:
            spark.streams.removeListener(counts)
        return before, counts.received

    assert run() == (0, 33)
    assert jobs.saved_count(spark, out) == 33
    write(src, "b.jsonl", [record(900 + i) for i in range(7)])
    assert run() == (33, 40)
    assert jobs.saved_count(spark, out) == spark.read.parquet(f"{out}/table").count() == 40
    # a batch that is repeated, its commit having been lost, counts once
    last = max(os.listdir(f"{cp}/commits"), key=lambda f: int(f) if f.isdigit() else -1)
    shutil.copytree(cp, f"{tmp_path}/cp2", ignore=lambda folder, names: [n for n in names if folder.endswith("commits") and n.strip(".").split(".")[0] == last])
    cp = f"{tmp_path}/cp2"
    assert run() == (40, 40) and jobs.saved_count(spark, out) == 40


def record(i):
    return line(_id=f"r{i % 40}", seq=i, name=f"n{i}", scraped_at=1.7e9 + i)


def test_stream_resumes_and_equals_batch(spark, tmp_path):
    src, out, cp = (f"{tmp_path}/{n}" for n in ("src", "out", "cp"))
    write(src, "x_checkpoint_10.jsonl", [record(i) for i in range(1, 31)] + ["", "{broken"])
    for step in range(2):
        stream = jobs.log_stream(spark, src, files_per_batch=1).filter("seq is not null")
        drain(jobs.save_live(stream, out, cp, available_now=True))
        if step == 0:
            write(src, "x_checkpoint_20.jsonl", [record(i) for i in range(31, 61)])
            write(src, "x_checkpoint_30.jsonl", [record(i) for i in range(61, 76)])
    stream = jobs.log_stream(spark, src).filter("seq is not null")
    drain(jobs.save_live(stream, out, cp, available_now=True))  # nothing new: nothing doubled
    for kind, reader in (("table", spark.read.parquet), ("json", spark.read.json)):
        assert sorted(r.seq for r in reader(f"{out}/{kind}").select("seq").collect()) == list(range(1, 76))
    csv = spark.read.option("header", "true").csv(f"{out}/csv")
    assert csv.count() == 75
    assert sorted(r.seq for r in spark.read.parquet(f"{out}/sample").collect()) == list(range(1, 76, 10))


def test_stream_dedup_remembers_across_restarts(spark, tmp_path):
    src, out, cp = (f"{tmp_path}/{n}" for n in ("src", "out", "cp"))
    for n, part in enumerate((range(0, 60), range(60, 120))):
        write(src, f"f{n}.jsonl", [record(i) for i in part])
        stream = jobs.distinct_records(jobs.log_stream(spark, src))
        drain(jobs.save_results(stream, out, cp, available_now=True))
    ids = [r._id for r in spark.read.parquet(out).collect()]
    assert sorted(ids) == sorted({f"r{i}" for i in range(40)})


def test_bounded_stream_dedup(spark, tmp_path):
    src, out, cp = (f"{tmp_path}/{n}" for n in ("src", "out", "cp"))
    write(src, "f.jsonl", [record(i) for i in range(80)])
    stream = jobs.log_stream(spark, src).withColumn("at", F.timestamp_seconds("scraped_at"))
    drain(jobs.save_results(jobs.distinct_records(stream, "1 hour", "at"), out, cp, available_now=True))
    assert spark.read.parquet(out).count() == 40


def test_late_rows_are_dropped(spark, tmp_path):
    src, out, cp = (f"{tmp_path}/{n}" for n in ("src", "out", "cp"))
    base = dt.datetime(2024, 1, 1)

    def put(n, minutes):
        rows = [(1, base + dt.timedelta(minutes=m)) for m in minutes]
        spark.createDataFrame(rows, "req_key bigint, ts timestamp").coalesce(1).write.mode("append").parquet(src)

    for n, minutes in enumerate(([0, 1, 30], [2, 31], [60])):
        put(n, minutes)
        stream = jobs.request_stream(spark, src, spark.createDataFrame([], "req_key bigint, ts timestamp").schema, "10 minutes")
        drain(jobs.save_results(jobs.sliding_rate(stream, "10 minutes", "10 minutes"), out, cp, available_now=True))
    got = {r.window_start: r.requests for r in spark.read.parquet(out).collect()}
    assert got[base] == 2  # the row of minute 2 came after the watermark had passed minute 10
    assert got[base + dt.timedelta(minutes=30)] == 2


def test_opened_counters_across_batches(spark, tmp_path):
    src, out, cp = (f"{tmp_path}/{n}" for n in ("src", "out", "cp"))
    base = dt.datetime(2024, 1, 1)
    schema = spark.createDataFrame([], "req_key bigint, ts timestamp").schema
    for seconds in ([0, 10, 59, 60, 61, 200], [210, 259, 261]):
        spark.createDataFrame([(7, base + dt.timedelta(seconds=s)) for s in seconds], schema).coalesce(1).write.mode("append").parquet(src)
        counters = jobs.opened_counters(jobs.request_stream(spark, src, schema), window_s=60, limit=2)
        drain(jobs.save_results(counters, out, cp, "update", available_now=True))
    rows = jobs.latest(spark.read.parquet(out), ["req_key", "opened"]).orderBy("opened").collect()
    assert [((r.opened - base).total_seconds(), r.requests, r.over_limit) for r in rows] == [(0, 3, 1), (60, 2, 0), (200, 3, 1), (261, 1, 0)]


def opened_by_hand(rows, width_us):
    """(key, opened, requests) of all counters, request by request."""
    out, last = [], {}
    for key, us in sorted(rows, key=lambda r: r[1]):
        if key not in last or us >= out[last[key]][1] + width_us:
            last[key] = len(out)
            out.append([key, us, 0])
        out[last[key]][2] += 1
    return sorted(map(tuple, out), key=repr)


@pytest.mark.parametrize("held, cell_s", [(10, 0.001), (500, 7.0), (100_000, 1.0)])
def test_opened_counters_of_a_busy_key(spark, tmp_path, held, cell_s):
    """Times that pass through the state store give what sorting them in memory gives; NULL is a key."""
    src, out, cp = (f"{tmp_path}/{n}" for n in ("src", "out", "cp"))
    schema = spark.createDataFrame([], "req_key bigint, ts timestamp").schema
    rnd, rows = random.Random(4), []
    for start in (0, 30):
        batch = [(rnd.choice([1, 1, 1, 1, 2, None]), start * 10**6 + rnd.randrange(30 * 10**6)) for _ in range(3000)] + [(3, start * 10**6 + 5)] * 40
        rows += batch
        df = spark.createDataFrame(batch, "req_key bigint, us bigint").select("req_key", F.timestamp_micros("us").alias("ts"))
        df.repartition(3).write.mode("append").parquet(src)
        counters = jobs.opened_counters(jobs.request_stream(spark, src, schema), window_s=2, limit=5, held=held, cell_s=cell_s)
        drain(jobs.save_results(counters, out, cp, "update", available_now=True))
    got = jobs.latest(spark.read.parquet(out), ["req_key", "opened"]).select("req_key", F.unix_micros("opened"), "requests", "over_limit").collect()
    assert sorted([tuple(r)[:3] for r in got], key=repr) == opened_by_hand(rows, 2 * 10**6)
    assert all(r.over_limit == max(0, r.requests - 5) for r in got)


def test_opened_counters_leave_the_state(spark, tmp_path):
    """A counter goes when the watermark passes its end; what passed through the store does not stay there."""
    src, out, cp = (f"{tmp_path}/{n}" for n in ("src", "out", "cp"))
    schema = spark.createDataFrame([], "req_key bigint, ts timestamp").schema
    base = dt.datetime(2024, 1, 1)
    for hour in range(3):
        rows = [(100 * hour + i % 3, base + dt.timedelta(hours=hour, milliseconds=i)) for i in range(600)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        counters = jobs.opened_counters(jobs.request_stream(spark, src, schema), window_s=60, held=50, cell_s=0.01)
        drain(jobs.save_results(counters, out, cp, "update", available_now=True))
    assert spark.read.parquet(out).agg(F.sum("requests")).first()[0] == 1800
    left = spark.read.format("statestore").option("path", cp).option("stateVarName", "counter").load()
    assert {r.k for r in left.select(F.col("key.name").alias("k")).collect()} <= {"=200", "=201", "=202"}
    waiting = spark.read.format("statestore").option("path", cp).option("stateVarName", "waiting").load()
    assert waiting.count() == 0


def test_broken_lines_leave_no_record(spark, tmp_path):
    src, out, cp = (f"{tmp_path}/{n}" for n in ("src", "out", "cp"))
    write(src, "f.jsonl", [record(1), "{broken", "", record(5), record(9)])
    drain(jobs.save_live(jobs.log_stream(spark, src), out, cp, available_now=True))
    assert sorted(r.seq for r in spark.read.parquet(f"{out}/table").collect()) == [1, 5, 9]
    assert jobs.saved_count(spark, out) == 3


def test_sample_counts_arrivals_over_batches(spark, tmp_path):
    src, out, cp = (f"{tmp_path}/{n}" for n in ("src", "out", "cp"))
    for n in range(3):
        write(src, f"f{n}.jsonl", [record(1000 * n + 7 * i) for i in range(1, 9)])
        drain(jobs.save_live(jobs.log_stream(spark, src), out, cp, available_now=True))
    arrived = [1000 * n + 7 * i for n in range(3) for i in range(1, 9)]
    assert sorted(r.seq for r in spark.read.parquet(f"{out}/sample").collect()) == arrived[::10]
    assert jobs.saved_count(spark, out) == 24


def test_running_counters(spark, tmp_path):
    src, out, cp = (f"{tmp_path}/{n}" for n in ("src", "out", "cp"))
    for n in range(3):
        write(src, f"f{n}.jsonl", [record(i) for i in range(n * 20, n * 20 + 20)])
    stream = jobs.log_stream(spark, src, RECORD, files_per_batch=1)
    drain(jobs.save_results(jobs.running_counters(stream), out, cp, "update", available_now=True))
    history = spark.read.parquet(out).orderBy("batch").collect()
    assert [r.received for r in history] == [20, 40, 60]
    assert jobs.latest(spark.read.parquet(out), ["scope"]).first().received == 60
