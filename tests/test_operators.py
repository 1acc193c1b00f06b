"""Operators against brute force, on data where one key holds a large share of the rows."""

import datetime as dt
import math
import os
import random
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from listloom.functions.similarity import ratio_of
from listloom.operators import balls, cluster, competitors, components, dedup, ordering, rate, ratio_join, reports, similar, store, taxonomy
from listloom.operators.emails import distinct_emails, ranked_emails
from listloom.plans.views import businesses
from tests.conftest import values

# -- dedup -----------------------------------------------------------------------

RECORD = (
    "seq bigint, name string, place_id string, phone_numbers array<string>, address string, website string,"
    " coordinates struct<lat:double,lng:double>, emails array<string>, amenities array<string>, social_media map<string,string>,"
    " rating double, description string, price_range string"
)


def records(n=400, seed=1):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        hot = rnd.random() < 0.35
        out.append(
            (
                i * 3, f"Shop {i}", "HOT" if hot else f"P{rnd.randrange(60)}",
                rnd.choice([None, [], [f"212555{rnd.randrange(40):04d}"]]), rnd.choice([None, "", "1 Main"]),
                rnd.choice([None, "", "http://a.com", "http://b.com", "http://c.com"]), None,
                rnd.choice([None, [f"e{rnd.randrange(30)}@x.com" for _ in range(rnd.randrange(4))]]),
                rnd.choice([None, [], [f"a{rnd.randrange(15)}" for _ in range(3)]]),
                rnd.choice([None, {}, {"facebook": f"f{i}"}, {"yelp": f"y{i}", "facebook": f"g{i}"}]),
                rnd.choice([None, 0.0, 3.5, 4.25]), rnd.choice([None, "", "short", "longer text", "other text!"]), rnd.choice([None, "$", "$$"]),
            )
        )
    return out


def merge_by_hand(group):
    cols = [c.strip().split(" ")[0] for c in RECORD.replace("struct<lat:double,lng:double>", "struct").replace("map<string,string>", "map").split(",")]
    rows = [dict(zip(cols, r)) for r in group]
    first = dict(rows[0])
    if len(rows) == 1:
        return first
    for f in ("phone_numbers", "emails", "amenities"):
        seen = list(dict.fromkeys(v for r in rows for v in (r[f] or [])))
        first[f] = seen[:10]
    social = {}
    for r in rows:
        social.update(r["social_media"] or {})
    first["social_media"] = social
    ratings = [r["rating"] for r in rows if r["rating"]]
    texts = [r["description"] for r in rows if r["description"]]
    first["rating"] = max(ratings) if ratings else first["rating"]
    first["description"] = max(texts, key=len) if texts else first["description"]
    for f in ("website", "price_range"):
        got = [r[f] for r in rows if r[f]]
        first[f] = Counter(got).most_common(1)[0][0] if got else first[f]
    return first


def test_remove_duplicates_by_hand(spark):
    rows = records()
    df = spark.createDataFrame(rows, RECORD)
    groups = defaultdict(list)
    for r in rows:
        groups["place_id:" + r[2]].append(r)
    got = {r.dedup_key: r.asDict() for r in dedup.remove_duplicates(df.repartition(7)).collect()}
    assert set(got) == set(groups)
    for key, group in groups.items():
        want = merge_by_hand(group)
        assert got[key].pop("copies") == len(group)
        assert got[key].pop("dedup_key") == key
        got[key].pop("coordinates")
        want.pop("coordinates")
        assert got[key] == want


def test_dedup_is_idempotent(spark):
    df = spark.createDataFrame(records(150, 2), RECORD)
    once = dedup.remove_duplicates(df).drop("dedup_key", "copies")
    twice = dedup.remove_duplicates(once).drop("dedup_key", "copies")
    assert sorted(map(repr, once.collect())) == sorted(map(repr, twice.collect()))


def test_dedup_report_on_empty(spark):
    empty = dedup.with_dedup_key(spark.createDataFrame([], RECORD))
    assert tuple(dedup.dedup_report(empty).first()) == (0, 0, 0)


# -- ordering and request logs ---------------------------------------------------


def test_serial_numbers_cross_buckets(spark):
    ids = random.Random(3).sample(range(-500, 5000), 800)
    df = spark.createDataFrame([(i,) for i in ids], "seq bigint").repartition(5)
    got = {r.seq: r.s_no for r in ordering.with_serial(df, span=37).collect()}
    assert got == {s: i + 1 for i, s in enumerate(sorted(ids))}


def burst_log(n=1500, seed=4):
    rnd = random.Random(seed)
    start = dt.datetime(2024, 1, 1)
    rows, at = [], 0.0
    for i in range(n):
        at += rnd.choice([0, 0.5, 1, 3, 40, 90 if i % 50 == 0 else 2])
        key = "hot" if rnd.random() < 0.6 else f"k{rnd.randrange(20)}"
        rows.append((i, key, start + dt.timedelta(seconds=at), rnd.random() > 0.4, rnd.randrange(1, 500) / 100))
    return rows


LOG = "seq bigint, req_key string, ts timestamp_ntz, ok boolean, response_s double"


@pytest.fixture(scope="module")
def log(spark):
    rows = burst_log()
    per_key = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[2], r[0])):
        per_key[r[1]].append(r)
    return spark.createDataFrame(rows, LOG).repartition(6), per_key


def test_trailing_requests(log):
    df, per_key = log
    got = {r.seq: r for r in rate.trailing_requests(df, limit=20, window_s=60, bucket_s=90).collect()}
    assert len(got) == 1500
    for rows in per_key.values():
        for r in rows:
            frame = [x[2] for x in rows if r[2] - dt.timedelta(seconds=60) <= x[2] <= r[2]]
            wait = (min(frame) - r[2]).total_seconds() + 60 if len(frame) > 20 else 0.0
            assert (got[r[0]].in_window, got[r[0]].over_limit) == (len(frame), len(frame) > 20)
            assert got[r[0]].wait_s == pytest.approx(wait)


def test_response_trend(log):
    df, per_key = log
    got = {r.seq: r for r in rate.response_trend(df, target_s=2.0, bucket_s=60, chunk=53).collect()}
    assert len(got) == 1500
    for rows in per_key.values():
        for i, r in enumerate(rows):
            frame = [x[4] for x in rows[max(0, i - 49) : i + 1]]
            mean = sum(frame) / len(frame)
            assert got[r[0]].samples == len(frame)
            assert got[r[0]].mean_s == pytest.approx(mean)
            assert got[r[0]].delay_factor == pytest.approx(mean / 2 if len(frame) > 5 and mean > 2 else 1.0)
            assert got[r[0]].verdict == ("few" if len(frame) <= 10 else "slow" if mean > 3 else "fast" if mean < 1.4 else "ok")


def test_failure_runs_and_delay(log):
    df, per_key = log
    got = {r.seq: r for r in rate.suggested_delay(rate.failure_runs(df, bucket_s=7)).collect()}
    assert len(got) == 1500
    for rows in per_key.values():
        run = 0
        for r in rows:
            run = 0 if r[3] else run + 1
            assert got[r[0]].failures == run
            assert got[r[0]].delay_s == max(1, min(min(2**run, 10), 5))


@pytest.mark.parametrize("chunk", [2, 7, 1024])
def test_rate_trace(log, chunk, monkeypatch):
    df, per_key = log
    rate_most = rate._most_per_key
    monkeypatch.setattr(rate, "_most_per_key", lambda log: 1500 if chunk < 1024 else rate_most(log))
    got = {r.seq: r.rate for r in rate.rate_trace(df, bucket_s=30, chunk=chunk).collect()}
    assert len(got) == 1500
    for rows in per_key.values():
        now = 30.0
        for r in rows:
            now = min(now * 1.05, 30.0) if r[3] else max(now * 0.9, 5.0)
            assert got[r[0]] == pytest.approx(now, abs=1e-6)


@pytest.mark.parametrize("bucket", [20, 86_400])
def test_failure_sessions(log, bucket):
    df, per_key = log
    got = sorted((r.req_key, r.first_failure, r.last_failure, r.failures) for r in rate.failure_sessions(df, gap_s=30, bucket_s=bucket).collect())
    want = []
    for key, rows in per_key.items():
        for t in [r[2] for r in rows if not r[3]]:
            if want and want[-1][0] == key and t - want[-1][2] < dt.timedelta(seconds=30):
                want[-1] = (key, want[-1][1], t, want[-1][3] + 1)
            else:
                want.append((key, t, t, 1))
    assert got == sorted(want)


# -- competitors -----------------------------------------------------------------


def haversine(a, b):
    la1, ln1, la2, ln2 = map(math.radians, (*a, *b))
    h = math.sin((la2 - la1) / 2) ** 2 + math.cos(la1) * math.cos(la2) * math.sin((ln2 - ln1) / 2) ** 2
    return 2 * 6371000.0 * math.asin(math.sqrt(min(1.0, h)))


def test_competitors_by_brute_force(spark):
    rnd = random.Random(5)
    points = []
    for i in range(500):
        kind = i % 5
        if kind < 2:
            at = (48.2, 16.37)  # one address for two fifths of all
        elif kind == 2:
            at = (48.2 + rnd.gauss(0, 0.0004), 16.37 + rnd.gauss(0, 0.0004))
        elif kind == 3:
            at = (48.2 + rnd.gauss(0, 0.03), 16.37 + rnd.gauss(0, 0.03))
        else:
            at = (rnd.uniform(-89, 89), rnd.choice([179.999, -179.999, 0.001]))
        points.append((i, f"n{i}", None, rnd.choice("ab"), (round(at[0], 6), round(at[1], 6))))
    points.append((900, "zero", None, "a", (0.0, 1.0)))
    df = spark.createDataFrame(points, "seq bigint, name string, rating double, category string, coordinates struct<lat:double,lng:double>")
    got = defaultdict(list)
    for r in competitors.find_competitors(df, radius_m=3000.0, k=4, levels=8).orderBy("seq", "rank").collect():
        got[r.seq].append((r.rank, r.competitor_seq, r.distance_m))
    for p in points:
        near = sorted((round(haversine(p[4], q[4]), 2), q[0]) for q in points if q[0] != p[0] and q[3] == p[3] and q[4][0] != 0)
        near = [x for x in near if x[0] <= 3000.0][:4] if p[4][0] != 0 else []
        assert [(r, c) for r, c, _ in got[p[0]]] == [(i + 1, s) for i, (_, s) in enumerate(near)], p
        assert [d for _, _, d in got[p[0]]] == pytest.approx([d for d, _ in near], abs=0.011)


# -- fuzzy duplicates ------------------------------------------------------------


def fuzzy_records(seed=6):
    rnd = random.Random(seed)
    long = "Long Street " * 12
    out = []
    for i in range(260):
        name = rnd.choice(["Joe's Bar", "Joes Bar", "JOE'S BAR!", "Anna Cafe", "Ana Café", "Zed"])
        address = rnd.choice(["1 Main St.", "1 Main St", "12 High Rd", "", None, long + str(i % 3), long + "x" + str(i % 2)])
        phone = rnd.choice(["2125550100", "+1 212 555 0100", "2125550100", f"20255501{i % 50:02d}", "123", None, ""])
        out.append((i, name, address, phone, rnd.choice(["bar", "Bar", "cafe", None])))
    return out


def score_by_hand(x, y):
    def clean(t):
        return " ".join("".join(c for c in (t or "") if c.isalnum() or c == "_" or c.isspace()).split())

    def phone(t):
        d = "".join(c for c in (t or "") if c.isdigit())
        d = d[1:] if len(d) == 11 and d[0] == "1" else d
        return d if len(d) >= 10 else None

    s = 0.4 * (ratio_of((x[1] or "").lower(), (y[1] or "").lower()) or 0)
    s += 0.3 * (ratio_of(clean(x[2]), clean(y[2])) or 0)
    p, q = phone(x[3]), phone(y[3])
    s += 20 if p and p == q else 0
    return round(s + 0.1 * (ratio_of((x[4] or "").lower(), (y[4] or "").lower()) or 0), 4)


@pytest.fixture(scope="module")
def fuzzy(spark):
    rows = fuzzy_records()
    df = spark.createDataFrame(rows, "seq bigint, name string, address string, primary_phone string, category string")
    want = {(x[0], y[0]): score_by_hand(x, y) for i, x in enumerate(rows) for y in rows[i + 1 :]}
    return df, {k: v for k, v in want.items() if v >= 80}


@pytest.mark.parametrize("small", [2, 1000])
def test_similar_pairs_by_brute_force(fuzzy, small, monkeypatch):
    monkeypatch.setattr(similar, "CELL_PART", 9)
    df, want = fuzzy
    links = similar.similar_links(df, small_block=small)
    rows = similar.expand_links(links).collect()
    assert len(rows) == len({(r.a, r.b) for r in rows})
    assert {(r.a, r.b): r.score for r in rows} == pytest.approx(want)
    assert links.count() < len(want)


def loose_records(n, seed=8):
    """Names and addresses of a few words with typing errors; each field may be missing."""
    rnd = random.Random(seed)
    words = "joe anna bar cafe zed garden house grill royal star kiosk pizza noodle north old river".split()
    streets = ["Main", "High", "Oak", "River", "Station", "Church"]

    def typo(t):
        t = list(t or "")
        for _ in range(rnd.choice([0, 0, 1, 2, 4])):
            if t:
                k = rnd.randrange(len(t))
                t[k : k + 1] = rnd.choice([[], ["x"], [t[k], " "]])
        return "".join(t)

    out = []
    for i in range(n):
        if out and rnd.random() < 0.35:
            o = rnd.choice(out)
            out.append((i, typo(o[1]), typo(o[2]), rnd.choice([o[3], None, f"20255{i:05d}"]), rnd.choice([o[4], "bar"])))
        else:
            name = rnd.choice([None, "", *[" ".join(rnd.choice(words).title() for _ in range(rnd.randrange(1, 5)))] * 9])
            address = rnd.choice([None, f"{rnd.randrange(99)} {rnd.choice(streets)} St., {rnd.choice(streets)} city", "Long Road " * 11 + rnd.choice(streets)])
            out.append((i, name, address, rnd.choice([None, f"20255{rnd.randrange(90):05d}"]), rnd.choice(["bar", "cafe", "Restaurant", None])))
    return out + [(n + i, "Same Name Here", "1 Same St", f"2125550{i:03d}" if i else None, "bar") for i in range(12)]


def reweighted(x, y):
    parts = [(0.4, (x[1] or "").lower(), (y[1] or "").lower()), (0.1, (x[4] or "").lower(), (y[4] or "").lower())]
    clean = [" ".join("".join(c for c in (r[2] or "") if c.isalnum() or c == "_" or c.isspace()).split()) for r in (x, y)]
    weight = sum(w for w, a, b in [*parts, (0.3, *clean)] if a and b) + (0.2 if x[3] and y[3] else 0)
    return round(score_by_hand(x, y) / weight, 4) if weight else 0.0


@pytest.mark.parametrize(("threshold", "normalize", "small", "cell"), [(75, False, 64, 2000), (60, False, 3, 7), (70, False, 0, 2000), (85, True, 64, 2000), (65, True, 3, 50)])
def test_similar_pairs_at_any_threshold(spark, monkeypatch, threshold, normalize, small, cell):
    by = similar.similar_by
    monkeypatch.setattr(similar, "similar_by", lambda *a, **k: by(*a, **k, small=small, cell=cell))
    rows = loose_records(160)
    df = spark.createDataFrame(rows, "seq bigint, name string, address string, primary_phone string, category string")
    rate = reweighted if normalize else score_by_hand
    want = {(x[0], y[0]): rate(x, y) for i, x in enumerate(rows) for y in rows[i + 1 :]}
    got = similar.expand_links(similar.similar_links(df, threshold, normalize=normalize)).collect()
    assert len(got) == len({(r.a, r.b) for r in got})
    assert {(r.a, r.b): r.score for r in got} == pytest.approx({k: v for k, v in want.items() if v >= threshold})


@pytest.mark.parametrize(("threshold", "normalize", "cell"), [(60, False, 7), (75, False, 2000), (85, True, 30)])
def test_all_pairs_give_the_same_as_the_keys(spark, monkeypatch, threshold, normalize, cell):
    pairs = ratio_join.all_pairs
    monkeypatch.setattr(similar, "all_pairs", lambda *a, **k: pairs(*a, **k, cell=cell))
    monkeypatch.setattr(ratio_join, "_RATED", 500)
    rows = loose_records(90)
    df = spark.createDataFrame(rows, "seq bigint, name string, address string, primary_phone string, category string")
    got = {}
    for met in (0, 10**9):
        monkeypatch.setattr(similar, "meetings", lambda *_: met)
        links = similar.expand_links(similar.similar_links(df, threshold, normalize=normalize)).collect()
        got[met] = sorted((r.a, r.b, r.score) for r in links)
    assert got[0] == got[10**9] and len(got[0]) > 20


def test_records_that_all_resemble_each_other_meet_once(spark, monkeypatch):
    """Numbered names share most of their keys: comparing every pair once is less work than meeting under each of them."""
    rows = [(i, f"Supplier#{i * 7919 % 10**9:09d} ASIA", f"{i % 40} Main St.", None, "asia") for i in range(300)]
    df = spark.createDataFrame(rows, "seq bigint, name string, address string, primary_phone string, category string")
    monkeypatch.setattr(similar, "similar_by", lambda *_, **__: pytest.fail("by keys"))
    got = similar.similar_links(df, 65.0)
    assert got.count() == sum(score_by_hand(x, y) >= 65 for i, x in enumerate(rows) for y in rows[i + 1 :])


def test_texts_with_a_ratio_meet_under_one_first_key():
    rnd = random.Random(2)
    texts = {"".join(rnd.choice("aabcdeé ") for _ in range(rnd.randrange(1, 30))) for _ in range(160)}
    texts |= {t[:k] + t[k + 1 :] for t in list(texts) for k in [rnd.randrange(len(t))] if len(t) > 1}
    texts = sorted(texts)
    ranks = {ch: [rnd.randrange(10**6) for _ in range(ratio_join.OCCURRENCES)] for t in texts for ch in t}
    for least in (45, 60, 72, 86, 93, 100):
        keys = {t: ratio_join.meeting_keys(t, least, ranks) for t in texts}
        met = 0
        for x in texts:
            for y in texts:
                if (len(x), x) < (len(y), y) and ratio_of(x, y) >= least:
                    met += 1
                    left, right = ({k[0]: k for k in keys[t] if k[3] == role} for t, role in ((x, 0), (y, 1)))
                    common = set(left) & set(right)
                    first = [k for k in common if len({t for t in left[k][4] if t <= left[k][2]} & {t for t in right[k][4] if t <= left[k][2]}) == left[k][1]]
                    assert len(first) == 1, (x, y, least)
        assert met or least == 100


def test_pairs_are_listed_without_writing_or_shuffling_them(spark, monkeypatch):
    """Only the members of profiles are written; the pairs, which grow with the square, meet them where they are made."""
    n = 120
    pairs = [(a, b, 90.0, "pair") for a in range(n) for b in range(a + 1, n) if (a + b) % 3]
    members = [(a, a + 1000 * k, 100.0, "same_profile") for a in range(0, n, 40) for k in (1, 2)]
    texts = [(200, 201, 80.0, "same_text"), (200, 202, 80.0, "same_text"), (202, 1202, 100.0, "same_profile")]
    links = spark.createDataFrame(pairs + members + texts, "a bigint, b bigint, score double, kind string").repartition(4)
    written, write = [], similar.cut
    monkeypatch.setattr(similar, "cut", lambda df, *a: written.append(write(df, *a)) or written[-1])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10000")
    try:
        listed = similar.expand_links(links)
        plan = listed._jdf.queryExecution().executedPlan().toString()
        got = sorted(map(tuple, listed.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" not in plan and max(d.count() for d in written) < 20
    of = {a: [a, a + 1000, a + 2000] for a in range(0, n, 40)} | {202: [202, 1202]}
    every = [*pairs, (200, 201, 80.0, ""), (200, 202, 80.0, ""), (201, 202, 80.0, "")]
    want = [(min(x, y), max(x, y), s) for a, b, s, _ in every for x in of.get(a, [a]) for y in of.get(b, [b])]
    want += [(x, y, 100.0) for group in of.values() for x in group for y in group if x < y]
    assert got == sorted(want)


def test_few_of_all_pairs_are_looked_at(spark):
    """Keys of the prefixes: what meets grows far below the square of the records."""
    def met(n):
        rnd = random.Random(1)
        names = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(20)) for _ in range(n)]
        p = spark.createDataFrame([(i, t) for i, t in enumerate(names)], "rep bigint, n_name string").withColumn("lists", F.array(F.lit(0)))
        rows = ratio_join._met(p, "n_name", 86, 2000, 64)
        return rows.groupBy("key").agg((F.count_if(F.col("role") == 0) * F.count_if(F.col("role") == 1)).alias("n")).agg(F.sum("n")).first()[0] or 0

    few, many = met(500), met(2000)
    assert many < 0.2 * 2000 * 2000 / 2 and many < 16 * max(few, 1000)


def union_find(pairs):
    root = {}

    def find(n):
        while root.setdefault(n, n) != n:
            n = root[n]
        return n

    for a, b in pairs:
        ra, rb = find(a), find(b)
        root[max(ra, rb)] = min(ra, rb)
    return {n: find(n) for n in list(root)}


def test_duplicate_groups(fuzzy):
    df, want = fuzzy
    got = {r.seq: r.group_id for r in similar.duplicate_groups(df).collect()}
    assert got == union_find(want)


def test_components(spark):
    rnd = random.Random(7)
    pairs = [(i, i + 1) for i in range(1000, 1150)] + [(5000, 5000 + i) for i in range(1, 200)]
    pairs += [(rnd.randrange(300), rnd.randrange(300)) for _ in range(140)]
    got = components.connected_components(spark.createDataFrame(pairs, "a bigint, b bigint"))
    assert {r.node: r.component for r in got.collect()} == union_find([p for p in pairs if p[0] != p[1]])


def test_tasks_of_a_merge_grow_with_the_records(spark, monkeypatch):
    """Each step before and after a shuffle takes a bounded number of records; a hot key is combined in slots and portions."""
    rows = [(i, i % 3 and i, [f"e{i}@x", f"e{i % 7}@x"], {"a": f"u{i}"}, i % 11 / 2, "d" * (i % 13), f"w{i % 5}") for i in range(600)]
    keyed = spark.createDataFrame(rows, "seq bigint, dedup_key string, emails array<string>, social_media map<string,string>, rating double, description string, website string")
    keyed = keyed.withColumns({"phone_numbers": F.lit(None).cast("array<string>"), "amenities": F.lit(None).cast("array<string>"), "price_range": F.lit(None).cast("string")})
    monkeypatch.setattr(dedup, "TASK_RECORDS", 20)
    merged = dedup.merged_fields(keyed)
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate(keys=[dedup_key" in plan and plan.count(", 30), REPARTITION_BY_NUM") >= 4 and "ENSURE_REQUIREMENTS" not in plan
    hot = merged.filter("dedup_key = 0").first()
    mine = [r for r in rows if not r[1]]
    want = list(dict.fromkeys(e for r in mine for e in r[2]))[:10]
    assert hot.emails == want and hot.copies == len(mine) and hot.social_media == {"a": "u597"} and hot.website == "w0"
    assert hot.rating == max(r[4] for r in mine) and hot.description == "d" * 12


# -- vectors ---------------------------------------------------------------------


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(8)
    centers = rng.normal(size=(12, 16))
    rows = []
    for i in range(500):
        if i % 3 == 0:
            v = centers[0] + rng.normal(size=16) * 0.05  # a dense group with a third of all
        elif i % 3 == 1:
            v = centers[rng.integers(12)] + rng.normal(size=16) * 0.6
        else:
            v = rng.normal(size=16)
        rows.append((i * 2, [float(x) for x in v]))
    rows += [(2001 + i, rows[5][1]) for i in range(30)] + [(3001, rows[7][1])]
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), [r[0] for r in rows], x @ x.T


@pytest.mark.parametrize("part", [40, 10_000])
def test_neighbour_pairs(vectors, part):
    df, ids, sim = vectors
    got = {(r.a, r.b) for r in cluster.neighbour_pairs(df, part=part).collect()}
    reps = [k for k, i in enumerate(ids) if i < 2000]
    want = {(ids[i], ids[j]) for n, i in enumerate(reps) for j in reps[n + 1 :] if sim[i, j] >= 0.7}
    assert got == want


@pytest.mark.parametrize("part", [40, 10_000])
def test_clusters(vectors, part):
    df, ids, sim = vectors
    pairs = [(ids[i], ids[j]) for i, j in zip(*np.nonzero(sim >= 0.7 - 1e-12)) if i < j]
    want = union_find(pairs)
    got = {r.vec_id: r.cluster for r in cluster.cluster(df, part=part).collect()}
    assert got == {i: want.get(i, -1) for i in ids}


def test_vectors_are_sent_to_cells_a_few_rows_at_a_time():
    """However many balls and parts there are, a task holds a bounded number of the rows it makes."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 8))
    pivots = balls.unit(pd.Series(list(x[:200])))
    every = range(200)
    found = cluster._Balls(SimpleNamespace(value=pivots), {b: 100 for b in every}, {b: 2.0 for b in every}, {b: b for b in every})
    send = cluster._sender(found, 0.3, 50, {(0, 1), (3, 3)})
    sizes = []
    for sent in send([pd.DataFrame({"rep": range(3000), "v": list(x), "mark": range(3000)})]):
        sizes.append(len(sent))
        assert not ((sent.ca == 0) & (sent.cb == 1) | (sent.ca == 3) & (sent.cb == 3)).any()
    assert max(sizes) <= cluster.SENT and sum(sizes) > 1_000_000


@pytest.mark.parametrize("held", [1, 2000])
def test_neighbours_do_not_depend_on_the_strips(vectors, monkeypatch, held):
    monkeypatch.setattr(cluster, "HELD", held)
    monkeypatch.setattr(cluster, "GIVEN", 100)
    test_neighbour_pairs(vectors, 200)
    test_clusters(vectors, 200)


@pytest.fixture(scope="module")
def shared_ids(spark):
    """Vectors of which many have one id, and a third none; and the pairs of unequal ids within 0.3."""
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(8, 12))
    x = np.array([centers[i % 8] + rng.normal(size=12) * 0.5 for i in range(400)])
    ids = [None if i % 3 == 0 else i % 5 if i % 3 == 1 else i for i in range(400)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], "vec_id bigint, embedding array<double>")
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = [(ids[i], ids[j]) for i, j in zip(*np.nonzero(np.triu(x @ x.T >= 0.7, 1)))]
    return df, ids, sorted((min(p), max(p)) for p in near if None not in p and p[0] != p[1])


@pytest.mark.parametrize("part", [40, 10_000])
def test_neighbour_pairs_of_shared_and_missing_ids(shared_ids, part):
    df, _, want = shared_ids
    assert values(cluster.neighbour_pairs(df, part=part), "a", "b") == sorted(want, key=repr)


@pytest.mark.parametrize("part", [40, 10_000])
def test_clusters_of_shared_and_missing_ids(shared_ids, part):
    df, ids, pairs = shared_ids
    want = union_find(pairs)
    assert {r.vec_id: r.cluster for r in cluster.cluster(df, part=part).collect()} == {i: want.get(i, -1) for i in ids}


@pytest.mark.parametrize("tree", [False, True])
def test_cells_are_bounded_whatever_the_ids(spark, monkeypatch, tree):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(7, v.tolist()) for v in rng.normal(size=(800, 8))], "vec_id bigint, embedding array<double>")
    d = cluster.distinct_vectors(df)
    monkeypatch.setattr(cluster, "MAX_PIVOTS", 1)
    if tree:
        cells = balls.cells(*balls.leaves(d, 0.3, 40, close=2.0), 40)
    else:
        cells = cluster._cells(d, cluster._balls(d, 40), 0.3, 40, set())
    assert cells.groupBy("ca", "cb", "ia", "ib").count().agg(F.max("count")).first()[0] < 4 * 40


@pytest.mark.parametrize(("tile", "read", "settled"), [(1, 1, 1 << 14), (1 << 15, 3, 7)])
def test_vectors_are_written_once_however_many_blocks_meet(spark, monkeypatch, tile, read, settled):
    """What is written grows with the vectors: no shuffle sends them to where they are compared."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(800, 8))
    # cosines that single precision does not tell from the bound
    x[1::4] = x[0::4] + rng.normal(size=(200, 8)) * 0.1
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for k in range(2, 800, 4):
        off = x[k + 1] - (x[k + 1] @ x[k]) * x[k]
        x[k + 1] = (0.4 + rng.choice([-1e-9, 1e-9])) * x[k] + np.sqrt(0.84) * off / np.linalg.norm(off)
        x[k + 1] /= np.linalg.norm(x[k + 1])
    df = spark.createDataFrame([(f"v{i:03d}", v.tolist()) for i, v in enumerate(x)], "vec_id string, embedding array<double>")
    monkeypatch.setattr(cluster, "TILE_BYTES", tile)
    monkeypatch.setattr(cluster, "READ", read)
    monkeypatch.setattr(cluster, "SETTLED", settled)
    paths, fresh = [], cluster.work_path
    monkeypatch.setattr(cluster, "work_path", lambda *a: paths.append(fresh(*a)) or paths[-1])
    pairs = cluster.neighbour_pairs(df, eps=0.6, part=40)
    assert "Exchange" not in pairs._jdf.queryExecution().executedPlan().toString()
    blocks = spark.read.parquet(*paths)
    assert blocks.count() == 800 and blocks.groupBy("ball", "part").count().agg(F.max("count")).first()[0] < 4 * 40
    want = {(f"v{i:03d}", f"v{j:03d}"): round(float(x[i] @ x[j]), 5) for i, j in zip(*np.nonzero(np.triu(x @ x.T >= 0.4, 1)))}
    got = pairs.collect()
    assert len(got) == len(want) > 1000 and {(r.a, r.b): round(r.cosine, 5) for r in got}.keys() == want.keys()
    assert all(abs(r.cosine - want[r.a, r.b]) < 2e-5 for r in got)


def test_cluster_of_nothing(spark):
    empty = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert cluster.cluster(empty).count() == 0


# -- store, taxonomy, e-mail -----------------------------------------------------


def test_upsert_with_itself_changes_nothing(spark, sf_dir):
    b = businesses(spark, sf_dir).select(F.col("seq").alias("id"), "name", "rating", "address")
    for up in (store.upsert_overwrite, store.upsert_fill):
        same = up(b, b, as_of="2024-01-01 00:00:00").drop("updated_at", "last_scraped")
        assert same.exceptAll(b).count() == 0 and same.count() == b.count()
    assert store.change_log(b, b).count() == 0


def test_upsert_modes_differ_on_null(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id int, name string, kept string")
    new = spark.createDataFrame([(1, None, 5), (3, "c", 6)], "id int, name string, unknown int")
    over = sorted(map(tuple, store.upsert_overwrite(old, new, as_of="2024-01-01").select("id", "name", "kept").collect()))
    fill = sorted(map(tuple, store.upsert_fill(old, new, as_of="2024-01-01").select("id", "name", "kept").collect()))
    assert over == [(1, None, "x"), (2, "b", "y"), (3, "c", None)]
    assert fill == [(1, "a", "x"), (2, "b", "y"), (3, "c", None)]


def test_category_paths_of_any_depth(spark):
    n = 130
    rows = [(i, i - 1 if i else None, f"c{i}") for i in range(n)] + [(900, 901, "x"), (901, 900, "y"), (902, 901, "z")]
    tree = spark.createDataFrame(rows, "id int, parent_id int, name string")
    got = {r.id: r for r in taxonomy.category_paths(tree).collect()}
    assert sorted(got) == list(range(n))
    assert got[n - 1].level == n - 1 and got[n - 1].path == "/".join(f"c{i}" for i in range(n))
    assert sorted(r.id for r in taxonomy.unrooted(tree).collect()) == [900, 901, 902]


def test_similar_links_do_not_depend_on_block_size(spark):
    def links(pairs, small):
        schema = "seq bigint, name string, address string, category string, primary_phone string"
        rows = [(i + 1, *x, "2125550100") for i, x in enumerate(pairs)]
        return values(similar.similar_links(spark.createDataFrame(rows, schema), small_block=small), "a", "b", "score")

    triple = [("abcdefghij", "abc", "c" * 25), ("abcdefghijkl", "abcdefghij", "c" * 26)]
    assert links(triple, 64) == links(triple, 1) == [(1, 2, 80.0)]


def test_newest_map_value_with_long_seq(spark):
    big = 2**53
    rows = [(s, "k", {"fb": v}) for s, v in ((big, "old"), (big + 1, "new"))]
    df = spark.createDataFrame(rows, "seq bigint, dedup_key string, social_media map<string,string>")
    df = df.withColumns({c: F.array().cast("array<string>") for c in dedup.LIST_FIELDS})
    got = dedup.merged_fields(df.withColumns({"rating": F.lit(None).cast("double"), "description": F.lit(None).cast("string")}))
    assert got.first().social_media == {"fb": "new"}


def test_rating_distribution_of_any_rating(spark):
    rows = [(1, 4.5), (1, 4.5), (1, 0.0), (1, None), (2, 7.0)]
    got = values(reports.rating_distribution(spark.createDataFrame(rows, "business_id int, rating double")), "business_id", "reviews_count", "rating_distribution")
    assert got == [(1, 4, {0.0: 1, 4.5: 2}), (2, 1, {7.0: 1})]


def test_buckets_narrow_with_the_busiest_key(spark):
    hot = [(i, 1, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=i)) for i in range(3000)]
    rows = hot + [(5000 + i, 2 + i % 50, dt.datetime(2024, 1, 1 + i % 20)) for i in range(6000)]
    log = spark.createDataFrame(rows, "seq bigint, req_key bigint, ts timestamp")
    assert [rate.bucket_seconds(log, n) for n in (5000, 400, 10)] == [86_400, 300, 60]


def test_sparse_numbers_do_not_make_a_bucket_each(spark):
    rows = [(i * 10**12 + 3,) for i in range(2000)]
    df = spark.createDataFrame(rows, "seq bigint")
    got = ordering.with_serial(df, span=1000, most=100)
    assert sorted(values(got, "seq", "s_no")) == [(r[0], i + 1) for i, r in enumerate(rows)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "1.0E15" in plan  # the span was widened


def test_null_keys_stay_in_rate_analytics(spark):
    rows = [(i, k, dt.datetime(2024, 1, 1 + i % 3, 0, i), i % 4 != 0, 1.0) for i, k in enumerate([None, 5, None, None, 5, None])]
    log = spark.createDataFrame(rows, "seq bigint, req_key bigint, ts timestamp, ok boolean, response_s double")
    for got in (rate.response_trend(log), rate.failure_runs(log), rate.rate_trace(log, chunk=2)):
        assert sorted((r.seq, r.req_key) for r in got.collect()) == [(r[0], r[1]) for r in rows]


def test_unknown_outcomes_count_neither_way(spark):
    at = dt.datetime(2024, 1, 1)
    oks = [False, None, False, True, None, False, None]
    log = spark.createDataFrame([(i, 1, at + dt.timedelta(seconds=i), ok, 1.0) for i, ok in enumerate(oks)], "seq bigint, req_key bigint, ts timestamp, ok boolean, response_s double")
    assert [r.failures for r in rate.failure_runs(log).orderBy("seq").collect()] == [1, 1, 2, 0, 0, 1, 1]
    for chunk in (2, 1024):
        got = [r.rate for r in rate.rate_trace(log, chunk=chunk).orderBy("seq").collect()]
        assert got == [27.0, 27.0, 24.3, 25.515, 25.515, 22.9635, 22.9635]
    assert [r.failures for r in rate.failure_sessions(log).collect()] == [3]
    assert "Python" not in rate.rate_trace(log)._jdf.queryExecution().executedPlan().toString()


def test_vectors_without_a_direction_are_noise(spark):
    rows = [(1, [0.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, 0.0]), (5, [1.0, 0.01]), (6, [float("nan"), 1.0])]
    got = values(cluster.cluster(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")), "vec_id", "cluster")
    assert got == [(1, -1), (2, -1), (3, -1), (4, 4), (5, 4), (6, -1)]


def test_category_paths_depth_cycle_orphan(spark):
    rows = [(i, i - 1 if i else None, f"n{i}") for i in range(20)] + [(100, 101, "c1"), (101, 100, "c2"), (200, 999, "o"), (300, 300, "self")]
    got = {r.id: r for r in taxonomy.category_paths(spark.createDataFrame(rows, "id int, parent_id int, name string")).collect()}
    assert set(got) == set(range(20))
    assert got[19].level == 19 and got[19].path == "/".join(f"n{i}" for i in range(20))


def test_email_ranking(spark):
    hits = spark.createDataFrame(
        [("s", 1, 0, "A@gmail.com", "text_pattern", None), ("s", 1, 1, "a@GMAIL.com", "mailto_link", None), ("s", 2, 0, "CONTACT_FORM_FOUND", "contact_form", None)]
        + [("s", 3, i, f"u{i}@x.com", "mailto_link", None) for i in range(15)],
        "site string, page_id int, pos int, address string, source string, context string",
    )
    d = distinct_emails(hits)
    assert d.count() == 16
    ranked = ranked_emails(d).orderBy("rank").collect()
    assert [r.address for r in ranked] == [f"u{i}@x.com" for i in range(10)]


# -- stores and keywords ---------------------------------------------------------


def test_keywords_by_list_and_table(spark):
    rnd = random.Random(3)
    letters = "abcé X\n"
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randrange(12))) for _ in range(400)] + [None, "", "😀 smile", "ab"]
    df = spark.createDataFrame(list(enumerate(texts)), "seq int, text string")
    for size in (0, 1, 20, 70, 3000):
        words = ["".join(rnd.choice(letters) for _ in range(rnd.randrange(3, 9))) for _ in range(size)] + ([None, "😀 S"] if size else [])
        want = [i for i, t in enumerate(texts) if not any(w.lower() in (t or "").lower() for w in words if w is not None)]
        table = spark.createDataFrame([(w,) for w in words], "w string")
        for keywords in (words, table):
            assert [r.seq for r in sorted(store.without_keywords(df, "text", keywords).select("seq").collect())] == want
    assert store.without_keywords(df, "text", spark.createDataFrame([("",)], "w string")).count() == 0
    assert store.without_keywords(df, "text", [""]).count() == 0


def test_texts_do_not_meet_all_keywords_of_a_beginning(spark):
    """Keywords that begin alike: the rows joined grow with the texts, not with texts times keywords."""
    df = spark.createDataFrame([(i, f"x no. {i}0") for i in range(3000)] + [(9999, "y" * 700 + "no. 77" + "😀" * 300 + "no. 5")], "seq int, text string")
    words = spark.range(2000).select(F.concat(F.lit("NO. "), F.col("id") * 10 + 5).alias("w")).union(spark.createDataFrame([("no. 77" + "😀" * 290 + "",)], "w string"))
    got = store.without_keywords(df, "text", words)
    want = [i for i in range(3000) if not any(f"{i}0"[:k].endswith("5") for k in range(1, 6))]
    assert sorted(r.seq for r in got.collect()) == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan and "Contains" not in plan and "contains(" not in plan


def test_many_keywords_are_joined(spark):
    df = spark.createDataFrame([(i, f"shop {i} of street {i % 7}") for i in range(2000)], "seq int, text string")
    words = spark.range(100_000).select(F.concat(F.lit("Shop "), F.col("id") * 3, F.lit(" ")).alias("w"))
    got = store.without_keywords(df, "text", words)
    assert sorted(r.seq for r in got.collect()) == [i for i in range(2000) if i % 3]


def _files(path):
    return {f"{d}/{f}": os.path.getmtime(f"{d}/{f}") for d, _, names in os.walk(path) for f in names if f.endswith(".parquet") and "/_" not in d}


def test_upsert_rewrites_only_its_buckets(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/store"
    old = spark.range(2000).select("id", F.concat(F.lit("n"), F.col("id").cast("string")).alias("name"), F.lit(1.5).alias("rating"), F.lit(None).cast("timestamp_ntz").alias("updated_at"))
    store.create_store(old, path, buckets=100)
    before = _files(path)
    batch = spark.createDataFrame([(5, None, "x"), (77, "new", "x"), (9001, "added", "x")], "id long, name string, unknown string")
    touched = store.upsert_store(batch, path, as_of="2024-01-31 00:00:00")
    after = _files(path)
    changed = {os.path.basename(os.path.dirname(f)) for f in set(before) ^ set(after)}
    assert len(touched) == 3 and changed == {f"{store.BUCKET}={b}" for b in touched}
    rows = {r.id: r for r in store.open_store(spark, path).collect()}
    assert len(rows) == 2001 and rows[5].name is None and rows[5].rating == 1.5 and rows[77].name == "new" and rows[9001].rating is None
    assert rows[6].updated_at is None and rows[9001].updated_at is not None
    assert store.upsert_store(batch.limit(0), path) == [] and _files(path) == after

    # cut off before and after everything is staged
    def stop(*_):
        raise RuntimeError("cut off")

    with monkeypatch.context() as m:
        m.setattr(store, "_finish", lambda spark, path, calls=[]: calls.append(1) if not calls else stop())
        with pytest.raises(RuntimeError):
            store.upsert_store(spark.createDataFrame([(6, "late")], "id long, name string"), path, as_of="2024-02-01 00:00:00")
    assert _files(path) == after
    assert {r.id: r.name for r in store.open_store(spark, path).collect()}[6] == "late"
    os.makedirs(f"{path}/_staged/{store.BUCKET}=0")
    assert store.open_store(spark, path).count() == 2001 and not os.path.exists(f"{path}/_staged")


def test_vectors_of_unequal_length_are_apart(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.01]), (3, [1.0, 0.0, 0.0]), (4, [2.0, 0.0, 0.01]), (5, [0.0, 1.0]), (6, None), (7, [0.0, 0.0]), (8, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted((r.a, r.b) for r in cluster.neighbour_pairs(df).collect()) == [(1, 2), (3, 4)]
    assert {r.vec_id: r.cluster for r in cluster.cluster(df).collect()} == {1: 1, 2: 1, 3: 3, 4: 3, 5: -1, 6: -1, 7: -1, 8: -1}
    assert cluster.neighbour_pairs(df.limit(0)).collect() == []


def clustered_vectors(n, seed=4, dims=6, centres=None, spread=0.08):
    rnd = random.Random(seed)
    middles = [[rnd.gauss(0, 1) for _ in range(dims)] for _ in range(centres or max(4, n // 60))]
    return [(i, [m + rnd.gauss(0, spread) for m in rnd.choice(middles)]) for i in range(n)]


def cosines(rows):
    import numpy as np

    x = np.array([v for _, v in rows])
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    return x @ x.T


@pytest.mark.parametrize(("eps", "part", "fan", "spread"), [(0.05, 20, 4, 0.2), (0.3, 30, 3, 0.5), (0.01, 25, 64, 0.01)])
def test_tree_of_balls_finds_all_neighbours(spark, monkeypatch, eps, part, fan, spread):
    import numpy as np

    monkeypatch.setattr(cluster, "MAX_PIVOTS", 0)
    build = balls.leaves
    monkeypatch.setattr(balls, "leaves", lambda *a, **k: build(*a, **k, fan=fan, task_rows=100))
    rows = clustered_vectors(420, spread=spread)
    rows += [(1000 + i, rows[i][1]) for i in range(15)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    near = cosines(rows[:420]) >= 1 - eps
    want = {(int(i), int(j)) for i, j in zip(*np.nonzero(near)) if i < j}
    got = [(r.a, r.b) for r in cluster.neighbour_pairs(df, eps=eps, part=part).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100
    groups = union_find(want | {(i, 1000 + i) for i in range(15)})
    assert {r.vec_id: r.cluster for r in cluster.cluster(df, eps=eps, part=part).collect()} == {i: groups.get(i, -1) for i, _ in rows}


def compared_pairs(cells):
    sides = cells.groupBy("ca", "cb", "ia", "ib").agg(F.count_if((F.col("ca") == F.col("cb")) & (F.col("side") == F.col("ia")) | (F.col("ca") != F.col("cb")) & (F.col("side") == 0)).alias("l"), F.count("*").alias("n"))
    return sides.agg(F.sum(F.when(F.col("l") == F.col("n"), F.col("n") * (F.col("n") - 1) / 2).otherwise(F.col("l") * (F.col("n") - F.col("l"))))).first()[0]


def test_tree_of_balls_compares_less_than_the_square(spark):
    found = {}
    for n in (1000, 4000):
        df = spark.createDataFrame(clustered_vectors(n, centres=n // 50, dims=8, spread=0.05), "rep long, v array<double>")
        found[n] = compared_pairs(balls.cells(*balls.leaves(df, 0.02, 100), 100))
    assert found[4000] < 0.1 * 4000 * 3999 / 2 and found[4000] < 8 * found[1000]
