"""Periodic runs, SimHash and centroids against brute force, and on odd rows."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from listloom.llm import centroids, queries, runs, simhash
from listloom.llm.text import AS_IS, NOT_SPACE, Words
from tests.llm.test_documents import ODD, docs_of, lowered

SPACE = r"[^\x20\x09-\x0D]+"


# -- 11 periodic runs --------------------------------------------------------------


def brute_runs(words, least=12):
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = q
        while i < n:
            s = i - q
            while i < n and words[i] == words[i - q]:
                i += 1
            if i - s >= max(least, 2 * q):
                found.setdefault((s, i), q)
            i += 1
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def collapsed(words, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def shapes(rnd):
    """Word lists with few words, nested repetitions, Fibonacci and Thue-Morse words, neighbours of one short period."""
    kind, k = rnd.randrange(6), rnd.choice([1, 2, 3, 30])
    if kind == 0:
        return [rnd.randrange(k) for _ in range(rnd.randrange(130))]
    if kind == 1:
        block = [rnd.randrange(k) for _ in range(rnd.randrange(1, 30))]
        return ([rnd.randrange(k) for _ in range(rnd.randrange(9))] + block * rnd.randrange(1, 7) + [rnd.randrange(k)] * 3) * rnd.randrange(1, 4)
    if kind == 2:
        a, b = [0], [0, 1]
        while len(b) < 150:
            a, b = b, b + a
        return b
    if kind == 3:
        t = [0]
        for _ in range(rnd.randrange(3, 8)):
            t = t + [1 - x for x in t]
        return t
    if kind == 4:
        return list(range(rnd.randrange(40)))
    block = [0, 1] * rnd.randrange(2, 12) + [0] * rnd.randrange(2)
    return [x for _ in range(rnd.randrange(1, 6)) for x in block[rnd.randrange(3) : len(block) - rnd.randrange(3)] + [rnd.randrange(3)] * rnd.randrange(2)]


@pytest.mark.parametrize("least", [2, 7, 12, 40])
def test_runs_equal_brute_force(least):
    rnd = random.Random(least)
    number = 0
    for _ in range(250):
        texts = [[f"w{x}" for x in shapes(rnd)] for _ in range(4)]
        words = Words(pa.array([" ".join(t) for t in texts]), NOT_SPACE, AS_IS)
        got = runs.runs_of(words.hashes, words.first, least).tolist()
        want = [[s + f, s + n + f, q] for f, t in zip(words.first.tolist(), texts) for s, n, q in brute_runs(t, least)]
        assert got == sorted(want, key=lambda r: (r[0], r[2]))
        number += len(want)
    assert number > 300


def test_runs_of_long_periodic_texts_take_no_square():
    """Texts whose words all occur everywhere: one lag a word and level is looked at, not all."""
    for text, expected in (([1] * 200_000, 1), (([1] * 9_999 + [2]) * 20, 21), (list(range(40_000)) * 5, 1)):
        words = np.array([hash((7, x)) & (2**62 - 1) for x in text], dtype=np.uint64)
        assert len(runs.runs_of(words, np.array([0, len(words)]))) == expected


def test_runs_in_a_table(spark):
    rnd = random.Random(4)
    rows = [(i, rnd.choice([" ", "\n", " \t"]).join(f"W{x}" for x in shapes(rnd))) for i in range(120)] + ODD
    got = runs.find_runs(docs_of(spark, rows).withColumn("runs", F.lit("old")).withColumn("extra", F.lit(1))).collect()
    assert len(got) == len(rows) and got[0].__fields__ == ["doc_id", "text", "extra", "n_words", "runs", "collapsed"]
    for r in got:
        words = re.findall(SPACE, r.text or "")
        want = brute_runs(words) if len(words) < 5000 else [(0, len(words), 1)]
        assert (r.n_words, [tuple(x) for x in r.runs], r.collapsed, r.extra) == (len(words), want, collapsed(words, want), 1)
    assert runs.find_runs(docs_of(spark, [])).collect() == []


def test_planted_texts(spark):
    rows = [(i, " ".join(f"v{j}" for j in range(i % 97))) for i in range(300)] + ODD
    for r, (i, t) in zip(queries.planted(docs_of(spark, rows)).collect(), rows):
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        words = re.findall(SPACE, t or "")
        if h % 10 == 0 and words:
            n, g = len(words), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            t = " ".join(words[i] if i < a else words[a + (i - a) % p] for i in range(n))
        assert (r.doc_id, r.text) == (i, t)


# -- 12 SimHash --------------------------------------------------------------------


def brute_fingerprint(text, k=3):
    w = re.findall(SPACE, lowered(text))
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]), 42) for i in range(max(1, len(w) - k + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fingerprints, distance):
    ids = sorted(fingerprints)
    root = {d: d for d in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (fingerprints[a] ^ fingerprints[b]).bit_count() <= distance:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}


def test_fingerprints_equal_brute_force(monkeypatch, spark):
    rnd = random.Random(2)
    texts = [None, "", " \n", "One", "a B", "é ß c", *(" ".join(rnd.choice(["Aa", "bb", "ÄÖ", "x"]) + rnd.choice(["", "\n", " \x0b"]) for _ in range(rnd.randrange(40))) for _ in range(200))]
    for shingles in (1 << 16, 3):
        monkeypatch.setattr(simhash, "_SHINGLES", shingles)
        assert [simhash.fingerprint(t) for t in texts] == [brute_fingerprint(t) for t in texts]
    # Spark's own xxhash64 is the same hash
    assert spark.range(1).select(F.xxhash64(F.lit("one two three"))).first()[0] % 2**64 == xxhash.xxh64_intdigest("one two three", 42)


@pytest.mark.parametrize("distance", range(8))
def test_close_fingerprints_share_a_list(distance):
    rnd = random.Random(distance)
    places = simhash.posted(distance)
    for _ in range(3000):
        changed = {rnd.randrange(64) // 8 for _ in range(distance)}
        assert any(not changed & set(p) for p in places)


def crowd(rnd):
    """Fingerprints: random ones, copies, chains of near ones, a crowd around one."""
    out = [rnd.getrandbits(64) for _ in range(150)]
    out += out[:20]
    x = rnd.getrandbits(64)
    for _ in range(30):
        x ^= sum(1 << b for b in rnd.sample(range(64), 3))
        out.append(x)
    base = rnd.getrandbits(64)
    for _ in range(150):
        y = base
        for b in rnd.sample(range(64), rnd.randrange(9)):
            y ^= 1 << b
        out.append(y)
    return out


@pytest.mark.parametrize(("distance", "cell"), [(0, 8), (3, 4096), (3, 8), (5, 8)])
def test_components_equal_brute_force(spark, monkeypatch, distance, cell):
    monkeypatch.setattr(simhash, "CELL", cell)
    monkeypatch.setattr(simhash, "_PAIRS", 50)
    prints = crowd(random.Random(distance))
    frame = spark.createDataFrame([(i, x - (1 << 64) if x >> 63 else x) for i, x in enumerate(prints)], "doc_id long, fp long")
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, k, seed: frame)
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs_of(spark, []), distance=distance).collect()}
    assert got == brute_components(dict(enumerate(prints)), distance)


def test_simhash_of_odd_rows(spark):
    rows = ODD + [(40, "one"), (9, "p q r s t"), (9, "one"), (8, "p q r s t")] + [(1000 + i, "copy of a text that stands here often") for i in range(150)]
    got = collections.defaultdict(set)
    found = simhash.near_duplicates(docs_of(spark, rows).withColumn("fp", F.lit(1))).collect()
    assert len(found) == len(rows)
    for r in found:
        got[r.doc_id].add((r.fp % 2**64, r.component_id))
    assert got[None] == {(brute_fingerprint(ODD[0][1]), None)}
    assert all(got[i] == {(0, 1)} for i in (1, 2, 3))
    # both texts of 9 hold their classes together
    one = brute_fingerprint("one")
    assert got[4] == got[40] == {(one, 4)} and {c for _, c in got[9]} == {4} and {c for _, c in got[8]} == {4}
    assert {c for i in range(1000, 1150) for _, c in got[i]} == {1000}
    assert simhash.near_duplicates(docs_of(spark, [])).collect() == []
    with pytest.raises(ValueError):
        simhash.posted(8)


def test_op12_equals_brute_force(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    prints = {d: brute_fingerprint(t) for d, t in docs.items()}
    root = brute_components(prints, 3)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op12(spark, sf_dir).collect()}
    assert got == {d: (f"{prints[d]:016x}", root[d]) for d in docs}


# -- 13 centroids ------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<double>"


def brute_clusters(rows, k, rounds, dims, scale=64, seed=1):
    kept = [(i, [int(np.floor(scale * x)) if abs(x) < 1e300 else int(x) * scale for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted((i is None, hashlib.sha256(f"{seed}:{i}".encode()).hexdigest() if i is not None else "", v) for i, v in kept)
    middles = [v for _, _, v in order[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(middles)) for _, v in kept]

    for _ in range(rounds):
        groups = collections.defaultdict(list)
        for (_, v), (_, c) in zip(kept, assign()):
            groups[c].append(v)
        middles = [[sum(x) // len(groups[c]) for x in zip(*groups[c])] if c in groups else m for c, m in enumerate(middles)]
    return sorted(((i, c, d) for (i, _), (d, c) in zip(kept, assign())), key=repr), middles


@pytest.mark.parametrize(("spread", "dims", "k"), [(1.0, 8, 16), (0.02, 8, 5), (30.0, 3, 16), (1.0, 1, 4)])
def test_clusters_equal_brute_force(spark, spread, dims, k):
    rnd = random.Random(dims)
    rows = [(i, [rnd.gauss(rnd.choice([-1, 0, 2]), spread) for _ in range(dims)]) for i in range(500)]
    rows += rows[:30] + [(1000 + i, rows[i % 3][1]) for i in range(50)]
    got, middles = centroids.cluster(spark.createDataFrame(rows, VECTORS).withColumn("cluster", F.lit("x")), k=k, dims=dims)
    want, want_middles = brute_clusters(rows, k, 3, dims)
    assert middles.tolist() == want_middles
    assert sorted(map(tuple, got.collect()), key=repr) == want


def test_search_computes_few_distances():
    rnd = np.random.default_rng(3)
    middles = rnd.integers(-400, 400, (64, 16))
    x = middles[rnd.integers(0, 64, 5000)] + rnd.integers(-5, 6, (5000, 16))
    best, least, computed = centroids.nearest(x, middles)
    far = ((x[:, None] - middles) ** 2).sum(axis=2)
    assert (best == far.argmin(axis=1)).all() and (least == far.min(axis=1)).all()
    assert computed < 0.15 * far.size


def test_ties_go_to_the_smaller_number():
    middles = np.array([[5, 5], [1, 3], [3, 1], [5, 5], [1, 3]])
    best, least, _ = centroids.nearest(np.array([[2, 2], [5, 5], [1, 3], [3, 4]]), middles)
    assert best.tolist() == [1, 0, 1, 0] and least.tolist() == [2, 0, 0, 5]


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(None, [1.0, 2.0]), (1, None), (2, [1.0]), (3, [1.0, None]), (4, [nan, 1.0]), (5, [-inf, 0.0]), (6, [-0.5, 0.0]), (6, [-0.5, 0.0]), (7, [0.0, 0.0, 0.0]), (8, [])]
    frame = spark.createDataFrame(rows, VECTORS)
    got, middles = centroids.cluster(frame, dims=2)
    want, want_middles = brute_clusters(rows, 16, 3, 2)
    assert len(want) == 3 and sorted(map(tuple, got.collect()), key=repr) == want and middles.tolist() == want_middles
    total = centroids.with_inertia(got).collect()
    assert {r.inertia for r in total} == {sum(d for _, _, d in want)}
    none, middles = centroids.cluster(frame.filter("vec_id = 1"), dims=2)
    assert none.collect() == [] and len(middles) == 0 and none.columns == ["vec_id", "cluster", "distance"]


def test_huge_components(spark):
    rows = [(i, [float(i % 3) * 1e30, float(i)]) for i in range(40)] + [(50, [1e306, 0.0]), (51, [-1e307, 0.0])]
    got, middles = centroids.cluster(spark.createDataFrame(rows, VECTORS), k=4, dims=2)
    want, want_middles = brute_clusters(rows, 4, 3, 2)
    assert middles.tolist() == want_middles
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(((i, c, d if d < 2**63 else None) for i, c, d in want), key=repr)
