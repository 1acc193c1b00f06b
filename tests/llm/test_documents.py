"""Operators on documents against brute force, and on nulls, empty and long texts, ties, repeated rows and empty tables."""

import collections
import hashlib
import os
import random
import re
import subprocess
import sys
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from listloom.llm import decontaminate, neardup, packing, pretokens, queries, sharding, text, token_count, toxicity

DOCS = "doc_id long, text string"
ODD = [(None, "a b c d e f g"), (1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (5, "w " * 30_000), (6, "é ß ▁x <|endoftext|> 😀 don't"), (7, "x" * 70_000)]


def docs_of(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def lowered(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


# -- words -------------------------------------------------------------------------


@pytest.mark.parametrize("piece", [7, 64, 1 << 20])
def test_words_equal_the_pattern(monkeypatch, piece):
    monkeypatch.setattr(text, "_PIECE", piece)
    rnd = random.Random(1)
    texts = [None, "", "A b c", *("".join(rnd.choice("ab Z9é\n\t.-\x0b\x00<") for _ in range(rnd.randrange(60))) for _ in range(500)), "x y" * 30]
    for inside, pattern in ((text.NOT_SPACE, r"[^\x20\x09-\x0D]+"), (text.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        w = text.Words(pa.array(texts), inside)
        found = [re.findall(pattern, lowered(t)) for t in texts]
        assert w.counts().tolist() == [len(f) for f in found]
        names = {}
        assert all(names.setdefault(a, h) == h for a, h in zip((x for f in found for x in f), w.hashes))
        assert len(set(names.values())) == len(names)


# -- 1 sharding --------------------------------------------------------------------


def test_shards_are_whole_and_even(spark):
    rows = [(i, f"t{i}" * (i % 50)) for i in range(1003)] + ODD
    got = sharding.shuffle_into_shards(docs_of(spark, rows).withColumn("slot", F.lit("old")).withColumn("extra", F.lit(1)), shards=7, bucket_bytes=5000).collect()
    assert sorted(map(repr, ((r.doc_id, r.text) for r in got))) == sorted(map(repr, rows))
    assert {r.extra for r in got} == {1}
    counts = collections.Counter(r.shard for r in got)
    assert sorted(counts) == list(range(7)) and max(counts.values()) - min(counts.values()) <= 1
    for s, n in counts.items():
        assert sorted(r.slot for r in got if r.shard == s) == list(range(n))


def test_sharding_repeats_and_mixes(spark):
    df = spark.range(2000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    a = {r.doc_id: (r.shard, r.slot) for r in sharding.shuffle_into_shards(df.repartition(3), bucket_bytes=3000).collect()}
    b = {r.doc_id: (r.shard, r.slot) for r in sharding.shuffle_into_shards(df.repartition(11), bucket_bytes=3000).collect()}
    assert a == b
    first = [d for d, (s, _) in a.items() if s == 0]
    assert 600 < sum(first) / len(first) < 1400


def test_sharding_keeps_columns_of_any_name(spark):
    df = docs_of(spark, [(i, f"t{i}") for i in range(50)])
    for name in ("bucket", "at", "before", "position", "order", "record", "records", "size", "number", "heavy", "n"):
        df = df.withColumn(name, F.concat(F.lit(name), F.col("doc_id").cast("string")))
    got = sharding.shuffle_into_shards(df, shards=3, bucket_bytes=100).collect()
    assert sorted(r.doc_id for r in got) == list(range(50))
    assert all(r[c] == f"{c}{r.doc_id}" for r in got for c in df.columns if c not in ("doc_id", "text"))
    assert got[0].__fields__ == [*df.columns, "shard", "slot"]


def test_a_repeated_row_is_spread_over_buckets(spark):
    rows = [(7, "same row " * 4)] * 2000 + [(i, f"t{i}") for i in range(100, 1100)]
    got = sharding.shuffle_into_shards(docs_of(spark, rows).repartition(5), shards=4, bucket_bytes=4000).collect()
    assert sorted((r.doc_id, r.text) for r in got) == sorted(rows)
    counts = collections.Counter(r.shard for r in got)
    assert max(counts.values()) - min(counts.values()) <= 1
    same = collections.Counter(r.shard for r in got if r.doc_id == 7)
    assert min(same.values()) > 400
    keyed = docs_of(spark, rows).select(F.struct("doc_id", "text").alias("record"), F.xxhash64("doc_id", "text").alias("order"), sharding.record_bytes().alias("size"))
    most = sharding._apart(keyed, 4000, 1).groupBy(F.pmod("order", F.lit(20))).count().agg(F.max("count")).first()[0]
    assert most < 400


def test_sharding_of_nothing(spark):
    assert sharding.shuffle_into_shards(docs_of(spark, [])).collect() == []


# -- 6 near-duplicates -------------------------------------------------------------


def brute_near(rows, k=5, percent=85):
    sets = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lowered(t))
        sets[d] = frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


def near_rows(seed=2):
    """Copies, near copies, chains of near copies, and a crowd that resembles one text without being linked."""
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]

    def words(n):
        return [rnd.choice(vocabulary) for _ in range(n)]

    def edit(w, n):
        w = list(w)
        for _ in range(n):
            w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
        return w

    texts = [words(rnd.randrange(1, 120)) for _ in range(60)]
    texts += [edit(rnd.choice(texts[:60]), rnd.randrange(3)) for _ in range(80)]
    base = words(150)
    texts += [edit(base, rnd.randrange(1, 9)) for _ in range(70)]
    chain = words(140)
    for _ in range(25):
        chain = edit(chain, 1)
        texts.append(chain)
    texts += [base] * 20
    rnd.shuffle(texts)
    return [(i, rnd.choice([" ", "\n", "  "]).join(w)) for i, w in enumerate(texts)]


def test_near_duplicates_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neardup, "CELL_DOCS", 20)
    rows = near_rows()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs_of(spark, rows)).collect()}
    assert got == brute_near(rows)


def test_small_sets_fall_into_common_bands():
    rnd = np.random.default_rng(1)
    missed = 0
    for n in range(7, 60):
        for _ in range(20):
            own = np.unique(rnd.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2))
            other = own.copy()
            keep = int(np.floor(0.15 * n / 1.85))
            other[:keep] = rnd.integers(0, 2**63, keep, dtype=np.uint64)
            other = np.sort(other)
            missed += not (neardup.bands_of(own) == neardup.bands_of(other)).any()
            assert (neardup.signature(own) == neardup.signature(other)).sum() >= neardup.LEAST_BINS - 20
    assert missed == 0


@pytest.mark.parametrize("percent", [70, 80, 85])
def test_crowded_buckets_keep_pairs_with_few_equal_bins(spark, percent):
    """Pairs just similar enough, the one in thousands with the fewest equal bins too, in one crowded bucket."""
    rnd = random.Random(percent)
    found = []
    for _ in range(3000):
        own = [f"w{rnd.randrange(10**6)}" for _ in range(50)]
        n = round(46 * 2 * percent / (100 + percent) + 0.499)  # shingles to share of 46
        pair = [" ".join(own), " ".join([*own[: n + 4], *(f"w{rnd.randrange(10**6)}" for _ in range(46 - n))])]
        a, b = neardup.shingle_sets(pa.array(pair))
        common = len(np.intersect1d(a, b))
        assert 100 * common >= percent * (len(a) + len(b) - common)
        assert (neardup.bands_of(a, neardup.band_rows(percent)) == neardup.bands_of(b, neardup.band_rows(percent))).any()
        found.append((int((neardup.signature(a) == neardup.signature(b)).sum()), pair))
    found.sort()
    assert percent == 85 or found[0][0] < neardup.LEAST_BINS
    rows = [(2 * i + j, t) for i, (_, pair) in enumerate(found[:60]) for j, t in enumerate(pair)]
    members = spark.createDataFrame([(1, d, len(rows)) for d, _ in rows], "bucket long, node long, members long")
    alone = spark.createDataFrame([], "node long, component long")
    got = neardup._left_over(docs_of(spark, rows), members, alone, 5, percent)
    assert sorted(map(tuple, got.collect())) == [(2 * i, 2 * i + 1) for i in range(60)]


def test_bands_follow_the_similarity():
    assert [neardup.band_rows(p) for p in (100, 85, 80, 70, 50, 40)] == [4, 4, 4, 2, 2, 1]
    for p in range(12, 101):
        n = neardup.band_rows(p)
        assert (1 - (p / 100) ** n) ** (neardup.BINS // n) <= neardup.MISS


@pytest.mark.parametrize("percent", [50, 70, 80])
def test_near_duplicates_of_other_similarities_equal_brute_force(spark, monkeypatch, percent):
    monkeypatch.setattr(neardup, "CELL_DOCS", 20)
    rows = near_rows()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs_of(spark, rows), percent=percent).collect()}
    assert got == brute_near(rows, percent=percent)


def test_near_duplicates_of_odd_rows(spark):
    df = docs_of(spark, ODD).withColumn("bands", F.lit(1))
    got = neardup.near_duplicates(df).collect()
    assert len(got) == len(ODD)
    by_id = {r.doc_id: r for r in got}
    assert by_id[None].kept and by_id[None].component_id is None and by_id[None].n_shingles == 3
    assert all(by_id[i].n_shingles == 0 and by_id[i].kept and by_id[i].component_id == i for i in (1, 2, 3))
    assert by_id[4].n_shingles == 1 and by_id[5].n_shingles == 1 and by_id[7].n_shingles == 1
    kept = neardup.keep_one(df)
    assert kept.columns == ["doc_id", "text", "bands"]
    assert sorted(map(repr, (r.doc_id for r in kept.collect()))) == sorted(map(repr, [None, 1, 2, 3, 4, 5, 6, 7]))
    assert neardup.near_duplicates(docs_of(spark, [])).collect() == []
    assert neardup.keep_one(docs_of(spark, [])).collect() == []


# -- 8 decontamination -------------------------------------------------------------


def brute_hits(rows, items, window=10):
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    tests = collections.defaultdict(set)
    for i, t in items:
        w = re.findall(pattern, lowered(t))
        k = min(window, len(w))
        for o in range(len(w) - k + 1 if w else 0):
            tests[tuple(w[o : o + k])].add(i)
    sizes = {len(s) for s in tests}
    out = []
    for d, t in rows:
        w = re.findall(pattern, lowered(t))
        hit, found = set(), set()
        for k in sizes:
            for o in range(len(w) - k + 1):
                if (s := tuple(w[o : o + k])) in tests:
                    hit |= set(range(o, o + k))
                    found |= tests[s]
        out.append((d, len(w), len(hit), tuple(sorted(found, key=str))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_matches_equal_brute_force(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(decontaminate, "SHARD_SUFFIXES", 16)
    rnd = random.Random(3)
    vocabulary = ["alpha", "Beta", "x", "é1", "9", "zeta"]
    items = [(i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.choice([0, 2, 5, 11, 30])))) for i in range(12)] + [(3, None), (50, "only short words"), (51, "unique")]
    rows = [(i, ", ".join(rnd.choice(vocabulary) for _ in range(rnd.randrange(80)))) for i in range(80)]
    rows += [(100 + i, "start " + items[rnd.randrange(12)][1] + " end " + items[rnd.randrange(12)][1]) for i in range(60)] + [(500, "a unique text"), *ODD]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = docs_of(spark, rows).withColumn("n_words", F.lit("old")).withColumn("found", F.lit("kept"))
    found = decontaminate.with_matches(df, bench, block_bytes=block_bytes)
    assert set(found.columns) == {"doc_id", "text", "found", "n_words", "matches", "n_hit"}
    assert {r.found for r in found.collect()} == {"kept"}
    got = [(r.doc_id, r.n_words, r.n_hit, tuple(sorted({m.item_id for m in r.matches}, key=str))) for r in found.collect()]
    assert sorted(got, key=repr) == brute_hits(rows, items)


def test_matches_are_longest_and_placed(spark):
    item = " ".join(f"q{i}" for i in range(40))
    rows = [(1, "a b " + " ".join(f"q{i}" for i in range(5, 30)) + " c"), (2, "nothing")]
    bench = spark.createDataFrame([(9, item)], "item_id long, text string")
    first = decontaminate.with_matches(docs_of(spark, rows), bench).orderBy("doc_id").first()
    assert [tuple(m) for m in first.matches] == [(9, 5, 2, 25)]
    left = decontaminate.remove_contaminated(docs_of(spark, rows).withColumn("matches", F.lit("own")), bench)
    assert [tuple(r) for r in left.collect()] == [(2, "nothing", "own")]
    assert decontaminate.with_matches(docs_of(spark, []), bench).collect() == []
    assert decontaminate.remove_contaminated(docs_of(spark, rows), bench.filter("false")).count() == 2


@pytest.mark.parametrize("slab_bytes", [1, 16 << 20])
def test_benchmark_of_many_blocks(spark, monkeypatch, slab_bytes):
    """Blocks hold at most their bytes (or one item); whatever they and the slabs are, matches stay the same."""
    monkeypatch.setattr(decontaminate, "SLAB_BYTES", slab_bytes)
    rnd = random.Random(8)
    items = [(i, " ".join(f"w{rnd.randrange(50)}" for _ in range(25))) for i in range(60)] + [(None, "alone " * 12), (70, None), (71, ""), (72, "x " * 400)]
    rows = [(i, f"intro {items[i % 60][1]} middle {items[(i * 7) % 60][1]}") for i in range(90)] + [(900, "alone " * 11), (901, None), (902, "x " * 30)]
    bench = spark.createDataFrame(items, "item_id long, text string").repartition(7)
    path = decontaminate._write_blocks(bench, 400)
    sizes = [sum(map(len, r.texts)) for r in spark.read.parquet(path).collect()]
    assert all(n <= 400 or n == 800 for n in sizes) and len(sizes) > 8
    assert sum(len(r.texts) for r in spark.read.parquet(path).collect()) == 63
    found = decontaminate.with_matches(docs_of(spark, rows), bench, block_bytes=400)
    got = [(r.doc_id, r.n_words, r.n_hit, tuple(sorted({m.item_id for m in r.matches}, key=str))) for r in found.collect()]
    assert sorted(got, key=repr) == brute_hits(rows, items)
    one = {r.doc_id: r.matches for r in decontaminate.with_matches(docs_of(spark, rows), bench).collect()}
    assert {r.doc_id: r.matches for r in found.collect()} == one


def test_no_benchmark_text_reaches_the_driver(spark, monkeypatch):
    """The driver asks Spark for one number, the bytes of the benchmark."""
    from pyspark.sql.classic.dataframe import DataFrame as Classic

    asked, plain = [], Classic.collect
    monkeypatch.setattr(Classic, "collect", lambda df: asked.append(df.columns) or plain(df))
    bench = spark.createDataFrame([(1, "a b c d e f g h i j k")], "item_id long, text string")
    found = decontaminate.with_matches(docs_of(spark, [(1, "a b c d e f g h i j")]), bench)
    assert all("text" not in columns for columns in asked)
    assert found.first().n_hit == 10


# -- 7 and 9 tokens ----------------------------------------------------------------

ALPHABET = ["a", "b", "s", "t", "re", "ll", "ve", "'", "'", " ", " ", "\n", "\t", "1", ".", ",", "é", "ß", "²", "\xa0", "日本", "😀", "́", "<|endoftext|>", "Z", "don't", "I'LL", "\x00", "\r\n", "▁", "<s>", "  ", "\x85"]


def noise(n, seed):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randrange(40))) for _ in range(n)]


def test_ids_equal_the_library(monkeypatch):
    from tokenizers import Tokenizer

    path = queries.tokenizer_file("byte_bpe_50k.json")
    own, library = packing.Encoder(path), Tokenizer.from_file(path)
    own.cache.most = 500  # the cache is emptied now and then
    texts = noise(4000, 4)
    for i in range(0, len(texts), 200):
        expected = [e.ids for e in library.encode_batch(texts[i : i + 200], add_special_tokens=False)]
        assert [x.tolist() for x in own.ids(texts[i : i + 200])] == expected
    monkeypatch.setattr(pretokens, "PIECE", 64)
    long = "".join(t for t in noise(200, 5) if "<|" not in t)
    assert own.ids([long])[0].tolist() == library.encode(long, add_special_tokens=False).ids


def test_token_counts_equal_the_library(spark):
    path = queries.tokenizer_file("piece_bpe_32k.model")
    rows = [(i, t) for i, t in enumerate(noise(1500, 6))] + ODD
    got = token_count.count_tokens(docs_of(spark, rows).withColumn("n_tokens", F.lit("old")), path, limit=20).collect()
    model = token_count._model(path)
    expected = [(d, len((t or "").encode()), len(model.encode(t or ""))) for d, t in rows]
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in got), key=repr) == sorted(expected, key=repr)
    assert all(r.over_limit == (r.n_tokens > 20) for r in got)
    assert token_count.count_tokens(docs_of(spark, []), path).collect() == []


def test_packing_is_an_exact_round_trip(spark):
    from tokenizers import Tokenizer

    path = queries.tokenizer_file("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rnd = random.Random(7)
    rows = [(100 + i, " ".join(rnd.choice(["the", "of", "lorem", "ipsum", "xyzzy"]) for _ in range(rnd.randrange(400)))) for i in range(200)] + ODD
    got = packing.pack(docs_of(spark, rows), path, window=128, shard_pieces=40).collect()
    ids = {i: np.frombuffer(bytes(r.ids), dtype="<u4") for i, r in enumerate(got)}
    assert all(len(ids[i]) == r.length > 0 for i, r in enumerate(got))
    by_seq = collections.defaultdict(list)
    for r in got:
        by_seq[r.sequence_id].append((r.offset, r.length))
    total = 0
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 128
        total += at
    assert total / (128 * len(by_seq)) > 0.95
    whole = collections.defaultdict(list)
    for i, r in enumerate(got):
        whole[r.doc_id].append((r.start, r.doc_tokens, ids[i].tolist()))
    for d, t in rows:
        if d == 4:  # a repeated row: both copies, each id twice
            assert sum(len(x[2]) for x in whole[4]) == 2 * (len(library.encode("one", add_special_tokens=False).ids) + 1)
            continue
        expected = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        assert [x for p in sorted(whole[d], key=lambda p: p[0]) for x in p[2]] == expected
        assert {p[1] for p in whole[d]} == {len(expected)}
    assert packing.pack(docs_of(spark, []), path).collect() == []


def test_a_repeated_row_is_spread_over_packing_shards(spark):
    rows = [(7, "the same row")] * 900 + [(i, f"row {i}") for i in range(1800)]
    dealt = packing._dealt(docs_of(spark, rows).repartition(4), 9, 300, 9).collect()
    assert sorted((r.doc_id, r.text) for r in dealt) == sorted(rows)
    same = collections.Counter(r.shard for r in dealt if r.text == "the same row")
    assert len(same) == 9 and max(same.values()) < 180
    assert len({r.shard for r in dealt if r.doc_id == 8}) == 1


def test_used_pieces_leave_the_index_and_ranks_stay():
    rng = np.random.default_rng(6)
    pieces = [rng.integers(2, 400, size=rng.integers(1, 300)).astype(np.uint32) for _ in range(120)]
    starts = np.arange(400) % 3 > 0
    index, whole = packing.Index(pieces, starts), packing.Index(pieces, starts)
    used = np.arange(120) % 4 > 0
    index.forget(used)
    assert len(index.owner) < 0.4 * len(whole.owner)
    for piece in range(120):
        assert (index.scores(piece)[~used] == whole.scores(piece)[~used]).all()
    taken = sorted((p, lo, hi) for row in packing.fill(pieces, starts, 500) for p, lo, hi in row)
    assert sum(hi - lo for _, lo, hi in taken) == sum(map(len, pieces))


def test_neighbours_fill_a_seed_window():
    starts = np.ones(1000, dtype=bool)
    seed = np.arange(100, 160, dtype=np.uint32)
    alike, other = seed[:30], np.arange(500, 530, dtype=np.uint32)
    rows = packing.fill([other, seed, alike], starts, 90)
    assert rows[0] == [(1, 0, 60), (2, 0, 30)] and rows[1] == [(0, 0, 30)]


# -- 5 toxicity --------------------------------------------------------------------


def toxic_rows(seed=8, n=900):
    rnd = random.Random(seed)
    plain = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(n):
        bad = i % 6 == 0
        w = [rnd.choice(plain) for _ in range(rnd.randrange(20, 80))]
        if bad:
            w += rnd.choices(["moron", "vileness", "vilely", "vilest", "scum"], k=3)
        rnd.shuffle(w)
        rows.append((i, " ".join(w)))
        labels.append((i, int(not bad), int(bad)))
    return rows, labels


def test_toxicity_on_held_out_rows(spark):
    rows, labels = toxic_rows()
    known = spark.createDataFrame([x for x in labels if x[0] < 600], "doc_id long, quality int, toxic int")
    df = docs_of(spark, rows)
    chain = toxicity.fit(df, known, ["quality", "toxic"])
    got = {r.doc_id: r.p_toxic >= 0.5 for r in toxicity.score(df, chain).collect()}
    wrong = [i for i, _, t in labels if i >= 600 and got[i] != bool(t)]
    assert len(wrong) <= 3
    again = toxicity.fit(df.repartition(5), known, ["quality", "toxic"])
    assert (again.vocabulary == chain.vocabulary).all() and np.allclose(again.weights[1], chain.weights[1])


def test_later_models_use_earlier_probabilities():
    n = 400
    rnd = np.random.default_rng(9)
    y = rnd.integers(0, 2, n)
    rows = np.arange(n)
    labels = np.column_stack((y, y))
    chain = toxicity._chain(["a", "b"], np.array([1], dtype=np.uint64), rows[y == 1], np.zeros(int(y.sum()), dtype=int), np.ones(int(y.sum())), labels, rows % 5, 1e-3, 100)
    assert len(chain.weights[0]) == 1 and len(chain.weights[1]) == 2 and chain.weights[1][1] > 0


def test_toxicity_of_odd_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    df = docs_of(spark, ODD).withColumn("p_toxic", F.lit("old"))
    chain = toxicity.fit(df, none, ["quality", "toxic"])
    assert {r.p_toxic for r in toxicity.score(df, chain).collect()} == {0.5}
    one = spark.createDataFrame([(4, 1, 0), (4, 1, None), (None, 0, 1), (5, 1, 0)], "doc_id long, quality int, toxic int")
    got = toxicity.remove_toxic(df, one, ["quality", "toxic"])
    assert got.columns == df.columns and got.count() == len(ODD) and {r.p_toxic for r in got.collect()} == {"old"}
    assert toxicity.remove_toxic(docs_of(spark, []), one, ["quality", "toxic"]).collect() == []


# -- queries -----------------------------------------------------------------------


def test_digest_columns(spark, sf_dir):
    rows = {r.doc_id: r for r in queries.op1(spark, sf_dir).collect()}
    for d, t in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect():
        assert rows[d].text_crc32 == zlib.crc32(t.encode()) and rows[d].size == len(t.encode()) + 8
    packed = queries.op9(spark, sf_dir)
    assert packed.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert hashlib.sha256(b"").hexdigest() in {r.items_sha256 for r in queries.op8(spark, sf_dir).collect()}


def test_token_counts_where_workers_lack_the_package(tmp_path):
    """Only the driver can import the package: functions must travel whole, more than once in one worker."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    script = f"""
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
from listloom.llm import queries, token_count
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
docs = spark.createDataFrame([(i, "some words and a few others " * (i % 5)) for i in range(50)], "doc_id long, text string")
for _ in range(2):
    rows = token_count.count_tokens(docs, queries.tokenizer_file("piece_bpe_32k.model")).collect()
print("counted", len(rows), sum(r.n_tokens > 0 for r in rows))
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "counted 50 40" in done.stdout, done.stderr[-2000:]
