"""Registered queries of this package, and the SQL twins of those that SQL can express."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, work_path
from . import ann, centroids, chat, decontaminate, extract, neardup, packing, runs, sharding, simhash, token_count, toxicity, warc
from .tables import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


@query("op6_minhash_near_dedup")
def op6(spark, sf_dir):
    return neardup.near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP8_SQL = rf"""
WITH items AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
  sizes AS (SELECT *, least(10, len(w)) AS k FROM items WHERE len(w) > 0),
  windows AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS s
              FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM sizes)),
  docs AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
  lengths AS (SELECT DISTINCT k FROM windows),
  places AS (SELECT r, i, k, array_to_string(w[i:i + k - 1], ' ') AS s
             FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM docs, lengths WHERE len(w) >= k)),
  hits AS (SELECT p.r, p.i, p.k, x.item_id FROM places p JOIN windows x ON x.k = p.k AND x.s = p.s),
  hit_words AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest(range(i, i + k)) AS j FROM hits) GROUP BY r),
  hit_items AS (SELECT r, count(DISTINCT item_id) AS n, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hits GROUP BY r)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(i.n, 0)::BIGINT AS n_items,
  sha256(coalesce(i.ids, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM docs d LEFT JOIN hit_words h ON h.r = d.r LEFT JOIN hit_items i ON i.r = d.r
"""


@query("op8_suffix_array_decontamination", OP8_SQL)
def op8(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.with_matches(docs, read(spark, sf_dir, "benchmark"))
    items = F.array_sort(F.array_distinct(F.filter(F.transform("matches", lambda m: m.item_id.cast("string")), lambda i: i.isNotNull())))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


CATEGORIES = ["quality", "toxic"]


@query("op5_toxicity_chain")
def op5(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    chain = toxicity.fit(docs, read(spark, sf_dir, "labels"), CATEGORIES)
    scored = toxicity.score(docs, chain)
    return scored.select("doc_id", "p_quality", "p_toxic", (F.col("p_toxic") >= toxicity.THRESHOLD).alias("toxic"))


@query("op7_token_counts")
def op7(spark, sf_dir):
    counted = token_count.count_tokens(read(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_file("piece_bpe_32k.model"))
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


@query("op9_lexical_packing")
def op9(spark, sf_dir):
    pieces = packing.pack(read(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op1_external_shuffle_sharding")
def op1(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    sharded = sharding.shuffle_into_shards(docs)
    return sharded.select(
        "doc_id", sharding.record_bytes().alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


OP10_SQL = """
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
  p AS (SELECT conv_id, row_number() OVER w AS place, count(*) OVER (PARTITION BY conv_id) AS n,
          '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS line,
          md5(string_agg(md5(role) || md5(text), '' ORDER BY turn NULLS FIRST) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST ROWS UNBOUNDED PRECEDING)) AS h
        FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST)),
  whole AS (SELECT h, min(conv_id) AS conv_id, count(*) AS copies FROM p WHERE place = n GROUP BY h),
  stay AS (SELECT conv_id, copies FROM whole WHERE h NOT IN (SELECT h FROM p WHERE place < n))
SELECT p.conv_id, (place - 1) // 256 AS segment, count(*) AS n_turns, copies, string_agg(line, '' ORDER BY place) AS text
FROM p JOIN stay USING (conv_id) GROUP BY p.conv_id, (place - 1) // 256, copies
"""


@query("op10_snapshot_collapse", OP10_SQL)
def op10(spark, sf_dir):
    return chat.format_chats(read(spark, sf_dir, "conversations"))


OP3_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
  d AS (SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha1(payload) AS payload_digest FROM p),
  m AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS target FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = target THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> target THEN target END AS refers_to
FROM m
"""


@query("op3_warc_archive", OP3_SQL)
def op3(spark, sf_dir):
    path = work_path(spark, "archive")
    warc.write_archive(read(spark, sf_dir, "pages"), path)
    return warc.read_archive(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op4_block_rules_extraction")
def op4(spark, sf_dir):
    return extract.extract(read(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


@query("op2_vantage_point_trees")
def op2(spark, sf_dir):
    return ann.nearest(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def planted(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text), every tenth text (by a hash of its id) periodic from some word on."""
    h = F.crc32(F.col("doc_id").cast("string"))
    chosen = docs.withColumn("h", h).withColumn("g", F.floor(F.col("h") / 10))
    words = F.array_remove(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), "")
    split = chosen.withColumn("words", F.when(F.col("h") % 10 == 0, words)).withColumn("n", F.size("words"))
    cut_at = split.withColumn("a", F.when(F.col("n") > 0, (F.col("g") % F.col("n")).cast("int")))
    shaped = cut_at.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    times = F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")
    tail = F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), times))
    text = F.array_join(F.slice(F.concat(F.slice("words", 1, F.col("a")), tail), 1, F.col("n")), " ")
    return shaped.select("doc_id", F.when(F.col("n") > 0, text).otherwise(F.col("text")).alias("text"))


OP11_SQL = r"""
WITH base AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS o,
    xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
        lambda c, b: list_reduce(range(8), lambda d, k: xor(d >> 1, 3988292384 * (d & 1)), xor(c, b)), 4294967295::BIGINT), 4294967295) AS h
  FROM documents),
  shape AS (SELECT *, len(o) AS n, h // 10 AS g FROM base),
  bent AS (SELECT *, CASE WHEN n > 0 THEN g % n END AS a FROM shape),
  docs AS (SELECT r, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
      THEN list_transform(range(n), lambda i: o[1 + CASE WHEN i >= a THEN a + (i - a) % (1 + (n - a) // (3 + g % 8)) ELSE i END]) ELSE o END AS w
    FROM bent),
  grams AS (SELECT r, i, array_to_string(w[i + 1:i + 6], ' ') AS s FROM (SELECT *, unnest(range(n - 5)) AS i FROM docs)),
  pairs AS (SELECT x.r, y.i, y.i - x.i AS q FROM grams x JOIN grams y ON x.r = y.r AND x.s = y.s AND x.i < y.i),
  islands AS (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM pairs),
  stretches AS (SELECT r, q, min(i) - q AS s, max(i) + 6 AS e FROM islands GROUP BY r, q, island HAVING max(i) + 6 - min(i) + q >= greatest(12, 2 * q)),
  runs AS (SELECT r, s, e - s AS l, min(q) AS q FROM stretches GROUP BY r, s, e),
  listed AS (SELECT r, count(*) AS n_runs, arg_min({'s': s, 'l': l, 'q': q}, {'l': -l, 's': s, 'q': q}) AS top,
      string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS text FROM runs GROUP BY r),
  gone AS (SELECT DISTINCT r, unnest(range(s + q, s + l)) AS i FROM runs),
  kept AS (SELECT d.r, string_agg(d.x, ' ' ORDER BY d.i) AS text FROM (SELECT r, unnest(range(n)) AS i, unnest(w) AS x FROM docs) d
    ANTI JOIN gone g ON g.r = d.r AND g.i = d.i GROUP BY d.r)
SELECT d.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, top.s::BIGINT AS start, top.l::BIGINT AS length, top.q::BIGINT AS period,
  (1000 * top.l // top.q)::BIGINT AS exponent_milli, sha256(coalesce(l.text, '')) AS runs_sha256, sha256(coalesce(k.text, '')) AS collapsed_sha256
FROM docs d LEFT JOIN listed l ON l.r = d.r LEFT JOIN kept k ON k.r = d.r
"""


@query("op11_periodic_runs", OP11_SQL)
def op11(spark, sf_dir):
    found = runs.find_runs(planted(read(spark, sf_dir, "documents").select("doc_id", "text")))
    longest = F.get(F.sort_array(F.transform("runs", lambda r: F.struct((-r.length).alias("l"), r.start.alias("s"), r.period.alias("q")))), F.lit(0))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string")), F.lit("\n")))
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("top"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return out.select(
        "doc_id", "n_runs", F.col("top.s").alias("start"), (-F.col("top.l")).alias("length"), F.col("top.q").alias("period"),
        F.expr("(-1000 * top.l) div top.q").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )


@query("op12_simhash_near_dedup")
def op12(spark, sf_dir):
    found = simhash.near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _op13_sql() -> str:
    """Three rounds written out one after the other."""
    near = "list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"
    steps = [
        """kept AS (SELECT vec_id, list_transform(embedding, lambda e: floor(64 * e::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64)""",
        "c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), x) - 1 AS c, x FROM kept QUALIFY c < 16)",
    ]
    for i in range(4):
        steps.append(f"d{i} AS (SELECT v.vec_id, v.x, arg_min({{'c': c.c, 'd': {near}}}, {{'d': {near}, 'c': c.c}}) AS best FROM kept v, c{i} c GROUP BY v.vec_id, v.x)")
        if i < 3:
            steps.append(f"s{i} AS (SELECT c, j, sum(e) AS s, count(*) AS n FROM (SELECT best.c AS c, unnest(range(64)) AS j, unnest(x) AS e FROM d{i}) GROUP BY c, j)")
            steps.append(f"m{i} AS (SELECT c, list((CASE WHEN s % n < 0 THEN s // n - 1 ELSE s // n END)::BIGINT ORDER BY j) AS x FROM s{i} GROUP BY c)")
            steps.append(f"c{i + 1} AS (SELECT c{i}.c, coalesce(m{i}.x, c{i}.x) AS x FROM c{i} LEFT JOIN m{i} ON m{i}.c = c{i}.c)")
    return (
        "WITH " + ", ".join(steps) + """
SELECT vec_id, best.c::INTEGER AS cluster, best.d AS distance, (sum(best.d) OVER (PARTITION BY best.c))::BIGINT AS cluster_inertia,
  (sum(best.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c3.x, ',')) AS centroid_sha256
FROM d3 JOIN c3 ON c3.c = best.c"""
    )


@query("op13_centroid_clustering", _op13_sql())
def op13(spark, sf_dir):
    assigned, middles = centroids.cluster(read(spark, sf_dir, "embeddings"))
    digests = [(c, hashlib.sha256(",".join(map(str, row)).encode()).hexdigest()) for c, row in enumerate(middles.tolist())]
    named = spark.createDataFrame(digests, "cluster int, centroid_sha256 string")
    whole = centroids.with_inertia(cut(assigned, "assigned"))
    return whole.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
