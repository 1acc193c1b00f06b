"""Deterministic sharded WARC writer and reader (operator 3).

Records are range-sorted by page_id into shards of about ``shard_bytes``. The ranges come from the
exact bytes of cells of ids, of which heavy ones are taken apart (``ranges``), so they depend on the rows alone, not on
partitions or samples. Only the records of a single id that is longer than a shard are dealt over several by a hash.
A shard's task streams its sorted records into files that are rolled by compressed size, one
gzip member a record, with headers, record ids and digests made anew. Files are written under
temporary names of their own for each attempt; the manifest, which Spark commits with one attempt
a task, says which of them count, and a second job gives those their names. Both steps may be
repeated after a loss. The same rows give the same files, byte by byte.

Of records with equal payloads of at least ``REVISIT_BYTES`` that with the largest page_id is a
response and the others are revisits of it.

Results: null html is an empty payload, a null url an empty target. A null page_id sorts first, is
written without an id header, and is never referred to unless all equal payloads have none, in
which case they are all responses. Rows repeated whole are records of their own with ids
of their own; rows that share payload and page_id are all responses or all revisits. Extra columns are
ignored. An empty table gives an archive without files.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut
from .tables import checked_broadcast, whole_texts

REVISIT_BYTES = 1000
SHARD_BYTES = 32 << 20
ROLL_BYTES = 8 << 20
DATE = "1970-01-01T00:00:00Z"
_CELL_BITS, _SPLIT_BITS = 16, 8
_OVERHEAD = 700
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_MANIFEST = "file string, temporary string, shard int, records long, bytes long, sha1 string"
_RECORD = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def typed(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, digest, refers_to) of every row of (page_id, url, html)."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]+", " ").alias("url"),
        F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"),
    ).withColumn("digest", F.sha1("payload"))
    big = rows.filter(F.octet_length("payload") >= REVISIT_BYTES)
    repeated = cut(big.groupBy("digest").agg(F.max("page_id").alias("target"), F.count("*").alias("n")).filter("n > 1 and target is not null").drop("n"), "repeated")
    found = rows.join(checked_broadcast(repeated), "digest", "left")
    return found.withColumn("refers_to", F.when(F.coalesce(F.col("page_id") < F.col("target"), F.col("target").isNotNull()), F.col("target"))).drop("target")


class Ranges:
    """Which shard an id belongs to: the least id that starts each shard, and ids dealt over several shards."""

    def __init__(self, starts: list[tuple], dealt: list[tuple], shards: int):
        self.low = np.array([low for low, _ in starts], dtype=np.int64)
        self.first = np.array([0, *(shard for _, shard in starts)], dtype=np.int32)
        self.dealt = {low: (first, many) for low, first, many in dealt}
        self.shards = shards

    def of(self, ids: pd.Series, hashes: pd.Series) -> np.ndarray:
        known = ids.notna().to_numpy()
        out = np.zeros(len(ids), dtype=np.int32)
        out[known] = self.first[np.searchsorted(self.low, ids[known].astype("int64").to_numpy(), "right")]
        for low, (first, many) in self.dealt.items():
            mine = ~known if low is None else known & (ids == low).fillna(False).to_numpy()
            out[mine] = first + hashes.to_numpy()[mine] % many
        return out


def _cells(ids: DataFrame, bits: int) -> DataFrame:
    return ids.groupBy(F.shiftright("id", bits).alias("cell")).agg(F.sum("size").alias("size"))


def ranges(pages: DataFrame, shard_bytes: int) -> Ranges:
    """Exact ranges of ids of about ``shard_bytes`` each.

    The bytes of each of at most 65,537 cells of ids are added up. A cell of over half a shard is taken apart into 256
    cells, and so on, until it is light or holds one id. A cell belongs to the shard in which its first byte falls.
    The driver gets a number a shard, and one an id that is longer than a shard.
    """
    ids = pages.select(F.col("page_id").cast("long").alias("id"), (F.coalesce(F.octet_length("html"), F.lit(0)) + _OVERHEAD).cast("long").alias("size"))
    low, high, total = ids.agg(F.min("id"), F.max("id"), F.sum("size")).first()
    bits = top = max(0, (high - low).bit_length() - _CELL_BITS) if low is not None else 0
    cells = cut(_cells(ids, bits), "cells")
    order = Window.orderBy(F.col("cell").asc_nulls_first())  # 65,537 rows at most
    before = cells.select(F.col("cell").alias("top"), (F.sum("size").over(order) - F.col("size")).alias("before"))
    leaves, heavy = [], F.col("size") > shard_bytes // 2
    while bits:
        split = cells.filter(heavy & F.col("cell").isNotNull()).select("cell")
        if split.isEmpty():
            break
        leaves.append(cells.filter(~heavy | F.col("cell").isNull()).select(F.shiftleft("cell", bits).alias("low"), "size"))
        # slim rows of the cells that are taken apart
        ids = cut(ids.withColumn("cell", F.shiftright("id", bits)).join(checked_broadcast(split), "cell").select("id", "size"), "ids")
        bits = max(0, bits - _SPLIT_BITS)
        cells = cut(_cells(ids, bits), "cells")
    leaves.append(cells.select(F.shiftleft("cell", bits).alias("low"), "size"))
    every = leaves[0]
    for part in leaves[1:]:
        every = every.unionByName(part)
    within = Window.partitionBy("top").orderBy("low")
    placed = every.withColumn("top", F.shiftright("low", top)).withColumn("inner", F.sum("size").over(within) - F.col("size"))
    start = F.col("before") + F.col("inner")
    placed = placed.join(F.broadcast(before), placed["top"].eqNullSafe(before["top"])).select("low", "size", start.alias("start"))
    first = F.expr(f"cast(start div {shard_bytes} as int)")
    many = F.expr(f"cast((start + size - 1) div {shard_bytes} as int)") - first + 1
    shards = cut(placed.select("low", "size", first.alias("first"), many.alias("many")), "shards")
    starts = shards.filter("low is not null").groupBy("first").agg(F.min("low").alias("low")).orderBy("low").collect()
    dealt = shards.filter(f"many > 1 and size > {shard_bytes} and (low is null or {bits} = 0)").select("low", "first", "many").collect()
    return Ranges([(r.low, r["first"]) for r in starts], [(r.low, r["first"], r.many) for r in dealt], 1 + (total or 0) // shard_bytes)


def _record_id(page_id, digest: str, repeat: int = 0) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id} {digest} {repeat}')}>"


def _sha1_32(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id, url: str, payload: bytes, digest: str, refers_to, repeat: int) -> bytes:
    """One compressed record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_record_id(page_id, digest, repeat)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {url}"]
    if refers_to is not None:
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_record_id(refers_to, digest)}", f"WARC-Refers-To-Page: {refers_to}"]
    if page_id is not None:
        lines.append(f"WARC-Page: {page_id}")
    lines += [f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}", f"WARC-Block-Digest: {_sha1_32(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


class _Roller:
    """Writes the records of shards, in order, to files of about ``roll_bytes``."""

    def __init__(self, path: str, roll_bytes: int):
        from pyarrow import fs

        self.fs, self.root = fs.FileSystem.from_uri(path)
        self.fs.create_dir(f"{self.root}/_temporary", recursive=True)
        self.roll_bytes, self.attempt = roll_bytes, uuid.uuid4().hex
        self.shard, self.number, self.out, self.closed = None, 0, None, []

    def add(self, shard: int, data: bytes) -> None:
        if shard != self.shard:
            self.close()
            self.shard, self.number = shard, 0
        if self.out is None:
            self.name = f"shard-{shard:08d}-{self.number:05d}.warc.gz"
            self.temporary = f"_temporary/{self.name}.{self.attempt}"
            self.out = self.fs.open_output_stream(f"{self.root}/{self.temporary}", compression=None)
            self.records, self.size, self.sha = 0, 0, hashlib.sha1()
        self.out.write(data)
        self.sha.update(data)
        self.records, self.size = self.records + 1, self.size + len(data)
        if self.size >= self.roll_bytes:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.closed.append((self.name, self.temporary, self.shard, self.records, self.size, self.sha.hexdigest()))
            self.out, self.number = None, self.number + 1

    def rows(self) -> pa.RecordBatch:
        columns = list(zip(*self.closed)) or [()] * 6
        self.closed = []
        types = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["file", "temporary", "shard", "records", "bytes", "sha1"])


def write_archive(pages: DataFrame, path: str, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Writes (page_id, url, html) to the new folder ``path``, one that all executors reach; returns the manifest."""
    spark = pages.sparkSession
    pages = whole_texts(pages.select("page_id", "url", "html"))
    of = ranges(pages, shard_bytes)

    @F.pandas_udf("int")
    def shard_of(ids: pd.Series, hashes: pd.Series) -> pd.Series:
        return pd.Series(of.of(ids, hashes))

    rows = typed(pages)
    shard = shard_of("page_id", F.pmod(F.xxhash64("digest", "page_id", "url"), F.lit(1 << 40))).alias("shard")
    # a revisit's payload is not written: only its length travels
    length = F.octet_length("payload").alias("length")
    payload = F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload")
    rows = rows.select(shard, "page_id", "url", "digest", "refers_to", length, payload)
    # a task a shard
    ordered = rows.repartitionById(of.shards, "shard").sortWithinPartitions("shard", "page_id", "digest", "url")

    def write(batches):
        roller, before, repeat = _Roller(path, roll_bytes), None, 0
        for batch in batches:
            for shard, page_id, url, digest, refers_to, length, payload in zip(*(batch.column(i).to_pylist() for i in range(7))):
                key = (shard, page_id, digest)
                repeat = repeat + 1 if key == before else 0
                before = key
                roller.add(shard, record(page_id, url, bytes(length) if payload is None else payload, digest, refers_to, repeat))
            yield roller.rows()
        roller.close()
        yield roller.rows()

    ordered.mapInArrow(write, _MANIFEST).write.parquet(f"{path}/_manifest")
    manifest = spark.read.schema(_MANIFEST).parquet(f"{path}/_manifest")

    def name(batches):
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(path)
        for batch in batches:
            for file, temporary in zip(batch.column("file").to_pylist(), batch.column("temporary").to_pylist()):
                if files.get_file_info(f"{root}/{temporary}").type != fs.FileType.NotFound:
                    files.move(f"{root}/{temporary}", f"{root}/{file}")
                elif files.get_file_info(f"{root}/{file}").type == fs.FileType.NotFound:
                    raise FileNotFoundError(file)
            yield batch

    manifest.mapInArrow(name, _MANIFEST).write.format("noop").mode("overwrite").save()
    return manifest.drop("temporary")


def _records(content: bytes):
    """(headers, block) of each gzip member, one held at a time."""
    view = memoryview(content)
    at = 0
    while at < len(view):
        z, parts = zlib.decompressobj(31), []
        while not z.eof:
            part = view[at : at + (1 << 16)]
            if not part:
                raise ValueError("a file ends within a record")
            parts.append(z.decompress(part))
            at += len(part)
        at -= len(z.unused_data)
        data = b"".join(parts)
        head, _, rest = data.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
        yield headers, rest[: int(headers["Content-Length"])]


def _parsed(headers: dict, block: bytes) -> tuple:
    if headers["WARC-Block-Digest"] != _sha1_32(block):
        raise ValueError(f"damaged record {headers['WARC-Record-ID']}")
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(http.rpartition(b"Content-Length: ")[2])
    digest = base64.b32decode(headers["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    kind = headers["WARC-Type"]
    if kind == "response" and (len(payload) != length or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"damaged payload in {headers['WARC-Record-ID']}")
    page, target = headers.get("WARC-Page"), headers.get("WARC-Refers-To-Page")
    return page and int(page), headers["WARC-Target-URI"], kind, length, digest, target and int(target), payload if kind == "response" else None


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """The records of an archive: page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload.

    Digests are checked; a damaged record ends the job. Files are held by tasks one at a time,
    which rolling bounds.
    """
    if spark.read.schema(_MANIFEST).parquet(f"{path}/_manifest").isEmpty():
        return spark.createDataFrame([], _RECORD)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path).select("content")
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    names = [f.split()[0] for f in _RECORD.split(", ")]

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    def parse(batches):
        for batch in batches:
            for content in batch.column("content"):
                rows, size = [], 0
                for headers, block in _records(content.as_py()):
                    rows.append(_parsed(headers, block))
                    size += len(block)
                    if size > 1 << 22:
                        yield batch_of(rows)
                        rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    return files.mapInArrow(parse, _RECORD)
