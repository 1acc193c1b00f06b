"""Record logs, stored tables and exports."""

from __future__ import annotations

import re

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.quality import flatten, named_column, nested_as_json
from ..functions.text import record_id
from ..operators.reports import report_rows
from ..schema import RECORD

# Fixed values -------------------------------------------------------------------
CHECKPOINT_NUMBER = r"_checkpoint_(\d+)\.jsonl"
EXPORT_FORMATS = ("csv", "json", "table", "report")
# --------------------------------------------------------------------------------

#: The column that keeps what a schema lacks.
REST = "rest"
#: Line counts are broadcast for so many blocks of files at most, 100 bytes each.
BLOCKS_BROADCAST = 500_000
_CORRUPT = "_corrupt_record"
_CSV = {"header": "true", "quote": '"', "escape": '"', "emptyValue": "", "encoding": "UTF-8"}


def _listed_blocks(files: DataFrame) -> int:
    """At most so many blocks are read, by the sizes the file listing names."""
    spark = files.sparkSession
    sizes = files._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    least = min(_in_bytes(spark, "spark.sql.files.maxPartitionBytes"), _in_bytes(spark, "spark.sql.files.openCostInBytes"))
    return len(files.inputFiles()) + int(str(sizes)) // max(1, least)


def _in_bytes(spark: SparkSession, key: str) -> int:
    return int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key).lower()))


def numbered_lines(spark: SparkSession, path) -> DataFrame:
    """(line_no, line, file): the lines of text files that are not blank, numbered from 1 in the order of
    the files' paths and of the lines in each.

    Files are read in blocks, in parallel. A task reads whole blocks, each from its first line to its last, so
    a row number of the task, less that of the block's first row, is the place in the block. A first pass
    counts the lines of each block; these counts, a row a block, are summed up in order.
    """
    files = spark.read.text(path)
    lines = files.filter(F.col("value").rlike(r"\S")).select(
        F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
    )
    before = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    counts = lines.groupBy("file", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    blocks = counts.select("file", "block", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first") + 1).alias("shift"))
    if _listed_blocks(files) <= BLOCKS_BROADCAST:
        blocks = F.broadcast(blocks)
    return lines.join(blocks, ["file", "block"]).select((F.col("at") + F.col("shift")).alias("line_no"), "line", "file")


def parsed(lines: DataFrame, schema: T.StructType) -> DataFrame:
    """``lines`` with their records as ``record``, and whether they could be read."""
    full = T.StructType([*schema.fields, T.StructField(_CORRUPT, T.StringType())])
    record = F.from_json("line", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT})
    return lines.withColumn("record", record).withColumn("readable", F.coalesce(F.col("record").isNotNull() & F.col(f"record.{_CORRUPT}").isNull(), F.lit(False)))


def rest_of(line, schema: T.StructType):
    """The keys of a JSON object that ``schema`` lacks, as a VARIANT object; NULL if there are none."""
    keys = F.map_filter(F.from_json(line, "map<string,variant>"), lambda k, _: ~k.isin(schema.names))
    return F.when(F.size(keys) > 0, F.to_variant_object(keys))


def _records(lines: DataFrame, schema: T.StructType, rest: str | None) -> DataFrame:
    """The readable records of numbered lines."""
    good = parsed(lines, schema).filter("readable")
    numbered = {"seq": F.coalesce("record.seq", "line_no").cast(schema["seq"].dataType)} if "seq" in schema.names else {}
    cols = [numbered.get(name, F.col(f"record.`{name}`")).alias(name) for name in schema.names]
    kept = [rest_of("line", schema).alias(rest)] if rest else []
    return good.select(*cols, *kept, "file")


def read_log(spark: SparkSession, path, schema: T.StructType = RECORD, rest: str | None = REST) -> DataFrame:
    """A JSON-lines record log; blank lines are skipped, unreadable ones left out.

    A record without ``seq`` gets the number of its line (``numbered_lines``), so that the order of the log is
    that of ``seq``; a log should either number all its records or none. Keys that ``schema``
    lacks are kept in the VARIANT column ``rest`` (U4), which exports open into columns.
    """
    return _records(numbered_lines(spark, path), schema, rest).drop("file")


def unreadable_lines(spark: SparkSession, path, schema: T.StructType = RECORD) -> DataFrame:
    """The lines ``read_log`` leaves out, with their file and number."""
    return parsed(numbered_lines(spark, path), schema).filter("not readable").select("file", "line_no", "line")


def _ddl(kind: T.DataType) -> str:
    """A type as DDL text, whatever characters its field names hold."""
    if isinstance(kind, T.StructType):
        return "STRUCT<" + ", ".join(f"`{f.name.replace('`', '``')}`: {_ddl(f.dataType)}" for f in kind.fields) + ">"
    if isinstance(kind, T.ArrayType):
        return f"ARRAY<{_ddl(kind.elementType)}>"
    return "STRING" if isinstance(kind, T.NullType) else kind.simpleString()


def widened(df: DataFrame, rest: str = REST) -> DataFrame:
    """U4: the VARIANT column ``rest`` opened into a column for each key that any record has, by name.

    One pass finds the keys and a type that holds all values of each; values of types that have none in common stay VARIANT.
    Where a key differs from a column only in case, ``_2``, ``_3``, ... is added to its name.
    """
    if rest not in df.columns or not isinstance(df.schema[rest].dataType, T.VariantType):
        return df
    shape = df.agg(F.schema_of_variant_agg(rest)).first()[0]
    out = df.drop(rest)
    if not shape or not shape.startswith("OBJECT<"):
        return out
    ddl = re.sub(r"`(?:[^`]|``)*`|OBJECT<", lambda m: "STRUCT<" if m[0] == "OBJECT<" else m[0], shape)
    taken, opened = {c.lower() for c in out.columns}, []
    values = F.col(rest).cast("map<string,variant>")
    for field in T.StructType.fromDDL(f"`{rest}` {ddl}")[0].dataType:
        name, copy = field.name, 1
        while name.lower() in taken:
            copy += 1
            name = f"{field.name}_{copy}"
        taken.add(name.lower())
        value = F.try_element_at(values, F.lit(field.name))
        opened.append((value if isinstance(field.dataType, T.VariantType) else F.try_variant_get(value, "$", _ddl(field.dataType))).alias(name))
    return df.select(*[named_column(c) for c in out.columns], *opened)


def with_record_id(df: DataFrame) -> DataFrame:
    """X1 for the records that carry no ``_id`` yet."""
    made = record_id("name", "phone", "address")
    return df.withColumn("_id", F.coalesce("_id", made) if "_id" in df.columns else made)


def merge_checkpoints(spark: SparkSession, folder: str, schema: T.StructType = RECORD) -> DataFrame:
    """All checkpoint files of a run as one table, the newest file winning per ``_id``.

    The number in the file name is the age; ties within one file go to the later ``seq`` or line.
    """
    number = F.regexp_extract("file", CHECKPOINT_NUMBER, 1).try_cast("bigint")
    lines = numbered_lines(spark, f"{folder}/*_checkpoint_*.jsonl")
    rows = _records(lines, schema, REST).withColumn("__no", number).drop("file")
    rank = F.row_number().over(Window.partitionBy("_id").orderBy(F.col("__no").desc(), F.col("seq").desc()))
    return with_record_id(rows).withColumn("__rank", rank).filter("__rank = 1").drop("__rank", "__no")


def read_store(spark: SparkSession, table: str | None = None, path: str | None = None, where: str | None = None) -> DataFrame:
    """S3: a stored table by name or by folder, optionally filtered; the filter reaches the scan."""
    df = spark.table(table) if table else spark.read.parquet(path)
    return df.filter(where) if where else df


def read_jdbc(spark: SparkSession, url: str, table: str, key: str, lower, upper, partitions: int = 64, **options) -> DataFrame:
    """S3 for an external database, read in parallel ranges of ``key``."""
    reader = spark.read.format("jdbc").options(
        url=url, dbtable=table, partitionColumn=key, lowerBound=lower, upperBound=upper, numPartitions=partitions
    )
    return reader.options(**options).load()


def write_csv(df: DataFrame, path: str, map_keys: dict[str, list[str]] | None = None, mode: str = "overwrite") -> None:
    """Nested columns flattened (X40), unknown keys as columns of their own (``widened``)."""
    flatten(widened(df), map_keys).write.mode(mode).options(**_CSV).csv(path)


def write_csv_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Nested columns as JSON text."""
    nested_as_json(widened(df)).write.mode(mode).options(**_CSV).csv(path)


def read_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """The text columns of an export, '' for empty cells."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    raw = spark.read.schema(schema).options(header="true", quote='"', escape='"', multiLine="true").csv(path)
    return raw.fillna("")


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object per line; times and other non-JSON values as text."""
    plain = (T.StringType, T.NumericType, T.BooleanType, T.ArrayType, T.MapType, T.StructType, T.VariantType)
    df = widened(df)
    cols = [named_column(f.name) if isinstance(f.dataType, plain) else named_column(f.name).cast("string").alias(f.name) for f in df.schema.fields]
    df.select(*cols).write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_table(
    df: DataFrame, table: str, path: str, buckets: int = 0, bucket_by: str = "seq", map_keys=None, lookups: list[str] = (), group_bytes: int | None = None
) -> None:
    """Full replacement of a table with the flattened records.

    Two things take the place of an index. ``buckets``: files are bucketed and sorted by ``bucket_by``.
    ``lookups``: columns whose values are looked up one at a time. Rows are ranged by the first of them, so that its value
    lies in a file or two, and all of them get Bloom filters, by which a reader leaves out row groups (of ``group_bytes``) that
    cannot hold a value.
    """
    flat = flatten(widened(df), map_keys)
    unknown = set(lookups) - set(flat.columns)
    if unknown or (lookups and buckets):
        raise ValueError(f"no such columns: {sorted(unknown)}" if unknown else "a table is bucketed or ranged, not both")
    if lookups:
        order = [named_column(c) for c in lookups]
        flat = flat.repartitionByRange(*order[:1]).sortWithinPartitions(*order)
    w = flat.write.mode("overwrite").option("path", path)
    for c in lookups:
        w = w.option(f"parquet.bloom.filter.enabled#{c}", "true")
    if group_bytes:
        w = w.option("parquet.block.size", group_bytes)
    if buckets:
        w = w.bucketBy(buckets, bucket_by).sortBy(bucket_by)
    w.saveAsTable(table)


def append_table(df: DataFrame, path: str) -> None:
    """Append, creating the table if missing."""
    df.write.mode("append").parquet(path)


def export_all(df: DataFrame, folder: str, formats=EXPORT_FORMATS, map_keys=None) -> dict[str, str]:
    """One dataset in every configured format, computed once; returns format -> path.

    ``table`` is the flattened table of S7 as Parquet, ``report`` the numbered rows of S11 as CSV.
    """
    unknown = set(formats) - set(EXPORT_FORMATS)
    if unknown:
        raise ValueError(f"unknown formats {sorted(unknown)}")
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    written = {f: f"{folder}/{f}" for f in formats}
    try:
        wide = widened(df)
        if "csv" in written:
            write_csv(wide, written["csv"], map_keys)
        if "json" in written:
            write_json(wide, written["json"])
        if "table" in written:
            flatten(wide, map_keys).write.mode("overwrite").parquet(written["table"])
        if "report" in written:
            write_csv(report_rows(df), written["report"])
    finally:
        df.unpersist()
    return written


def snapshot(spark: SparkSession, store: str, folder: str, stamp: str) -> str:
    """Copy of a store as ``snapshot=<stamp>``, taken before it is written."""
    path = f"{folder}/snapshot={stamp}"
    spark.read.parquet(store).write.mode("errorifexists").parquet(path)
    return path
