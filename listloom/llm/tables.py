"""Small helpers the operators share: reading the tables, appended columns, checked broadcasts."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A side is broadcast only when it has been written, counted, and holds no more rows than this.
BROADCAST_ROWS = 1_000_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checked_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (slim rows, already written) with a broadcast hint if it has at most ``limit`` rows."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


#: Rows of an Arrow batch between Spark and a worker; Spark's own default of 10,000 whole texts is held
#: several times over, on both sides.
BATCH_ROWS = 1024


def whole_texts(df: DataFrame) -> DataFrame:
    """``df``, after setting its session's Arrow batches to ``BATCH_ROWS`` rows if they are larger."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    return df


#: Text bytes a task works on at a time: its numpy arrays take about thirty times as much.
SLICE_BYTES = 1 << 20


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of Arrow batches in slices of about ``limit`` text bytes (one row may be longer).

    A batch is let go before the next is fetched; users of a slice drop it after use.
    """
    for batch in batches:
        if batch.num_rows:
            size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
            part = np.cumsum(size, dtype=np.int64) // limit
            cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                yield batch.slice(lo, hi - lo)
        del batch


def append(df: DataFrame, fn: Callable[[pa.RecordBatch], list], added: str, column: str = "text") -> DataFrame:
    """``df`` with the columns of the DDL string ``added``, which ``fn`` makes from slices of Arrow batches.

    ``fn`` returns one Arrow array a column. An input column with the name of an added one is replaced.
    """
    new = T.StructType.fromDDL(added)
    names = {f.name.lower() for f in new}
    kept = [f for f in df.schema if f.name.lower() not in names]
    schema = T.StructType([*kept, *new])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column):
            columns = [batch.column(batch.schema.get_field_index(f.name)) for f in kept] + list(fn(batch))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)
            del batch, columns

    return whole_texts(df).mapInArrow(run, schema)
