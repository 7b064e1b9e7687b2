"""What the operators share: bounded Arrow batches, stored intermediate tables, joins that bear hot keys."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from contextlib import suppress

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of a batch that an operator works on at most (a longer row is a batch of its own), and of one that Spark sends to Python.
BATCH_BYTES, SENT_BYTES = 1 << 20, 1 << 22


def session_of(df: DataFrame) -> SparkSession:
    return df.sparkSession


def prepared(spark: SparkSession) -> SparkSession:
    """The session, with batches to Python of SENT_BYTES at most. For applications: operators leave settings alone."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
    if now > SENT_BYTES:
        spark.conf.set(key, str(SENT_BYTES))
    return spark


def in_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches, cut into pieces of BATCH_BYTES or one row; no bytes are copied."""
    for b in batches:
        rows = b.num_rows if b.nbytes <= BATCH_BYTES else max(1, b.num_rows * BATCH_BYTES // b.nbytes)
        for i in range(0, b.num_rows, rows) if b.num_rows else ():
            part = b.slice(i, rows)
            if part.nbytes > 2 * BATCH_BYTES and part.num_rows > 1:  # long texts side by side
                yield from in_pieces([part])
            else:
                yield part


def give_back() -> None:
    """Returns memory that this worker process has freed to the system: idle workers are kept for a while."""
    pa.default_memory_pool().release_unused()
    with suppress(AttributeError, OSError):  # where the C library is another
        ctypes.CDLL(None).malloc_trim(0)


def _ran(fn, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from fn(in_pieces(batches))
    give_back()


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow over pieces of bounded size: memory follows the longest texts, not the partition. No piece is empty."""
    names = df.columns
    if not any(set(".`") & set(c) for c in names):
        return df.mapInArrow(lambda batches: _ran(fn, batches), schema)
    # mapInArrow takes a dot in a column's name for one in a path.
    plain = df.toDF(*(f"c{i}" for i in range(len(names))))
    return plain.mapInArrow(lambda batches: _ran(fn, (b.rename_columns(names) for b in batches)), schema)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or where that is unset, the warehouse."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def own_dir(spark: SparkSession) -> str:
    """This application's own folder within the shared one."""
    return f"{shared_dir(spark).rstrip('/')}/brindle/{spark.sparkContext.applicationId}"


def stored(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """df written as Parquet to the shared folder and read again: computed once, its lineage cut there.

    With partition_by, rows of one value of that column can be read without the others. ``forget`` deletes the files of one, ``clear_stored`` those of the application.
    """
    spark = session_of(df)
    path = f"{own_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path, partitionBy=partition_by)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes the files of stored tables that nothing will read again."""
    for t in tables:
        _delete(session_of(t), t.stored_at)


def clear_stored(spark: SparkSession) -> None:
    """Deletes what ``stored`` has written in this application."""
    _delete(spark, own_dir(spark))


def join_hot(left: DataFrame, right: DataFrame, on: str, weight: str, total: int, how: str = "inner") -> DataFrame:
    """left joined with right (one row for each key) where a few keys may hold most rows of left.

    right has in ``weight`` how many rows of left have the key. Keys with more than one in a thousand
    of ``total`` rows number under a thousand, whatever the input, so their rows of right are
    broadcast; all others are joined by shuffle, where no key has more than that share.
    """
    heavy = F.col(weight) > F.lit(max(1000, total // 1000))
    hot = F.broadcast(right.where(heavy).drop(weight))
    hot_keys = F.broadcast(right.where(heavy).select(on))
    cold = right.where(~heavy).drop(weight)
    return left.join(hot, on, "inner").unionByName(left.join(hot_keys, on, "left_anti").join(cold, on, how), allowMissingColumns=True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{sf_dir}/documents.parquet")


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def field(df: DataFrame, name: str) -> T.StructField:
    return T.StructField(name, df.schema[name].dataType, True)


def fresh_prefix(df: DataFrame) -> str:
    """A prefix that no column of df has, for columns that are added for a while."""
    prefix = "__x"
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix += "x"
    return prefix
