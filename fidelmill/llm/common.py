"""Shared plumbing of the training-data operators: tables, shared storage, Arrow sizes."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fidelmill.runtime import new_dir, saved, shared_dir, ship  # noqa: F401  (the operators take them from here)

#: Rows of a side that may be broadcast; a larger side is joined by shuffle.
BROADCAST_ROWS = 200_000


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Rows and bytes of an Arrow batch: some texts are very long.
BATCH_ROWS, BATCH_BYTES = 256, 8 << 20


def tune(spark: SparkSession) -> None:
    """Keep Arrow batches small, and let workers find the package. The settings are the same for all operators, so lazy plans do not disturb each other."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def drop_dir(spark: SparkSession, path: str) -> None:
    """Remove a folder of the shared storage that no later plan reads."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint only if it has at most ``limit`` rows; else as it is, for a shuffled join."""
    few = df.limit(limit + 1).count() <= limit
    return F.broadcast(df) if few else df


def shuffled_apart(rows: DataFrame, per_key: DataFrame, key: str, size: str, total: int | None = None, most: int = 100_000) -> DataFrame:
    """Inner join of ``rows`` with ``per_key`` (one row a key, with the key's number of rows in ``size``), no key in one task.

    Keys that hold more than a ``most``-th of all rows are fewer than ``most``, so
    they are broadcast, and their rows stay where they are; the rest is shuffled.
    """
    if total is None:
        total = int(per_key.agg(F.sum(size)).first()[0] or 0)
    large = F.col(size) > max(256, total // most)
    few = F.broadcast(per_key.where(large))
    rest = rows.join(F.broadcast(per_key.where(large).select(key)), key, "left_anti").join(per_key.where(~large), key)
    return rows.join(few, key).unionByName(rest)


def trim() -> None:
    """Give back what earlier tasks of this worker have freed: workers live on, and allocators keep memory."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def arrow_map(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]], schema: str) -> DataFrame:
    """mapInArrow with per-task state: ``make()`` runs once a task and gives what handles each batch."""

    def run(batches):
        trim()
        handle = make()
        for batch in batches:
            yield from handle(batch)
        trim()

    return df.mapInArrow(run, schema)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """A text column as a list, null as the empty text."""
    return [x or "" for x in column(batch, name).to_pylist()]


def crc_remainder(name: str, modulus: int) -> F.Column:
    """crc32 of the id as text, mod ``modulus``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))
