"""How Python workers find this package, and where intermediate tables are kept."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Bytes of an Arrow batch: a batch of 10,000 rows holds as many whole texts, so a worker's memory would follow their length.
BATCH_BYTES = 8 << 20


def ship(spark: SparkSession) -> None:
    """Put the package's folder on the workers' path, and keep Arrow batches small.

    That serves local mode and clusters whose nodes share the folder; elsewhere
    the package is submitted with ``--py-files``, and the extra entry is idle.
    """
    root = str(Path(__file__).resolve().parent.parent)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "")
    if root not in have.split(os.pathsep):
        env["PYTHONPATH"] = root + os.pathsep + have if have else root


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir`` or the context's checkpoint folder.

    Without either a local session gets a temporary folder; a cluster gets an
    error, since its executors would each write to a disk of their own.
    """
    sc = spark.sparkContext
    held = sc._jsc.sc().getCheckpointDir()
    where = spark.conf.get("spark.checkpoint.dir", None) or (held.get() if held.isDefined() else None)
    if where is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="fidelmill-")
    if not held.isDefined():
        sc.setCheckpointDir(where)
    return where.rstrip("/")


def new_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared folder and read again: lineage ends there, and lost executors cost only their tasks."""
    spark = df.sparkSession
    path = new_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
