"""The edit ledger as a stream: running counts of corrections, with the state Spark keeps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fidelmill.operators.store import LEARNED_KINDS, ledger

EDITS = "edit_id long, page_id long, ts timestamp, before string, after string, kind string, source string"


def read_edits(spark: SparkSession, path: str) -> DataFrame:
    """A stream of appended Parquet files of edits."""
    return spark.readStream.schema(EDITS).parquet(path)


def running_corrections(edits: DataFrame) -> DataFrame:
    """before, after, n so far, of learned kinds; for update or complete mode."""
    return ledger(edits).where(F.col("kind").isin(*LEARNED_KINDS)).groupBy("before", "after").agg(F.count(F.lit(1)).alias("n"))


def windowed_edits(edits: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Edits of each kind by time window; rows later than the watermark are left out, and closed windows leave the state."""
    return edits.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "kind").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "kind", "n")
