"""Connected components of an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fidelmill.llm.common import column, drop_dir, new_dir, shuffled_apart

EDGE = "u long, v long"
#: Edges that a task joins up at a time (16 bytes each).
LOCAL_EDGES = 1 << 20


def _write(df: DataFrame, spark: SparkSession) -> tuple[DataFrame, str]:
    path = new_dir(spark, "edges")
    df.write.parquet(path)
    return spark.read.schema(EDGE).parquet(path), path


def joined_up(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, component) of the nodes of an edge list: each node's least reachable node."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    label = np.arange(len(nodes))
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        np.minimum.at(new, label, new)
        new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def locally(edges: DataFrame, at_once: int = LOCAL_EDGES) -> DataFrame:
    """Edges that connect the same nodes, fewer of them: every task makes stars of what it holds, some edges at a time."""

    def stars(u: list[np.ndarray], v: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        node, least = joined_up(np.concatenate(u), np.concatenate(v))
        node, least = node[node > least], least[node > least]
        for at in range(0, len(node), 65_536):
            yield pa.RecordBatch.from_arrays([pa.array(x[at : at + 65_536]) for x in (node, least)], names=["u", "v"])

    def run(batches):
        u, v, held = [], [], 0
        for batch in batches:
            u.append(column(batch, "u").to_numpy())
            v.append(column(batch, "v").to_numpy())
            held += batch.num_rows
            if held >= at_once:
                yield from stars(u, v)
                u, v, held = [], [], 0
        if held:
            yield from stars(u, v)

    return edges.mapInArrow(run, EDGE)


def components(edges: DataFrame, u: str = "u", v: str = "v", at_once: int = LOCAL_EDGES) -> DataFrame:
    """(node, component) of every node that has an edge to another; the component is its smallest node.

    Every task first joins up the edges that it holds. Then stars are contracted:
    large-star joins every neighbour that is larger to the least neighbour,
    small-star every smaller one; both keep components, and in a few rounds
    (logarithmic in the longest path) every component is a star around its least
    node. The way is the same at every size. Minima are combined before the
    shuffle; nodes with very many neighbours are joined where their edges lie.
    Each round is written to shared storage, which cuts lineage.
    """
    spark = edges.sparkSession
    e = edges.select(F.greatest(u, v).cast("long").alias("u"), F.least(u, v).cast("long").alias("v")).where("u > v")
    e, path = _write(locally(e, at_once), spark)
    count = F.count(F.lit(1)).alias("k")
    state = None
    while True:
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            break
        state = now
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m"), count).select("u", F.least("u", "m").alias("m"), "k")
        large = shuffled_apart(both, least, "u", "k", 2 * now[0]).where("v > u and v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large, between = _write(large, spark)
        least = large.groupBy("u").agg(F.min("v").alias("m"), count)
        small = shuffled_apart(large, least, "u", "k", now[0]).where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e, new = _write(locally(small.union(least.select("u", F.col("m").alias("v"))).distinct(), at_once), spark)
        drop_dir(spark, path)
        drop_dir(spark, between)
        path = new
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
