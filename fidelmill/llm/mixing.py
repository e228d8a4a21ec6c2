"""Mixing sources to target weights by repetition rates.

Tokens are summed per source; a source's rate is its target over its tokens.
Each document is emitted floor(rate) times, and once more if a number hashed
from its id and a seed falls below the fraction, so reruns and lost tasks agree.
The draws of one seed can leave a source of few documents off its target, so
every source is summed under ``SEEDS`` seeds at once and takes the one whose sum
is nearest its target. Texts are counted once; what follows reads ids and sizes.

Targets share a budget by weight, capped at ``max_rate`` times the source; what
is over a cap goes to the others by weight. With sources in order of cap/weight
the capped ones are a prefix, so running sums give every target in closed form.

Defined results. Null text: size 0. Null source: a source of its own, last in
order. Source without words: rate 0, taken 0. Null doc_id hashes as the empty
text; repeated rows draw alike. Equally near seeds: the first. Empty table: no
rows. Extra columns pass through ``emit`` whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fidelmill.llm.common import saved, small

WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, pattern: tuple[int, ...] = (3, 1, 2), budget: float = 1.5, max_rate: float = 2.0) -> DataFrame:
    """source, source_size -> target. One row per source goes through the windows, never documents."""
    weight = F.element_at(F.array(*map(F.lit, pattern)), (F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(pattern))) + 1).cast("int"))
    s = sizes.select("source", "source_size", weight.cast("double").alias("w"))
    cap, all_ = F.col("source_size") * F.lit(max_rate), Window.partitionBy()
    order = Window.orderBy((cap / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    s = s.select(
        "*",
        cap.alias("cap"),
        (F.sum("source_size").over(all_) * F.lit(budget)).alias("all"),
        F.coalesce(F.sum(cap).over(before), F.lit(0.0)).alias("capped"),
        (F.sum("w").over(all_) - F.coalesce(F.sum("w").over(before), F.lit(0.0))).alias("rest_w"),
    )
    # the level at which a source would be filled if exactly those before it were capped; the first uncapped one sets it
    level = (F.col("all") - F.col("capped")) / F.col("rest_w")
    s = s.select("*", level.alias("level"), (F.col("w") * level >= F.col("cap")).alias("full"))
    first = F.min(F.when(~F.col("full"), F.struct((F.col("cap") / F.col("w")).alias("r"), F.col("source").isNull().alias("z"), F.col("source").alias("s"), F.col("level")))).over(all_)
    s = s.select("*", first["level"].alias("common"))
    target = F.when(F.col("common").isNull() | (F.col("w") * F.col("common") >= F.col("cap")), F.col("cap")).otherwise(F.col("w") * F.col("common"))
    return s.select("source", "source_size", target.alias("target"))


#: Seeds that a source is summed under: four hashes of an id give four draws each.
SEEDS = 16


def draw(doc_id: Column, seed: int, number: Column | int) -> Column:
    """A number in [0, 1) from the id, the seed and the draw's number; 32 bits of an md5, the same on every engine."""
    number = number if isinstance(number, Column) else F.lit(number)
    key = F.concat((F.floor(number / 4) + seed).cast("string"), F.lit(":"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.md5(key.cast("binary")).substr((number % 4 * 8 + 1).cast("int"), F.lit(8)), 16, 10).cast("double") / F.lit(4294967296.0)


def plan(docs: DataFrame, *, pattern: tuple[int, ...] = (3, 1, 2), budget: float = 1.5, max_rate: float = 2.0, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """doc_id, source, size of every row, and source, source_size, target, rate, number (of the draw) of every source."""
    sizes = saved(docs.select("doc_id", "source", words(F.col("text")).alias("size")), "mix-sizes")
    t = targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), pattern, budget, max_rate)
    t = saved(t.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))), "mix-targets")
    of = small(t.select(F.col("source").alias("of_source"), "rate"))
    rows = sizes.join(of, sizes["source"].eqNullSafe(of["of_source"])).select("source", "doc_id", "size", "rate")
    fraction = F.col("rate") - F.floor("rate")
    taken = [F.sum(F.col("size") * (F.floor("rate") + (draw(F.col("doc_id"), seed, i) < fraction).cast("long"))).alias(f"n{i}") for i in range(SEEDS)]
    sums = rows.groupBy("source").agg(*taken)
    both = t.join(sums.withColumnRenamed("source", "of_source"), F.col("source").eqNullSafe(F.col("of_source")))
    off = F.array(*(F.abs(F.col(f"n{i}") - F.col("target")) for i in range(SEEDS)))
    return sizes, saved(both.select("source", "source_size", "target", "rate", (F.array_position(off, F.array_min(off)) - 1).cast("int").alias("number")), "mix-plan")


def copies(doc_id: Column, rate: Column, number: Column, seed: int) -> Column:
    return F.floor(rate) + (draw(doc_id, seed, number) < rate - F.floor(rate)).cast("long")


def taken(docs: DataFrame, *, seed: int = 42, **options) -> DataFrame:
    """doc_id, size, source_size, target, copies and taken (words the mix takes of the row) of every row."""
    sizes, sources = plan(docs, seed=seed, **options)
    s = small(sources.withColumnRenamed("source", "of_source"))
    rows = sizes.join(s, sizes["source"].eqNullSafe(s["of_source"])).withColumn("copies", copies(F.col("doc_id"), F.col("rate"), F.col("number"), seed))
    return rows.select("doc_id", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def emit(docs: DataFrame, *, seed: int = 42, **options) -> DataFrame:
    """The mix itself: each row as often as it is taken, in the columns of ``docs``, whatever their names."""
    _, sources = plan(docs, seed=seed, **options)
    s = small(sources.withColumnRenamed("source", "of_source"))
    held = docs.select("doc_id", "source", F.struct("*").alias("row"))
    rows = held.join(s, held["source"].eqNullSafe(s["of_source"])).select("row", copies(F.col("doc_id"), F.col("rate"), F.col("number"), seed).alias("copies"))
    rows = rows.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return rows.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


ORACLE = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, (CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END)::DOUBLE AS w FROM s),
r AS (SELECT *, source_size * 2.0::DOUBLE AS cap, sum(source_size) OVER () * 1.5::DOUBLE AS "all",
  coalesce(sum(source_size * 2.0::DOUBLE) OVER (ORDER BY source_size * 2.0::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
  sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY source_size * 2.0::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest_w FROM w),
l AS (SELECT *, ("all" - capped) / rest_w AS level FROM r),
c AS (SELECT (SELECT level FROM l WHERE w * level < cap ORDER BY cap / w, source NULLS LAST LIMIT 1) AS common),
t AS (SELECT source, source_size, CASE WHEN common IS NULL OR w * common >= cap THEN cap ELSE w * common END AS target FROM l, c),
m AS (SELECT d.doc_id, d.size, t.source, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
u AS (SELECT *, i, size * (floor(rate) + (('0x' || substr(md5((42 + i // 4)::VARCHAR || ':' || coalesce(doc_id::VARCHAR, '')), i % 4 * 8 + 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE < rate - floor(rate))::INT) AS n
  FROM m, range(16) r(i)),
b AS (SELECT source, i FROM (SELECT source, i, row_number() OVER (PARTITION BY source ORDER BY abs(sum(n) - any_value(target)), i) AS k FROM u GROUP BY source, i) WHERE k = 1)
SELECT doc_id, size, source_size, target, n::BIGINT AS taken FROM u JOIN b ON u.source IS NOT DISTINCT FROM b.source AND u.i = b.i
"""
