"""A correction session over the page store: metadata, pages, texts, and what accepting, normalising and verifying change.

Tables go in and new tables come out; what a point update changes is a join with the
rows that change, so a session of one page and one of a whole book are the same plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fidelmill.functions import normalize
from fidelmill.functions.distance import Costs
from fidelmill.functions.script import fold
from fidelmill.operators import lexicon as lex
from fidelmill.operators import store

# What a new project's metadata hold.
DEFAULTS = {"schema_version": "1", "author": "", "language": "am", "policy": "faithful"}
#: Characters of the longest manual edit that is learned from.
LONGEST_LEARNED = 40


def meta_value(meta: DataFrame, key: str, default: str = "") -> Column:
    """The value of a key of (key, value) rows, as an aggregate."""
    return F.coalesce(F.max(F.when(F.col("key") == key, F.col("value"))), F.lit(default))


def with_defaults(meta: DataFrame, title: str) -> DataFrame:
    """The metadata with a new project's values where a key is missing."""
    spark = meta.sparkSession
    new = spark.createDataFrame(sorted({**DEFAULTS, "title": title}.items()), "key string, value string")
    return meta.unionByName(new.join(meta.select("key"), "key", "left_anti"))


def new_texts(pages: DataFrame) -> DataFrame:
    """Empty text rows of new pages (page_id)."""
    return pages.select("page_id", F.lit("").alias("raw_text"), F.lit("").alias("edited_text"), F.lit(0).alias("version"))


def decoded(pages: DataFrame) -> DataFrame:
    """Stored page rows with missing engine and confidence as empty and 0."""
    return pages.na.fill({"engine": "", "mean_conf": 0.0})


def page_texts(pages: DataFrame, texts: DataFrame) -> DataFrame:
    """page_id, raw_text, edited_text, current of every page; empty where a page has no text row."""
    t = pages.select("page_id").join(texts.select("page_id", "raw_text", "edited_text"), "page_id", "left").na.fill("", ["raw_text", "edited_text"])
    return t.withColumn("current", store.edited_text(F.col("raw_text"), F.col("edited_text")))


def updated(table: DataFrame, changes: DataFrame, key: str = "page_id") -> DataFrame:
    """``table`` with the columns of ``changes`` (key and some of its columns) where a row of its key is there."""
    named = [c for c in changes.columns if c != key]
    new = changes.select(key, *(F.col(c).alias(f"new_{c}") for c in named), F.lit(True).alias("is_new"))
    return table.join(new, key, "left").select(*(F.when(F.col("is_new"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) if c in named else F.col(c) for c in table.columns))


def with_edits(texts: DataFrame, pages: DataFrame, edited: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Texts and pages after edited texts (page_id, text) are stored: versions count up, new and recognized pages come into review."""
    e = edited.select("page_id", F.col("text").alias("new_text"))
    t = texts.join(e, "page_id", "left").withColumn("version", F.col("version") + F.col("new_text").isNotNull().cast("int")).withColumn("edited_text", F.coalesce("new_text", "edited_text")).drop("new_text")
    opened = pages.join(e.select("page_id"), "page_id", "left_semi").where("status in ('new', 'recognized')").select("page_id", F.lit("in_review").alias("status"))
    return t.select(*texts.columns), updated(pages, opened)


def reordered(pages: DataFrame, page_id: int, to: int) -> DataFrame:
    """page_id, idx after one page moves to another place; the pages between move up by one."""
    at = pages.where(F.col("page_id") == page_id).select(F.col("idx").alias("was")).limit(1)
    p = pages.join(F.broadcast(at), how="left")  # one row
    idx, was = F.col("idx"), F.col("was")
    moved = F.when(was.isNull(), idx).when(F.col("page_id") == page_id, to).when((idx >= to) & (idx < was), idx + 1).when((idx > was) & (idx <= to), idx - 1).otherwise(idx)
    return p.select("page_id", moved.cast("int").alias("idx"))


def labels(pages: DataFrame, places: DataFrame) -> DataFrame:
    """page_idx, label of places (page_idx): the page's label, or its number."""
    p = pages.select(F.col("idx").alias("page_idx"), F.nullif("label", F.lit("")).alias("label"))
    return places.join(p, "page_idx", "left").select("page_idx", F.coalesce("label", (F.col("page_idx") + 1).cast("string")).alias("label"))


def first_files(blocks: DataFrame) -> DataFrame:
    """page_id, file: the first file of those (page_id, file_no, file) in which a page stands."""
    return blocks.groupBy("page_id").agg(F.min(F.struct("file_no", "file")).alias("f")).select("page_id", F.col("f.file").alias("file"))


def image_path(root: str, relative: Column) -> Column:
    """Where a page's image lies: beneath the project, or where an absolute path says; null without one."""
    return F.when(F.coalesce(relative, F.lit("")) == "", None).when(F.startswith(relative, F.lit("/")), relative).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), relative))


def safe_name(title: Column) -> Column:
    """A title as a file name: without the characters that file systems reserve, ``book`` if nothing is left."""
    kept = F.trim(F.translate(title, '\\/:*?"<>|', ""))
    return F.when(kept == "", "book").otherwise(kept)


def history(edits: DataFrame, limit: int = 500) -> DataFrame:
    """The latest edits first."""
    return edits.orderBy(F.desc("ts"), F.desc("edit_id")).limit(limit)


def scope(pages: DataFrame, which: str, page_id: int | None = None) -> DataFrame:
    """The pages of a run: ``page``, ``book``, ``unrecognized``, or ``open`` (all but the verified)."""
    where = {"page": F.col("page_id") == F.lit(page_id), "book": F.lit(True), "unrecognized": F.col("status") == "new", "open": F.col("status") != "verified"}
    return pages.where(where[which])


# ---- corrections -----------------------------------------------------------------------------------------------------


def learnable(before: Column, after: Column) -> Column:
    """Whether a manual edit is one to learn from: both sides say something, and neither is long."""
    said = lambda c: (F.trim(c) != "") & (F.length(c) <= LONGEST_LEARNED)
    return said(before) & said(after)


def accepted(corrections: DataFrame, edits: DataFrame, lexicon: DataFrame, learned: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Ledger, lexicon and confusions after corrections (page_id, ts, before, after, source): each is logged and learned, and its unknown words are added."""
    c = corrections.where("before <> after")
    ledger = edits.unionByName(c.select("page_id", "ts", "before", "after", F.lit("accepted").alias("kind"), "source"))
    words = c.select(F.explode(F.split(F.trim("after"), r"\s+")).alias("word")).where("word <> ''").distinct()
    new = lex.known(words, lexicon).where("not known").select("word", F.lit(1).cast("long").alias("freq"))
    both = learned.unionByName(lex.learned(c)).groupBy("observed", "intended").agg(F.sum("n").alias("n"))
    return ledger, lexicon.unionByName(lex.build(new)), both


def normalized(pages: DataFrame, modern: bool = False) -> DataFrame:
    """page_id, text of the pages that normalising changes."""
    p = pages.select("page_id", "text", normalize.normalize(F.col("text"), modern).alias("new"))
    return p.where("new <> text").select("page_id", F.col("new").alias("text"))


def stored_results(words: DataFrame, texts: DataFrame, modern: bool = False) -> tuple[DataFrame, DataFrame]:
    """Texts and word boxes of recognized pages after normalising: boxes keep their offsets only where the text keeps its length."""
    t = texts.select("page_id", "text", normalize.normalize(F.col("text"), modern).alias("new"))
    voided = t.where((F.length("new") != F.length("text")) & (F.col("new") != F.col("text"))).select("page_id", F.lit(True).alias("moved"))
    w = words.join(voided, "page_id", "left")
    off = lambda c: F.when(F.col("moved"), -1).otherwise(F.col(c)).alias(c)
    return t.select("page_id", F.col("new").alias("text")), w.select(*(off(c) if c in ("start", "end") else F.col(c) for c in words.columns))


def verified(pages: DataFrame, page_ids: DataFrame) -> DataFrame:
    """The pages after some (page_id) are marked verified."""
    return updated(pages, page_ids.select("page_id").distinct().withColumn("status", F.lit("verified")))


def under_cursor(places: DataFrame, words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """page_id, at, word, known: the first word whose span holds each place (page_id, at), ends included."""
    j = places.join(words.select("page_id", "start", "end", "word"), "page_id").where("start <= at and at <= end")
    w = j.groupBy("page_id", "at").agg(F.min_by("word", "start").alias("word")).withColumn("folded", fold(F.col("word")))
    forms = lexicon.select("folded").distinct().withColumn("known", F.lit(True))
    return w.join(forms, "folded", "left").select("page_id", "at", "word", F.coalesce("known", F.lit(False)).alias("known"))


# ---- the confusion model ---------------------------------------------------------------------------------------------


def save_model(spark: SparkSession, costs: Costs, path: str) -> None:
    """The model as JSON in one file."""
    spark.createDataFrame([(costs.to_json(),)], "value string").coalesce(1).write.mode("overwrite").text(path, lineSep="\x00")


def load_model(spark: SparkSession, path: str) -> Costs:
    """The model of ``save_model``; nothing learned where there is none."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return Costs()
    return Costs.from_json("".join(r[0] for r in spark.read.text(path, lineSep="\x00").collect()))
