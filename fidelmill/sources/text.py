"""Readers: page texts, word lists, recognizer tables, dumps; boilerplate and text-layer probes."""

from __future__ import annotations

import io
import lzma
from collections.abc import Callable
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fidelmill.functions import script

#: Where a text breaks into pages; ``(?d)`` keeps line ends to \n.
PAGE_BREAK = r"(?idm)\f|^\s*(?:---+\s*page\s*\d*\s*---+|\[page\s*\d+\])\s*$"
# Fixed values of the text-layer probe.
LEAST_RATIO, LEAST_CHARS, SHARE, SAMPLE = 0.30, 120, 0.6, 8


def page_chunks(text: Column, lines_per_page: int = 0) -> Column:
    """The page texts of one imported text. Without page breaks it is groups of ``lines_per_page`` lines, or one page."""
    parts = F.filter(F.split(text, PAGE_BREAK), lambda s: F.regexp_replace(s, r"\s", "") != "")
    whole = F.when(F.size(parts) > 0, parts).otherwise(F.array(text))
    if lines_per_page > 0:
        lines = F.split(text, "\n", -1)
        first = F.sequence(F.lit(1), F.size(lines), F.lit(lines_per_page))
        groups = F.transform(first, lambda i: F.array_join(F.slice(lines, i, F.lit(lines_per_page)), "\n"))
        whole = F.when(F.size(parts) <= 1, groups).otherwise(whole)
    return F.transform(whole, lambda s: F.regexp_replace(s, r"^\n+|\n+$", ""))


def import_pages(texts: DataFrame, key: str, lines_per_page: int = 0) -> DataFrame:
    """key, idx, label, text, status of every page of every text."""
    p = texts.select(key, F.posexplode(page_chunks(F.col("text"), lines_per_page)).alias("idx", "text"))
    return p.select(key, "idx", F.concat(F.lit("p. "), (F.col("idx") + 1).cast("string")).alias("label"), "text", F.lit("recognized").alias("status"))


# File endings of each kind, in the order in which a mixed drop is imported.
ENDINGS = {"images": ("png", "jpg", "jpeg", "tif", "tiff", "bmp", "webp"), "pdf": ("pdf",), "text": ("txt", "text", "md")}


def kind_of(name: Column) -> Column:
    """images, pdf or text by a file's ending, null for others."""
    ending = F.lower(F.regexp_extract(name, r"\.([^./]*)$", 1))
    out = F.lit(None).cast("string")
    for kind, endings in ENDINGS.items():
        out = F.when(ending.isin(*endings), kind).otherwise(out)
    return out


def dispatched(files: DataFrame) -> DataFrame:
    """name, kind, seq of the files that can be imported: images in natural order, then the others in order of their kind and as given (pos)."""
    f = files.withColumn("kind", kind_of(F.col("name"))).where("kind is not null")
    order = F.array_position(F.array(*map(F.lit, ENDINGS)), F.col("kind"))
    w = Window.orderBy(order, F.when(F.col("kind") == "images", natural_key(F.regexp_replace("name", r"\.[^.]*$", ""))).otherwise(""), "pos")
    return f.select("name", "kind", (F.row_number().over(w) - 1).alias("seq"))  # one row a file of one drop


def needs_recognition(kind: Column, pages: Column) -> Column:
    """Whether what was imported has images and no text."""
    return (pages > 0) & kind.isin("images", "pdf_scanned")


def read_lines_xz(spark: SparkSession, path: str) -> DataFrame:
    """text: the lines of xz files, each file read by one task as a stream."""

    def run(batches):
        for batch in batches:
            for content in batch.column(0).to_pylist():
                with lzma.open(io.BytesIO(content), "rt", encoding="utf-8", errors="replace") as f:
                    while lines := list(islice(f, 10_000)):
                        yield pa.RecordBatch.from_pydict({"text": [x.rstrip("\n") for x in lines]})

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "text string")


def shards(names: DataFrame) -> DataFrame:
    """The names of a listing that are shards of clean documents, in order."""
    return names.where(F.col("name").contains("clean_docs") & F.col("name").endswith(".jsonl.gz")).select("name").distinct().orderBy("name")


#: Readers by the name of a source; ``register`` adds one.
READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(name: str, reader: Callable[[SparkSession, str], DataFrame]) -> None:
    READERS[name] = reader


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """path, text of whole files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_wordlist(spark: SparkSession, path: str) -> DataFrame:
    """surface, freq of a tab-separated list, gzip or not; comments and empty words are left out, a missing or bad count is 1."""
    cut = F.split("value", "\t")
    rows = spark.read.text(path).where("not startswith(value, '#')").select(cut[0].alias("surface"), F.coalesce(F.expr("try_cast(get(split(value, '\t'), 1) as int)"), F.lit(1)).alias("freq"))
    return rows.where("trim(surface) <> ''")


def write_wordlist(counts: DataFrame, path: str, least: int = 2, limit: int | None = None) -> None:
    """The words of at least that frequency, the commonest first, as a gzip table."""
    rows = counts.where(F.col("freq") >= least).orderBy(F.desc("freq"), "word")
    (rows.limit(limit) if limit else rows).select("word", "freq").write.csv(path, sep="\t", compression="gzip")


def read_jsonl(spark: SparkSession, path: str, field: str = "text") -> DataFrame:
    return spark.read.schema(f"{field} string").json(path, mode="DROPMALFORMED").where(F.col(field).isNotNull()).select(F.col(field).alias("text"))


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    """text of the pages of a wiki dump."""
    return spark.read.format("xml").option("rowTag", "page").schema("revision struct<text:string>").load(path).select("revision.text")


def recognizer_words(rows: DataFrame) -> DataFrame:
    """line_idx, word_idx, text, box and confidence of a recognizer's table (key, row_no, level, block_num, par_num, line_num, left, top, width, height, conf, text)."""
    r = rows.where("level = 5 and trim(text) <> ''")
    first = F.min("row_no").over(Window.partitionBy("key", "page_num", "block_num", "par_num", "line_num"))
    r = r.withColumn("first", first).withColumn("line_idx", F.dense_rank().over(Window.partitionBy("key").orderBy("first")) - 1)
    word = F.row_number().over(Window.partitionBy("key", "line_idx").orderBy("row_no")) - 1
    return r.select("key", "line_idx", word.alias("word_idx"), "text", F.col("left").alias("x"), F.col("top").alias("y"), F.col("width").alias("w"), F.col("height").alias("h"), (F.greatest(F.lit(0.0), F.col("conf").cast("double")) / 100).alias("conf"))


def natural_key(name: Column) -> Column:
    """A string that sorts numbers in names by value."""
    return F.array_join(F.transform(F.regexp_extract_all(name, F.lit(r"\d+|\D+"), F.lit(0)), lambda s: F.when(s.rlike(r"^\d"), F.lpad(s, 20, "0")).otherwise(F.lower(s))), "")


#: Templates, tables, references, tags, links and signs of a wiki's source.
WIKI_NOISE = r"(?s)\{\{[^{}]*\}\}|\{\|.*?\|\}|<ref[^>]*/>|<ref.*?</ref>|<!--.*?-->|<[^<>]+>|\[\[(?:File|Image|Category)[^\[\]]*\]\]|\[https?://[^\]\s]+\s?|https?://\S+|'{2,}|={2,}|&[a-z]+;"


def strip_wiki(text: Column, passes: int = 3) -> Column:
    """Text without templates, tables, references, tags and link brackets; nested ones need several passes."""
    for _ in range(passes):
        text = F.regexp_replace(text, WIKI_NOISE, " ")
    return text


def boilerplate(pages: DataFrame, book: str = "book", share: float = SHARE) -> DataFrame:
    """book, line: lines on at least that share of a book's pages (three at least); none for books of fewer than three."""
    n = pages.groupBy(book).agg(F.count(F.lit(1)).alias("pages"))
    line = F.explode(F.array_distinct(F.filter(F.transform(F.split("text", r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")))
    counts = pages.select(book, line.alias("line")).groupBy(book, "line").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(n, book).where("pages >= 3").where(F.col("n") >= F.greatest(F.lit(3), F.floor(F.col("pages") * F.lit(share)))).select(book, "line", "n")


def strip_boilerplate(pages: DataFrame, lines: DataFrame, book: str = "book") -> DataFrame:
    """The pages without their book's boilerplate lines; pages are cut at all line ends, as lines are counted.

    A line is boilerplate on a share of a book's pages, so a book has at most a page's lines over that share of them.
    """
    drop = lines.groupBy(book).agg(F.collect_set("line").alias("drop"))
    trimmed = lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda s: ~F.array_contains("drop", trimmed(s))), "\n")
    return pages.join(drop, book, "left").withColumn("text", F.when(F.col("drop").isNull(), F.col("text")).otherwise(kept)).drop("drop")


def imported_ratio(text: Column) -> Column:
    """Share of the letters that are of the script's main block or its extension: narrower than the ratio of a page's quality."""
    letters, own = script.letter_counts(text, script.main_letters())
    return F.when(letters > 0, own / letters).otherwise(F.lit(0.0))


def sampled(pages: DataFrame, book: str = "book", size: int = SAMPLE) -> DataFrame:
    """The pages (book, idx) of each book whose places are spread evenly over it, ``size`` at most."""
    n = pages.groupBy(book).agg(F.count(F.lit(1)).alias("n_pages"))
    places = F.when(F.col("n_pages") <= size, F.sequence(F.lit(0), F.col("n_pages") - 1)).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.least(F.floor(i * F.col("n_pages") / size), F.col("n_pages") - 1))))
    return pages.join(n.select(book, "n_pages", F.explode(places).alias("idx")), [book, "idx"])


def probe(pages: DataFrame, book: str = "book") -> DataFrame:
    """book, pages, sampled, boilerplate, chars_per_page, ratio, usable, reason of books' text layers (book, idx, text).

    Only a sample of each book is read. Lines that most of it share are stamps and
    are left out, unless nothing else is there. A layer is usable if it has enough
    text, and of the script.
    """
    some = sampled(pages, book)
    stamps = boilerplate(some, book)
    cut = strip_boilerplate(some, stamps, book).withColumn("left", F.regexp_replace("text", r"^[\s]+|[\s]+$", ""))
    whole = some.select(book, "idx", F.regexp_replace("text", r"^[\s]+|[\s]+$", "").alias("plain"))
    s = F.sort_array(F.collect_list(F.struct("idx", "left", "plain")))  # at most SAMPLE pages a book
    g = cut.select(book, "idx", "left", "n_pages").join(whole, [book, "idx"]).groupBy(book).agg(F.max("n_pages").alias("pages"), F.count(F.lit(1)).alias("sampled"), s.alias("s"))
    texts = F.when(F.exists("s", lambda x: x["left"] != ""), F.transform("s", lambda x: x["left"])).otherwise(F.transform("s", lambda x: x["plain"]))
    g = g.withColumn("joined", F.array_join(texts, "\n")).withColumn("chars_per_page", F.length("joined") / F.col("sampled")).withColumn("ratio", imported_ratio(F.col("joined")))
    lines = stamps.groupBy(book).agg(F.array_sort(F.collect_list("line")).alias("boilerplate"))
    g = g.join(lines, book, "left").withColumn("boilerplate", F.coalesce("boilerplate", F.array().cast("array<string>")))
    reason = F.when((F.col("chars_per_page") < LEAST_CHARS) & (F.size("boilerplate") > 0), "stamp").when(F.col("chars_per_page") < LEAST_CHARS, "too little").when(F.col("ratio") < LEAST_RATIO, "other script").otherwise("usable")
    return g.select(book, "pages", "sampled", "boilerplate", "chars_per_page", "ratio", (reason == "usable").alias("usable"), reason.alias("reason"))


register("text", read_texts)
register("wordlist", read_wordlist)
register("jsonl", read_jsonl)
register("dump", read_dump)
register("lines", read_lines_xz)
