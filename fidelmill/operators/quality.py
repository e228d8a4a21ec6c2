"""Page and book quality: rates, score, grade, flags, worst-first review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fidelmill.functions import script
from fidelmill.operators.lexicon import unknown_rates
from fidelmill.operators.tokens import characters

# Fixed values of the score, the grades and the flags.
GRADES = ((0.92, "excellent"), (0.82, "good"), (0.65, "needs review"))


def score(words: Column, status: Column, unknown: Column, conf: Column, ratio: Column, high: Column, suspects: Column) -> Column:
    lexical = 1 - F.least(F.lit(1.0), unknown)
    penalty = F.least(F.lit(0.35), 0.02 * high + 0.05 * suspects)
    full = F.greatest(F.lit(0.0), 0.5 * lexical + 0.25 * F.when(conf > 0, conf).otherwise(0.75) + 0.25 * ratio - penalty)
    return F.when(words > 0, full).otherwise(F.when(status == "skipped", 1.0).otherwise(0.0))


def grade(score: Column) -> Column:
    out = None
    for least, name in GRADES:
        out = F.when(score >= least, name) if out is None else out.when(score >= least, name)
    return out.otherwise("poor")


def page_quality(pages: DataFrame, lexicon: DataFrame, issues: DataFrame | None = None, affixes: bool = True, seen: DataFrame | None = None) -> DataFrame:
    """A row of figures for each page (page_id, text, status, mean_conf): see the last select."""
    bad = f"[{script.classes()['other_ethiopic']}]"
    p = pages.select(
        "page_id", "status", "mean_conf", F.length("text").alias("n_chars"), script.ethiopic_ratio(F.col("text")).alias("ratio"), F.col("text").rlike(r"\S").alias("inked"),
        F.regexp_count("text", F.lit(bad)).alias("n_suspect"), F.size(F.array_distinct(F.regexp_extract_all("text", F.lit(bad), F.lit(0)))).alias("suspect_kinds"),
    )
    p = p.join(unknown_rates(pages, lexicon, affixes, seen), "page_id", "left").na.fill(0, ["n_words", "n_unknown"])
    if issues is not None:
        counts = issues.groupBy("page_id").agg(F.count_if(F.col("severity") == "high").alias("high"), F.count_if(F.col("kind") == "run_together").alias("run"))
        p = p.join(counts, "page_id", "left").na.fill(0, ["high", "run"])
    else:
        p = p.withColumn("high", F.lit(0)).withColumn("run", F.lit(0))
    p = p.withColumn("unknown_rate", F.when(F.col("n_words") > 0, F.col("n_unknown") / F.col("n_words")).otherwise(0.0))
    p = p.withColumn("score", score(*(F.col(c) for c in ("n_words", "status", "unknown_rate", "mean_conf", "ratio", "high", "suspect_kinds"))))
    c = F.col
    flags = F.array(
        F.when((c("n_words") > 0) & (c("unknown_rate") > 0.4), "very high unknown-word rate"),
        F.when((c("ratio") < 0.6) & (c("n_words") > 5), "mostly non-Ethiopic text"),
        F.when(c("n_suspect") > 0, F.concat(c("n_suspect").cast("string"), F.lit(" impossible characters"))),
        F.when((c("n_words") > 0) & (c("n_chars") / F.greatest(c("n_words"), F.lit(1)) > 24), "very long words — word separators may be missing"),
        F.when((c("mean_conf") > 0) & (c("mean_conf") < 0.6), "low recognizer confidence"),
        F.when(c("run") > 0, "run-together words"),
        F.when((c("n_chars") > 0) & ~c("inked"), "blank"),
    )
    return p.select("page_id", "status", "n_chars", "n_words", "unknown_rate", "mean_conf", "ratio", "score", "high", grade(c("score")).alias("grade"), F.array_join(F.filter(flags, lambda x: x.isNotNull()), "; ").alias("flags"))


def worst_pages(quality: DataFrame, limit: int = 20) -> DataFrame:
    """The report's first ``limit`` pages: not verified, with words, the lowest score first."""
    return quality.where("status <> 'verified' and n_words > 0").orderBy("score", "page_id").limit(limit)


def book_quality(quality: DataFrame, book: str | None = None) -> DataFrame:
    """Totals of all pages, or of each book."""
    g = quality.groupBy(book) if book else quality.groupBy()
    words = F.col("n_words") > 0
    return g.agg(
        F.count(F.lit(1)).alias("n_pages"), F.sum("n_words").alias("n_words"), F.sum("n_chars").alias("n_chars"), F.coalesce(F.avg(F.when(words, F.col("score"))), F.lit(0.0)).alias("mean_score"),
        F.coalesce(F.try_divide(F.sum(F.col("unknown_rate") * F.col("n_words")), F.sum("n_words")), F.lit(0.0)).alias("unknown_rate"), F.count_if(F.col("status") == "verified").alias("verified"),
    )


def histogram(pages: DataFrame) -> DataFrame:
    return characters(pages).groupBy("ch").agg(F.count(F.lit(1)).alias("n"))


def rare_characters(hist: DataFrame, most: int = 3) -> DataFrame:
    return hist.where((F.col("n") <= most) & F.col("ch").rlike(f"[{script.classes()['syllable']}]"))


def impossible_characters(hist: DataFrame) -> DataFrame:
    return hist.where(F.col("ch").rlike(f"[{script.classes()['other_ethiopic']}]"))


def percent(share: Column) -> Column:
    """A share as whole per cent; halves round to even."""
    return F.concat(F.bround(share * 100).cast("int").cast("string"), F.lit("%"))


def described(label: Column, quality: DataFrame) -> DataFrame:
    """page_id, line: a page's label, grade, score, unknown words and flags in words."""
    flags = F.when(F.col("flags") != "", F.concat(F.lit(", flags: "), F.replace("flags", F.lit("; "), F.lit(", ")))).otherwise("")
    return quality.select("page_id", F.concat(label, F.lit(": "), F.col("grade"), F.lit(" ("), percent(F.col("score")), F.lit(") — "), percent(F.col("unknown_rate")), F.lit(" unknown words, "), F.col("n_words").cast("string"), F.lit(" words"), flags).alias("line"))


def summary(book: DataFrame) -> Column:
    """One line about a book's totals."""
    return F.concat(
        F.col("n_pages").cast("string"), F.lit(" pages · quality "), percent(F.col("mean_score")), F.lit(" · "), F.format_string("%.1f", F.col("unknown_rate") * 100), F.lit("% unknown words · "),
        F.col("verified").cast("string"), F.lit("/"), F.col("n_pages").cast("string"), F.lit(" verified"),
    )


def list_rows(pages: DataFrame, quality: DataFrame) -> DataFrame:
    """page_id, line: a page's label with its grade and unknown words, or with its status where nothing was assessed."""
    q = quality.where("n_words > 0").select("page_id", F.concat(F.col("grade"), F.lit(" · "), percent(F.col("unknown_rate")), F.lit(" unknown")).alias("second"))
    return pages.select("page_id", "label", "status").join(q, "page_id", "left").select("page_id", F.concat("label", F.lit("\n"), F.coalesce("second", F.replace("status", F.lit("_"), F.lit(" ")))).alias("line"))


def readiness(n_lines: Column) -> Column:
    """What the number of training lines is enough for."""
    return F.when(n_lines < 150, F.concat(F.lit("Verify more pages — about "), (150 - n_lines).cast("string"), F.lit(" more lines needed before fine-tuning pays off."))).when(
        n_lines < 600, "Enough to fine-tune. Expect a solid gain on this book's typeface."
    ).otherwise("Plenty of training data. Fine-tuning should give a large gain.")


def heat(confidence: Column) -> Column:
    """The colour class of a confidence."""
    return F.when(confidence >= 0.90, "verified").when(confidence >= 0.75, "low").when(confidence >= 0.55, "medium").otherwise("high")


def confidence(score: Column) -> Column:
    """A suggestion's cost as a confidence from 0 to 1."""
    return 1 / (1 + F.greatest(F.lit(0.0), score))
