"""Issue detectors: each a DataFrame of (page_id, start, end, kind, severity, word, suggestion, score, verified, gap, observed_known).

``gap`` is how far the second suggestion's score lies behind the first's, null without a second.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fidelmill.functions import distance, normalize, script
from fidelmill.operators import lexicon as lex
from fidelmill.operators.tokens import context_table, match_table
from fidelmill.runtime import saved

COLUMNS = ("page_id", "start", "end", "kind", "severity", "word", "suggestion", "score", "verified", "gap", "observed_known")
SEVERITIES = ("high", "medium", "low")


def _issue(df: DataFrame, kind: str, severity: Column | str, word: Column, suggestion: Column | None = None, score: float | Column | None = None, verified: bool | Column = False, gap: Column | None = None, observed_known: Column | None = None) -> DataFrame:
    s = severity if isinstance(severity, Column) else F.lit(severity)
    none = F.lit(None)
    return df.select(
        "page_id", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), F.lit(kind).alias("kind"), s.alias("severity"), word.alias("word"),
        (suggestion if suggestion is not None else none).cast("string").alias("suggestion"), (F.lit(score) if score is not None and not isinstance(score, Column) else score if score is not None else none).cast("double").alias("score"), (verified if isinstance(verified, Column) else F.lit(verified)).alias("verified"),
        (gap if gap is not None else none).cast("double").alias("gap"), (observed_known if observed_known is not None else F.lit(False)).alias("observed_known"),
    )


def suspect_characters(pages: DataFrame) -> DataFrame:
    """Invisible characters, and those of the script's other blocks."""
    other = "".join(f"\\U{a:08X}-\\U{b:08X}" for a, b in script.OTHER_BLOCKS)
    invisible = match_table(pages, f"[{normalize.INVISIBLE}]")
    a = _issue(invisible, "suspect_character", "high", F.col("m"), F.lit(""), 0.0, True)
    return a.union(_issue(match_table(pages, f"[{other}]"), "non_amharic_script", "high", F.col("m")))


def mixed_script(words: DataFrame) -> DataFrame:
    n = lambda p: F.regexp_count("word", F.lit(p))
    own, latin = n(f"[{script.classes()['ethiopic']}]"), n("[A-Za-z]")
    return _issue(words.where((F.length("word") >= 2) & (own > 0) & (latin > 0) & (own >= latin)), "mixed_script", "high", F.col("word"))


#: Ge'ez marks that may be doubled or lead a line (Python classes: matches are cut in Arrow batches).
MARKS = "[\u1362-\u1368]"


def punctuation(pages: DataFrame) -> DataFrame:
    """A mark doubled, a mark that leads a line, a colon on its own."""
    doubled = _issue(match_table(pages, f"({MARKS})\\1+"), "punctuation", "medium", F.col("m"), F.substring("m", 1, 1), 0.1, True)
    leading = _issue(match_table(pages, f"(?m)^[ \t]*({MARKS})", 1), "punctuation", "low", F.col("m"))
    colon = _issue(match_table(pages, f"(?<={normalize.OWN})\\s+:\\s+"), "punctuation", "medium", F.col("m"), F.lit(script.WORDSPACE), 0.05, True)
    return doubled.union(leading).union(colon)


def _next(words: DataFrame) -> DataFrame:
    """The words with the one after each, which ``context_table`` gives where a page lies."""
    if "next" in words.columns:
        return words
    w = Window.partitionBy("page_id").orderBy("word_no")
    return words.select("*", F.lead("word").over(w).alias("next"), F.lead("end").over(w).alias("next_end"))


def repeated_words(words: DataFrame) -> DataFrame:
    r = _next(words).where((F.col("word") == F.col("next")) & (F.length("word") >= 2)).withColumn("end", F.col("next_end"))
    return _issue(r, "repeated_word", "low", F.concat_ws(" ", "word", "next"), F.col("word"), 0.3)


def unknown_words(words: DataFrame, recognized: DataFrame, ranked: DataFrame | None = None) -> DataFrame:
    """Words of the script that are not recognised; with ranked candidates (of each place) the best of them."""
    u = words.where((F.length("word") >= 2) & F.col("word").rlike(f"[{script.classes()['ethiopic']}]")).join(recognized.where("not known").select("word"), "word")
    if ranked is None:
        return _issue(u, "unknown_word", "medium", F.col("word"))
    place = ["page_id", "word_no", "word"]
    at = lambda r: F.max(F.when(F.col("rank") == r, F.struct("surface", "score")))
    best = ranked.where("rank <= 2").groupBy(*place).agg(at(1).alias("first"), at(2).alias("second"))
    u = u.join(best.select(*place, "first.surface", F.col("first.score").alias("best"), (F.col("second.score") - F.col("first.score")).alias("gap")), place, "left")
    severity = F.when(F.col("best") < 0.4, "high").otherwise("medium")
    out = _issue(u, "unknown_word", severity, F.col("word"), F.col("surface"), F.col("best"), gap=F.col("gap"))
    return out.withColumn("verified", F.col("suggestion").isNotNull())


def split_words(words: DataFrame, known: DataFrame, lexicon: DataFrame, affixes: bool = True) -> DataFrame:
    """Neighbours that are one known word together, and not both known apart. ``known`` covers the single words."""
    k = known.select(F.col("word").alias("k"), "known")
    p = _next(words).where("next is not null")
    p = p.join(k.withColumnsRenamed({"k": "word", "known": "known1"}), "word").join(k.withColumnsRenamed({"k": "next", "known": "known2"}), "next").where("not (known1 and known2)")
    p = p.withColumn("joined", F.concat("word", "next")).where(F.length("joined") >= 3)
    p = saved(p.select("page_id", "start", F.col("next_end").alias("end"), "word", "next", "joined"), "unknown-pairs")
    whole = lex.recognized(p.select(F.col("joined").alias("word")), lexicon, affixes).where("known").select(F.col("word").alias("joined"))
    p = p.join(whole, "joined", "left_semi")
    return _issue(p, "split_word", "medium", F.concat_ws(" ", "word", "next"), F.col("joined"), 0.2, True)


def run_together(words: DataFrame, known: DataFrame, lexicon: DataFrame, affixes: bool = True) -> DataFrame:
    """Unknown words that some cut leaves as two known ones; the first such cut."""
    u = known.where("not known").select("word").where(F.length("word") >= 4)
    word = F.col("word")
    cuts = u.select("word", F.explode(F.sequence(F.lit(2), F.length("word") - 2)).alias("cut"))
    cuts = cuts.select("word", "cut", word.substr(F.lit(1), F.col("cut")).alias("left"), word.substr(F.col("cut") + 1, F.length("word")).alias("right"))
    parts = cuts.select(F.col("left").alias("word")).union(cuts.select("right"))
    real = lex.recognized(parts, lexicon, affixes).where("known").select("word")
    cuts = cuts.join(real.withColumnRenamed("word", "left"), "left", "left_semi").join(real.withColumnRenamed("word", "right"), "right", "left_semi")
    first = cuts.groupBy("word").agg(F.min_by(F.concat_ws(" ", "left", "right"), "cut").alias("apart"))
    return _issue(words.join(first, "word"), "run_together", "medium", F.col("word"), F.col("apart"), 0.25, True)


def low_confidence(readings: DataFrame, known: DataFrame, threshold: float = 0.72) -> DataFrame:
    """Readings (page_id, start, end, word, conf) below the threshold."""
    r = readings.where((F.col("conf") < threshold) & (F.trim("word") != "")).join(known, "word")
    return _issue(r, "low_confidence", F.when(~F.col("known") & (F.col("conf") < 0.5), "medium").otherwise("low"), F.col("word"))


def disagreements(readings: DataFrame, lexicon: DataFrame, affixes: bool = True) -> DataFrame:
    """Words that another reader read otherwise: (page_id, start, end, word, reading), a row for each of the other readings.

    A reading that is no word is no rival of one that is. Best is the cheapest, a known one 0.5 cheaper.
    """
    r = readings.where("reading <> '' and reading <> word").select("page_id", "start", "end", "word", "reading").distinct()
    r = saved(r, "other-readings")
    every = lex.recognized(r.select("word").union(r.select("reading")), lexicon, affixes)
    r = r.join(every.select("word", F.col("known").alias("k")), "word").join(every.select(F.col("word").alias("reading"), "known"), "reading").where("known or not k")
    costs = r.select("word", "reading").distinct().withColumn("d", distance.distance(F.col("word"), F.col("reading")))
    r = r.join(costs, ["word", "reading"]).withColumn("s", F.struct((F.col("d") - F.when(F.col("known"), 0.5).otherwise(0.0)).alias("score"), "reading", "known"))
    s = F.sort_array(F.collect_list("s"))
    g = r.groupBy("page_id", "start", "end", "word", "k").agg(s.alias("s"))
    g = g.select("*", F.col("s")[0].alias("best"), (F.try_element_at("s", F.lit(2))["score"] - F.col("s")[0]["score"]).alias("gap"))
    return _issue(g, "engine_disagreement", F.when(F.col("k"), "medium").otherwise("high"), F.col("word"), F.col("best.reading"), F.col("best.score"), gap=F.col("gap"), observed_known=F.col("k"), verified=F.col("best.known"))


def deduplicated(*issues: DataFrame) -> DataFrame:
    """One issue a span: by severity, then a verified suggestion, any suggestion, the score; the kind breaks ties."""
    every = reduce(DataFrame.unionByName, issues)
    rank = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))
    order = [rank, F.when(F.col("suggestion").isNotNull() & F.col("verified"), 0).otherwise(1), F.col("suggestion").isNull().cast("int"), F.coalesce("score", F.lit(999.0)), F.col("kind"), F.coalesce("suggestion", F.lit(""))]
    n = F.row_number().over(Window.partitionBy("page_id", "start", "end").orderBy(*order))
    return every.withColumn("n", n).where("n = 1").drop("n")


def auto_applied(pages: DataFrame, issues: DataFrame, most: float = 0.35, least_gap: float = 0.25) -> DataFrame:
    """page_id, text, applied: sure suggestions (cheap, well ahead of the second, for no known word) spliced in from the right; of overlapping spans the first stays."""
    sure = issues.where(auto_applicable(most, least_gap))
    w = Window.partitionBy("page_id").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    sure = sure.withColumn("reach", F.coalesce(F.max("end").over(w), F.lit(0))).where("start >= reach")
    spans = sure.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("start", "end", "suggestion")), asc=False).alias("spans"))
    splice = F.aggregate("spans", F.col("text"), lambda t, s: F.concat(t.substr(F.lit(1), s["start"]), s["suggestion"], t.substr(s["end"] + 1, F.length(t))))
    return pages.join(spans, "page_id").select("page_id", splice.alias("text"), F.size("spans").alias("applied"))


def reranked(words: DataFrame, ranked: DataFrame, pairs: DataFrame, weight: float = 0.25, most: int = 6) -> DataFrame:
    """page_id, word_no, word, rank, surface, score: candidates by score less the weight of pairs with the neighbours."""
    w = Window.partitionBy("page_id").orderBy("word_no")
    before, after = (F.col("previous"), F.col("next")) if "next" in words.columns else (F.lag("word").over(w), F.lead("word").over(w))
    c = words.select("page_id", "word_no", "word", script.fold(before).alias("before"), script.fold(after).alias("after")).join(ranked.select("word", "surface", "score"), "word")
    c = c.withColumn("folded", script.fold(F.col("surface")))
    left = pairs.select(F.col("w1").alias("before"), F.col("w2").alias("folded"), F.col("freq").alias("f1"))
    right = pairs.select(F.col("w1").alias("folded"), F.col("w2").alias("after"), F.col("freq").alias("f2"))
    c = c.join(left, ["before", "folded"], "left").join(right, ["folded", "after"], "left")
    c = c.withColumn("score", F.col("score") - weight * F.log1p(F.coalesce("f1", F.lit(0)) + F.coalesce("f2", F.lit(0))))
    rank = F.row_number().over(Window.partitionBy("page_id", "word_no").orderBy("score", "surface"))
    return c.withColumn("rank", rank).where(F.col("rank") <= most).select("page_id", "word_no", "word", "rank", "surface", "score")


def next_issue(cursors: DataFrame, issues: DataFrame, back: bool = False) -> DataFrame:
    """page_id, at, start: the first issue after each place, else the page's first; backwards the last before it, else the last."""
    pick = F.max if back else F.min
    ends = issues.groupBy("page_id").agg(pick("start").alias("end_one"))
    near = cursors.join(issues.select("page_id", "start"), "page_id").where("start < at" if back else "start > at").groupBy("page_id", "at").agg(pick("start").alias("near"))
    return cursors.join(ends, "page_id").join(near, ["page_id", "at"], "left").select("page_id", "at", F.coalesce("near", "end_one").alias("start"))


def at_offset(places: DataFrame, issues: DataFrame) -> DataFrame:
    """page_id, at, start, kind: the first issue whose span holds each place (page_id, at), ends included."""
    j = places.join(issues.select("page_id", "start", "end", "kind"), "page_id").where("start <= at and at <= end")
    return j.groupBy("page_id", "at").agg(F.min(F.struct("start", "end", "kind")).alias("i")).select("page_id", "at", "i.start", "i.kind")


def totals(issues: DataFrame) -> DataFrame:
    """severity, n, n_auto: issues of each severity, and those that may be applied without asking."""
    return issues.groupBy("severity").agg(F.count(F.lit(1)).alias("n"), F.count_if(auto_applicable()).alias("n_auto"))


def auto_applicable(most: float = 0.35, least_gap: float = 0.25) -> Column:
    """Whether an issue's best suggestion is corroborated, cheap, well ahead of the second, and replaces no known word."""
    return F.col("verified") & (F.col("score") <= most) & (F.col("gap").isNull() | (F.col("gap") >= least_gap)) & ~F.col("observed_known")


def explained(source: Column, observed: Column, candidate: Column) -> Column:
    """Why a candidate was found: the vowels that differ, or what kind of likeness it is."""
    rows = F.create_map(*(x for c, (row, _) in script.syllables().items() for x in (F.lit(c), F.lit(row))))
    both = F.filter(F.arrays_zip(F.split(observed, "").alias("a"), F.split(candidate, "").alias("b")), lambda p: p["a"].isNotNull() & p["b"].isNotNull() & (p["a"] != p["b"]))
    vowels = F.transform(F.filter(both, lambda p: F.try_element_at(rows, p["a"]) == F.try_element_at(rows, p["b"])), lambda p: F.concat(p["a"], F.lit("→"), p["b"]))
    order = F.when(F.size(vowels) > 0, F.concat(F.lit("Vowel order: "), F.array_join(vowels, ", "))).otherwise("Same consonant skeleton")
    return F.when(source == "order", order).when(source == "family", "Visually similar consonant").when(source == "indel", "A character was added or lost").otherwise(source)


def detected(pages: DataFrame, lexicon: DataFrame, affixes: bool = True, suggest: bool = False, readings: DataFrame | None = None, known: DataFrame | None = None) -> DataFrame:
    """All detectors, one issue a span; with ``suggest`` unknown words get candidates in their context, with ``readings`` those of other readers are compared.

    ``known`` is the recognition of the pages' words, if it is at hand. Words with
    their places, recognition and candidates are kept: each is read more than once.
    """
    words = saved(context_table(pages), "placed-words")
    if known is None:
        known = saved(lex.recognized(words, lexicon, affixes), "recognized-words")
    ranked = None
    if suggest:
        best = saved(lex.candidates(known.where("not known"), lexicon, most=12, cutoff=1.3), "candidates")
        ranked = saved(reranked(words, best, bigrams_of(words)).where("rank <= 2"), "reranked")
    found = [
        suspect_characters(pages), mixed_script(words), punctuation(pages), repeated_words(words), unknown_words(words, known, ranked), split_words(words, known, lexicon, affixes), run_together(words, known, lexicon, affixes)
    ]
    return deduplicated(*found, *([disagreements(readings, lexicon, affixes)] if readings is not None else []))


def bigrams_of(words: DataFrame) -> DataFrame:
    """``lexicon.bigrams`` of the words of a ``context_table``."""
    return words.where("next is not null").groupBy(script.fold(F.col("word")).alias("w1"), script.fold(F.col("next")).alias("w2")).agg(F.count(F.lit(1)).alias("freq"))
