"""The lexicon: counts, pairs, retrieval keys, recognition and ranked candidates.

Look-ups run on distinct words and are joined back. Retrieval is by equal keys
(skeleton, swapped skeleton, deletion) so that no distance is computed for pairs
that share none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fidelmill.functions import distance, morph, script
from fidelmill.operators.tokens import words_only


def count_words(words: DataFrame) -> DataFrame:
    """word, freq; counted before the shuffle within each task."""
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("freq"))


def summed(counted: DataFrame) -> DataFrame:
    """word, freq of parts (word, n) of a count."""
    return counted.groupBy("word").agg(F.sum("n").alias("freq"))


def build(counts: DataFrame, least: int = 1) -> DataFrame:
    """surface, folded, skeleton, freq of the words that occur often enough."""
    return counts.where(F.col("freq") >= least).select(F.col("word").alias("surface"), script.fold(F.col("word")).alias("folded"), script.skeleton(F.col("word")).alias("skeleton"), "freq")


def merge(*parts: DataFrame) -> DataFrame:
    """surface, freq summed over tables of (surface, freq, source), and the first source that names it."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    every = every.withColumn("surface", F.trim("surface")).where("surface <> ''")
    return every.groupBy("surface").agg(F.sum("freq").alias("freq"), F.min("source").alias("source"))


def bigrams(pages: DataFrame) -> DataFrame:
    """w1, w2 (folded), freq. Texts are folded as a whole but for the marks that folding drops, which go word by word: a word of nothing else stays one."""
    whole = pages.select("page_id", script.fold(F.col("text"), script.Fold(gemination=False)).alias("text"))
    words = F.transform(script.words(F.col("text")), lambda w: F.translate(w, script.GEMINATION, ""))
    w, n = F.col("w"), F.greatest(F.size("w") - 1, F.lit(0))
    pairs = F.explode(F.arrays_zip(F.slice(w, 1, n).alias("w1"), F.slice(w, 2, n).alias("w2"))).alias("p")
    return whole.select(words.alias("w")).select(pairs).groupBy(F.col("p.w1").alias("w1"), F.col("p.w2").alias("w2")).agg(F.count(F.lit(1)).alias("freq"))


def deletions(lexicon: DataFrame, least: int = 20) -> DataFrame:
    """key, surface: each word under itself without one character, for words of at least that frequency."""
    return lexicon.where(F.col("freq") >= least).select(F.explode(script.deletion_keys(F.col("folded"))).alias("key"), "surface").distinct()


def known(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """word, known of distinct ``words`` by folded form."""
    forms = lexicon.select("folded").distinct().withColumn("known", F.lit(True))
    w = words.select("word").distinct().withColumn("folded", script.fold(F.col("word")))
    return w.join(forms, "folded", "left").select("word", F.coalesce("known", F.lit(False)).alias("known"))


def inflected(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """word of the distinct ``words`` some reading of which has a known stem."""
    r = words.select("word", F.explode(morph.stem_sets(F.col("word"))).alias("stem")).withColumn("folded", script.fold(F.col("stem")))
    return r.join(lexicon.select("folded").distinct(), "folded", "left_semi").select("word").distinct()


def analyses(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """word, stem, depth, prefixes, suffixes: the shallowest reading whose stem is known."""
    w = inflected(words.select("word").distinct(), lexicon)
    r = w.select("word", F.posexplode(morph.stems(F.col("word"))).alias("pos", "r")).withColumn("folded", script.fold(F.col("r.stem")))
    hit = r.join(lexicon.select("folded").distinct(), "folded", "left_semi")
    best = hit.groupBy("word").agg(F.min_by("r", "pos").alias("r"))
    return best.select("word", "r.stem", (F.size("r.prefixes") + F.size("r.suffixes")).alias("depth"), "r.prefixes", "r.suffixes")


def recognized(words: DataFrame, lexicon: DataFrame, affixes: bool = True) -> DataFrame:
    """word, known: in the lexicon, or by its affixes."""
    flat = known(words, lexicon)
    if not affixes:
        return flat
    rest = inflected(flat.where("not known").select("word"), lexicon).withColumn("inflected", F.lit(True))
    return flat.join(rest, "word", "left").select("word", (F.col("known") | F.coalesce("inflected", F.lit(False))).alias("known"))


def family_variants() -> dict[str, list[str]]:
    """First-order characters and all the first-order ones they may be misread for."""
    costs = distance.Costs()
    out = {}
    for c, (_, order) in script.syllables().items():
        if order == 0:
            near = [v for v, _ in costs.neighbors(c, 0.45, len(costs.letters)) if script.syllables()[v][1] == 0]
            if near:
                out[c] = near
    return out


#: Characters of the longest form that is a key as it is; of longer ones the hash is, so that rows do not grow with the square of a word's length.
LONG = 64
HASHED = "\0"


def _shortened(words: DataFrame, word: str, at: str, *more: str) -> DataFrame:
    """A row for each ``word`` as it is (``at`` 0) and without each character of its folded form in turn (``at`` from 1), by that form or its hash."""
    form, n = F.col("form"), F.length("form")
    every = words.select(word, *more, script.fold(F.col(word)).alias("form"))
    every = every.select(word, *more, form, F.explode(F.when(n >= 2, F.sequence(F.lit(0), n)).otherwise(F.array(F.lit(0)))).alias(at))
    short = n - F.when(F.col(at) == 0, 0).otherwise(1) <= LONG
    cut = _without(form, F.col(at))
    return every.select(word, *more, at, F.when(short, cut).otherwise(F.concat(F.lit(HASHED), F.xxhash64(cut).cast("string"))).alias("key"))


def _without(form: Column, at: Column) -> Column:
    return F.when(at == 0, form).otherwise(F.concat(form.substr(F.lit(1), at - 1), form.substr(at + 1, F.length(form))))


def _listed(lexicon: DataFrame) -> DataFrame:
    """key, surface, freq, rank: the lexicon by skeleton (rank 0), and by each skeleton with one character that may be misread for its own (rank 1). It is the lexicon that is swapped, since there are more words than that."""
    read: dict[str, list[str]] = {}
    for c, near in family_variants().items():
        for v in near:
            read.setdefault(v, []).append(c)
    own = lexicon.select(F.col("skeleton").alias("key"), "surface", "freq", F.lit(0).alias("rank"))
    if not read:
        return own
    table = F.create_map(*(x for k, v in read.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    s, i = F.col("skeleton"), F.col("i")
    swapped = lexicon.where(F.length(s) > 0).select("skeleton", "surface", "freq", F.explode(F.sequence(F.lit(1), F.length(s))).alias("i"))
    swapped = swapped.select("skeleton", "surface", "freq", "i", F.explode(F.try_element_at(table, s.substr(i, F.lit(1)))).alias("c"))
    return own.union(swapped.select(F.concat(s.substr(F.lit(1), i - 1), "c", s.substr(i + 1, F.length(s))), "surface", "freq", F.lit(1)))


def _found(words: DataFrame, lexicon: DataFrame, least: int) -> DataFrame:
    """word, surface, freq, rank of ``pool``, all rows of a word together. Nothing is sorted for the look-ups; keys that are hashes are compared as forms, and what is found is shuffled once."""
    w = words.select("word").distinct()
    alike = w.select("word", script.skeleton(F.col("word")).alias("key")).join(_listed(lexicon).hint("shuffle_hash"), "key").select("word", "surface", "freq", "rank")
    own, listed = _shortened(w, "word", "at"), _shortened(lexicon, "surface", "l_at", "freq")
    if least > 1:
        listed = listed.where((F.col("l_at") == 0) | (F.coalesce("freq", F.lit(0)) >= least))
    same = _without(script.fold(F.col("word")), F.col("at")) == _without(script.fold(F.col("surface")), F.col("l_at"))
    indel = own.join(listed.hint("shuffle_hash"), "key").where("at + l_at > 0").where(~F.col("key").startswith(HASHED) | same).select("word", "surface", "freq", F.lit(2).alias("rank"))
    return alike.union(indel).where("word <> surface").repartition("word").groupBy("word", "surface", "freq").agg(F.min("rank").alias("rank"))


def _source(rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, ("order", "family", "indel"))), rank + 1)


def pool(words: DataFrame, lexicon: DataFrame, least: int = 1) -> DataFrame:
    """word, surface, source: all candidates of distinct words; the first of order, family and indel that finds one names it. Words of a lower frequency than ``least`` are found by no deletion of theirs."""
    return _found(words, lexicon, least).groupBy("word", "surface").agg(F.min("rank").alias("rank")).select("word", "surface", _source(F.col("rank")).alias("source"))


def candidates(words: DataFrame, lexicon: DataFrame, *, most: int = 8, cutoff: float = 1.4, least: int = 1, costs: distance.Costs | None = None) -> DataFrame:
    """word, rank, surface, source, cost, freq, score: the best ``most`` candidates; equal scores by surface."""
    p = _found(words, lexicon, least).select("word", "surface", _source(F.col("rank")).alias("source"), "freq")
    p = p.withColumn("cost", distance.distance(F.col("word"), F.col("surface"), cutoff, costs)).where(F.col("cost") <= cutoff)
    p = p.withColumn("score", F.col("cost") - 0.06 * F.log1p("freq"))
    rank = F.row_number().over(Window.partitionBy("word").orderBy("score", "surface"))
    return p.withColumn("rank", rank).where(F.col("rank") <= most).select("word", "rank", "surface", "source", "cost", "freq", "score")


#: The commonest words of a lexicon, which are known, are looked up where a page lies; only rarer ones are shuffled.
USUAL = 100_000


def unknown_rates(pages: DataFrame, lexicon: DataFrame, affixes: bool = True, seen: DataFrame | None = None) -> DataFrame:
    """page_id, n_words, n_unknown: recognition (``seen``, of at least the words of the pages, if it is at hand) on distinct words, joined back to the counts of each page."""
    usual = lexicon.orderBy(F.desc("freq"), "surface").limit(USUAL).select(F.col("surface").alias("word"), F.lit(True).alias("usual")).distinct()
    words = words_only(pages).join(F.broadcast(usual), "word", "left").select("page_id", F.when(F.col("usual").isNull(), F.col("word")).alias("word"))
    per = words.groupBy("page_id", "word").agg(F.count(F.lit(1)).alias("n"))
    if seen is None:
        seen = recognized(per.where("word is not null"), lexicon, affixes)
    per = per.join(seen.where("not known").select("word", F.lit(True).alias("unknown")), "word", "left")
    return per.groupBy("page_id").agg(F.sum("n").alias("n_words"), F.sum(F.when(F.col("unknown"), F.col("n")).otherwise(0)).alias("n_unknown"))


def learned(corrections: DataFrame) -> DataFrame:
    """observed, intended, n: substitutions of aligned (before, after) pairs."""
    ops = corrections.select(F.explode(distance.alignment(F.col("before"), F.col("after"))).alias("o")).where("o.op = 'sub'")
    return ops.groupBy("o.observed", "o.intended").agg(F.count(F.lit(1)).alias("n"))


def top_confusions(learned: DataFrame, limit: int = 20) -> DataFrame:
    """The commonest confusions; equal counts by their characters."""
    return learned.orderBy(F.desc("n"), "observed", "intended").limit(limit)


def costs_of(learned: DataFrame, most: int = 1 << 20) -> distance.Costs:
    """The model of learned confusions: one row a pair of characters, so small; an error beyond ``most``."""
    rows = learned.select("observed", "intended", "n").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} confusions")
    return distance.Costs({(r[0], r[1]): r[2] for r in rows})


#: Frequencies of the tiers of a seed list, the commonest words first.
TIERS = (10_000, 3_000, 800, 200)


def seeded(words: DataFrame) -> DataFrame:
    """surface, freq, source of a seed list (word, tier from 0): the frequency of the highest tier that names a word."""
    tier = F.array(*map(F.lit, TIERS))
    return words.where(F.trim("word") != "").groupBy(F.trim("word").alias("surface")).agg(F.max(F.element_at(tier, F.col("tier") + 1)).cast("long").alias("freq"), F.lit("seed").alias("source"))


def from_sources(seed: DataFrame, counts: DataFrame, least: int = 3) -> DataFrame:
    """The lexicon of a seed list and a corpus' counts (word, freq): seed words whatever their count."""
    corpus = counts.where(F.col("freq") >= least).select(F.col("word").alias("surface"), "freq", F.lit("corpus").alias("source"))
    both = merge(corpus, seed.select("surface", "freq", "source"))
    return both.select("surface", script.fold(F.col("surface")).alias("folded"), script.skeleton(F.col("surface")).alias("skeleton"), "freq", "source")
