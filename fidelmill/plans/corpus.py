"""The driver's tables as the page store's tables.

``documents`` are pages in Ge'ez script, by transliteration; ``source`` is the
book, ``doc_id`` the page number. A page is verified or in review by its quality
label, else recognised; its confidence follows from its id. Words of the pages
are laid out on a grid as boxes; a second reader changes one word in eleven. The
ledger has an edit for each doubled pair of neighbours in ``conversations``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fidelmill.functions import morph, script
from fidelmill.functions.translit import pattern, spelt, token_map, transliterate
from fidelmill.operators import lexicon as lex
from fidelmill.operators.tokens import counted_words, word_table
from fidelmill.runtime import saved, ship

#: Least count of a word in the lexicon that is built from the pages.
LEXICON_LEAST = 3


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table; one of fewer files than cores is dealt out over them, since a file of one row group is one task."""
    ship(spark)
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if table == "documents" and len(df.inputFiles()) < cores else df  # one file of one row group is one task


def raw_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, book, text as they are stored, in Latin letters."""
    return load(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), F.col("source").alias("book"), "text")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, book, text in Ge'ez script."""
    return raw_pages(spark, sf_dir).withColumn("text", transliterate(F.col("text")))


def placed_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``word_table`` of the pages; a text is spelt and cut by one worker, and passes the JVM once."""
    return word_table(raw_pages(spark, sf_dir), spelt)


#: What is planted in the pages of ``marked_pages``: characters of other blocks, without ink, doubled and leading marks, a colon on its own.
PLANTED = "\u2d80\u200bሰላም።። ቤት : ሰላ\n፣ሰላም"


def marked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages, each followed by what the detectors of characters and marks look for, as often as its number says (0 to 2)."""
    n = F.pmod("page_id", F.lit(3)).cast("int")
    return pages(spark, sf_dir).withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.repeat(F.lit("\n" + PLANTED), n)))


MARKED_SQL = f"marked AS (SELECT page_id, book, coalesce(text, '') || repeat(chr(10) || {"'" + PLANTED.replace(chr(10), "' || chr(10) || '") + "'"}, (page_id % 3)::INTEGER) AS text FROM pages)"


def store_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, idx, book, text, status, mean_conf."""
    labels = load(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.when(F.col("quality") == 1, "verified").otherwise("in_review").alias("s"))
    p = pages(spark, sf_dir).join(labels, "page_id", "left")
    return p.select("page_id", F.col("page_id").alias("idx"), "book", "text", F.coalesce("s", F.lit("recognized")).alias("status"), (F.pmod(F.col("page_id") * 37, F.lit(101)) / 100.0).alias("mean_conf"))


def counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """word, freq of the distinct words of all pages; a text is spelt, cut and counted by one worker, and neither it nor its words pass the JVM."""
    return lex.summed(counted_words(raw_pages(spark, sf_dir), spelt))


def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """word, freq of the distinct words of all pages, counted once and kept: what looks up words or the lexicon reads no page again."""
    return saved(counted(spark, sf_dir), "word-counts")


def lexicon(spark: SparkSession, sf_dir: str, least: int = LEXICON_LEAST) -> DataFrame:
    return lex.build(counted(spark, sf_dir), least)


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, line_idx, word_idx, text, start, end, x, y, w, h, conf: ten words a line, sixty units a word."""
    w = placed_words(spark, sf_dir)
    n = F.col("word_no")
    return w.select(
        "page_id", F.floor(n / 10).cast("int").alias("line_idx"), (n % 10).cast("int").alias("word_idx"), F.col("word").alias("text"), "start", "end", ((n % 10) * 60).cast("int").alias("x"),
        (F.floor(n / 10) * 40).cast("int").alias("y"), F.lit(50).alias("w"), F.lit(30).alias("h"), (F.pmod(F.col("page_id") * 31 + n * 17, F.lit(100)) / 100.0).alias("conf"),
    )


def edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """edit_id, page_id, before, after, kind: each conversation turn's first word after the one before it."""
    c = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.regexp_extract("text", "[A-Za-z]+", 0).alias("first"))
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("first").alias("after"))
    kind = F.element_at(F.array(*map(F.lit, ("manual", "accepted", "auto", "propagated"))), (F.pmod(F.col("conv_id") + F.col("turn"), F.lit(4)) + 1).cast("int"))
    return c.join(nxt, ["conv_id", "turn"]).select((F.col("conv_id") * 1000 + F.col("turn")).alias("edit_id"), F.col("conv_id").alias("page_id"), F.col("first").alias("before"), "after", kind.alias("kind"))


# ---- the same as SQL ------------------------------------------------------------------------------------------------


def text_of(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sql_class(name: str) -> str:
    return script.classes()[name]


def fold_sql(column: str) -> str:
    return f"translate({column}, {text_of(script.fold_table()[0])}, {text_of(script.fold_table()[1])})"


def skeleton_sql(column: str) -> str:
    return f"translate({column}, {text_of(script.skeleton_table()[0])}, {text_of(script.skeleton_table()[1])})"


def with_pages(body: str, *more: str) -> str:
    """A query over CTE ``pages`` (page_id, book, text) in Ge'ez script, and more CTEs."""
    rows = ", ".join(f"({text_of(k)}, {text_of(v)})" for k, v in token_map().items())
    cut = f"regexp_extract_all(text, {text_of(pattern())})"
    ctes = [
        f"key_map(k, v) AS (VALUES {rows})",
        f"cut AS (SELECT doc_id, unnest({cut}) AS k, generate_subscripts({cut}, 1) AS pos FROM documents)",
        "spelt AS (SELECT doc_id, string_agg(coalesce(v, cut.k), '' ORDER BY pos) AS text FROM cut LEFT JOIN key_map USING (k) GROUP BY doc_id)",
        "pages AS (SELECT d.doc_id AS page_id, d.source AS book, coalesce(s.text, d.text) AS text FROM documents d LEFT JOIN spelt s USING (doc_id))",
        *more,
    ]
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + body


def words_cte(source: str = "pages") -> str:
    """CTE words(page_id, pos, word) of word tokens, numbered from 0."""
    w = f"regexp_extract_all(text, {text_of(script.word_pattern())})"
    return f"words AS (SELECT page_id, unnest({w}) AS word, generate_subscripts({w}, 1) - 1 AS word_no FROM {source})"


def tokens_cte(source: str = "pages") -> str:
    """CTE tokens(page_id, pos, start, end, kind, token)."""
    t = f"regexp_extract_all(text, {text_of(script.token_pattern())})"
    c = script.classes()
    kind = " ".join(f"WHEN regexp_matches(token, {text_of('^[' + c[k] + ']')}) THEN '{k}'" for k in ("space", "punct", "number"))
    return (
        f"cut_tokens AS (SELECT page_id, unnest({t}) AS token, generate_subscripts({t}, 1) - 1 AS pos FROM {source}),\n"
        "placed AS (SELECT *, coalesce(sum(length(token)) OVER (PARTITION BY page_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INTEGER AS start FROM cut_tokens),\n"
        f"tokens AS (SELECT page_id, pos::INTEGER AS pos, start, (start + length(token))::INTEGER AS \"end\", CASE {kind} ELSE 'word' END AS kind, token FROM placed),\n"
        "placed_words AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS word_no, start, \"end\", token AS word FROM tokens WHERE kind = 'word')"
    )


def lexicon_cte(least: int = LEXICON_LEAST) -> str:
    """CTE lexicon(surface, folded, skeleton, freq) from CTE words."""
    return f"lexicon AS (SELECT word AS surface, {fold_sql('word')} AS folded, {skeleton_sql('word')} AS skeleton, count(*) AS freq FROM words GROUP BY word HAVING count(*) >= {least})"


def known_cte() -> str:
    """CTE known(word, known) of the words of CTE words: in the lexicon as they are."""
    return f"known AS (SELECT word, {fold_sql('word')} IN (SELECT folded FROM lexicon) AS known FROM (SELECT DISTINCT word FROM words))"


def recognized_cte(name: str = "known", source: str = "SELECT DISTINCT word FROM words") -> str:
    """CTE ``name`` (word, known) of distinct words: in the lexicon, or as a stem with up to three affixes."""
    listed = lambda forms: "[" + ", ".join(map(text_of, forms)) + "]"
    vowels, plain = map(text_of, morph.bare_table())
    long = lambda x: f"length(stem) - length({x}) >= {morph.LEAST_STEM}"
    bare = lambda x: f"{x}[:length({x}) - 1] || {plain}[strpos({vowels}, {x}[length({x})])]"
    can = lambda x: f"strpos({vowels}, {x}[length({x})]) > 0"
    cuts = f"[stem[:length(stem) - length(s)] FOR s IN {listed(morph.SUFFIXES)} IF ends_with(stem, s) AND {long('s')}]"
    heads = f"[stem[length(p) + 1:] FOR p IN {listed(morph.PREFIXES)} IF starts_with(stem, p) AND {long('p')}]"
    return (
        f"{name}_flat AS (SELECT word, {fold_sql('word')} IN (SELECT folded FROM lexicon) AS known FROM ({source})),\n"
        f"{name}_reads(word, stem, depth) AS (SELECT word, word, 0 FROM {name}_flat WHERE NOT known UNION\n"
        f" SELECT word, unnest(list_concat(list_concat(heads, cuts), [{bare('x')} FOR x IN list_concat(cuts, [stem]) IF length(x) >= {morph.LEAST_STEM} AND {can('x')}])), depth + 1\n"
        f" FROM (SELECT word, stem, depth, {heads} AS heads, {cuts} AS cuts FROM {name}_reads WHERE depth < {morph.MOST_AFFIXES})),\n"
        f"{name} AS (SELECT word, known OR word IN (SELECT word FROM {name}_reads WHERE {fold_sql('stem')} IN (SELECT folded FROM lexicon)) AS known FROM {name}_flat)"
    )


#: CTE neighbours(page_id, start, "end", word, next, next_end): each word with the one after it.
NEIGHBOURS_SQL = 'neighbours AS (SELECT page_id, start, "end", word, lead(word) OVER w AS next, lead("end") OVER w AS next_end FROM placed_words WINDOW w AS (PARTITION BY page_id ORDER BY word_no))'

EDITS_SQL = """turns AS (SELECT conv_id, turn, regexp_extract(text, '[A-Za-z]+') AS first FROM conversations),
edits AS (SELECT a.conv_id * 1000 + a.turn AS edit_id, a.conv_id AS page_id, a.first AS before, b.first AS after,
  ['manual', 'accepted', 'auto', 'propagated'][((a.conv_id + a.turn) % 4 + 1)::INTEGER] AS kind FROM turns a JOIN turns b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"""

STORE_SQL = """store AS (SELECT p.page_id, p.page_id AS idx, p.book, p.text, CASE WHEN l.quality = 1 THEN 'verified' WHEN l.doc_id IS NOT NULL THEN 'in_review' ELSE 'recognized' END AS status,
  (p.page_id * 37 % 101) / 100.0::DOUBLE AS mean_conf FROM pages p LEFT JOIN labels l ON l.doc_id = p.page_id)"""

BOXES_SQL = """boxes AS (SELECT page_id, (word_no // 10)::INTEGER AS line_idx, (word_no % 10)::INTEGER AS word_idx, word AS text, start, "end", (word_no % 10 * 60)::INTEGER AS x,
  (word_no // 10 * 40)::INTEGER AS y, 50 AS w, 30 AS h, ((page_id * 31 + word_no * 17) % 100) / 100.0::DOUBLE AS conf FROM placed_words)"""
