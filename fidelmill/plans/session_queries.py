"""The queries of sessions, stores and small scalar functions, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fidelmill.functions import normalize, script, translit
from fidelmill.operators import document, geometry, quality, session, store
from fidelmill.operators import lexicon as lex
from fidelmill.operators.tokens import words_only
from fidelmill.plans.corpus import BOXES_SQL, EDITS_SQL, MARKED_SQL, STORE_SQL, boxes, counted, edits, fold_sql, lexicon, lexicon_cte, load, marked_pages, pages, placed_words, raw_pages, store_pages, text_of, tokens_cte, with_pages, words_cte
from fidelmill.plans.queries import _first_words, query
from fidelmill.runtime import saved
from fidelmill.sources import text as source

_STORE = "pages AS (SELECT doc_id AS page_id, source AS book, text FROM documents)"


def _sql(body: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([_STORE, *ctes]) + "\n" + body


# ---- pages and texts ---------------------------------------------------------------------------------------------------


@query("page_reorder", _sql("SELECT page_id, (CASE WHEN page_id = 5 THEN 2 WHEN page_id BETWEEN 2 AND 4 THEN page_id + 1 ELSE page_id END)::INTEGER AS idx FROM pages"))
def page_reorder(spark, sf):
    """The fifth page moves to the second place; pages are numbered by id."""
    return session.reordered(raw_pages(spark, sf).select("page_id", F.col("page_id").alias("idx")), 5, 2)


@query("page_labels", _sql("SELECT p.page_id AS page_idx, CASE WHEN p.page_id % 4 = 0 THEN (p.page_id + 1)::VARCHAR ELSE 'p. ' || p.page_id END AS label FROM pages p"))
def page_labels(spark, sf):
    """Pages whose label is empty are called by their number."""
    p = raw_pages(spark, sf).select(F.col("page_id").alias("idx"), F.when(F.col("page_id") % 4 == 0, "").otherwise(F.concat(F.lit("p. "), F.col("page_id").cast("string"))).alias("label"))
    return session.labels(p, p.select(F.col("idx").alias("page_idx")))


def _texts(spark, sf) -> DataFrame:
    """Stored texts: every third page was never edited, and every seventh has no row."""
    t = raw_pages(spark, sf).where("page_id % 7 <> 3")
    edited = F.when(F.col("page_id") % 3 == 0, "").otherwise(F.reverse(F.substring("text", 1, 80)))
    return t.select("page_id", F.substring("text", 1, 80).alias("raw_text"), edited.alias("edited_text"), F.lit(1).alias("version"))


_TEXTS_SQL = "texts AS (SELECT page_id, text[:80] AS raw_text, CASE WHEN page_id % 3 = 0 THEN '' ELSE reverse(text[:80]) END AS edited_text FROM pages WHERE page_id % 7 <> 3)"


@query("page_texts", _sql("SELECT p.page_id, coalesce(raw_text, '') AS raw_text, coalesce(edited_text, '') AS edited_text, coalesce(nullif(edited_text, ''), raw_text, '') AS current FROM pages p LEFT JOIN texts USING (page_id)", _TEXTS_SQL))
def page_texts(spark, sf):
    return session.page_texts(raw_pages(spark, sf), _texts(spark, sf))


@query("store_edits", _sql("SELECT page_id, status, count(*) AS n FROM (SELECT page_id % 10 AS page_id, CASE WHEN page_id % 2 = 0 AND status IN ('new', 'recognized') THEN 'in_review' ELSE status END AS status FROM store) GROUP BY ALL", STORE_SQL))
def store_edits(spark, sf):
    """Statuses by last digit after every second page's text was edited."""
    p = store_pages(spark, sf).select("page_id", "status")
    _, after = session.with_edits(_texts(spark, sf), p, raw_pages(spark, sf).where("page_id % 2 = 0").select("page_id", F.lit("new").alias("text")))
    return after.groupBy((F.col("page_id") % 10).alias("page_id"), "status").agg(F.count(F.lit(1)).alias("n"))


@query("edit_versions", _sql("SELECT t.page_id, 1 + (t.page_id % 2 = 0)::INTEGER AS version, CASE WHEN t.page_id % 2 = 0 THEN 'new' ELSE edited_text END AS edited_text FROM texts t", _TEXTS_SQL))
def edit_versions(spark, sf):
    p = store_pages(spark, sf).select("page_id", "status")
    after, _ = session.with_edits(_texts(spark, sf), p, raw_pages(spark, sf).where("page_id % 2 = 0").select("page_id", F.lit("new").alias("text")))
    return after.select("page_id", "version", "edited_text")


@query("mark_verified", _sql("SELECT CASE WHEN page_id % 5 = 0 THEN 'verified' ELSE status END AS status, count(*) AS n FROM store GROUP BY 1", STORE_SQL))
def mark_verified(spark, sf):
    p = store_pages(spark, sf).select("page_id", "status")
    return session.verified(p, p.where("page_id % 5 = 0")).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("page_scope", _sql("SELECT w AS which, count(*) AS n FROM store, (VALUES ('page'), ('book'), ('open')) t(w) WHERE w = 'book' OR w = 'page' AND page_id = 7 OR w = 'open' AND status <> 'verified' GROUP BY w", STORE_SQL))
def page_scope(spark, sf):
    p = store_pages(spark, sf)
    runs = [session.scope(p, w, 7).agg(F.count(F.lit(1)).alias("n")).select(F.lit(w).alias("which"), "n") for w in ("page", "book", "open")]
    return runs[0].union(runs[1]).union(runs[2])


@query("first_files", _sql("SELECT page_id, 'part-' || (page_id % 3) || '.xhtml' AS file FROM pages"))
def first_files(spark, sf):
    p = raw_pages(spark, sf).select("page_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
    n = F.col("page_id") % 3 + F.col("k")
    return session.first_files(p.select("page_id", n.alias("file_no"), F.concat(F.lit("part-"), n.cast("string"), F.lit(".xhtml")).alias("file")))


@query("safe_names", r"""SELECT page_id, CASE WHEN trim(translate(url, '\/:*?"<>|', '')) = '' THEN 'book' ELSE trim(translate(url, '\/:*?"<>|', '')) END AS name FROM pages""")
def safe_names(spark, sf):
    return load(spark, sf, "pages").select("page_id", session.safe_name(F.col("url")).alias("name"))


@query("image_paths", _sql("SELECT page_id, CASE page_id % 3 WHEN 0 THEN NULL WHEN 1 THEN '/scans/' || page_id || '.png' ELSE '/book/images/' || page_id || '.png' END AS path FROM pages"))
def image_paths(spark, sf):
    i = F.col("page_id").cast("string")
    relative = F.when(F.col("page_id") % 3 == 0, "").when(F.col("page_id") % 3 == 1, F.concat(F.lit("/scans/"), i, F.lit(".png"))).otherwise(F.concat(F.lit("images/"), i, F.lit(".png")))
    return raw_pages(spark, sf).select("page_id", session.image_path("/book/", relative).alias("path"))


@query("page_rows", with_pages("SELECT s.page_id, 'p. ' || s.page_id || chr(10) || replace(s.status, '_', ' ') AS line FROM store s WHERE s.page_id % 2 = 1", STORE_SQL))
def page_rows(spark, sf):
    """Rows of the page list before anything was assessed, odd pages."""
    p = store_pages(spark, sf).where("page_id % 2 = 1").withColumn("label", F.concat(F.lit("p. "), F.col("page_id").cast("string")))
    return quality.list_rows(p, p.select("page_id", F.lit(0).alias("n_words"), F.lit("").alias("grade"), F.lit(0.0).alias("unknown_rate")))


# ---- corrections -------------------------------------------------------------------------------------------------------


@query("edit_history", f"WITH {EDITS_SQL} SELECT edit_id, before, after, kind FROM edits ORDER BY edit_id DESC LIMIT 500")
def edit_history(spark, sf):
    return session.history(edits(spark, sf).withColumn("ts", F.col("edit_id"))).select("edit_id", "before", "after", "kind")


_LEARNABLE = "trim(before) <> '' AND trim(after) <> '' AND length(before) <= 40 AND length(after) <= 40"


@query("learnable_edits", f"WITH {EDITS_SQL} SELECT kind, count(*) AS n FROM edits WHERE {_LEARNABLE} GROUP BY kind")
def learnable_edits(spark, sf):
    e = edits(spark, sf)
    return e.where(session.learnable(F.col("before"), F.col("after"))).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


_OWN_LEXICON = f"own AS (SELECT DISTINCT {fold_sql('word')} AS folded FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS word FROM benchmark))"


@query(
    "accept_correction",
    f"WITH {EDITS_SQL}, {_OWN_LEXICON}, c AS (SELECT DISTINCT unnest(string_split_regex(trim(after), '\\s+')) AS word FROM edits WHERE before <> after) SELECT word AS surface, 1::BIGINT AS freq FROM c WHERE word <> '' AND {fold_sql('word')} NOT IN (SELECT folded FROM own)",
)
def accept_correction(spark, sf):
    """The words that accepting all corrections adds to a lexicon of the benchmark's words."""
    e = edits(spark, sf)
    held = load(spark, sf, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("word"))
    own = lex.build(lex.count_words(held)).withColumn("freq", F.col("freq") * 0 - 1)
    new = e.select("page_id", F.col("edit_id").alias("ts"), "before", "after", F.lit("editor").alias("source"))
    ledger = new.select("page_id", "ts", "before", "after", F.lit("manual").alias("kind"), "source").where("false")
    none = spark.createDataFrame([], "observed string, intended string, n long")
    return session.accepted(new, ledger, own, none)[1].where("freq > 0").select("surface", "freq")


@query("accepted_ledger", f"WITH {EDITS_SQL} SELECT 'accepted' AS kind, count(*) AS n FROM edits WHERE before <> after")
def accepted_ledger(spark, sf):
    e = edits(spark, sf)
    new = e.select("page_id", F.col("edit_id").alias("ts"), "before", "after", F.lit("editor").alias("source"))
    ledger = new.select("page_id", "ts", "before", "after", F.lit("manual").alias("kind"), "source").where("false")
    none = spark.createDataFrame([], "observed string, intended string, n long")
    return session.accepted(new, ledger, lexicon(spark, sf), none)[0].groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("normalized_pages", with_pages(f"SELECT page_id FROM marked WHERE regexp_matches(text, '[{normalize.INVISIBLE}]')", MARKED_SQL))
def normalized_pages(spark, sf):
    """The pages with planted characters that normalising changes, and no others without them."""
    changed = session.normalized(marked_pages(spark, sf))
    return changed.join(marked_pages(spark, sf).where(F.col("text").rlike(f"[{normalize.INVISIBLE}]")).select("page_id"), "page_id").select("page_id")


@query("search_results", with_pages(f"SELECT page_id, 'p. ' || page_id AS label, o AS \"offset\" FROM (SELECT page_id, (i - 1)::INTEGER AS o FROM (SELECT page_id, text, unnest(range(1, length(text) + 1)) AS i FROM marked WHERE contains({fold_sql('text')}, 'ሰላ')) WHERE {fold_sql('text[i]')} = 'ሰ' AND {fold_sql('text[i + 1]')} = 'ላ') ORDER BY page_id, o LIMIT 500", MARKED_SQL))
def search_results(spark, sf):
    p = marked_pages(spark, sf)
    labelled = p.select("page_id", F.col("page_id").alias("idx"), F.concat(F.lit("p. "), F.col("page_id").cast("string")).alias("label"))
    return store.first_results(store.occurrences(p, "ሰላ", folded=True), labelled).select("page_id", "label", "offset")


@query("word_under_cursor", with_pages('SELECT c.page_id, c.a AS at, c.word, c.f IN (SELECT folded FROM lexicon) AS known FROM (SELECT page_id, a, arg_min(word, start) AS word, ' + fold_sql("arg_min(word, start)") + ' AS f FROM placed_words, (VALUES (0), (40), (400)) t(a) WHERE start <= a AND a <= "end" GROUP BY page_id, a) c', tokens_cte(), words_cte(), lexicon_cte()))
def word_under_cursor(spark, sf):
    places = raw_pages(spark, sf).select("page_id", F.explode(F.array(F.lit(0), F.lit(40), F.lit(400))).alias("at"))
    return session.under_cursor(places, placed_words(spark, sf), lexicon(spark, sf))


# ---- geometry and documents --------------------------------------------------------------------------------------------


@query("boxes_at_point", with_pages("SELECT page_id, line_idx, word_idx FROM boxes WHERE x <= 130 AND 130 <= x + w AND y <= 85 AND 85 <= y + h", tokens_cte(), BOXES_SQL))
def boxes_at_point(spark, sf):
    return geometry.at_point(boxes(spark, sf), 130, 85).select("page_id", "line_idx", "word_idx")


@query("boxes_in_view", with_pages("SELECT page_id, count(*) AS n FROM boxes WHERE x < 300 AND 100 < x + w AND y < 260 AND 60 < y + h GROUP BY page_id", tokens_cte(), BOXES_SQL))
def boxes_in_view(spark, sf):
    return geometry.in_view(boxes(spark, sf), 100, 60, 200, 200).groupBy("page_id").agg(F.count(F.lit(1)).alias("n"))


@query("page_confidence", with_pages("SELECT page_id, round(avg(conf), 9) AS stored, round(coalesce(avg(conf) FILTER (conf > 0), 0), 9) AS shown, count(*) FILTER (conf > 0 AND conf < 0.72) AS n_low FROM boxes GROUP BY page_id", tokens_cte(), BOXES_SQL))
def page_confidence(spark, sf):
    return geometry.confidences(boxes(spark, sf)).select("page_id", F.round("stored", 9).alias("stored"), F.round("shown", 9).alias("shown"), "n_low")


@query("confidence_heat", with_pages("SELECT CASE WHEN conf >= 0.9 THEN 'verified' WHEN conf >= 0.75 THEN 'low' WHEN conf >= 0.55 THEN 'medium' ELSE 'high' END AS heat, count(*) AS n FROM boxes GROUP BY 1", tokens_cte(), BOXES_SQL))
def confidence_heat(spark, sf):
    return boxes(spark, sf).groupBy(quality.heat(F.col("conf")).alias("heat")).agg(F.count(F.lit(1)).alias("n"))


@query("drop_lines", with_pages("SELECT page_id, count(*) AS n, max(k) AS last_line FROM (SELECT *, dense_rank() OVER (PARTITION BY page_id ORDER BY line_idx) - 1 AS k FROM boxes WHERE line_idx % 3 <> 1) GROUP BY page_id", tokens_cte(), BOXES_SQL))
def drop_lines(spark, sf):
    """Lines are dropped by their text: here every third line's, whose place is written before its words."""
    b = boxes(spark, sf)
    tag = F.when(F.col("line_idx") % 3 == 1, F.lit("stamp")).otherwise(F.concat(F.lit("line"), F.col("line_idx").cast("string")))
    named = b.withColumn("text", F.when(F.col("word_idx") == 0, tag).otherwise("x"))
    lines = saved(geometry.by_line(named.select("page_id", "line_idx", "word_idx", "text")), "lines")
    stamps = lines.where("line like 'stamp%'").select("line").distinct()
    return geometry.without_lines(lines, stamps).groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.max("line_idx").alias("last_line"))


@query("training_lines", with_pages("SELECT b.page_id, count(DISTINCT b.line_idx) AS n FROM boxes b JOIN store s USING (page_id) WHERE s.status = 'verified' AND length(trim(string_split(s.text, chr(10))[b.line_idx + 1])) > 0 GROUP BY b.page_id", tokens_cte(), STORE_SQL, BOXES_SQL))
def training_lines(spark, sf):
    return geometry.training_lines(geometry.lines(boxes(spark, sf)), store_pages(spark, sf)).groupBy("page_id").agg(F.count(F.lit(1)).alias("n"))


@query("training_readiness", "SELECT n_lines, CASE WHEN n_lines < 150 THEN 'Verify more pages — about ' || (150 - n_lines) || ' more lines needed before fine-tuning pays off.' WHEN n_lines < 600 THEN 'Enough to fine-tune. Expect a solid gain on this book''s typeface.' ELSE 'Plenty of training data. Fine-tuning should give a large gain.' END AS advice FROM (SELECT count(*) AS n_lines FROM documents GROUP BY source)")
def training_readiness(spark, sf):
    n = raw_pages(spark, sf).groupBy("book").agg(F.count(F.lit(1)).alias("n_lines"))
    return n.select("n_lines", quality.readiness(F.col("n_lines")).alias("advice"))


@query("strip_furniture", with_pages("SELECT page_id, coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (regexp_matches(l, '[^\\s\\x{A0}]')), '') AS text FROM (SELECT page_id, unnest(string_split(t, chr(10))) AS l, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM (SELECT page_id, CASE WHEN page_id % 7 <> 0 THEN text[31:] ELSE text END AS t FROM pages)) GROUP BY page_id"))
def strip_furniture(spark, sf):
    p = pages(spark, sf)
    return document.without_spans(p, _first_words(p), store.FURNITURE)


_BLOCKS = r"blocks AS (SELECT book, page_id, row_number() OVER (PARTITION BY page_id ORDER BY i) AS block_no, b AS text FROM (SELECT book, page_id, i, list_reduce(list_prepend('', list_filter(list_transform(string_split(part, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')), lambda a, x: CASE WHEN a = '' THEN x WHEN a[-1] = '፡' THEN a || x ELSE a || ' ' || x END) AS b FROM (SELECT book, page_id, unnest(string_split(text, chr(10) || chr(10))) AS part, generate_subscripts(string_split(text, chr(10) || chr(10)), 1) AS i FROM pages)) WHERE trim(b) <> '')"


@query("document_statistics", with_pages(f"SELECT book, 1::BIGINT AS chapters, count(*) AS blocks, (sum(length(text)) + 2 * (count(*) - 1))::BIGINT AS characters, sum(len(regexp_extract_all(text, {text_of(script.word_pattern())})))::BIGINT AS words, count(DISTINCT page_id) AS pages FROM blocks GROUP BY book", _BLOCKS))
def document_statistics(spark, sf):
    p = pages(spark, sf)
    b = document.blocks(p).join(p.select("page_id", "book"), "page_id").withColumn("chapter_no", F.lit(0))
    return document.statistics(b).drop("ratio")


@query("character_sets", with_pages("SELECT book, string_agg(ch, '' ORDER BY ch) AS characters FROM (SELECT DISTINCT book, unnest(string_split(text, '')) AS ch FROM pages) WHERE ch <> '' GROUP BY book"))
def character_sets(spark, sf):
    return document.character_set(pages(spark, sf), "book")


@query("missing_glyphs", with_pages("SELECT book, list_sort(list(ch)) AS missing FROM (SELECT DISTINCT book, unnest(string_split(text, '')) AS ch FROM pages) WHERE ch <> '' AND trim(ch) <> '' AND NOT ch BETWEEN 'ሀ' AND 'ፚ' AND ascii(ch) >= 128 GROUP BY book"))
def missing_glyphs(spark, sf):
    """What a font of the main syllables and ASCII lacks."""
    covered = "".join(map(chr, [*range(32, 128), 9, 10, 13, *range(0x1200, 0x135B)]))
    out = document.character_set(pages(spark, sf), "book").select("book", document.missing_glyphs(F.col("characters"), covered).alias("missing"))
    return out.where("size(missing) > 0")


@query("excerpts", _sql(r"SELECT page_id, CASE WHEN length(t) > 40 THEN t[:38] || '…' ELSE t END AS excerpt FROM (SELECT page_id, replace(trim(text[:60]), chr(10), ' ') AS t FROM pages)"))
def excerpts(spark, sf):
    return raw_pages(spark, sf).select("page_id", store.excerpt(F.substring("text", 1, 60)).alias("excerpt"))


# ---- scalars -----------------------------------------------------------------------------------------------------------


@query("typed_text")
def typed_text(spark, sf):
    """What typing every document key by key writes."""
    return raw_pages(spark, sf).select("page_id", translit.typed(F.col("text")).alias("text"))


@query("imported_ratio", with_pages(f"SELECT page_id, round(CASE WHEN n > 0 THEN own::DOUBLE / n ELSE 0 END, 9) AS ratio FROM (SELECT page_id, len(regexp_extract_all(text, '[{script.classes()['letter']}]')) AS n, len(regexp_extract_all(text, '[{script.main_letters()}]')) AS own FROM marked)", MARKED_SQL))
def imported_ratio(spark, sf):
    return marked_pages(spark, sf).select("page_id", F.round(source.imported_ratio(F.col("text")), 9).alias("ratio"))


@query("same_family", "WITH s AS (SELECT chr((b + o)::INTEGER) AS ch, b FROM (SELECT unnest(range(4608, 4952, 8)) AS b), (SELECT unnest(range(8)) AS o) WHERE NOT (b IN " + str(tuple(script.PLAIN_OF)) + " AND o NOT IN (0, 2, 3, 4, 5)) AND b + o NOT IN (4695, 4799, 4823)) SELECT x.ch AS a, count(*) AS n FROM s x JOIN s y USING (b) GROUP BY x.ch")
def same_family(spark, sf):
    s = spark.createDataFrame([(c,) for c in script.syllables()], "ch string")
    pairs = s.select(F.col("ch").alias("a")).join(s.select(F.col("ch").alias("b")), F.substring("a", 1, 0) == F.substring("b", 1, 0))
    return pairs.where(script.same_family(F.col("a"), F.col("b"))).groupBy("a").agg(F.count(F.lit(1)).alias("n"))


@query("file_dispatch", "SELECT kind, count(*) AS n FROM (SELECT CASE WHEN e IN ('png', 'tif') THEN 'images' WHEN e = 'pdf' THEN 'pdf' WHEN e IN ('txt', 'md') THEN 'text' END AS kind FROM (SELECT ['png', 'TIF', 'pdf', 'txt', 'md', 'exe'][(doc_id % 6 + 1)::INTEGER].lower() AS e FROM documents)) WHERE kind IS NOT NULL GROUP BY kind")
def file_dispatch(spark, sf):
    ending = F.element_at(F.array(*map(F.lit, ("png", "TIF", "pdf", "txt", "md", "exe"))), (F.col("page_id") % 6 + 1).cast("int"))
    files = raw_pages(spark, sf).select(F.concat(F.lit("page_"), F.col("page_id").cast("string"), F.lit("."), ending).alias("name"), F.col("page_id").alias("pos"))
    return source.dispatched(files).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("natural_order", "SELECT 'page_' || doc_id || '.png' AS name, (row_number() OVER (ORDER BY doc_id) - 1)::INTEGER AS seq FROM documents")
def natural_order(spark, sf):
    files = raw_pages(spark, sf).select(F.concat(F.lit("page_"), F.col("page_id").cast("string"), F.lit(".png")).alias("name"), F.lit(0).alias("pos"))
    return source.dispatched(files).select("name", "seq")


@query("text_by_lines", "SELECT doc_id AS page_id, count(*) AS n FROM (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE i % 3 = 1 GROUP BY doc_id")
def text_by_lines(spark, sf):
    """Texts without page breaks, three lines a page."""
    t = raw_pages(spark, sf).select("page_id", F.regexp_replace("text", source.PAGE_BREAK, "x").alias("text"))
    return source.import_pages(t, "page_id", lines_per_page=3).groupBy("page_id").agg(F.count(F.lit(1)).alias("n"))


@query("seed_lexicon", "SELECT surface, max([10000, 3000, 800, 200][(tier + 1)::INTEGER])::BIGINT AS freq FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS surface, item_id % 4 AS tier FROM benchmark) GROUP BY surface")
def seed_lexicon(spark, sf):
    """Words of the benchmark as a seed list, in tiers by item."""
    words = load(spark, sf, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("word"), (F.col("item_id") % 4).cast("int").alias("tier"))
    return lex.seeded(words).select("surface", "freq")


@query("lexicon_from_sources", with_pages("SELECT surface, sum(freq)::BIGINT AS freq FROM (SELECT surface, max([10000, 3000, 800, 200][(tier + 1)::INTEGER])::BIGINT AS freq FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS surface, item_id % 4 AS tier FROM benchmark) GROUP BY surface UNION ALL SELECT word, count(*) FROM words GROUP BY word HAVING count(*) >= 3) GROUP BY surface", words_cte()))
def lexicon_from_sources(spark, sf):
    return lex.from_sources(lex.seeded(_seed(spark, sf)), counted(spark, sf)).select("surface", "freq")


def _seed(spark, sf) -> DataFrame:
    return load(spark, sf, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("word"), (F.col("item_id") % 4).cast("int").alias("tier"))


@query("book_summary", "SELECT source AS book, count(*) || ' pages · quality 0% · 0.0% unknown words · 0/' || count(*) || ' verified' AS line FROM documents GROUP BY source")
def book_summary(spark, sf):
    """Of books in which nothing was assessed yet."""
    b = raw_pages(spark, sf).groupBy("book").agg(F.count(F.lit(1)).alias("n_pages"), F.lit(0.0).alias("mean_score"), F.lit(0.0).alias("unknown_rate"), F.lit(0).alias("verified"))
    return b.select("book", quality.summary(b).alias("line"))


@query("suggestion_confidence", "SELECT range AS n, round(1 / (1 + greatest(0, range / 10.0::DOUBLE - 1)), 9) AS confidence FROM range(50)")
def suggestion_confidence(spark, sf):
    return spark.range(50).select(F.col("id").alias("n"), F.round(quality.confidence(F.col("id") / 10.0 - 1), 9).alias("confidence"))


@query("project_counts", with_pages("SELECT (SELECT count(*) FROM store) AS pages, (SELECT count(*) FROM store WHERE status <> 'new') AS recognized, (SELECT count(*) FROM store WHERE status = 'verified') AS verified, (SELECT count(*) FROM boxes) AS words, (SELECT count(*) FROM edits) AS edits", tokens_cte(), STORE_SQL, BOXES_SQL, EDITS_SQL))
def project_counts(spark, sf):
    p = store_pages(spark, sf).agg(F.count(F.lit(1)).alias("pages"), F.count_if(F.col("status") != "new").alias("recognized"), F.count_if(F.col("status") == "verified").alias("verified"))
    one = lambda df, name: F.broadcast(df.agg(F.count(F.lit(1)).alias(name)))
    return p.join(one(boxes(spark, sf), "words"), how="cross").join(one(edits(spark, sf), "edits"), how="cross")  # one row each
