"""Every registered query of the text-correction operators against its SQL, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from fidelmill.functions.translit import spelt, transliterate
from fidelmill.operators import lexicon as lex
from fidelmill.operators.tokens import counted_words, words_only
from fidelmill.plans import corpus, session_queries
from fidelmill.plans.queries import ORACLES, QUERIES
from fidelmill.runtime import saved

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name not in ORACLES:
        return
    want = duck.sql(ORACLES[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    a, b = (d[columns].astype(str).sort_values(columns).reset_index(drop=True) for d in (got, want))
    assert len(a) == len(b) and (a == b).all().all()


def test_distances_and_readings_cover_the_lexicon(spark):
    words = {r.surface: r.skeleton for r in QUERIES["lexicon_build"](spark, SF).collect()}
    assert {r.word for r in QUERIES["stems_of_words"](spark, SF).collect()} == set(words)
    alike = {}
    for w, s in words.items():
        alike.setdefault(s, []).append(w)
    want = {(a, b) for ws in alike.values() for a in ws for b in ws if a < b}
    assert {(r.a, r.b) for r in QUERIES["edit_distance"](spark, SF).collect()} == want


@pytest.mark.parametrize("name", ["candidate_pool", "candidates_ranked", "frequency_lookup", "run_together", "split_words", "issue_totals"])
def test_words_are_counted_once(spark, monkeypatch, name):
    """Queries about distinct words count them once and keep the table; only words with places are cut again."""
    counted = []
    monkeypatch.setattr(corpus, "saved", lambda df, name: counted.append(name) or df)
    QUERIES[name](spark, SF)
    assert counted == ["word-counts"]


@pytest.mark.parametrize("name", ["unknown_words", "page_quality", "worst_pages", "book_quality", "recognized_with_affixes", "edit_distance", "low_confidence", "vote_words"])
def test_quality_takes_recognition_from_counted_words(spark, monkeypatch, name):
    counted = []
    monkeypatch.setattr(corpus, "saved", lambda df, name: counted.append(name) or df)
    QUERIES[name](spark, SF)
    assert counted == ["word-counts"]


@pytest.mark.parametrize("name", ["tokenize_offsets", "mixed_script", "boxes_at_point", "word_at_offset", "issue_box_overlap"])
def test_words_are_spelt_and_cut_by_one_worker(spark, name):
    """No text goes to a second Python worker between its spelling and its words."""
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "EvalPython" not in plan


@pytest.mark.parametrize("name", ["stems_of_words", "lexicon_from_sources", "lexicon_build", "lexicon_merge", "known_words"])
def test_words_are_spelt_cut_and_counted_by_one_worker(spark, name):
    """Neither texts nor words that are only counted pass the JVM."""
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "EvalPython" not in plan


def test_counts_of_batches_are_those_of_all_words(spark):
    rows = [(1, "selam lehulum selam"), (2, None), (3, ""), (4, "..., 12"), (5, "a\U0001f600b selam::lehulum é"), (6, "selam " * 30_000)]
    texts = spark.createDataFrame(rows, "page_id long, text string").repartition(2)
    own = {r.word: r.freq for r in lex.summed(counted_words(texts, spelt)).collect()}
    assert own == {r.word: r.freq for r in lex.count_words(words_only(texts.withColumn("text", transliterate("text")))).collect()} and own["ሰላም"] > 30_000


def test_lines_are_grouped_once(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(session_queries, "saved", lambda df, name: kept.append(name) or saved(df, name))
    plan = QUERIES["drop_lines"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert kept == ["lines"] and "MapInArrow" not in plan and "SortMergeJoin" not in plan


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
