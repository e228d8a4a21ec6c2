import random
import re
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from fidelmill.functions import distance, script
from fidelmill.operators import document, geometry, issues, lexicon, quality, session, store, tokens, voting
from fidelmill.operators.tokens import token_table, word_table, words_only
from fidelmill.sources import text as source
from fidelmill.streaming import corrections


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def lex(spark):
    words = [("ሰላም", 50), ("ነው", 50), ("ለሁሉም", 50), ("መጽሐፍ", 50), ("ጠይቀው", 40), ("ቤት", 50), ("ቅዱስ", 30)]
    return lexicon.build(frame(spark, words, "word string, freq long"))


def pages_of(spark, *texts):
    return frame(spark, [(i, t) for i, t in enumerate(texts)], "page_id long, text string")


def test_tokens_spell_the_page(spark):
    texts = ["ሰላም፡ለሁሉም። ok 12", "", "  x", "\U0001e7e0a.b"]
    t = token_table(pages_of(spark, *texts)).orderBy("page_id", "pos").collect()
    for i, text in enumerate(texts):
        own = [r for r in t if r.page_id == i]
        assert "".join(r.token for r in own) == text and all(text[r.start : r.end] == r.token for r in own)


def test_recognition(spark, lex):
    w = frame(spark, [("ሰላም",), ("ሠላም",), ("የሰላም",), ("ቤቱ",), ("ዠዠዠ",)], "word string")
    assert {r.word: r.known for r in lexicon.known(w, lex).collect()} == {"ሰላም": True, "ሠላም": True, "የሰላም": False, "ቤቱ": False, "ዠዠዠ": False}
    assert {r.word for r in lexicon.recognized(w, lex).where("known").collect()} == {"ሰላም", "ሠላም", "የሰላም", "ቤቱ"}


@pytest.mark.parametrize("query, target", [("ጣይቃው", "ጠይቀው"), ("መጽሐ", "መጽሐፍ"), ("መጽሐፍፍ", "መጽሐፍ")])
def test_candidates(spark, lex, query, target):
    got = lexicon.candidates(frame(spark, [(query,)], "word string"), lex).orderBy("rank").collect()
    assert got[0].surface == target and [r.rank for r in got] == list(range(1, len(got) + 1))


def test_all_candidates_are_found(spark):
    words = ["ሰላም", "ሰላ", "ሸላም", "ላም", "ሰላምም", "ሀላም", "ረቅ" * 15, "ረቅ" * 15 + "ረ"]  # once each, two of them long
    lex = lexicon.build(frame(spark, [(w, 1) for w in words], "word string, freq long"))
    rows = {(r.word, r.surface): r.source for r in lexicon.pool(frame(spark, [("ሰላም",), ("ረቅ" * 15 + "ቅ",)], "word string"), lex).collect()}
    assert {s for w, s in rows if w == "ሰላም"} == {"ሰላ", "ሸላም", "ላም", "ሰላምም", "ሀላም"}
    assert {s for w, s in rows if w != "ሰላም"} == {"ረቅ" * 15, "ረቅ" * 15 + "ረ"}
    rare = {(r.word, r.surface) for r in lexicon.pool(frame(spark, [("ሰላም",)], "word string"), lex, least=20).collect()}
    assert ("ሰላም", "ሰላ") in rare and ("ሰላም", "ሰላምም") not in rare  # no deletions of rare words
    costs = distance.Costs()
    firsts = {c for c, (_, order) in script.syllables().items() if order == 0}
    for c, near in lexicon.family_variants().items():
        assert set(near) == {v for v, _ in costs.neighbors(c, 0.45, 1000)} & firsts


def test_long_words_are_found_by_hashed_forms(spark, lex):
    """Forms at and beyond the longest that is a key as it is, one character shorter, longer or another."""
    rows = [(a + b, a + b, a + b, 5) for a in ("ሰላም" * 21, "ሰላም" * 22) for b in ("", "ለ", "ለሀ", "ለሁ", "ለሁለ")]
    lex = frame(spark, rows, "surface string, folded string, skeleton string, freq long")
    words = [r[0] for r in rows]
    cut = lambda w: {w[:i] + w[i + 1 :] for i in range(len(w))}
    want = {(a, b) for a in words for b in words if a != b and (cut(a) & cut(b) or a in cut(b) or b in cut(a))}
    got = {(r.word, r.surface) for r in lexicon.pool(frame(spark, [(w,) for w in words], "word string"), lex).collect()}
    assert want and got == want


def test_candidates_are_looked_up_without_sorting_and_shuffled_once(spark, lex):
    plan = lexicon.candidates(frame(spark, [("ሰላም",)], "word string"), lex)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ShuffledHashJoin") == 2 and "SortMergeJoin" not in plan
    assert plan.count("REPARTITION_BY_COL") == 1


def test_no_candidates_for_noise(spark, lex):
    assert lexicon.candidates(frame(spark, [("ቅቅቅቅቅቅ",)], "word string"), lex, cutoff=0.9).count() == 0


def test_learning(spark):
    got = {(r.observed, r.intended): r.n for r in lexicon.learned(frame(spark, [("ሰላም", "ሸላም"), ("ሰው", "ሸው"), ("ሰላም", "ሰላ")], "before string, after string")).collect()}
    assert got == {("ሰ", "ሸ"): 2}


DETECTED = [
    ("ሰላም ቅቅቅቅ ነው", "unknown_word", None), ("ሰላod ነው", "mixed_script", None), ("መጽ ሐፍ ቅዱስ", "split_word", "መጽሐፍ"), ("ሰላምለሁሉም", "run_together", "ሰላም ለሁሉም"), ("ሰላም ሰላም", "repeated_word", "ሰላም"),
    ("ሰ\u200bላም", "suspect_character", ""), ("ሰላም።።", "punctuation", "።"), ("ሰላም : ነው", "punctuation", "፡"),
]


def test_detectors(spark, lex):
    rows = issues.detected(pages_of(spark, *(t for t, _, _ in DETECTED)), lex).collect()
    for i, (text, kind, suggestion) in enumerate(DETECTED):
        found = [r for r in rows if r.page_id == i and r.kind == kind]
        assert found and found[0].suggestion == suggestion and all(0 <= r.start < r.end <= len(text) for r in found), text


def test_clean_text_has_no_issue(spark, lex):
    assert issues.detected(pages_of(spark, "ሰላም ነው።", "", "hello world"), lex).count() == 0


def test_auto_apply_splices_sure_suggestions(spark, lex):
    p = pages_of(spark, "ሰላምለሁሉም መጽ ሐፍ።።", "ሰላም")
    got = {r.page_id: (r.text, r.applied) for r in issues.auto_applied(p, issues.detected(p, lex)).collect()}
    assert got == {0: ("ሰላም ለሁሉም መጽሐፍ።", 3)}


def test_affixes_candidates_and_other_readings(spark, lex):
    p = pages_of(spark, "የሰላም ነው", "ጣይቃው", "መጽሐ", "ሰላም")
    rows = [(2, 0, 3, "መጽሐ", "መጽሐፍ"), (3, 0, 3, "ሰላም", "ሰላ"), (3, 0, 3, "ሰላም", "ቅዱስ"), (0, 5, 7, "ነው", "ነው")]
    readings = frame(spark, rows, "page_id long, start int, end int, word string, reading string")
    found = {(r.page_id, r.start, r.kind): r for r in issues.detected(p, lex, affixes=True, suggest=True, readings=readings).collect()}
    assert set(found) == {(1, 0, "unknown_word"), (2, 0, "engine_disagreement"), (3, 0, "engine_disagreement")}  # an inflected word is none
    assert found[1, 0, "unknown_word"].suggestion == "ጠይቀው" and found[2, 0, "engine_disagreement"].suggestion == "መጽሐፍ" and found[2, 0, "engine_disagreement"].severity == "high"
    known = found[3, 0, "engine_disagreement"]
    assert (known.suggestion, known.severity, known.observed_known, known.gap) == ("ቅዱስ", "medium", True, None)  # ሰላ is no word
    near = issues.detected(p, lex, True, True, readings).withColumn("score", F.lit(0.1))
    assert {r.page_id: r.text for r in issues.auto_applied(p, near).collect()} == {1: "ጠይቀው", 2: "መጽሐፍ"}
    assert issues.auto_applied(p, near.withColumn("gap", F.lit(0.2))).count() == 0
    second = issues.detected(pages_of(spark, "በሰላም ቤት", "ቤትየሰላም"), lex, True).where("kind = 'run_together'").collect()
    assert [(r.page_id, r.suggestion) for r in second] == [(1, "ቤት የሰላም")]


def test_quality_orders_pages(spark, lex):
    p = pages_of(spark, "ሰላም ለሁሉም ነው።", "ቅቅቅቅ ዠዠዠዠ ጨጨጨ ኰኰኰ", "ሰላም ⶀⶀⶀ ነው", "ሰላም hello world foo bar", "").withColumn("status", F.lit("recognized")).withColumn("mean_conf", F.element_at(F.array(*map(F.lit, (0.9, 0.3, 0.9, 0.9, 0.0))), F.col("page_id").cast("int") + 1))
    q = {r.page_id: r for r in quality.page_quality(p, lex, issues.detected(p, lex)).collect()}
    assert len(q) == 5 and all(0 <= r.score <= 1 for r in q.values())
    assert q[0].score > q[3].score > q[1].score and q[0].grade == "excellent" and q[4].score == 0
    assert "impossible characters" in q[2].flags and q[3].ratio < 0.6 and q[1].unknown_rate == 1
    assert quality.book_quality(quality.page_quality(p, lex)).first().n_words == sum(r.n_words for r in q.values())
    assert [r.page_id for r in quality.worst_pages(quality.page_quality(p, lex), 2).collect()][0] == 1


def test_ledger(spark):
    rows = [(1, "a", "b", "manual"), (2, "a", "b", "accepted"), (3, "a", "c", "manual"), (4, "a", "c", "manual"), (5, "x", "y", "auto"), (6, "z", "z", "manual"), (7, "q", "r", "manual")]
    e = frame(spark, rows, "page_id long, before string, after string, kind string")
    assert [(r.before, r.after, r.n) for r in store.known_corrections(e).collect()] == [("a", "b", 2)]


def test_propagation(spark):
    """A word stands between spaces and word separators; a mark of the script may follow, any other may not."""
    p = pages_of(spark, "cat cats cat። cat.", "concat", "dog", "፡cat፡\u2003cat\x1c(cat)")
    assert {r.page_id: (r.n, r.text) for r in store.propagate(p, "cat", "$1\\").collect()} == {0: (2, "$1\\ cats $1\\። cat."), 3: (2, "፡$1\\፡\u2003$1\\\x1c(cat)")}
    assert {r.page_id: r.n for r in store.propagate(p, "cat", "x", whole_word=False, dry=True).collect()} == {0: 4, 1: 1, 3: 3}
    c = frame(spark, [("cat", "dog", 5), ("dog", "cow", 2)], "before string, after string, n long")
    assert {r.page_id: r.text for r in store.apply_ledger(p, c).collect()} == {0: "cow cats cow። cat.", 2: "cow", 3: "፡cow፡\u2003cow\x1c(cat)"}


def test_runs_are_corrected_once_whatever_the_text_repeats(monkeypatch):
    cases = [("a", "b c"), ("b", ""), ("b c", "a። a"), ("c", "d"), (" a", "x"), ("d።", "a"), ("a።d", "b")]
    texts = ["a b c", "a። a c d።", " a a\u1361b c", "d። b c a", "", "b c b c።", "a።d a።d x"]
    for n in range(len(cases) + 1):
        for text in texts:
            want = text
            for before, after in cases[:n]:
                want = store._replaced(want, before, after)
            assert store.replay(cases[:n])(text) == want
    chain = [(f"w{i}", f"w{i + 1}") for i in range(5000)]
    looked = []
    monkeypatch.setattr(store, "_replaced", lambda *a: looked.append(a))
    assert store.replay(chain)("w0 w7። " * 1000) == "w5000 w5000። " * 1000 and not looked  # no pass over the text for each correction


def test_the_whole_ledger_is_replayed(spark):
    """700 corrections, chains, joins and marks among them, against a plain fold."""
    r = random.Random(3)
    rows = [(f"w{i}", f"w{i + 1}" if i % 7 == 0 else f"v{i} w{r.randrange(700)}", 900 - i) for i in range(690)]
    rows += [("-a-", "w", 990), ("ww", "w5 b", 60), ("b.", "b", 50), ("w1 w2", "two", 2000), ("...", "…", 40), ("é_1", "w600", 1000), ("v3", "", 10), ("$", "$1", 9), ("w690", "last", 1), (" ", "  ", 3)]
    texts = [" ".join(f"w{r.randrange(700)}" + r.choice(["", ".", "...", "x", "።", "፣፤"]) for _ in range(40)) for _ in range(50)] + ["-a--a- w1 w2 é_1", "w690", "a $ b. , ", "", "none"]
    want = {}
    for i, text in enumerate(texts):
        new = text
        for before, after, _ in sorted(rows, key=lambda x: (-x[2], x[0])):
            new = re.sub(rf"(?<![^\s\u1361]){re.escape(before)}(?![^\s\u1361-\u1368])", lambda _, a=after: a, new)
        if new != text:
            want[i] = new
    c = frame(spark, rows, "before string, after string, n long")
    assert {r.page_id: r.text for r in store.apply_ledger(pages_of(spark, *texts), c).collect()} == want and want[51] == "last"


def test_occurrences_overlap(spark):
    got = store.occurrences(pages_of(spark, "ababab", "x", "aba"), "aba").orderBy("page_id", "offset").collect()
    assert [(r.page_id, r.offset) for r in got] == [(0, 0), (0, 2), (2, 0)]


def test_store_edits(spark):
    t = frame(spark, [(1, "a"), (2, "b")], "page_id long, text string")
    assert {r.page_id: r.text for r in store.upsert(t, frame(spark, [(2, "c"), (3, "d")], t.schema), "page_id").collect()} == {1: "a", 2: "c", 3: "d"}
    assert store.delete_pages(frame(spark, [(1,)], "page_id long"), t)[0].count() == 1
    d = frame(spark, [("r", "", "n"), ("r", "r", "n"), ("r", "e", "n")], "raw string, edited string, new string")
    assert [x[0] for x in d.select(store.rerecognized(*map(F.col, ("raw", "edited", "new")))).collect()] == ["n", "n", "e"]
    assert [x[0] for x in d.select(store.edited_text(F.col("raw"), F.col("edited"))).collect()] == ["r", "r", "e"]
    s = frame(spark, [('{"a":"1","b":"2"}', '{"b":"3"}'), ("broken", '{"c":"4"}')], "held string, new string")
    assert [x[0] for x in s.select(store.merged_settings(F.col("held"), F.col("new"))).collect()] == ['{"a":"1","b":"3"}', '{"c":"4"}']
    idx = frame(spark, [(4,)], "idx int")
    assert [r.idx for r in store.add_pages(idx, frame(spark, [(1, "x"), (2, "y")], "seq int, raw_text string")).orderBy("idx").collect()] == [5, 6]


def boxes(spark, *words):
    return frame(spark, [(1, ln, i, t, i * 60, ln * 40, 50 if len(t) < 8 else 180, 30, 0.5) for ln, i, t in words], "page_id long, line_idx int, word_idx int, text string, x int, y int, w int, h int, conf double")


def test_geometry(spark):
    b = boxes(spark, (0, 0, "ሰላም"), (0, 1, "ለሁሉም"), (1, 0, "ነው"))
    assert geometry.page_texts(b).first().text == "ሰላም ለሁሉም\nነው"
    a = geometry.assembled(b).orderBy("line_idx", "word_idx").collect()
    assert [(r.start, r.end) for r in a] == [(0, 3), (4, 8), (9, 11)]
    line = geometry.lines(b).orderBy("line_idx").first()
    assert (line.x, line.w, line.text, line.baseline) == (0, 110, "ሰላም ለሁሉም", 30)
    s = geometry.split_boxes(boxes(spark, (0, 0, "ሰላም፡ለሁሉም"), (0, 1, "ነው፡"))).orderBy("word_idx").collect()
    assert {(r.text, r.x, r.w) for r in s} == {("ሰላም", 0, 68), ("ለሁሉም", 90, 90), ("ነው", 60, 33)}
    at = geometry.box_at(frame(spark, [(1, 3), (1, 5), (1, 50)], "page_id long, at int"), geometry.assembled(b)).orderBy("at").collect()
    assert [(r.at, r.text, r.covers) for r in at] == [(3, "ለሁሉም", False), (5, "ለሁሉም", True)]


def test_characters_to_words(spark):
    chars = [(1, 0, "a", 0.0, 0.0, 5.0, 10.0), (1, 1, "b", 6.0, 0.0, 11.0, 10.0), (1, 2, "c", 30.0, 0.0, 35.0, 10.0), (1, 3, "d", 0.0, 50.0, 5.0, 60.0)]
    got = geometry.from_characters(frame(spark, chars, "page_id long, pos int, ch string, left double, bottom double, right double, top double"), 100.0).collect()
    assert [(r.text, r.line_idx, r.word_idx) for r in got] == [("ab", 0, 0), ("c", 0, 1), ("d", 1, 0)]


def test_words_with_their_neighbours(spark):
    """Words cut with their neighbours are those that a window over each page would give, and no page is shuffled for them."""
    p = frame(spark, [(1, "ab ab cd"), (2, "x"), (3, ""), (4, None), (5, "cd ab")], "page_id long, text string")
    got = tokens.context_table(p)
    assert sorted((r.page_id, r.word_no, r.start, r.end, r.word, r.previous or "", r.next or "", r.next_end or -1) for r in got.collect()) == [
        (1, 0, 0, 2, "ab", "", "ab", 5), (1, 1, 3, 5, "ab", "ab", "cd", 8), (1, 2, 6, 8, "cd", "ab", "", -1), (2, 0, 0, 1, "x", "", "", -1), (5, 0, 0, 2, "cd", "", "ab", 5), (5, 1, 3, 5, "ab", "cd", "", -1),
    ]
    found = issues.repeated_words(got)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.collect() == issues.repeated_words(tokens.word_table(p)).collect()
    pairs = lambda d: {(r.w1, r.w2): r.freq for r in d.collect()}
    assert pairs(issues.bigrams_of(got)) == pairs(lexicon.bigrams(p))


def test_unknown_rates_look_up_usual_words_first(spark, monkeypatch):
    """The same rates whether a known word is among the usual ones or not, with recognition at hand or not."""
    held = frame(spark, [("ab", "ab", "ab", 5), ("cd", "cd", "cd", 4)], "surface string, folded string, skeleton string, freq long")
    p = frame(spark, [(1, "ab cd xy ab xy"), (2, "cd"), (3, ""), (4, None)], "page_id long, text string")
    seen = frame(spark, [("ab", True), ("cd", True), ("xy", False)], "word string, known boolean")
    for most in (1, 100):
        monkeypatch.setattr(lexicon, "USUAL", most)
        for s in (None, seen):
            assert sorted((r.page_id, r.n_words, r.n_unknown) for r in lexicon.unknown_rates(p, held, seen=s).collect()) == [(1, 5, 2), (2, 1, 0)]


def test_vote(spark, lex):
    r = frame(spark, [(1, 0, 0, "ሰላም", 0.9), (1, 0, 1, "ለሁላም", 0.9), (1, 1, 0, "ሰላም", 0.9), (1, 1, 1, "ለሁሉም", 0.9)], "page_id long, engine_rank int, word_idx int, text string, conf double")
    got = voting.voted(r, lex).orderBy("word_idx").collect()
    assert [(x.text, x.n_readings) for x in got] == [("ሰላም", 1), ("ለሁሉም", 2)] and got[0].conf == 0.9 and 0.3 <= got[1].conf <= 1


def test_readers_are_compared_where_pages_lie(spark):
    """Rows of readings and readings page by page give the same words, and the latter are not shuffled."""
    texts = {1: [["a", "b", "c", "d"], ["a", "x", "c", "d"], ["a", "b", "d"]], 2: [["a"], []], 3: [["a", "b"]]}
    rows = [(p, e, i, w, i / 10) for p, readers in texts.items() for e, words in enumerate(readers) for i, w in enumerate(words)]
    by_row = voting.aligned(frame(spark, rows, "page_id long, engine_rank int, word_idx int, text string, conf double"))
    pages = [(p, list(range(len(r[0]))), [i / 10 for i in range(len(r[0]))], r) for p, r in texts.items()]
    by_page = voting.compared(frame(spark, pages, "page_id long, word_idx array<int>, conf array<double>, texts array<array<string>>"))
    want = [(1, 0, "a", 0.0, ["a", "a"]), (1, 1, "b", 0.1, ["x", "b"]), (1, 2, "c", 0.2, ["c"]), (1, 3, "d", 0.3, ["d", "d"]), (2, 0, "a", 0.0, []), (3, 0, "a", 0.0, []), (3, 1, "b", 0.1, [])]
    for got in (by_row, by_page):
        assert sorted((r.page_id, r.word_idx, r.text, r.conf, r.others) for r in got.collect()) == want
    assert "Exchange" not in by_page._jdf.queryExecution().executedPlan().toString()


def test_sources(spark, tmp_path):
    t = frame(spark, [(1, "a\n\fb\n"), (2, "x\n--- Page 3 ---\ny"), (3, "plain"), (4, "")], "k long, text string")
    got = [(r.k, r.idx, r.label, r.text) for r in source.import_pages(t, "k").orderBy("k", "idx").collect()]
    assert got == [(1, 0, "p. 1", "a"), (1, 1, "p. 2", "b"), (2, 0, "p. 1", "x"), (2, 1, "p. 2", "y"), (3, 0, "p. 1", "plain"), (4, 0, "p. 1", "")]
    (tmp_path / "list.tsv").write_text("# comment\nኢትዮጵያ\t5000\nጥንታዊት\nbad\tx\n\t7\n", "utf-8")
    assert {(r.surface, r.freq) for r in source.read_wordlist(spark, str(tmp_path / "list.tsv")).collect()} == {("ኢትዮጵያ", 5000), ("ጥንታዊት", 1), ("bad", 1)}
    source.write_wordlist(frame(spark, [("b", 5), ("a", 5), ("c", 1)], "word string, freq long"), str(tmp_path / "out"))
    assert [(r.surface, r.freq) for r in source.read_wordlist(spark, str(tmp_path / "out")).collect()] == [("a", 5), ("b", 5)]
    assert table_of(spark, source.strip_wiki(F.col("t")), "a {{x {{y}} z}} [[File:q.png]] <b>c</b>") == "a c"
    names = frame(spark, [("page_10",), ("page_2",), ("page_1",)], "n string")
    assert [r.n for r in names.orderBy(source.natural_key(F.col("n"))).collect()] == ["page_1", "page_2", "page_10"]
    pages = frame(spark, [("a", i) for i in range(3)] + [("b", i) for i in range(100)], "book string, idx int")
    places = {b: sorted(r.idx for r in source.sampled(pages).where(F.col("book") == b).collect()) for b in "ab"}
    assert places == {"a": [0, 1, 2], "b": [0, 12, 25, 37, 50, 62, 75, 87]}
    assert source.read_texts(spark, str(tmp_path / "list.tsv")).count() == 1


def table_of(spark, column, text):
    return " ".join(spark.createDataFrame([(text,)], "t string").select(column).first()[0].split())


def test_boilerplate(spark):
    p = frame(spark, [(i, "b", f"stamp\nline {i}\nstamp") for i in range(8)] + [(8, "c", "stamp"), (9, "c", "stamp")], "page_id long, book string, text string")
    lines = source.boilerplate(p)
    assert [(r.book, r.line, r.n) for r in lines.collect()] == [("b", "stamp", 8)]
    assert {r.page_id: r.text for r in source.strip_boilerplate(p, lines).collect()}[0] == "line 0"
    page = "ሰላም ለሁሉም ሰው ይሁን። " * 10
    rows = [(i, "stamped", f"t.me/x\n{i} {page}") for i in range(10)] + [(i, "stamp", "Scanned\nt.me/x") for i in range(9)] + [(i, "latin", f"{i} some words of a page " * 9) for i in range(4)] + [(0, "same", page), (1, "same", page), (2, "same", page)]
    got = {r.book: r for r in source.probe(frame(spark, [(b, i, t) for i, b, t in rows], "book string, idx int, text string")).collect()}
    assert {b: (r.usable, r.reason, list(r.boilerplate)) for b, r in got.items()} == {
        "stamped": (True, "usable", ["t.me/x"]), "stamp": (False, "stamp", ["Scanned", "t.me/x"]), "latin": (False, "other script", []), "same": (True, "usable", [page.strip()])
    }
    assert got["stamped"].sampled == 8 and got["stamped"].pages == 10


def test_recognizer_table(spark):
    rows = [("k", 0, 5, 1, 1, 1, 1, 0, 0, 10, 10, "90", "one"), ("k", 1, 4, 1, 1, 1, 1, 0, 0, 10, 10, "-1", ""), ("k", 2, 5, 1, 1, 1, 1, 20, 0, 10, 10, "-1", "two"), ("k", 3, 5, 1, 1, 1, 2, 0, 20, 10, 10, "80", "three")]
    d = frame(spark, rows, "key string, row_no int, level int, page_num int, block_num int, par_num int, line_num int, left int, top int, width int, height int, conf string, text string")
    got = source.recognizer_words(d).orderBy("line_idx", "word_idx").collect()
    assert [(r.line_idx, r.word_idx, r.text, r.conf) for r in got] == [(0, 0, "one", 0.9), (0, 1, "two", 0.0), (1, 0, "three", 0.8)]


def test_documents(spark):
    p = pages_of(spark, "TITLE\nline one\nline two\n\nnext፡\npart")
    marks = frame(spark, [(0, 0, 5, "chapter")], "page_id long, start int, end int, kind string")
    b = document.blocks(p, marks).orderBy("block_no").collect()
    assert [(r.kind, r.text) for r in b] == [("chapter", "TITLE"), ("paragraph", "line one line two"), ("paragraph", "next፡part")]
    d = spark.createDataFrame(b)
    assert document.markdown(d, "page_id", ("block_no",)).first().markdown == "## TITLE\n\nline one line two\n\nnext፡part\n"
    assert [r.chapter_no for r in document.chapters(d.withColumn("book", F.lit("b"))).orderBy("block_no").collect()] == [1, 1, 1]
    alto = document.alto(boxes(spark, (0, 0, "a<b"))).first().alto
    assert 'CONTENT="a&lt;b"' in alto and document.hocr(boxes(spark, (0, 0, "x"))).first().hocr.count("ocrx_word") == 1


@pytest.mark.parametrize("text", ["ሰላም ለሁሉም፡ነው። እኔ", "a" * 50, "one two  three", ""])
def test_wrapping(text):
    assert "".join(a + b for a, b in document.segments(text)) == text
    lines = document.wrapped(text, 10)
    assert all(len(x) <= 10 for x in lines) and "".join("".join(lines).split()) == "".join(text.split())


def test_stream_of_edits(spark, tmp_path):
    rows = [(1, 1, None, "a", "b", "manual", "s"), (2, 1, None, "a", "b", "accepted", "s"), (3, 1, None, "c", "c", "manual", "s"), (4, 1, None, "d", "e", "auto", "s")]
    spark.createDataFrame(rows, corrections.EDITS).write.parquet(str(tmp_path / "edits"))
    running = corrections.running_corrections(corrections.read_edits(spark, str(tmp_path / "edits")))
    q = running.writeStream.outputMode("complete").format("memory").queryName("running").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [(r.before, r.after, r.n) for r in spark.table("running").collect()] == [("a", "b", 2)]


def test_empty_pages(spark, lex):
    none = pages_of(spark, "x").where("false")
    for d in (token_table(none), word_table(none), words_only(none), lexicon.bigrams(none), issues.detected(none, lex), quality.histogram(none), document.blocks(none), document.wrap_lines(none)):
        assert d.count() == 0


@pytest.mark.parametrize(
    "text, width, lines",
    [
        ("one two three", 7, ["one two", "three"]),
        ("ሰላም፡ለሁሉም፡ነው።", 9, ["ሰላም፡ለሁሉም፡", "ነው።"]),
        ("a/b-c,d", 3, ["a/", "b-", "c,d"]),
        ("word.) next", 6, ["word.)", "next"]),
        ("abcdefghij kl", 4, ["abcd", "efgh", "ij", "kl"]),
        ("x  y", 2, ["x", "y"]),
    ],
)
def test_lines_break_after_marks(text, width, lines):
    assert document.wrapped(text, width) == lines


def test_explanations(spark):
    rows = frame(spark, [("order", "ሰላም", "ሱላም"), ("order", "ሰላ", "መላ"), ("family", "a", "b"), ("indel", "a", "b"), ("engine", "a", "b")], "s string, a string, b string")
    got = [r[0] for r in rows.select(issues.explained(F.col("s"), F.col("a"), F.col("b"))).collect()]
    assert got == ["Vowel order: ሰ→ሱ", "Same consonant skeleton", "Visually similar consonant", "A character was added or lost", "engine"]


def test_readers_are_aligned():
    own = "one two three four five six seven".split()
    assert voting.read_at(own, own) == own
    assert voting.read_at(own, "one two thrxx four five six seven".split())[2] == "thrxx"
    assert voting.read_at(own, "one two five six seven".split())[2:4] == ["", ""]
    assert voting.read_at(own, "zero one two three four five six seven".split()) == own
    r = random.Random(2)
    for _ in range(100):  # a shuffled text with a few words read otherwise
        own = [f"w{r.randrange(60)}" for _ in range(r.randint(1, 300))]
        other = [w + "x" if r.random() < 0.1 else w for w in own]
        runs = [list(g) for _, g in groupby(range(len(own)), key=lambda i: own[i] != other[i])]  # neighbours read otherwise are one run
        want = [" ".join(other[i] for i in run) if own[run[0]] != other[run[0]] else other[k] for run in runs for k in run]
        assert voting.read_at(own, other) == want


def test_runs_that_failed_have_no_vote(spark):
    runs = [(1, 0, "a", "amh", 0, "no model"), (1, 1, "b", "", 5, None), (1, 2, "c", "tir", 4, ""), (2, 0, "a", "amh", 0, "no model"), (2, 1, "b", "", 0, None)]
    got = {r.page_id: (r.engine, r.ok, r.error) for r in voting.outcome(frame(spark, runs, "page_id long, engine_rank int, engine string, language string, n_words int, error string")).collect()}
    assert got == {1: ("b+c/tir", True, ""), 2: ("", False, "no model")}


def test_sessions(spark, lex, tmp_path):
    meta = session.with_defaults(frame(spark, [("author", "A")], "key string, value string"), "Book")
    assert {r.key: r.value for r in meta.collect()} == {"author": "A", "title": "Book", "language": "am", "policy": "faithful", "schema_version": "1"}
    assert meta.agg(session.meta_value(meta, "title"), session.meta_value(meta, "none", "x")).first()[:] == ("Book", "x")
    pages = frame(spark, [(i, i, f"p. {i}", s) for i, s in enumerate(["new", "verified", "skipped", "recognized"])], "page_id long, idx int, label string, status string")
    assert [r.page_id for r in session.scope(pages, "unrecognized").collect()] == [0]
    assert {r.page_id: r.idx for r in session.reordered(pages, 0, 2).collect()} == {0: 2, 1: 0, 2: 1, 3: 3} and session.reordered(pages, 99, 1).count() == 4
    words = frame(spark, [(0, 0, 2, "ab"), (1, 0, 2, "ab")], "page_id long, start int, end int, text string")
    texts, boxes_ = session.stored_results(words, frame(spark, [(0, "ሰላም  ነው"), (1, "ab")], "page_id long, text string"))
    assert {r.page_id: r.text for r in texts.collect()} == {0: "ሰላም ነው", 1: "ab"} and {r.page_id: (r.start, r.end) for r in boxes_.collect()} == {0: (-1, -1), 1: (0, 2)}
    new = frame(spark, [(1, 1.0, "ሰሉም", "ሰላም አዲስ", "editor"), (1, 2.0, "x", "x", "editor")], "page_id long, ts double, before string, after string, source string")
    old = frame(spark, [], "page_id long, ts double, before string, after string, kind string, source string")
    ledger, lexicon_, learned = session.accepted(new, old, lex, frame(spark, [("ሉ", "ላ", 2)], "observed string, intended string, n long"))
    assert [r.kind for r in ledger.collect()] == ["accepted"] and lexicon_.where("surface = 'አዲስ'").count() == 1 and {(r.observed, r.intended): r.n for r in learned.collect()}[("ሉ", "ላ")] == 3
    costs = lexicon.costs_of(learned)
    session.save_model(spark, costs, f"file://{tmp_path}/model")
    assert session.load_model(spark, f"file://{tmp_path}/model").seen == costs.seen and session.load_model(spark, f"file://{tmp_path}/none").seen == {}
    assert [r.observed for r in lexicon.top_confusions(learned, 1).collect()] == ["ሉ"]


def test_exports_of_a_book(spark):
    p = frame(spark, [(1, 1, "new"), (2, 0, "skipped")], "page_id long, idx int, status string")
    words = boxes(spark, (0, 0, "x"))
    words = words.unionByName(words.withColumn("page_id", F.lit(2).cast("long")).withColumn("text", F.lit("gone")))
    text = document.hocr_book(p, words, "A & B").first().hocr
    assert "A &amp; B" in text and ">x<" in text and "gone" not in text
    body = spark.createDataFrame([("one\n",)], "b string")
    assert [body.select(document.titled(F.col("b"), F.lit(t), F.lit(a))).first()[0] for t, a in (("T", "A"), ("T", ""), ("", "A"))] == ["T\n\nA\n\n\n\none\n", "T\n\n\n\none\n", "one\n"]


def test_mixed_drops_and_xz(spark, tmp_path):
    import lzma

    files = frame(spark, [("b.txt", 0), ("p10.png", 1), ("x.exe", 2), ("p2.PNG", 3), ("d.pdf", 4), ("a.md", 5)], "name string, pos int")
    assert [r.name for r in source.dispatched(files).orderBy("seq").collect()] == ["p2.PNG", "p10.png", "d.pdf", "b.txt", "a.md"]
    with lzma.open(tmp_path / "t.xz", "wt", encoding="utf-8") as f:
        f.write("ሰላም\nnext\n")
    assert [r.text for r in source.READERS["lines"](spark, str(tmp_path / "t.xz")).collect()] == ["ሰላም", "next"]
    names = frame(spark, [("am/clean_docs.2.jsonl.gz",), ("am/noisy_docs.1.jsonl.gz",), ("am/clean_docs.1.jsonl.gz",)], "name string")
    assert [r.name for r in source.shards(names).collect()] == ["am/clean_docs.1.jsonl.gz", "am/clean_docs.2.jsonl.gz"]
    lines = frame(spark, [(1, "a\nb\nc\nd\ne"), (2, "a\n\fb")], "k long, text string")
    assert [(r.k, r.text) for r in source.import_pages(lines, "k", 2).orderBy("k", "idx").collect()] == [(1, "a\nb"), (1, "c\nd"), (1, "e"), (2, "a"), (2, "b")]


def test_issues_weigh_on_quality(spark, lex):
    p = pages_of(spark, "ሰላም ነው ሰላም", "ሰላም ነው ሰላam").withColumn("status", F.lit("new")).withColumn("mean_conf", F.lit(0.9))
    plain, weighed = ({r.page_id: r for r in quality.page_quality(p, lex, i).collect()} for i in (None, issues.detected(p, lex)))
    assert weighed[0].score == plain[0].score and weighed[1].high >= 1 and weighed[1].score == pytest.approx(plain[1].score - 0.02 * weighed[1].high)


def test_words_without_boilerplate_lines(spark):
    words = [(1, 0, 1, "b", 7), (1, 0, 0, "a", 6), (1, 1, 0, "stamp", 5), (1, 2, 0, " c", 4), (2, 0, 0, "stamp", 3), (2, 5, 0, "d", 2), (2, 5, 0, "a", 1)]
    lines = geometry.by_line(frame(spark, words, "page_id long, line_idx int, word_idx int, text string, x int"))
    assert {(r.page_id, r.line_idx, r.line) for r in lines.collect()} == {(1, 0, "a b"), (1, 1, "stamp"), (1, 2, "c"), (2, 0, "stamp"), (2, 5, "a d")}
    got = geometry.without_lines(lines, frame(spark, [(" stamp ",), ("",), (None,)], "line string"))
    assert sorted(map(tuple, got.collect())) == [(1, 0, 0, "a", 6), (1, 0, 1, "b", 7), (1, 1, 0, " c", 4), (2, 0, 0, "a", 1), (2, 0, 0, "d", 2)]
