import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fidelmill.llm import langid, toxicity

SYLLABLES = {"en": "th an er on ing ed st the".split(), "de": "sch ei ung ver ich aus heit ge".split(), "fr": "eau que ment oi eux tion aire les".split()}


def sentence(r, lang, low=5, high=60):
    return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 3))) for _ in range(r.randint(low, high)))


@pytest.fixture(scope="module")
def labelled(spark):
    r = random.Random(3)
    docs, labels = [], []
    for i in range(600):
        lang = r.choice(list(SYLLABLES))
        words = sentence(r, lang).split()
        toxic = i % 4 == 0
        if toxic:
            for _ in range(2):
                words.insert(r.randrange(len(words)), r.choice(["fnargle", "grubbish", "snotting"]))
        docs.append((i, " ".join(words), lang, "s"))
        labels.append((i, 1, int(toxic)))
    docs += [(1000, None, "en", None), (1001, "", None, "s"), (1002, "12 34 !!", "en", "s"), (None, "the thing", "en", "s"), (1003, "fnargle " + sentence(r, "de", 9000, 9000), "de", "s"), (1004, "数学 数学 数学", None, "s")]
    labels += [(5000, 1, 1), (7, None, None)]
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").withColumn("score", F.lit("x")), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_on_held_out_rows(labelled):
    docs, labels = labelled
    got = toxicity.score(docs, labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.count() == docs.count()
    rows = got.join(labels.where("toxic is not null"), "doc_id").where("held_out").collect()
    assert len(rows) > 80 and np.mean([r.predicted == r.toxic for r in rows]) > 0.97
    by = {r.doc_id: r for r in got.collect()}
    assert by[1003].predicted == 1  # one word in a very long text
    assert by[1000].predicted == by[1001].predicted == 0 and by[1000].score == by[1001].score
    clean = toxicity.keep_clean(docs, labels)
    assert clean.columns == docs.columns and clean.count() == got.where("score < 0.5").count()


def test_labels_of_held_out_rows_are_not_used(labelled):
    docs, labels = labelled
    flipped = labels.withColumn("toxic", F.when(toxicity.crc_remainder("doc_id", 5) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a = {(r.doc_id, r.score) for r in toxicity.score(docs, labels).collect()}
    assert a == {(r.doc_id, r.score) for r in toxicity.score(docs, flipped).collect()}


def test_swapping_names_lowers_false_positives():
    """Texts that name one group are mostly labelled toxic; a neutral mention must not be."""
    r = random.Random(0)
    rows = []
    for i in range(400):
        toxic = i % 2 == 0
        words = sentence(r, "en").split() + (["fnargle"] if toxic and r.random() < 0.7 else []) + (["muslims"] if r.random() < (0.8 if toxic else 0.05) else [])
        rows.append((" ".join(words), float(toxic)))

    def rows_of(swaps):
        out = []
        for text, y in rows:
            raw = toxicity._raw(text)
            out.append((np.unique(toxicity.features([raw])[1]).view(np.int64), y, toxicity.swapped(raw) if swaps else []))
        return out

    neutral = [sentence(r, "en") + " muslims" for _ in range(50)]
    biased, fair = (toxicity.Scorer(toxicity.fit(rows_of(s))).scores(neutral).mean() for s in (False, True))
    assert fair < biased - 0.1
    assert toxicity.Scorer(toxicity.fit(rows_of(True))).scores(["fnargle an the"])[0] > 0.5


def test_one_class_and_nothing(labelled, spark):
    docs, labels = labelled
    low, high = (toxicity.score(docs, labels.where(f"toxic = {k}")).agg(F.min("score"), F.max("score")).first() for k in (0, 1))
    assert low[0] == low[1] < 0.1 and high[0] == high[1] > 0.9
    assert toxicity.score(docs, labels.where("false")).agg(F.max("score")).first()[0] < 1e-12
    assert toxicity.score(docs.where("false"), labels).count() == 0
    assert toxicity.score(docs, labels.where("false")).count() == docs.count()


def test_language_on_held_out_rows(labelled):
    docs, _ = labelled
    got = langid.identify(docs).drop("lang").join(docs.select("doc_id", "lang"), "doc_id")
    rows = got.where("held_out and doc_id < 600").collect()
    assert len(rows) > 100 and np.mean([r.lang == r.lang_pred for r in rows]) > 0.98
    by = {r.doc_id: r for r in langid.identify(docs).collect()}
    assert len(by) == docs.count()
    for i in (1000, 1001, 1002):
        assert (by[i].lang_pred, by[i].score, by[i].rejected) == ("und", 0.0, True)
    assert by[1004].lang_pred in SYLLABLES and by[1004].rejected
    assert all(0 <= r.score <= 1 for r in by.values())
    kept = langid.keep_known(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.select("doc_id").collect()} >= {r.doc_id for r in rows}


def test_language_without_labels(labelled):
    docs, _ = labelled
    assert {r.lang_pred for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.identify(docs.where("false")).count() == 0


def test_scores_by_plain_words(labelled):
    """Against the sum of weights over a text's distinct words and word beginnings, looked up one by one."""
    docs, labels = labelled
    keys, weights, intercept = toxicity.fit(toxicity.training_rows(docs, labels, 5, 3000))
    held = dict(zip(keys.tolist(), weights.tolist()))
    got = {r.doc_id: r.score for r in toxicity.score(docs, labels).collect()}
    for d, text in [(r.doc_id, r.text or "") for r in docs.collect()]:
        words = {w for w in "".join(c if c.isalpha() or not c.isascii() else " " for c in text.lower()).split()}
        found = {int(h) for w in words for h in toxicity.word_features(w)}
        z = intercept + sum(held.get(h, 0.0) for h in found)
        assert abs(got[d] - 1 / (1 + np.exp(-z))) < 1e-9


def test_long_texts_are_scored_in_pieces(labelled, monkeypatch):
    docs, labels = labelled
    model = toxicity.fit(toxicity.training_rows(docs, labels, 5, 3000))
    parts = [r.text or "" for r in docs.collect()]
    whole = toxicity.Scorer(model).scores(parts)
    monkeypatch.setattr("fidelmill.llm.wordtable.RUN_BYTES", 100)
    assert np.allclose(toxicity.Scorer(model).scores(parts), whole, atol=1e-12)


def test_languages_by_plain_cosines(labelled):
    """Against vectors as dictionaries and every cosine by its definition."""
    docs, _ = labelled
    model = langid.fit(docs)
    rows = docs.where("doc_id < 60").collect()
    lang, score, rejected = model.predict([r.text for r in rows])
    for r, got, value, no in zip(rows, lang, score, rejected):
        counts = langid.trigrams(r.text)
        x = {int(i): np.log1p(counts[i]) * model.idf[i] for i in np.flatnonzero(counts)}
        norm = sum(v * v for v in x.values()) ** 0.5
        cosine = [sum(v * p[i] for i, v in x.items()) / norm for p in model.points]
        best = int(np.argmax(cosine))
        assert got == model.langs[model.owner[best]] and abs(value - cosine[best]) < 1e-4 and no == (cosine[best] < model.floor[model.owner[best]])


def test_language_fit_is_the_same_in_any_order(labelled):
    docs, _ = labelled
    a, b = langid.fit(docs), langid.fit(docs.repartition(7, "text"))
    assert a.langs == b.langs and (a.points == b.points).all() and (a.floor == b.floor).all()
    odd = np.zeros((400, langid.DIMENSIONS), np.float32)
    odd[:, :50] = np.random.default_rng(0).random((400, 50))
    odd[7] = 0
    odd[7, 5000] = 1  # one stray text is no centroid
    odd /= np.linalg.norm(odd, axis=1, keepdims=True)
    assert (langid.centroids(odd, 4) @ odd[7] < 0.5).all()


def test_trigrams_of_long_texts(monkeypatch):
    text = "abc déf ghi " * 500
    whole = langid.trigrams(text)
    monkeypatch.setattr(langid, "SLICE", 97)
    assert (langid.trigrams(text) == whole).all()
