import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fidelmill.llm import ngram, pivots
from tests_brute import components, shingles


def expected(rows):
    sets = {d: shingles(t) for d, t, *_ in rows if d is not None}
    ids = sorted(sets)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    return {d: len(s) for d, s in sets.items()}, components(ids, links)


def test_join_matches_brute_force(docs, rows):
    sizes, classes = expected(rows)
    got = {r.doc_id: r for r in ngram.join_classes(docs).collect()}
    assert len(got) == len(rows) and got[None].component_id is None
    for d in sizes:
        assert (got[d].n_shingles, got[d].component_id) == (sizes[d], classes[d])


@pytest.mark.parametrize("known, coarse, range_bytes", [(1_000_000, 11, 16 << 20), (0, 11, 16 << 20), (40, 1, 1 << 12)])
def test_heavy_lists_lose_no_link(spark, monkeypatch, known, coarse, range_bytes):
    """A family of near copies larger than the heavy limit, at similarities around the threshold, in several blocks.

    With all heavy tokens known; with none, so that posting lists are long; with some, and ranges dealt twice.
    """
    monkeypatch.setattr(ngram, "HEAVY", 8)
    monkeypatch.setattr(ngram, "BLOCK", 16)
    monkeypatch.setattr(ngram, "MAX_HEAVY", known)
    monkeypatch.setattr(ngram, "COARSE", coarse)
    monkeypatch.setattr(ngram, "RANGE_BYTES", range_bytes)
    r = random.Random(5)
    base = [f"w{r.randint(0, 400)}" for _ in range(150)]
    rows = []
    for i in range(90):
        w = list(base)
        for _ in range(r.randint(0, 7)):
            w[r.randrange(len(w))] = f"x{i}_{r.randint(0, 9)}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, " ".join(base[:50] + [f"y{i}_{j}" for j in range(60)])) for i in range(40)]  # share a passage only
    sizes, classes = expected(rows)
    got = {x.doc_id: x.component_id for x in ngram.join_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == classes


def test_keep_one(docs, rows):
    _, classes = expected(rows)
    kept = ngram.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted(set(classes.values()))


def test_pairs_end_at_prefixes_before_sets_are_moved(spark):
    """Two texts that share some shingles often share a prefix token under one order, but seldom under all."""
    r = random.Random(3)
    rows = []
    for i in range(60):
        common = [f"c{i}_{j}" for j in range(12)]
        rows += [(2 * i + k, " ".join(common + [f"d{i}_{k}_{r.randint(0, 10**6)}" for _ in range(40)])) for k in (0, 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    pairs = spark.createDataFrame([(2 * i, 2 * i + 1) for i in range(60)], "a long, b long")
    sets = ngram.sets_of(d, d.select("doc_id"), 80)
    passed = ngram.kept_pairs(ngram.both_sides(pairs, sets, ["p0", "p1"]), ngram.share_prefixes).count()
    assert passed < 60 and ngram.verified(d, pairs, 80).count() == 0


def test_long_words_and_pieces(monkeypatch):
    r = random.Random(8)
    text = " ".join("w" * r.randint(1, 40) + str(r.randint(0, 99)) for _ in range(5000)).encode()
    whole = ngram.shingle_sets([text, b"", b"a b", text[:1000]])
    monkeypatch.setattr(ngram, "RUN_BYTES", 777)
    assert all((a == b).all() for a, b in zip(whole, ngram._sets([text, b"", b"a b", text[:1000]])))
    assert ngram.normalized(" A\t b\n\x0b " * 200) == b" ".join([b"a b"] * 200)


def test_empty_join(empty):
    assert ngram.join_classes(empty).count() == 0


def test_pivots_match_brute_force(spark):
    g = np.random.default_rng(1)
    x = g.normal(size=(400, 32))
    x[50:120] = x[0] + 0.05 * g.normal(size=(70, 32))  # a dense group
    x[120:130] = x[5]
    rows = [(i, v.astype(np.float32).tolist(), i % 3) for i, v in enumerate(x)]
    rows += [(500, None, 1), (501, [0.0] * 32, 1), (502, [float("nan")] * 32, 1), (503, [None] * 32, 1), (504, [float("inf")] + [1.0] * 31, 1), (505, [], 1)]
    y = np.array([r[1] for r in rows[:400]], float)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    link = (y @ y.T >= 0.95) & ~np.eye(400, dtype=bool)
    classes = components(range(400), list(zip(*np.nonzero(link))))
    got = {r.vec_id: r for r in pivots.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)).collect()}
    assert len(got) == len(rows)
    for i in range(400):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (link[i].sum(), classes[i], classes[i] == i)
    for i in range(500, 506):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)


def test_pivot_recall_at_the_threshold(spark):
    """Pairs at a cosine of 0.951 in 64 dimensions among unrelated vectors."""
    g = np.random.default_rng(0)
    a = g.normal(size=(5000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = g.normal(size=(400, 64))
    b -= (b * a[:400]).sum(1, keepdims=True) * a[:400]
    b = 0.951 * a[:400] + (1 - 0.951**2) ** 0.5 * b / np.linalg.norm(b, axis=1, keepdims=True)
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(np.concatenate([a, b]))], "vec_id long, embedding array<double>")
    assert pivots.near_duplicates(d).agg(F.sum("n_links")).first()[0] / 800 >= 0.9


def test_lengths_do_not_mix_and_repeats_are_rows(spark):
    """Two lengths of vectors, long lists in blocks, repeated ids and an extra column."""
    g = np.random.default_rng(4)
    rows = []
    for dim, at in ((16, 0), (24, 1000), (3, 2000)):
        x = g.normal(size=(150, dim))
        x[20:100] = x[0] + 0.02 * g.normal(size=(80, dim))
        x[100:110] = x[3]
        rows += [(at + i, v.tolist(), "x") for i, v in enumerate(x)]
    rows += [(5, rows[200][1], "y"), (3000, [2.0], "z"), (3001, [5.0], "z"), (None, [1.0], "z")]
    ids, links = range(len(rows)), []
    count = [0] * len(rows)
    for i in ids:
        for j in range(i + 1, len(rows)):
            a, b = np.array(rows[i][1]), np.array(rows[j][1])
            if len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.95:
                count[i], count[j] = count[i] + 1, count[j] + 1
                links.append((rows[i][0], rows[j][0]))
    node = components(sorted({r[0] for r in rows if r[0] is not None}), [x for x in links if None not in x])
    d = spark.createDataFrame([(v, e, k, k) for v, e, k in rows], "vec_id long, embedding array<double>, cls string, digest string").repartition(3)
    got = sorted((r.vec_id is None, r.vec_id or 0, r.n_links, r.component_id or 0) for r in pivots.near_duplicates(d).collect())
    want = sorted((v is None, v or 0, n, 0 if v is None else node[v]) for (v, _, _), n in zip(rows, count))
    assert got == want


def test_no_vectors(spark):
    assert pivots.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
