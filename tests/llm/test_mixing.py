import random
import re

from fidelmill.llm import mixing


def water(sizes, pattern=(3, 1, 2), budget=1.5, most=2.0):
    """Targets by repeated sharing."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: pattern[i % len(pattern)] for i, s in enumerate(names)}
    target, left, open_ = {}, budget * sum(sizes.values()), set(names)
    while open_:
        share = {s: left * w[s] / sum(w[o] for o in open_) for s in open_}
        full = {s for s in open_ if share[s] >= most * sizes[s]}
        if not full:
            return target | share
        for s in full:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def test_targets_and_copies(docs, rows):
    sizes = {}
    for _, text, _, source in rows:
        sizes[source] = sizes.get(source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    want = water(sizes)
    got = mixing.taken(docs).collect()
    assert len(got) == len(rows)
    source_of = {r[0]: r[3] for r in rows}
    for r in got:
        assert abs(r.target - want[source_of[r.doc_id]]) < 1e-6
        assert r.source_size == sizes[source_of[r.doc_id]]
        rate = r.target / r.source_size if r.source_size else 0
        assert r.copies in (int(rate), int(rate) + 1) and r.copies <= 2
    again = sorted(map(str, mixing.taken(docs.repartition(2)).collect()))
    assert again == sorted(map(str, got))


def test_small_sources_come_near_their_targets(spark):
    r = random.Random(9)
    rows = [(i, "w " * r.randint(1, 400), f"s{i % 20:02}", "own") for i in range(1000)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, rate string")
    got = mixing.taken(d).join(d.select("doc_id", "source"), "doc_id").groupBy("source").agg({"taken": "sum", "target": "max"}).collect()
    for x in got:
        assert abs(x["sum(taken)"] / x["max(target)"] - 1) < 0.05
    assert mixing.emit(d).columns == d.columns


def test_emit_repeats_rows_and_keeps_columns(docs):
    out = mixing.emit(docs)
    assert out.columns == docs.columns
    assert out.count() == sum(r.copies for r in mixing.taken(docs).collect())


def test_empty(empty):
    assert mixing.taken(empty).count() == 0 and mixing.emit(empty).count() == 0


def test_hashed_draw_is_fair(spark):
    d = spark.range(20_000).selectExpr("id as doc_id", "'a b c d' as text", "case when id % 2 = 0 then 'p' else 'q' end as source")
    got = mixing.taken(d).join(d.select("doc_id", "source"), "doc_id").groupBy("source").agg({"copies": "avg", "target": "max"}).collect()
    for r in got:
        assert abs(r["avg(copies)"] - r["max(target)"] / 40_000) < 0.02
