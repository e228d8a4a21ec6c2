import re
import zlib

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fidelmill.llm import langid, mixing, toxicity
from fidelmill.llm.tokens import tokenizer_path
from tests_brute import components, shingles

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def final(spark):
    return corpus_pipeline.run(spark, SF).cache()


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language ID", "n-gram Jaccard join", "mixing sources to target weights", "packing"]


def test_run_matches_plain_steps(spark, final):
    """Decisions of the trained stages row by row, then plain Python for near-duplicates, mixing and packing."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    toxic = {r.doc_id for r in toxicity.score(docs, labels).where("score >= 0.5").collect()}
    clean = docs.where(~F.col("doc_id").isin(list(toxic)))
    gone = {r.doc_id for r in langid.identify(clean).where("rejected").collect()}
    rows = {r.doc_id: r for r in clean.collect() if r.doc_id not in gone}
    sets = {d: shingles(r.text) for d, r in rows.items()}
    ids = sorted(sets)
    classes = components(ids, [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])])
    kept = [rows[d] for d in ids if classes[d] == d]
    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in kept}
    copies = {r.doc_id: r.copies for r in mixing.taken(spark.createDataFrame(kept, docs.schema)).collect()}
    assert set(copies) == set(size)
    t = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    want = {}
    for r in kept:
        if copies[r.doc_id]:
            want[r.doc_id] = (len(t.encode(r.text, add_special_tokens=False).ids) + 1) * copies[r.doc_id]
    got, windows = {}, {}
    for r in final.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert got == want
    assert sorted(windows) == list(range(len(windows)))
    for k, parts in windows.items():
        assert sum(n for _, n in parts) == 4096 or k == len(windows) - 1
    total = {r.doc_id: r.length for r in final.where("start = 0").select("doc_id", "length").collect()}
    assert set(total) == set(want) and zlib.crc32(np.zeros(0, "<u4").tobytes()) == 0


def test_all_but_the_last_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns, name


def test_stages_take_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
