import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from tokenizers import Tokenizer
from tokenizers.models import Unigram

from fidelmill.llm import bitpack, counts, packing, tokens
from fidelmill.llm.tokens import Encoder, tokenizer_path
from fidelmill.llm.wordtable import Table

BYTE, WORD, PIECES = (tokenizer_path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))


def plain(path):
    t = Tokenizer.from_file(path)
    return lambda s: t.encode(s, add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


@pytest.mark.parametrize("path, chunks", [(BYTE, "byte"), (WORD, "word")])
def test_cached_encoding_is_the_tokenizers(path, chunks):
    r, want, e = random.Random(1), plain(path), Encoder(path, chunks)
    texts = ["", " ", "\n", " \n", "a \nb", "don't  I'll", "İ Σ ΣΑΣ é", "x\r\ny", "<|endoftext|>a", "a\x00b", "q\xa0w", "a\x1cb"]
    texts += ["a <|endoftext|> b", "<|startoftext|>x<|endoftext|>", "x<|ENDOFTEXT|>y", "<|endoftext", "a <|start oftext|> b"]
    texts += ["".join(r.choice("ab é.,\n \t '1Z　\U0001f600") for _ in range(r.randint(0, 40))) for _ in range(500)]
    for _ in range(2):  # unseen, then seen
        assert [x.tolist() for x in e.encode(texts)] == [want(t) for t in texts]


@pytest.mark.parametrize("path, chunks", [(BYTE, "byte"), (WORD, "word")])
def test_long_texts_are_encoded_in_slices(path, chunks, monkeypatch):
    r, want, e = random.Random(4), plain(path), Encoder(path, chunks)
    monkeypatch.setattr(tokens, "SLICE", 50)
    texts = ["".join(r.choice(["ab", " ", "  ", "é", "\n", "9", " a", ".", "\xa0", "<|endoftext|>", "'s"]) for _ in range(900)) for _ in range(30)] + ["x" * 500, " " * 300]
    assert max(len(tokens.slices(t)) for t in texts) > 5
    assert [x.tolist() for x in e.encode(texts)] == [want(t) for t in texts]


def test_an_id_that_does_not_fit_is_an_error():
    with pytest.raises(ValueError):
        bitpack.pack_bits(np.array([1, 8], np.uint32), 3)


def test_table_finds_what_was_added():
    r = np.random.default_rng(0)
    h = np.unique(r.integers(1, 1 << 63, 3000).astype(np.uint64) | np.uint64(1))
    t = Table(1 << 13)
    t.add(h[:2000], np.arange(2000, dtype=np.int32))
    found = t.find(h)
    assert (found[:2000] == np.arange(2000)).all() and (found[2000:] == -1).all()


@pytest.mark.parametrize("bits", [1, 5, 13, 16, 17, 32])
def test_bits_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1001).astype(np.uint32)
    raw = bitpack.pack_bits(ids, bits)
    assert len(raw) == (1001 * bits + 7) // 8
    assert (bitpack.unpack_bits(raw, bits, 1001) == ids).all()


def test_files_round_trip(spark, docs, rows):
    want, end = plain(BYTE), 0
    folder, manifest = bitpack.write_ids(docs, path=BYTE, end_id=end, shard_bytes=1 << 13)
    assert len(manifest) > 3 and sum(m[1] for m in manifest) == len(rows)
    got = bitpack.read_ids(spark, folder, manifest).orderBy("start").collect()
    at = 0
    for (d, text, *_), r in zip(sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0)), got):
        ids = want(text or "") + [end]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d, at, len(ids), crc(ids))
        at += len(ids)
    where, top = bitpack.opened(folder)  # random access
    reader = bitpack.Reader(where.open_input_file(f"{top}/shard-{manifest[-1][0]:08d}.fmb"))
    whole = np.concatenate([i for _, i in reader.documents()])
    assert (reader.read(3, 50) == whole[3:53]).all()


def test_rows_of_one_id_are_split_over_shards(spark):
    want = plain(BYTE)
    rows = [(7, f"text number {i}") for i in range(50)] + [(None, f"none {i}") for i in range(20)] + [(9, "same")] * 10
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    folder, manifest = bitpack.write_ids(d, path=BYTE, end_id=0, shard_bytes=100)
    got = bitpack.read_ids(spark, folder, manifest).orderBy("start").collect()
    assert len(manifest) > 4 and [r.doc_id for r in got] == [None] * 20 + [7] * 50 + [9] * 10
    assert sorted((r.doc_id or 0, r.ids_crc32) for r in got) == sorted((i or 0, crc(want(t) + [0])) for i, t in rows)
    again = bitpack.read_ids(spark, *bitpack.write_ids(d.repartition(2), path=BYTE, end_id=0, shard_bytes=100)).orderBy("start").collect()
    assert again == got


def test_no_documents_no_files(spark, empty):
    folder, manifest = bitpack.write_ids(empty, path=BYTE, end_id=0)
    assert manifest == [] and bitpack.read_ids(spark, folder, manifest).count() == 0


def test_counts_match_a_unigram_tokenizer(docs, rows):
    with open(PIECES, "rb") as f:
        vocabulary = counts.pieces(f.read())
    t = Tokenizer(Unigram([(p, s) for p, s, _ in vocabulary], unk_id=0, byte_fallback=True))
    got = {r.doc_id: r.n_tokens for r in counts.count_tokens(docs, PIECES).collect()}
    for d, text, *_ in rows:
        assert got[d] == (len(t.encode("▁" + text.replace(" ", "▁")).ids) if text else 0)


def test_counts_by_brute_force():
    c = counts.Counter([("a", -1.0, 1), ("b", -1.0, 1), ("ab", -2.0, 1), ("ba", -1.5, 1), ("aba", -3.0, 1), ("▁", -0.5, 1)])

    def best(s):
        top = {0: (0.0, 0)}
        for end in range(1, len(s) + 1):
            for start in range(end):  # earliest start first, later ones only if strictly better
                score = {"a": -1.0, "b": -1.0, "ab": -2.0, "ba": -1.5, "aba": -3.0, "▁": -0.5}.get(s[start:end])
                if score is not None and (end not in top or top[start][0] + score > top[end][0]):
                    top[end] = (top[start][0] + score, top[start][1] + 1)
        return top[len(s)][1]

    r = random.Random(2)
    for _ in range(300):
        s = "".join(r.choice("ab ") for _ in range(r.randint(1, 14)))
        assert c.count(s)[0] == best("▁" + s.replace(" ", "▁"))


def check_packing(got, rows, want, size):
    by, windows = {}, {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length, r.queue))
    for d, text, *_ in rows:
        ids, at = want(text or "") + [2], 0
        for r in sorted(by[d], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == crc(ids[at : at + r.length])
            at += r.length
        assert at == len(ids)
    assert sorted(windows) == list(range(len(windows)))
    for k, parts in windows.items():
        at = 0
        for offset, length, _ in sorted(parts):
            assert offset == at
            at += length
        assert at == size or k == len(windows) - 1 and at < size
    return windows


def test_packing_is_exact_and_follows_the_mixture(docs, rows):
    got = packing.pack(docs, path=WORD, size=256).collect()
    windows = check_packing(got, rows, plain(WORD), 256)
    total, n = {}, 0
    for r in got:
        total[r.queue] = total.get(r.queue, 0) + r.length
        n += r.length
    served = dict.fromkeys(total, 0)
    for k in sorted(windows)[:-1]:
        for _, length, q in windows[k]:
            served[q] += length
        for q in total:  # what a queue is owed at any window stays small
            assert abs(served[q] - (k + 1) * 256 * total[q] / n) <= len(total) + 1


def test_packing_with_other_weights(docs, rows):
    got = packing.pack(docs, path=WORD, size=128, weights={"hot": 5.0, "s0": 1.0, "s1": 1.0, "s2": 1.0, None: 1.0}).collect()
    windows = check_packing(got, rows, plain(WORD), 128)
    first = {}
    for k in range(5):
        for _, length, q in windows[k]:
            first[q] = first.get(q, 0) + length
    assert max(first.values()) > 0.4 * sum(first.values())


def test_packing_nothing(empty):
    assert packing.pack(empty, path=WORD).count() == 0


def test_served_is_one_order():
    totals = np.array([1, 7, 1000, 333, 2])
    all_ = packing.served(np.arange(totals.sum() + 1), totals, totals)
    assert (all_.sum(1) == np.arange(totals.sum() + 1)).all() and (np.diff(all_, axis=0) >= 0).all() and (all_[-1] == totals).all()


@pytest.mark.parametrize("cells", [1 << 20, 5000])
@pytest.mark.parametrize("own", [True, False])
def test_many_queues_are_served_in_order_of_due_time(monkeypatch, cells, own):
    monkeypatch.setattr(packing, "CELLS", cells)
    g = np.random.default_rng(5)
    totals = g.integers(1, 60, 700)
    weights = totals if own else g.integers(1, 9, 700).astype(float)
    order = sorted((Fraction(2 * t + 1, 2 * int(w)), q, t) for q, (n, w) in enumerate(zip(totals, weights)) for t in range(n))
    queue, start = np.arange(700).repeat(2), np.stack([0 * totals, totals // 2], 1).ravel()
    n = np.stack([totals // 2, totals - totals // 2], 1).ravel()
    got = packing.pack_rows(queue, start, n, weights, totals, 128)
    windows = {(int(queue[r]), int(start[r] + s + x)): (int(k), int(o + x)) for r, s, m, k, o in zip(*got) for x in range(m)}
    # doubles can swap tokens that are due at the very same time
    assert sorted((k, Fraction(2 * t + 1, 2 * int(weights[q]))) for (q, t), (k, _) in windows.items()) == [(i // 128, due) for i, (due, *_) in enumerate(order)]
    assert sorted(windows.values()) == [(i // 128, i % 128) for i in range(len(order))]


def test_each_of_many_sources_is_a_queue(spark):
    rows = [(i, "one two three four " * (1 + i % 3), f"s{i % 300}") for i in range(600)] + [(600, "none at all", None), (601, "no name", "")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = packing.pack(d, path=WORD, size=64).collect()
    check_packing(got, rows, plain(WORD), 64)
    source = {x[0]: x[2] for x in rows}
    assert len({(r.queue, source[r.doc_id]) for r in got}) == len({r.queue for r in got}) == 302
    got = packing.pack(d, path=WORD, size=64, weights={s: 1000.0 if s == "s7" else 1.0 for s in source.values()}).collect()
    check_packing(got, rows, plain(WORD), 64)
    first = [r for r in got if r.sequence_id == 0]
    assert sum(r.length for r in first if source[r.doc_id] == "s7") == sum(r.doc_tokens for r in {r.doc_id: r for r in got if source[r.doc_id] == "s7"}.values())
