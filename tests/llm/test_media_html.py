import hashlib
import random
import re
import struct
import zlib
from html import unescape

import numpy as np
import pytest

from fidelmill.llm import html, media


def test_round_trip_of_texts(docs, rows):
    got = media.round_trip(docs).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    for d, text, *_ in rows:
        raw = (text or "").encode()
        padded = raw + b" " * (-len(raw) % 192 if raw else 192)
        r = by[d][0]
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(padded))
        assert r.payload_sha256 == hashlib.sha256(padded).hexdigest() and r.tail_crc32 == zlib.crc32(padded[-16:])
        file = media.encode_avi(padded)
        assert (r.media_bytes, r.media_sha256) == (len(file), hashlib.sha256(file).hexdigest())


def test_any_bytes_and_both_decoders():
    r = random.Random(0)
    for payload in (bytes(range(256)) * 3, b"\xff" * 192, b"\0\xff" * 96, bytes(r.randint(0, 255) for _ in range(192 * 20))):
        file = media.encode_avi(payload)
        assert media.read_frames(file)[0].tobytes() == payload
        frames, rate = media.parse_avi(file)
        assert rate == media.RATE and len(frames) == len(payload) // 192
        for k, (at, size) in enumerate(frames[:3]):
            plane = media.decode_frame(file[at : at + size])
            assert plane.shape == (96, 128) and plane[3::8, 5::8].tobytes() == payload[k * 192 : (k + 1) * 192]
        assert media.parse_avi(file.replace(b"idx1", b"junk"))[0] == frames  # without an index


def test_transform_of_a_general_block():
    """A frame with AC terms, quantised, against the transform by definition."""
    coefficients = {0: 5, 1: -3, 8: 2, 9: 1}
    natural = np.zeros((8, 8))
    for i, v in coefficients.items():
        natural[i // 8, i % 8] = v * 16
    x = np.arange(8)
    want = sum(
        natural[u, v] / 4 * (0.5**0.5 if u == 0 else 1) * (0.5**0.5 if v == 0 else 1) * np.outer(np.cos((2 * x + 1) * u * np.pi / 16), np.cos((2 * x + 1) * v * np.pi / 16)) for u in range(8) for v in range(8)
    )
    bits = ""
    order = [0, 1, 8, 16, 9]
    values = [5, -3, 2, 0, 1]
    bits += "0" + "101"  # category 3 is the code 0
    run = 0
    for v in values[1:]:
        if not v:
            run += 1
            continue
        size = abs(v).bit_length()
        code = {(0, 2): "00", (0, 1): "01", (1, 1): "10", (0, 0): "110"}
        bits += code[run, size if size < 3 else 2] + format(v if v > 0 else v + (1 << size) - 1, f"0{size}b")
        run = 0
    assert order[3] == 16
    bits += "110"
    bits += "1" * (-len(bits) % 8)
    seg = media._segment
    jpeg = b"\xff\xd8" + seg(0xDB, b"\0" + b"\x10" * 64) + seg(0xC0, struct.pack(">BHHBBBB", 8, 8, 8, 1, 1, 0x11, 0))
    jpeg += seg(0xC4, b"\0" + bytes([1] + [0] * 15) + b"\x03") + seg(0xC4, b"\x10" + bytes([0, 3, 1] + [0] * 13) + bytes([0x02, 0x01, 0x11, 0x00]))
    jpeg += seg(0xDA, bytes([1, 1, 0, 0, 63, 0])) + int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\0") + b"\xff\xd9"
    assert np.abs(media.decode_frame(jpeg).astype(int) - np.clip(np.rint(want + 128), 0, 255)).max() <= 1


def test_clips(spark):
    g = np.random.default_rng(0)
    shots = [g.integers(lo, lo + 20, (20, 192)).astype(np.uint8) for lo in (0, 100, 200)]
    file = media.encode_avi(np.concatenate(shots).tobytes())
    rows = media.clip_rows(spark.createDataFrame([(1, bytearray(file)), (2, None), (3, bytearray(b"nothing"))], "doc_id long, media binary")).orderBy("clip").collect()
    assert [(r.doc_id, r.first_frame, r.frames, r.start_ms, r.end_ms) for r in rows] == [(1, 0, 20, 0, 800), (1, 20, 20, 800, 1600), (1, 40, 20, 1600, 2400)]


def test_media_column(docs, empty):
    got = media.to_media(docs).where("doc_id = 103").first()
    assert media.read_frames(bytes(got.media))[0].tobytes().rstrip(b" ") == b"one two"
    assert media.round_trip(empty).count() == 0


@pytest.fixture(scope="module")
def model():
    return html.trained()


def test_generated_pages_of_another_seed(model):
    r = random.Random(99)
    pages = [html.training_page(r) for _ in range(200)]
    exact = hit = got_n = want_n = 0
    for page, text in zip(pages, html.extract_many([p.replace(' data-article="yes"', "") for p in pages], model)):
        marked, want = set(), []
        for n in html.ordered(html.parse(page)):
            if n.marked or n.parent is not None and id(n.parent) in marked and not n.bad:
                marked.add(id(n))
                want += [n.text] if n.tag == "#text" else []
        got = text.split("\n") if text else []
        exact += got == want
        hit += len(set(got) & set(want))
        got_n, want_n = got_n + len(set(got)), want_n + len(set(want))
    assert hit / got_n > 0.97 and hit / want_n > 0.97 and exact / 200 > 0.88


def test_pages_of_the_driver(spark, model):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    for r, text in zip(rows, html.extract_many([r.html for r in rows], model)):
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [" ".join(unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert text == "\n".join(b for b in blocks if b)


def test_no_kept_node_below_a_dropped_one(model):
    r = random.Random(5)
    for _ in range(30):
        nodes = html.ordered(html.parse(html.training_page(r)))
        html.summed(nodes)
        kept = dict(zip(map(id, nodes), html.decoded(nodes, np.random.default_rng(1).normal(size=len(nodes)))))
        assert all(kept[id(n.parent)] for n in nodes if n.parent is not None and kept[id(n)])


def test_odd_pages(spark, model):
    pages = [(1, "u", None), (2, None, ""), (3, "u", "<p>a &amp; b<br>c &lt;d&gt;  e"), (4, "u", "<div class='x\">broken <p>text"), (5, "u", "plain text < 3 and more"), (6, "u", "<script>var a = '</p>'"), (7, "u", "<p>" + "word " * 50_000)]
    got = {r.page_id: r for r in html.extract(spark.createDataFrame(pages, "page_id long, url string, html string"), model).collect()}
    assert len(got) == 7 and all(r.n_chars == len(r.text) for r in got.values())
    assert got[1].text == got[2].text == got[6].text == ""
    assert got[3].text in ("", "a & b c <d> e")
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string"), model).count() == 0


def test_blocks_of_misnested_markup():
    text = lambda h: [n.text for n in html.ordered(html.parse(h)) if n.tag == "#text"]
    assert text("<ul><li>one<li>two<li><b>three</ul>after") == ["one", "two", "three", "after"]
    assert text("<p>a<p>b</p>c</div>d") == ["a", "b", "cd"]
    assert text("x<!-- <p>no</p> -->y<style>p{}</style>z") == ["xy z"]
    assert text("<td>a<td>b") == ["a", "b"]


@pytest.mark.parametrize("tag", "select svg object iframe textarea video audio canvas math title script style noscript template".split())
def test_an_unclosed_element_ends_no_page(model, tag):
    r = random.Random(11)
    body = "".join(f"<p>{html._sentence(r)} {html._sentence(r)} {html._sentence(r)}</p>" for _ in range(6))
    want = html.extract_many([f"<html><body><article><h1>A heading of the page</h1>{body}</article></body></html>"], model)[0]
    got = html.extract_many([f"<html><body><article><h1>A heading of the page</h1><{tag}>{body}</article></body></html>"], model)[0]
    assert want.count("\n") == 6 and len(got) >= 0.8 * len(want)


def test_siblings_are_counted_at_any_number():
    def same(n):
        nodes = html.ordered(html.parse("<div>" + "<p>a b</p>" * n + "<ul>x</ul></div>"))
        html.summed(nodes)
        rows = html.features(nodes)
        return {int(row[19]) for row, node in zip(rows, nodes) if node.tag == "p"}, {int(row[19]) for row, node in zip(rows, nodes) if node.tag == "ul"}

    assert [same(n) for n in (3, 199, 200, 450)] == [({n}, {1}) for n in (3, 199, 200, 450)]


def test_decoding_is_the_likeliest_labelling():
    """Against all labellings of small trees in which no node is kept below a dropped one."""
    g = np.random.default_rng(2)
    for _ in range(60):
        nodes = [html.Node("div", None)]
        for _ in range(int(g.integers(0, 8))):
            nodes.append(html.Node("p", nodes[int(g.integers(0, len(nodes)))]))
        nodes = html.ordered(nodes[0])
        odds = g.normal(size=len(nodes)) * 3
        place = {id(n): i for i, n in enumerate(nodes)}
        keep, drop = -np.logaddexp(0, -odds), -np.logaddexp(0, odds)
        best = max(
            (sum(keep[i] if m >> i & 1 else drop[i] for i in range(len(nodes))), m)
            for m in range(1 << len(nodes))
            if all(not m >> i & 1 or n.parent is None or m >> place[id(n.parent)] & 1 for i, n in enumerate(nodes))
        )
        got = html.decoded(nodes, odds.copy())
        assert abs(sum(np.where(got, keep, drop)) - best[0]) < 1e-9


def test_clashing_names_and_repeated_pages(spark, model):
    d = spark.createDataFrame([(1, "u", "<article><p>One sentence of the page. Another one.</p></article>", "x", 3)] * 2, "page_id long, url string, html string, text string, n_chars int")
    got = html.extract(d, model).collect()
    assert len(got) == 2 and got[0] == got[1]


def test_files_are_built_and_read_in_groups(monkeypatch):
    g = np.random.default_rng(3)
    payloads = [bytes(g.integers(0, 256, 192 * n).astype(np.uint8)) for n in (1, 7, 3, 1, 20)]
    whole = [media.encode_avi(p) for p in payloads]
    monkeypatch.setattr(media, "FRAMES", 4)
    assert [media.encode_avi(p) for p in payloads] == whole
    assert [f.tobytes() for f, _ in media.read_many(whole)] == payloads
    assert media.read_many([]) == []


def test_restart_intervals_and_damaged_frames():
    """The same blocks cut by restart markers give the same plane; a frame that ends early is an error."""
    payload = bytes(range(192))
    file = media.encode_avi(payload)
    (at, size), *_ = media.parse_avi(file)[0]
    frame = file[at : at + size]
    v = np.frombuffer(payload, np.uint8).astype(int) - 128
    scan = b""
    for k in range(0, 192, 48):
        bits = "".join(format(int(c), "010b") for c in media._CODE[np.diff(v[k : k + 48], prepend=0) + 255])
        bits += "1" * (-len(bits) % 8)
        scan += int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\0") + (b"\xff" + bytes([0xD0 + k // 48]) if k < 144 else b"")
    head = media.HEADER.tobytes()
    cut = head.index(b"\xff\xda")
    restarted = head[:cut] + media._segment(0xDD, struct.pack(">H", 48)) + head[cut:] + scan + b"\xff\xd9"
    assert (media.decode_frame(restarted) == media.decode_frame(frame)).all()
    with pytest.raises(ValueError):
        media.decode_frame(head[:cut] + media._segment(0xDD, struct.pack(">H", 48)) + head[cut:] + scan[:60] + b"\xff\xd9")
    with pytest.raises(ValueError):
        media.dc_images([b"\xff\xd8\xff\xd9"])
