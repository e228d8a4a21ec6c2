"""AVI motion-JPEG media columns: payload round trip, intra-frame decoding, and shots.

*Container.* RIFF AVI 1.0 with stream headers, a ``movi`` list and an ``idx1``
index; frames are found through the index, or by walking ``movi`` without one.

*Frames.* Baseline JPEG: Huffman tables, quantisation, restart intervals and
component sampling of any baseline frame. Frames with the same header are decoded
together, block by block, all frames (of many files) at once in numpy. From the
coefficients come the whole luma plane (``decode_frame``) or its DC image, a
sample a block (``read_frames``), which is what shots are found in. The frames
written here hold 192 payload bytes as 16 x 12 blocks of one grey each: with
quantiser 8 a block's DC term is the byte minus 128, exactly. They are read back
by the same decoder as any other frame.

*Shots.* Frames are compared by 32-bin histograms of their DC images. A cut is where the difference
exceeds the mean of the ``WINDOW`` differences before it by ``SIGMAS`` of their
deviations, and ``FLOOR`` of the samples; computed in integers, so it is the
same everywhere. Clips are the frames between cuts, timed by the frame rate.

Defined results. Null or empty text: one frame of spaces. Null media or what is
no AVI: no clip rows. Repeated rows: each by itself. Empty table: no rows. Extra
columns are ignored. A text is taken whole, whatever its length: files are built
and decoded some ``FRAMES`` frames at a time. A text cell holds less than 2^31
bytes, so its file stays below the 4 GB that a RIFF size can say; a longer payload
is an error. Frames of one file that differ in size are one too.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fidelmill.llm.common import arrow_map, column, texts, tune
from fidelmill.llm.wordtable import runs

UNIT, BLOCKS_WIDE, BLOCKS_HIGH, RATE = 192, 16, 12, 25
BINS, WINDOW, SIGMAS, FLOOR = 32, 12, 3, 96

_DIFF = np.arange(-255, 256)
_SIZE = np.array([abs(int(d)).bit_length() for d in _DIFF])
_EXTRA = np.where(_DIFF > 0, _DIFF, _DIFF + (1 << _SIZE) - 1)
#: Ten bits of a block: 8 - s ones, a zero, s bits of the difference, and a zero that ends the block.
_CODE = (((((1 << (8 - _SIZE)) - 1) << (_SIZE + 1)) | _EXTRA) << 1).astype(np.uint16)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _header() -> bytes:
    quant = _segment(0xDB, b"\0" + b"\x08" * 64)
    frame = _segment(0xC0, struct.pack(">BHHBBBB", 8, BLOCKS_HIGH * 8, BLOCKS_WIDE * 8, 1, 1, 0x11, 0))
    dc = _segment(0xC4, b"\x00" + bytes([1] * 9 + [0] * 7) + bytes(range(8, -1, -1)))
    ac = _segment(0xC4, b"\x10" + bytes([1] + [0] * 15) + b"\0")
    scan = _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))
    return b"\xff\xd8" + quant + frame + dc + ac + scan


HEADER = np.frombuffer(_header(), np.uint8)


def _list(kind: bytes, body: bytes) -> bytes:
    return b"LIST" + struct.pack("<I", len(body) + 4) + kind + body


def _chunk(kind: bytes, body: bytes) -> bytes:
    return kind + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


#: Frames that are written or decoded at once.
FRAMES = 4096


def _movi(v: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The chunks of some frames, and the size of each frame."""
    n = len(v)
    c = _CODE[np.diff(v, axis=1, prepend=np.int16(0)) + 255].reshape(n, UNIT // 4, 4)
    scan = np.empty((n, UNIT // 4, 5), np.uint8)
    scan[:, :, 0] = c[:, :, 0] >> 2
    scan[:, :, 1] = (c[:, :, 0] & 3) << 6 | c[:, :, 1] >> 4
    scan[:, :, 2] = (c[:, :, 1] & 15) << 4 | c[:, :, 2] >> 6
    scan[:, :, 3] = (c[:, :, 2] & 63) << 2 | c[:, :, 3] >> 8
    scan[:, :, 4] = c[:, :, 3] & 255
    scan = scan.reshape(n, -1)
    stuffed = scan == 255
    before = np.cumsum(stuffed, 1) - stuffed  # zero bytes to come before each byte
    width = scan.shape[1]
    size = len(HEADER) + width + stuffed.sum(1) + 2
    whole = 8 + size + (size & 1)
    start = np.cumsum(whole) - whole
    movi = np.zeros(int(whole.sum()), np.uint8)
    movi[start[:, None] + np.arange(4)] = np.frombuffer(b"00dc", np.uint8)
    movi[start[:, None] + np.arange(4, 8)] = size.astype("<u4").view(np.uint8).reshape(n, 4)
    movi[start[:, None] + np.arange(8, 8 + len(HEADER))] = HEADER
    movi[(start + 8 + len(HEADER))[:, None] + np.arange(width) + before] = scan
    movi[start + 8 + size - 2] = 0xFF
    movi[start + 8 + size - 1] = 0xD9
    return movi.tobytes(), size


def encode_avi(payload: bytes) -> bytes:
    """An AVI file whose frames hold the payload, a positive multiple of UNIT bytes."""
    flat = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
    n = len(flat)
    got = [_movi(flat[at : at + FRAMES].astype(np.int16) - 128) for at in range(0, n, FRAMES)]
    size = np.concatenate([z for _, z in got])
    whole = 8 + size + (size & 1)
    if int(whole.sum()) + 16 * n + 4096 >= 1 << 32:
        raise ValueError("a RIFF file holds less than 4 GB")
    index = np.zeros(n, [("id", "S4"), ("flags", "<u4"), ("at", "<u4"), ("size", "<u4")])
    index["id"], index["flags"], index["at"], index["size"] = b"00dc", 16, np.cumsum(whole) - whole + 4, size
    w, h = BLOCKS_WIDE * 8, BLOCKS_HIGH * 8
    avih = struct.pack("<14I", 1_000_000 // RATE, int(size.max()) * RATE, 0, 0x10, n, 0, 1, int(size.max()), w, h, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIIIHHHH", b"vids", b"MJPG", 0, 0, 0, 0, 1, RATE, 0, n, int(size.max()), 0xFFFFFFFF, 0, 0, 0, w, h)
    strf = struct.pack("<IiiHH4sIiiII", 40, w, h, 1, 24, b"MJPG", w * h * 3, 0, 0, 0, 0)
    head = _list(b"hdrl", _chunk(b"avih", avih) + _list(b"strl", _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    body = [b"AVI ", head, b"LIST" + struct.pack("<I", int(whole.sum()) + 4) + b"movi", *(m for m, _ in got), _chunk(b"idx1", index.tobytes())]
    return b"".join([b"RIFF" + struct.pack("<I", sum(map(len, body))), *body])


def parse_avi(data: bytes) -> tuple[list[tuple[int, int]], float]:
    """(offset, size) of each video frame by the index, and frames a second. ValueError if it is no AVI."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    rate, movi, movi_end, index = float(RATE), None, 0, None
    stack = [(12, min(len(data), 8 + struct.unpack_from("<I", data, 4)[0]))]
    while stack:
        at, end = stack.pop()
        while at + 8 <= end:
            kind, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
            inner, stop = at + 8, min(at + 8 + size, end)
            if kind == b"LIST" and data[inner : inner + 4] == b"movi":
                movi, movi_end = inner, stop
            elif kind == b"LIST":
                stack.append((inner + 4, stop))
            elif kind == b"strh" and data[inner : inner + 4] == b"vids":
                scale, per = struct.unpack_from("<II", data, inner + 20)
                rate = per / scale if scale and per else rate
            elif kind == b"idx1":
                index = (inner, stop)
            at += 8 + size + (size & 1)
    if movi is None:
        return [], rate
    if index:
        entries = np.frombuffer(data, [("id", "S4"), ("flags", "<u4"), ("at", "<u4"), ("size", "<u4")], (index[1] - index[0]) // 16, index[0])
        video = np.char.endswith(entries["id"], b"dc") | np.char.endswith(entries["id"], b"db")
        entries = entries[video]
        at = entries["at"].astype(np.int64) + 8
        # offsets count from the movi list or from the file's start
        if len(at) and data[movi + int(at[0]) - 8 :][:4] == entries["id"][0]:
            at += movi
        return list(zip(at.tolist(), entries["size"].tolist())), rate
    out, at = [], movi + 4
    while at + 8 <= movi_end:
        size = struct.unpack_from("<I", data, at + 4)[0]
        if data[at + 2 : at + 4] in (b"dc", b"db"):
            out.append((at + 8, size))
        at += 8 + size + (size & 1)
    return out, rate


_ZIGZAG = sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8)))
_k, _x = np.arange(8)[:, None], np.arange(8)[None, :]
_COSINE = np.where(_k == 0, np.sqrt(1 / 8), 0.5) * np.cos((2 * _x + 1) * _k * np.pi / 16)


def _lookup(counts: bytes, symbols: bytes) -> np.ndarray:
    """For every 16 bits that may come next: code length * 256 + symbol, 0 where no code fits."""
    out, code, k = np.zeros(1 << 16, np.int32), 0, 0
    for length, n in enumerate(counts, 1):
        for symbol in symbols[k : k + n]:
            out[code << (16 - length) : (code + 1) << (16 - length)] = length * 256 + symbol
            code += 1
        k += n
        code <<= 1
    return out


class Header:
    """What comes before a frame's entropy-coded data. ValueError if the frame is no baseline JPEG."""

    def __init__(self, data: bytes):
        self.quant: dict[int, np.ndarray] = {}
        self.tables: dict[int, np.ndarray] = {}
        self.restart, self.parts, self.shape = 0, [], (0, 0)
        at = 2
        while at + 4 <= len(data):
            marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
            body = data[at + 4 : at + 2 + size]
            at += 2 + size
            if marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    self.quant[body[0] & 15] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, 1).astype(int)
                    body = body[1 + 64 * (1 + wide) :]
            elif marker == 0xC4:
                while body:
                    n = sum(body[1:17])
                    self.tables[body[0]] = _lookup(body[1:17], body[17 : 17 + n])
                    body = body[17 + n :]
            elif marker == 0xC0:
                self.shape = struct.unpack_from(">HH", body, 1)
                self.parts = [{"id": body[6 + 3 * i], "h": body[7 + 3 * i] >> 4, "v": body[7 + 3 * i] & 15, "q": body[8 + 3 * i]} for i in range(body[5])]
            elif 0xC1 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
                raise ValueError("not a baseline JPEG")
            elif marker == 0xDD:
                self.restart = struct.unpack(">H", body[:2])[0]
            elif marker == 0xDA:
                for i in range(body[0]):
                    for p in self.parts:
                        if p["id"] == body[1 + 2 * i]:
                            p["dc"], p["ac"] = body[2 + 2 * i] >> 4, 16 + (body[2 + 2 * i] & 15)
                break
        self.raw = data[:at]
        if not self.parts or any("dc" not in p or p["dc"] not in self.tables or p["ac"] not in self.tables or p["q"] not in self.quant for p in self.parts):
            raise ValueError("not a whole JPEG")
        if len(self.parts) == 1:  # a scan of one component has one block a unit
            self.parts[0]["h"] = self.parts[0]["v"] = 1
        hmax, vmax = max(p["h"] for p in self.parts), max(p["v"] for p in self.parts)
        self.wide, self.high = -(-self.shape[1] // (8 * hmax)), -(-self.shape[0] // (8 * vmax))


def _pieces(header: Header, scan: bytes) -> list[bytes]:
    """The scan between restart markers, as it stands."""
    out, last, k = [], 0, scan.find(b"\xff") if header.restart else -1
    while k >= 0 and k + 1 < len(scan):
        if 0xD0 <= scan[k + 1] <= 0xD7:
            out.append(scan[last:k])
            last = k + 2
        k = scan.find(b"\xff", k + 2)
    return [*out, scan[last:]]


def _coefficients(header: Header, scans: list[bytes], planes: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """Of frames with one header: DC terms (frame, row, column) of the first component's blocks, and all its coefficients if asked."""
    n_units = header.wide * header.high
    step = header.restart or n_units
    cut = [_pieces(header, s) for s in scans]
    per = -(-n_units // step)
    if any(len(c) < per for c in cut):
        raise ValueError("a JPEG scan ends early")
    flat = np.frombuffer(b"".join(p for c in cut for p in c[:per]) + b"\0" * 8, np.uint8)
    length = np.array([len(p) for c in cut for p in c[:per]], np.int64)
    begin = np.cumsum(length) - length
    stuffed = np.zeros(len(flat), bool)
    stuffed[1:] = (flat[:-1] == 255) & (flat[1:] == 0)
    stuffed[begin[length > 0]] = False
    stuffed[-8:] = False
    begin = begin - (np.cumsum(stuffed) - stuffed)[begin]
    flat = flat[~stuffed].astype(np.int32)
    ahead = flat[:-2] << 16 | flat[1:-1] << 8 | flat[2:]  # 24 bits from every byte on
    bit, last_bit = begin * 8, (len(ahead) - 1) * 8
    frames, first = len(scans), header.parts[0]
    units = np.minimum(step, n_units - np.arange(per) * step)
    left = np.tile(units, frames)
    same = bool((units == step).all())
    dc = np.zeros((frames * per, step, first["v"] * first["h"]), np.int32)
    full = np.zeros((*dc.shape, 64), np.int32) if planes else None
    before = [np.zeros(frames * per, np.int32) for _ in header.parts]
    every = np.arange(frames * per)

    def peek(at: np.ndarray) -> np.ndarray:
        return ahead[np.minimum(at, last_bit) >> 3] >> (8 - (at & 7)) & 0xFFFF

    def symbol(table: np.ndarray, on: np.ndarray) -> np.ndarray:
        got = table[peek(bit[on])]
        if not got.all():
            raise ValueError("bad Huffman code")
        bit[on] += got >> 8
        return got & 255

    def value(size: np.ndarray, on: np.ndarray) -> np.ndarray:
        got = peek(bit[on]) >> (16 - size)
        bit[on] += size
        return np.where((got >> np.maximum(size - 1, 0)) > 0, got, np.where(size > 0, got - (1 << size) + 1, 0)).astype(np.int32)

    for unit in range(step):
        on = every if same else every[left > unit]
        for i, p in enumerate(header.parts):
            for b in range(p["h"] * p["v"]):
                before[i][on] += value(symbol(header.tables[p["dc"]], on), on)
                if i == 0:
                    dc[on, unit, b] = before[0][on]
                rest, k = on, np.ones(len(on), np.int64)
                while len(rest):
                    got = symbol(header.tables[p["ac"]], rest)
                    if not got.any():
                        break
                    run, size = got >> 4, got & 15
                    go = (size > 0) | (run == 15)
                    rest, run, size = rest[go], run[go], size[go]
                    k = k[go] + run
                    if (k > 63).any():
                        raise ValueError("too many coefficients")
                    v = value(size, rest)
                    if full is not None and i == 0:
                        full[rest, unit, b, k] = v
                    k += 1
                    more = k < 64
                    rest, k = rest[more], k[more]

    def laid(x: np.ndarray) -> np.ndarray:
        """(piece, unit, block, ...) as (frame, row, column, ...)."""
        x = x.reshape(frames, per * step, *x.shape[2:])[:, :n_units]
        x = x.reshape(frames, header.high, header.wide, first["v"], first["h"], *x.shape[3:])
        return np.moveaxis(x, 3, 2).reshape(frames, header.high * first["v"], header.wide * first["h"], *x.shape[5:])

    if full is not None:
        full[..., 0] = dc
        return laid(dc), laid(full)
    return laid(dc), None


def _scan(header: Header, data: bytes) -> bytes:
    end = data.rfind(b"\xff\xd9")
    return data[len(header.raw) : end if end > 0 else len(data)]


def decode_frame(data: bytes) -> np.ndarray:
    """The luma plane (or the first component) of a baseline JPEG."""
    header = Header(data)
    first = header.parts[0]
    _, c = _coefficients(header, [_scan(header, data)], True)
    natural = np.zeros(c[0].shape)
    natural[..., _ZIGZAG] = c[0] * header.quant[first["q"]]
    blocks = _COSINE.T @ natural.reshape(*natural.shape[:2], 8, 8) @ _COSINE
    plane = np.moveaxis(blocks, 2, 1).reshape(blocks.shape[0] * 8, blocks.shape[1] * 8)
    return np.clip(np.rint(plane + 128), 0, 255).astype(np.uint8)[: header.shape[0], : header.shape[1]]


def dc_images(frames: list[bytes]) -> np.ndarray:
    """One row a frame: the mean of each block of the luma plane. Neighbours with the same header are decoded together."""
    out, at = [], 0
    while at < len(frames):
        header = Header(frames[at])
        end = at
        while end < len(frames) and end - at < FRAMES and frames[end].startswith(header.raw):
            end += 1
        dc, _ = _coefficients(header, [_scan(header, f) for f in frames[at:end]], False)
        q = int(header.quant[header.parts[0]["q"]][0])
        out.append(np.clip(np.rint(dc * (q / 8) + 128), 0, 255).astype(np.uint8).reshape(end - at, -1))
        at = end
    if len({x.shape[1] for x in out}) > 1:
        raise ValueError("frames of different sizes")
    return np.concatenate(out) if out else np.zeros((0, UNIT), np.uint8)


def read_many(files: list[bytes]) -> list[tuple[np.ndarray, float]]:
    """DC images, one row a frame, and frames a second of each file; the frames of all files are decoded together."""
    found = [parse_avi(f) for f in files]
    out, some, n = [], [], 0

    def decoded() -> None:
        frames = [files[i][a : a + s] for i in some for a, s in found[i][0]]
        rows = dc_images(frames)
        at = 0
        for i in some:
            out.append((rows[at : at + len(found[i][0])], found[i][1]))
            at += len(found[i][0])

    for i, (frames, _) in enumerate(found):
        if some and n + len(frames) > FRAMES:
            decoded()
            some, n = [], 0
        some.append(i)
        n += len(frames)
    if some:
        decoded()
    return out


def read_frames(data: bytes) -> tuple[np.ndarray, float]:
    """DC images of one file, one row a frame, and frames a second."""
    return read_many([data])[0]


def cuts(frames: np.ndarray) -> np.ndarray:
    """Numbers of the frames that begin a new shot, besides the first."""
    n = len(frames)
    if n < 2:
        return np.zeros(0, np.int64)
    hist = np.bincount((np.arange(n)[:, None] * BINS + (frames >> 3)).ravel(), minlength=n * BINS).reshape(n, BINS)
    d = np.abs(np.diff(hist, axis=0)).sum(1)
    total, square = (np.concatenate([[0], np.cumsum(x)]) for x in (d, d * d))
    at = np.arange(len(d))
    low = np.maximum(at - WINDOW, 0)
    k, s1, s2 = at - low, total[at] - total[low], square[at] - square[low]
    over = k * d - s1
    least = FLOOR * frames.shape[1] // UNIT
    return np.flatnonzero((k > 1) & (d >= least) & (over > 0) & (over * over > SIGMAS * SIGMAS * (k * s2 - s1 * s1))) + 1


CLIPS = pa.list_(pa.struct([(c, pa.int64()) for c in ("first_frame", "frames", "start_ms", "end_ms")]))


def clips(frames: np.ndarray, rate: float) -> list[dict[str, int]]:
    """The shots of a file in order, timed."""
    edges = [0, *cuts(frames).tolist(), len(frames)] if len(frames) else []
    return [{"first_frame": a, "frames": b - a, "start_ms": round(a * 1000 / rate), "end_ms": round(b * 1000 / rate)} for a, b in zip(edges, edges[1:])]


def payload_of(text: str) -> tuple[bytes, int]:
    """The text's bytes, padded with spaces to a positive multiple of UNIT, and their number unpadded."""
    raw = text.encode("utf-8", "replace")
    return raw + b" " * (-len(raw) % UNIT if raw else UNIT), len(raw)


def to_media(docs: DataFrame) -> DataFrame:
    """doc_id and media: every whole text as an AVI file."""
    tune(docs.sparkSession)

    def make():
        def handle(batch):
            media = pa.array([encode_avi(payload_of(t)[0]) for t in texts(batch)], pa.binary())
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), media], names=["doc_id", "media"])

        return handle

    return arrow_map(docs.select("doc_id", "text"), make, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, media binary")


def clip_rows(media: DataFrame, key: str = "doc_id", name: str = "media") -> DataFrame:
    """A row for each clip of each file: clip, first_frame, frames, start_ms, end_ms."""
    tune(media.sparkSession)

    def make():
        def handle(batch):
            out = {c: [] for c in (key, "clip", "first_frame", "frames", "start_ms", "end_ms")}
            for k, raw in zip(column(batch, key).to_pylist(), column(batch, name).to_pylist()):
                try:
                    frames, rate = read_frames(raw or b"")
                except (ValueError, struct.error):
                    continue
                for i, clip in enumerate(clips(frames, rate)):
                    for c, v in zip(out, (k, i, *clip.values())):
                        out[c].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[key], column(batch, key).type), *(pa.array(out[c], pa.int64()) for c in list(out)[1:])], names=list(out))

        return handle

    kind = media.schema[key].dataType.simpleString()
    return arrow_map(media.select(key, name), make, f"{key} {kind}, clip long, first_frame long, frames long, start_ms long, end_ms long")


def round_trip(docs: DataFrame) -> DataFrame:
    """Every text stored as a file, and what is read from the file: see the schema."""
    tune(docs.sparkSession)
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "clips"]

    def row(n: int, media: bytes, frames: np.ndarray, rate: float) -> tuple:
        back = frames.tobytes()
        new = cuts(frames)
        feature = f"frames={len(frames)};shots={len(new) + 1};cuts_ms={','.join(str(int(c) * 1000 // RATE) for c in new)};mean={int(frames.sum(dtype=np.int64)) * 1000 // frames.size}"
        return n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature, clips(frames, rate)

    def rows(some: list[str]) -> list[tuple]:
        sizes, media = [], []
        for t in some:
            payload, n = payload_of(t)
            sizes.append(n)
            media.append(encode_avi(payload))
        return [row(n, m, *f) for n, m, f in zip(sizes, media, read_many(media))]

    def make():
        def handle(batch):
            every = texts(batch)
            got = [r for a, b in runs([t.encode("utf-8", "replace") for t in every]) for r in rows(every[a:b])]
            got = list(zip(*got)) or [[]] * 8
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), CLIPS)
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), *(pa.array(g, k) for g, k in zip(got, kinds))], names=names)

        return handle

    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow_map(docs.select("doc_id", "text"), make, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, clips array<struct<first_frame:long,frames:long,start_ms:long,end_ms:long>>")
