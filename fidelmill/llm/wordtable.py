"""Vectorised look-up of words of whole texts.

Texts go through numpy as one run of bytes: words are cut by masks, hashed by
prefix sums of a polynomial, and found in an open-addressing table of 64-bit
hashes. What Python handles one by one is only the words a worker has not seen.
A table is emptied when it is full, so its memory is bounded.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np

U = np.uint64
BASE, INVERSE = U(0x9E3779B97F4A7C15), U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Bytes of text that are handled at once; a longer text is handled in pieces, cut at white space.
RUN_BYTES = 1 << 20
_powers = [np.ones(1, U), np.ones(1, U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse mod 2^64, at least ``n`` of each."""
    if len(_powers[0]) < n:
        n = max(n, RUN_BYTES + (1 << 16))
        for i, b in enumerate((BASE, INVERSE)):
            a = np.full(n, b, U)
            a[0] = 1
            _powers[i] = np.multiply.accumulate(a)
    return _powers[0], _powers[1]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each span of bytes, never 0."""
    up, down = powers(len(buf) + 1)
    total = np.zeros(len(buf) + 1, U)
    np.cumsum((buf.astype(U) + U(1)) * up[: len(buf)], out=total[1:])
    return mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U)) | U(1)


_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True


def runs(parts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about RUN_BYTES."""
    at = 0
    while at < len(parts):
        end, size = at, 0
        while end < len(parts) and (end == at or size + len(parts[end]) <= RUN_BYTES):
            size += len(parts[end])
            end += 1
        yield at, end
        at = end


_CUT = re.compile(rb"[\x20\t-\r]")


def pieces(raw: bytes) -> list[bytes]:
    """A long text cut before white space, so that every word is in one piece; one word longer than a piece is whole."""
    out, at = [], 0
    while len(raw) - at > RUN_BYTES:
        found = _CUT.search(raw, at + RUN_BYTES)
        if not found:
            break
        out.append(raw[at : found.start()])
        at = found.start()
    return [*out, raw[at:]] if at else [raw]


def plain_words(buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans of the words between ASCII spaces; ``bounds`` are where texts begin, and the end."""
    white = _WHITE[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[bounds] = True
    solid = ~white
    starts = np.flatnonzero(solid & (np.concatenate([[True], white[:-1]]) | edge[:-1]))
    ends = np.flatnonzero(solid & (np.concatenate([white[1:], [True]]) | edge[1:])) + 1
    return starts, ends


def spaced_words(buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans that cover each text: words with the one space before them, and the rest of each run of spaces.

    Of a run before a word all but its last character is one span; the last goes
    to the word if it is a space, and is a span of its own otherwise. A run at a
    text's end is one span.
    """
    white = _WHITE[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[bounds] = True
    first, last = edge[:-1], edge[1:]
    after_solid = np.concatenate([[False], ~white[:-1]]) & ~first
    after_space = np.concatenate([[False], buf[:-1] == 32]) & ~first
    before_word = np.concatenate([~white[1:], [False]]) & ~last
    starts = np.flatnonzero(first | np.where(white, before_word | after_solid, ~after_solid & ~after_space))
    return starts, np.append(starts[1:], len(buf))


class Table:
    """Hash -> entry number, by open addressing."""

    def __init__(self, slots: int = 1 << 22):
        self.slots, self.shift = slots, U(64 - (slots - 1).bit_length())
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(self.slots, U)
        self.entry = np.zeros(self.slots, np.int32)
        self.used = 0

    def full(self) -> bool:
        return self.used > self.slots * 6 // 10

    def find(self, h: np.ndarray) -> np.ndarray:
        """Entry of each hash, -1 where there is none."""
        out = np.full(len(h), -1, np.int32)
        at = (h >> self.shift).astype(np.int64)
        rest = np.arange(len(h))
        while len(rest):
            key = self.keys[at]
            hit = key == h[rest]
            out[rest[hit]] = self.entry[at[hit]]
            go = ~hit & (key != 0)
            rest, at = rest[go], (at[go] + 1) % self.slots
        return out

    def add(self, h: np.ndarray, entry: np.ndarray) -> None:
        """New distinct hashes."""
        self.used += len(h)
        at = (h >> self.shift).astype(np.int64)
        while len(h):
            free = self.keys[at] == 0
            self.keys[at[free]] = h[free]
            own = self.keys[at] == h
            self.entry[at[own]] = entry[own]
            h, entry, at = h[~own], entry[~own], (at[~own] + 1) % self.slots


class Words:
    """Numbers each distinct word, and hands new ones to ``learn(words, first entry)``."""

    def __init__(self, cut: Callable, learn: Callable[[list[bytes]], None], forget: Callable[[], None], slots: int = 1 << 22):
        self.cut, self.learn, self.forget, self.table = cut, learn, forget, Table(slots)

    def entries(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Entry of every word of ``parts`` in order, and where each text's words begin, with the end."""
        if self.table.full():
            self.table.clear()
            self.forget()
        buf = np.frombuffer(b"".join(parts), np.uint8)
        bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        if not len(buf):
            return np.zeros(0, np.int32), np.zeros(len(parts) + 1, np.int64)
        starts, ends = self.cut(buf, bounds)
        h = span_hashes(buf, starts, ends)
        found = self.table.find(h)
        new = np.flatnonzero(found < 0)
        if len(new):
            distinct, first = np.unique(h[new], return_index=True)
            raw = buf.tobytes()
            first = new[first]
            self.learn([raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())])
            self.table.add(distinct, np.arange(self.table.used, self.table.used + len(distinct), dtype=np.int32))
            found[new] = self.table.find(h[new])
        return found, np.searchsorted(starts, bounds)


class Flat:
    """A growing array."""

    def __init__(self, dtype):
        self.data, self.n = np.zeros(1 << 16, dtype), 0

    def extend(self, x: np.ndarray) -> None:
        if self.n + len(x) > len(self.data):
            grown = np.zeros(max(len(self.data) * 2, self.n + len(x)), self.data.dtype)
            grown[: self.n] = self.data[: self.n]
            self.data = grown
        self.data[self.n : self.n + len(x)] = x
        self.n += len(x)
