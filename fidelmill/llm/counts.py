"""Token counts without tokens: a Viterbi pass that carries only best score and piece count.

The vocabulary is a sentencepiece model file read as a unigram model: the scores
in the file are the pieces' log-probabilities. An Aho-Corasick automaton lists
all pieces that end at each character; per end, the best score and its piece
count are kept. Rules that decide results are the library's own:

- a space becomes U+2581 and one more leads the text;
- a later candidate wins only with a strictly better score, and starts run from
  left to right, so of equal scores the longest piece wins;
- user-defined pieces score max * length - 0.1;
- a character that is no piece scores min - 10 and counts as its UTF-8 bytes.

No piece but a run of spaces holds a space after its first character, so a text
splits before the first space of each run; counts and scores of those segments
add up, and each worker keeps those of segments it has seen.

Defined results. Null or empty text: 0 pieces, score 0. Null or repeated doc_id:
each row by itself. Empty table: no rows. Extra columns are ignored.
"""

from __future__ import annotations

import re
import struct

import pyarrow as pa
from pyspark.sql import DataFrame

from fidelmill.llm.common import arrow_map, column, texts, tune

SPACE = "▁"
SEGMENT = re.compile(f"{SPACE}+[^{SPACE}]*")
#: Segments kept per worker; the cache is emptied beyond that.
CACHE_SEGMENTS = 600_000
NORMAL, USER_DEFINED = 1, 4

_counters: dict[str, "Counter"] = {}


def fields(raw: bytes):
    """(number, value) of each field of a protocol buffer message."""

    def varint(i):
        x = shift = 0
        while True:
            x |= (raw[i] & 127) << shift
            shift += 7
            i += 1
            if raw[i - 1] < 128:
                return x, i

    i = 0
    while i < len(raw):
        tag, i = varint(i)
        kind = tag & 7
        if kind == 0:
            value, i = varint(i)
        elif kind == 2:
            n, i = varint(i)
            value, i = raw[i : i + n], i + n
        else:
            n = 4 if kind == 5 else 8
            value, i = raw[i : i + n], i + n
        yield tag >> 3, value


def pieces(model: bytes) -> list[tuple[str, float, int]]:
    """(piece, score, type) of a sentencepiece model file, in id order."""
    out = []
    for number, value in fields(model):
        if number == 1:
            x = dict(fields(value))
            out.append((x.get(1, b"").decode(), struct.unpack("<f", x[2])[0] if 2 in x else 0.0, x.get(3, NORMAL)))
    return out


class Counter:
    def __init__(self, vocabulary: list[tuple[str, float, int]]):
        import ahocorasick

        scores = [s for _, s, kind in vocabulary if kind == NORMAL]
        self.unknown = min(scores) - 10.0
        self.automaton = ahocorasick.Automaton()
        for piece, score, kind in vocabulary:
            if kind in (NORMAL, USER_DEFINED):
                self.automaton.add_word(piece, (len(piece), score if kind == NORMAL else len(piece) * max(scores) - 0.1))
        self.automaton.make_automaton()
        self.seen: dict[str, tuple[int, float]] = {}

    def segment(self, s: str) -> tuple[int, float]:
        """Piece count and best score of one segment."""
        n = len(s)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for end, match in self.automaton.iter(s):
            ends[end].append(match)
        best, count = [0.0] * (n + 1), [0] * (n + 1)
        for end in range(n):
            top, pieces, single = None, 0, False
            for length, score in sorted(ends[end], reverse=True):  # the earliest start first
                start = end + 1 - length
                if top is None or best[start] + score > top:
                    top, pieces = best[start] + score, count[start] + 1
                single |= length == 1
            if not single and (top is None or best[end] + self.unknown > top):
                top, pieces = best[end] + self.unknown, count[end] + len(s[end].encode("utf-8", "replace"))
            best[end + 1], count[end + 1] = top, pieces
        return count[n], best[n]

    def count(self, text: str) -> tuple[int, float]:
        if not text:
            return 0, 0.0
        parts = SEGMENT.findall(SPACE + text.replace(" ", SPACE))
        seen = self.seen
        if len(seen) > CACHE_SEGMENTS:
            seen.clear()
        for p in parts:
            if p not in seen:
                seen[p] = self.segment(p)
        got = [seen[p] for p in parts]
        return sum(n for n, _ in got), sum(s for _, s in got)


def counter(path: str) -> Counter:
    if path not in _counters:
        with open(path, "rb") as f:
            _counters[path] = Counter(pieces(f.read()))
    return _counters[path]


def count_tokens(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """doc_id, n_tokens and best_score of every row."""
    tune(docs.sparkSession)

    def make():
        def handle(batch):
            got = [counter(path).count(t) for t in texts(batch, text)]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array([n for n, _ in got], pa.int64()), pa.array([s for _, s in got], pa.float64())], names=["doc_id", "n_tokens", "best_score"])

        return handle

    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow_map(docs.select("doc_id", text), make, f"doc_id {kind}, n_tokens long, best_score double")
