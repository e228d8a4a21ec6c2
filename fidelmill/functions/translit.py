"""Latin keys to Ge'ez script (SERA): one regular expression says how keys are cut, arrays of code points apply it to many texts at once."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from fidelmill.functions.codes import BREAK, joined, parcels, strings
from fidelmill.functions.script import ORDERS, compose

# Fixed values of the key layout.
CONSONANTS = (
    "h 1200 l 1208 H 1210 m 1218 S 1220 r 1228 s 1230 sh 1238 x 1238 q 1240 Q 1250 b 1260 v 1268 t 1270 ch 1278 c 1278 X 1280 n 1290 ny 1298 N 1298 k 12A8 kh 12B8 K 12B8"
    " w 12C8 ` 12D0 z 12D8 zh 12E0 Z 12E0 y 12E8 d 12F0 D 12F8 j 1300 g 1308 G 1318 T 1320 C 1328 P 1330 ts 1338 TS 1338 tz 1340 f 1348 p 1350"
).split()
CONSONANT_ROWS = {k: int(v, 16) for k, v in zip(CONSONANTS[::2], CONSONANTS[1::2])}
VOWELS = "euiaEIo"  # orders 0 to 6 after a consonant
LONE_VOWELS = {"a": 0, "e": 0, "u": 1, "i": 2, "A": 3, "E": 4, "I": 5, "o": 6}
ALF, BARE = 0x12A0, 5
MARKS = {"::": "።", ":": "፡", ",": "፣", ";": "፤", "-:": "፥", ":-": "፦", "?": "፧", "::-": "፨"}


@lru_cache
def pattern() -> str:
    """A consonant with its vowel, a lone vowel, a mark, or a run of anything else."""
    by_length = lambda keys: "|".join(map(re.escape, sorted(keys, key=lambda k: (-len(k), k))))
    consonant = by_length(CONSONANT_ROWS)
    marks = by_length(MARKS)
    first = "".join(sorted({k[0] for k in [*CONSONANT_ROWS, *LONE_VOWELS, *MARKS]} - {"-"}))
    return f"(?:{consonant})(?:[{VOWELS}](?:wa|WA)?)?|[{''.join(LONE_VOWELS)}]|{marks}|[^{first}-]+|-"


@lru_cache
def rows() -> dict[str, list[str]]:
    """The eight outputs of each consonant key; a slot without a letter gives the key."""
    return {k: [compose(r, o) or k for o in range(ORDERS)] for k, r in CONSONANT_ROWS.items()}


def token_map() -> dict[str, str]:
    """Every key sequence that the pattern can cut, with its output."""
    out = {}
    for k, outputs in rows().items():
        out[k] = outputs[BARE]
        for o, v in enumerate(VOWELS):
            out[k + v] = outputs[o]
            out[k + v + "wa"] = out[k + v + "WA"] = outputs[7]
    out |= {k: compose(ALF, o) for k, o in LONE_VOWELS.items()}
    return out | MARKS


@lru_cache
def _tables() -> dict[str, np.ndarray]:
    """The layout as arrays by ASCII character (0: none): consonants of one key, first and second keys of those of two, vowels, and what a character gives by itself."""
    keys, of = list(CONSONANT_ROWS), lambda dtype: np.zeros(128, dtype)
    t = {"one": of(np.uint8), "first": of(np.uint8), "second": of(np.uint8), "vowel": of(np.uint8), "alone": np.arange(128, dtype=np.uint32), "mark": of(bool)}
    pairs = [k for k in keys if len(k) == 2]
    firsts, seconds = ("".join(sorted({k[i] for k in pairs})) for i in (0, 1))
    t["two"] = np.zeros((len(firsts) + 1, len(seconds) + 1), np.uint8)
    for n, k in enumerate(keys, 1):
        if len(k) == 1:
            t["one"][ord(k)] = n
        else:
            t["two"][firsts.index(k[0]) + 1, seconds.index(k[1]) + 1] = n
    for name, held in (("first", firsts), ("second", seconds), ("vowel", VOWELS)):
        for n, c in enumerate(held, 1):
            t[name][ord(c)] = n
    for k, v in token_map().items():
        if len(k) == 1 and k not in CONSONANT_ROWS:
            t["alone"][ord(k)] = ord(v)
    t["mark"][[ord(":"), ord("-")]] = True
    t["out"] = np.zeros((2, len(keys) + 1, ORDERS), np.uint32)  # a slot without a letter gives the key, of two characters at most
    for n, k in enumerate(keys, 1):
        for o, v in enumerate(rows()[k]):
            t["out"][: len(v), n, o] = list(map(ord, v))
    return t


def spelt(codes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points of joined texts in Ge'ez script, and where their ends are then: as ``pattern`` cuts from the left, for all places at once.

    Three things depend on what was cut before: a consonant of two keys takes its
    second (no such key begins where two others overlap), ``wa`` after a vowel is
    taken by turns, and colons with hyphens are cut run by run.
    """
    t = _tables()
    u = np.concatenate(([BREAK] * 2, codes, [BREAK] * 3)).astype(np.uint32)
    a = np.where(u < 128, u, 0).astype(np.uint8)
    two = np.zeros(len(a), np.uint8)
    two[:-1] = t["two"][t["first"][a[:-1]], t["second"][a[1:]]]
    two[1:] = np.where(two[:-1] > 0, 0, two[1:])
    begun = two > 0
    taken = np.zeros(len(a), bool)  # what an earlier place stands for
    taken[1:] = begun[:-1]
    vowel = t["vowel"][a]
    key = t["one"][a]
    closed = (key > 0) & ~begun
    bound = np.zeros(len(a), bool)
    bound[1:] = (vowel[1:] > 0) & closed[:-1]
    eighth = np.zeros(len(a), bool)
    w = np.flatnonzero(bound[:-2] & ((a[1:-1] == ord("w")) & (a[2:] == ord("a")) | (a[1:-1] == ord("W")) & (a[2:] == ord("A"))))  # the vowels before it
    if len(w):
        k = np.arange(len(w))
        run = np.maximum.accumulate(np.where(np.diff(w, prepend=-9) != 2, k, 0))
        w = w[(k - run) % 2 == 0]
        eighth[w] = True
        bound[w + 2] = False
        taken[w + 1] = taken[w + 2] = True
    taken |= bound
    key = np.where(begun, two, np.where(taken, 0, key))
    at = np.flatnonzero(key)
    after = at + 1 + begun[at]
    order = np.where(eighth[after], ORDERS - 1, np.where(bound[after], vowel[after].astype(np.int64) - 1, BARE))
    out = np.where(a > 0, t["alone"][a], u)
    out[at] = t["out"][0, key[at], order]
    more = t["out"][1, key[at], order]
    if more.any():
        out[at[more > 0] + 1] = more[more > 0]
        taken[at[more > 0] + 1] = False
    mark = t["mark"][a]
    if (mark[:-1] & mark[1:]).any():
        edges = np.flatnonzero(np.diff(mark)) + 1  # the padding is no mark, so edges come in pairs
        for b, e in edges.reshape(-1, 2)[(edges[1::2] - edges[::2]) > 1]:
            s = _cutter().sub(lambda m: _spellings().get(m[0], m[0]), a[b:e].tobytes().decode())
            out[b : b + len(s)] = list(map(ord, s))
            taken[b + len(s) : e] = True
    kept = ~taken
    kept[:2] = kept[-3:] = False
    return out[kept], np.cumsum(kept)[ends + 2] - 1


@lru_cache
def _cutter() -> re.Pattern:
    return re.compile(pattern())


@lru_cache
def _spellings() -> dict[str, str]:
    return token_map()


def _without_breaks(codes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.delete(codes, ends), ends - np.arange(len(ends))


def transliterate_text(text: str) -> str:
    """A whole text at once."""
    return spelt(*joined([text]))[0][:-1].tobytes().decode("utf-32-le", "surrogatepass")


def transliterate(text: Column) -> Column:
    """The same for a column, in Arrow batches; nothing is kept from one text to the next."""

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        out = [strings(*_without_breaks(*spelt(*joined(held))), np.array([t is None for t in held])) for _, held in parcels(texts)]
        return pa.concat_arrays(out) if out else pa.array([], pa.string())

    return run(text)


def keyboard() -> list[tuple[str, str, str]]:
    """(key, first order, all seven) of each row once, in key order."""
    out, seen = [], set()
    for k, r in CONSONANT_ROWS.items():
        if r not in seen:
            seen.add(r)
            out.append((k, compose(r, 0) or "", " ".join(compose(r, o) or "·" for o in range(7))))
    return out


class Typing:
    """Keys typed one at a time: ``feed`` tells how many characters before the cursor go and what comes.

    What a key does depends on what the last ones left open: a consonant that a
    second key or a vowel may still change, a syllable whose vowel is set, or a
    mark that another key may extend. A single ``w`` makes the eighth form here.
    """

    def __init__(self):
        self.reset()

    def reset(self) -> None:
        """The cursor moved: nothing is open."""
        self.consonant = self.marks = ""
        self.vowelled = False

    def _rules(self, key: str, marks: str):
        """(deleted, inserted, state after) of every rule that the key meets, in order of precedence; state is (consonant, vowelled, marks)."""
        open_, row = self.consonant, CONSONANT_ROWS.get(self.consonant, 0)
        if open_ and not self.vowelled and open_ + key in CONSONANT_ROWS:
            yield 1, compose(CONSONANT_ROWS[open_ + key], BARE), (open_ + key, False, "")
        if open_ and not self.vowelled and key in VOWELS:
            yield 1, compose(row, VOWELS.index(key)), (open_, True, "")
        if open_ and self.vowelled and key in "wW":
            yield 1, compose(row, 7), ("", False, "")
        if key in CONSONANT_ROWS:
            yield 0, compose(CONSONANT_ROWS[key], BARE), (key, False, "")
        if key in LONE_VOWELS:
            yield 0, compose(ALF, LONE_VOWELS[key]), ("", False, "")
        if marks and marks + key in MARKS:
            yield 1, MARKS[marks + key], (open_, self.vowelled, marks + key)
        if key in MARKS:
            yield 0, MARKS[key], ("", False, key)

    def feed(self, key: str) -> tuple[int, str, bool]:
        """(characters to delete, text to insert, whether the key was taken) of one key."""
        marks, self.marks = self.marks, ""
        for deleted, inserted, state in self._rules(key, marks) if len(key) == 1 else ():
            if inserted:
                self.consonant, self.vowelled, self.marks = state
                return deleted, inserted, True
        self.reset()
        return 0, "", False


def typed_text(keys: str) -> str:
    """What stands in the editor after the keys were typed in a row; a key that is not taken stands for itself."""
    typing, out = Typing(), ""
    for key in keys:
        deleted, inserted, taken = typing.feed(key)
        out = (out[: len(out) - deleted] + inserted) if taken else out + key
    return out


def typed(keys: Column) -> Column:
    """``typed_text`` of a column, in Arrow batches."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else typed_text(t) for t in texts], dtype=object)

    return run(keys)
