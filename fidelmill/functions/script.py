"""The Ge'ez script as Column expressions: syllables, folding, tokens, numerals, sentences.

Every table is built once in Python from the script's own order (each consonant
row is eight code points) and enters a plan as a literal, so the expressions stay
inside whole-stage code generation. Character classes come from ``unicodedata``,
because the JVM's and Python's ideas of digits and punctuation differ.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the script: blocks, rows of consonants, sparse rows, marks, sound groups.
MAIN = (0x1200, 0x137F)
OTHER_BLOCKS = ((0x1380, 0x139F), (0x2D80, 0x2DDF), (0xAB00, 0xAB2F), (0x1E7E0, 0x1E7FF))
ROWS = tuple(range(0x1200, 0x1358, 8))
LABIOVELAR_OF = {0x1240: 0x1248, 0x1250: 0x1258, 0x1280: 0x1288, 0x12A8: 0x12B0, 0x12B8: 0x12C0, 0x1308: 0x1310}
HOMOPHONES = ((0x1200, 0x1210, 0x1280), (0x1230, 0x1220), (0x12A0, 0x12D0), (0x1338, 0x1340))
SOFT_HOMOPHONES = ((0x12A8, 0x12B8),)
GEMINATION = "\u135d\u135e\u135f"
WORDSPACE, FULL_STOP = "፡", "።"
BREAKS = "\u1361 \t\n\r\u00a0\u200b"
SENTENCE_ENDS = "።፧፨.?!"
DIGIT_VALUES = (*range(1, 10), *range(10, 100, 10), 100, 10000)
DIGITS = {chr(0x1369 + i): v for i, v in enumerate(DIGIT_VALUES)}

PLAIN_OF = {v: k for k, v in LABIOVELAR_OF.items()}
ORDERS = 8


@lru_cache
def syllables() -> dict[str, tuple[int, int]]:
    """character -> (row, order) of every assigned syllable."""
    out = {}
    for row in ROWS:
        for order in range(ORDERS):
            c = chr(row + order)
            if unicodedata.name(c, "") and not (row in PLAIN_OF and order not in (0, 2, 3, 4, 5)):
                out[c] = (row, order)
    return out


def compose(row: int, order: int) -> str | None:
    c = chr(row + order)
    return c if syllables().get(c) == (row, order) else None


@dataclass(frozen=True)
class Fold:
    """Which distinctions a matching form ignores."""

    homophones: bool = True
    ha_orders: bool = True
    kha: bool = False
    labiovelar: bool = False
    gemination: bool = True


STRICT, AGGRESSIVE = Fold(False, False, False, False, False), Fold(True, True, True, True, True)
MODERN = Fold(True, False, False, False, True)


@lru_cache
def fold_table(policy: Fold = Fold()) -> tuple[str, str]:
    """``translate`` arguments: characters, and their replacements; those beyond the second string are dropped."""
    canonical = {m: g[0] for g in (HOMOPHONES if policy.homophones else ()) for m in g}
    soft = {m: g[0] for g in (SOFT_HOMOPHONES if policy.kha else ()) for m in g}
    pairs = []
    for c, (row, order) in syllables().items():
        if policy.labiovelar and row in PLAIN_OF and compose(PLAIN_OF[row], order):
            row = PLAIN_OF[row]
        row = canonical.get(row, row)
        row = soft.get(row, row)
        if policy.ha_orders and order == 3 and row in HOMOPHONES[0]:
            order = 0
        to = compose(row, order) or c
        if to != c:
            pairs.append((c, to))
    drop = GEMINATION if policy.gemination else ""
    return "".join(a for a, _ in pairs) + drop, "".join(b for _, b in pairs)


@lru_cache
def skeleton_table() -> tuple[str, str]:
    canonical = {m: g[0] for g in HOMOPHONES for m in g}
    pairs = [(c, compose(canonical.get(row, row), 0)) for c, (row, _) in syllables().items()]
    pairs = [(a, b) for a, b in pairs if b and a != b]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def fold(text: Column, policy: Fold = Fold()) -> Column:
    """The matching form of a text."""
    return F.translate(text, *fold_table(policy)) if fold_table(policy)[0] else text


def skeleton(text: Column) -> Column:
    """Every syllable as the first order of its row, rows of one sound as one."""
    return F.translate(text, *skeleton_table())


def order_variants(c: str) -> list[str]:
    row, order = syllables()[c]
    return [v for o in range(ORDERS) if o != order and (v := compose(row, o))]


def homophone_variants(c: str, policy: Fold = Fold()) -> list[str]:
    """Other spellings of a syllable's sound, in order of rows."""
    row, order = syllables()[c]
    orders = (0, 3) if policy.ha_orders and row in HOMOPHONES[0] and order in (0, 3) else (order,)
    groups = HOMOPHONES + (SOFT_HOMOPHONES if policy.kha else ())
    return [v for g in groups if row in g for r in g for o in orders if (v := compose(r, o)) and v != c]


# ---- character classes ---------------------------------------------------------------------------------------------


def _class(points: Iterable[int], python: bool = False) -> str:
    """The inside of a bracket expression that holds the code points, in a form that Java and RE2 read, or Python."""
    form = "\\U{:08X}" if python else "\\x{{{:X}}}"
    out, run = [], []
    for p in [*points, None]:
        if run and p == run[-1] + 1:
            run.append(p)
            continue
        if run:
            a, b = run[0], run[-1]
            out.append(form.format(a) + ("-" + form.format(b) if b > a else ""))
        run = [p] if p is not None else []
    return "".join(out)


def _points(test: Callable[[str], bool]) -> list[int]:
    return [p for p in range(sys.maxunicode + 1) if not 0xD800 <= p <= 0xDFFF and test(chr(p))]


@lru_cache
def token_points() -> dict[str, list[int]]:
    """Code points of space, punct and number, by Python's rules."""
    return {"space": sorted(map(ord, BREAKS)), "punct": _points(lambda c: unicodedata.category(c)[0] == "P" and c not in BREAKS), "number": _points(lambda c: c in DIGITS or c.isdigit())}


KINDS, WORD = ("space", "punct", "number", "word"), 3


@lru_cache
def kinds() -> np.ndarray:
    """The place in ``KINDS`` of every code point's kind."""
    out = np.full(sys.maxunicode + 1, WORD, np.uint8)
    for k, points in token_points().items():
        out[points] = KINDS.index(k)
    return out


@lru_cache
def python_token_pattern() -> str:
    """As ``token_pattern``, for Python, with a named group for each kind."""
    c = {k: _class(v, True) for k, v in token_points().items()}
    return "|".join(f"(?P<{k}>[{v}]+)" for k, v in c.items()) + f"|(?P<word>[^{''.join(c.values())}]+)"


@lru_cache
def python_word_pattern() -> str:
    return f"[^{''.join(_class(v, True) for v in token_points().values())}]+"


@lru_cache
def classes() -> dict[str, str]:
    """space, punct, number (by Python's rules) and letter classes, disjoint where tokens need it."""
    return {
        **{k: _class(v) for k, v in token_points().items()},
        "letter": _class(_points(str.isalpha)),
        "ethiopic": _class(p for a, b in (MAIN, *OTHER_BLOCKS) for p in range(a, b + 1)),
        "other_ethiopic": _class(p for a, b in OTHER_BLOCKS for p in range(a, b + 1)),
        "syllable": _class(sorted(map(ord, syllables()))),
    }


@lru_cache
def ethiopic_letters() -> str:
    return _class(p for a, b in (MAIN, *OTHER_BLOCKS) for p in range(a, b + 1) if chr(p).isalpha())


@lru_cache
def main_letters() -> str:
    """Letters of the main block and of the extension, as far as an importer counts them."""
    return _class(p for a, b in (MAIN, (0x2D80, 0x2DDE)) for p in range(a, b + 1) if chr(p).isalpha())


@lru_cache
def token_pattern() -> str:
    c = classes()
    every = c["space"] + c["punct"] + c["number"]
    return f"[{c['space']}]+|[{c['punct']}]+|[{c['number']}]+|[^{every}]+"


def tokens(text: Column) -> Column:
    """All tokens of a text in order; together they are the text."""
    return F.regexp_extract_all(text, F.lit(token_pattern()), F.lit(0))


def token_kind(token: Column) -> Column:
    c, first = classes(), F.substring(token, 1, 1)
    return (
        F.when(first.rlike(f"^[{c['space']}]"), "space").when(first.rlike(f"^[{c['punct']}]"), "punct").when(first.rlike(f"^[{c['number']}]"), "number").otherwise("word")
    )


@lru_cache
def word_pattern() -> str:
    c = classes()
    return f"[^{c['space']}{c['punct']}{c['number']}]+"


@lru_cache
def letter_runs() -> str:
    """Runs of letters, for the JVM: usual letters first, and ASCII's other characters ruled out before the long class is tried."""
    return f"(?:[A-Za-z\\x{{1200}}-\\x{{1248}}]++|(?![\\x{{0}}-@\\[-`{{-\\x{{7F}}])[{classes()['letter']}])++"


@lru_cache
def fast_word_pattern() -> str:
    """``word_pattern`` for the JVM, which tries a class range by range: runs of the usual letters first, without going back, and the usual characters between words ruled out one by one before the long class is tried."""
    between = "".join(f"\\x{{{p:X}}}" for points in token_points().values() for p in points if p < 0x80)
    return f"(?:[A-Za-z\\x{{1200}}-\\x{{135A}}]++|(?![{between}\\x{{1361}}-\\x{{137C}}]){word_pattern()[:-1]})++"


def words(text: Column) -> Column:
    """The word tokens of a text, in order."""
    return F.regexp_extract_all(text, F.lit(fast_word_pattern()), F.lit(0))


def has(text: Column, kind: str) -> Column:
    return text.rlike(f"[{classes()[kind]}]")


@lru_cache
def usual() -> tuple[str, str, str]:
    """Letters of the main block, letters of Latin-1, and what of ASCII and of the main block is no letter."""
    main, latin = ((c for p in r if (c := chr(p)).isalpha()) for r in (range(0x1200, 0x1380), range(0x100)))
    other = (c for r in (range(0x80), range(0x135B, 0x137D)) for p in r if not (c := chr(p)).isalpha())
    return "".join(main), "".join(latin), "".join(other)


def letter_counts(text: Column, own: str) -> tuple[Column, Column]:
    """How many characters are letters, and how many of these are of the main block or of the class ``own``.

    The usual characters are counted by taking them out, which is a look-up each;
    only what is left meets the long classes.
    """
    main, latin, other = usual()
    left = F.translate(text, main, "")
    rest = F.translate(left, latin, "")
    rare = F.translate(rest, other, "")
    n_main, n_latin = F.length(text) - F.length(left), F.length(left) - F.length(rest)
    few = lambda c: F.when(F.length(rare) > 0, F.regexp_count(rare, F.lit(f"[{c}]"))).otherwise(0)
    return n_main + n_latin + few(classes()["letter"]), n_main + few(own)


def ethiopic_ratio(text: Column) -> Column:
    """Share of the letters that are of the script, in any of its blocks; 0 without letters."""
    letters, own = letter_counts(text, ethiopic_letters())
    return F.when(letters > 0, own / letters).otherwise(F.lit(0.0))


def sentences(text: Column) -> Column:
    """Sentences with their ends, trimmed, the empty ones left out."""
    ends = _class(sorted(map(ord, SENTENCE_ENDS)))
    parts = F.regexp_extract_all(text, F.lit(f"[^{ends}]*[{ends}]|[^{ends}]+"), F.lit(0))
    return F.filter(F.transform(parts, lambda s: F.regexp_replace(s, r"^[\s\x{A0}]+|[\s\x{A0}]+$", "")), lambda s: s != "")


def deletion_keys(word: Column, longest: int = 24) -> Column:
    """The word without each of its characters in turn; none for words of one character or too many."""
    n = F.length(word)
    return F.when((n >= 2) & (n <= longest), F.array_distinct(F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(word.substr(F.lit(1), i - 1), word.substr(i + 1, n))))).otherwise(
        F.array().cast("array<string>")
    )


# ---- numerals ------------------------------------------------------------------------------------------------------


def numeral_value(text: Column) -> Column:
    """The value of an Ethiopic numeral, or null. Sums within a group; a hundred and a myriad multiply what is before."""
    values = F.create_map(*(F.lit(x) for kv in DIGITS.items() for x in kv))
    start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("part"))

    def step(acc: Column, c: Column) -> Column:
        v, one = values[c].cast("long"), lambda x: F.when(x == 0, F.lit(1).cast("long")).otherwise(x)
        total = F.when(v == 10000, (acc["total"] + one(acc["part"])) * 10000).otherwise(acc["total"])
        part = F.when(v == 10000, F.lit(0).cast("long")).when(v == 100, one(acc["part"]) * 100).otherwise(acc["part"] + v)
        return F.struct(total.alias("total"), part.alias("part"))

    valid = text.rlike(f"^[{_class(sorted(map(ord, DIGITS)))}]+$")
    return F.when(valid, F.aggregate(F.split(text, ""), start, step, lambda acc: acc["total"] + acc["part"]))


def numeral(value: Column) -> Column:
    """The numeral of 1 to 99 999 999; null outside."""
    chars = {v: k for k, v in DIGITS.items()}
    units = F.array(F.lit(""), *(F.lit(chars[i]) for i in range(1, 10)))
    tens = F.array(F.lit(""), *(F.lit(chars[i]) for i in range(10, 100, 10)))
    two = lambda n: F.concat(F.element_at(tens, (F.floor(n / 10) + 1).cast("int")), F.element_at(units, (n % 10 + 1).cast("int")))

    def four(n: Column) -> Column:
        h, rest = F.floor(n / 100), n % 100
        return F.concat(F.when(h > 1, two(h)).otherwise(""), F.when(h > 0, chars[100]).otherwise(""), two(rest))

    high, low = F.floor(value / 10000), value % 10000
    big = F.concat(F.when(high > 1, four(high)).otherwise(""), F.when(high > 0, chars[10000]).otherwise(""), four(low))
    return F.when((value > 0) & (value < 100_000_000), big)


def same_family(a: Column, b: Column) -> Column:
    """Whether two characters are syllables of one row."""
    rows = F.create_map(*(x for c, (row, _) in syllables().items() for x in (F.lit(c), F.lit(row))))
    return F.coalesce(F.try_element_at(rows, a) == F.try_element_at(rows, b), F.lit(False))
