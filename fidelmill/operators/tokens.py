"""Token, word and character tables of a page table (page_id, text).

Offsets are known inside a text, so tables with offsets are cut where a page lies, in
Arrow batches, and nothing is shuffled or sorted. Tables without them are expressions.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fidelmill.functions import script
from fidelmill.functions.codes import joined, parcels, strings

#: Characters of text whose matches leave a task at once, about.
CHARACTERS = 1 << 18
#: Kind of the break after a text, which is in no token.
END = 255


def _cut(pages: DataFrame, pattern: str, columns: Callable[[list, np.ndarray], dict], schema: str) -> DataFrame:
    """A row for each match of ``pattern`` in every text: page_id and ``columns(matches, number within the page)``."""

    def run(batches):
        find = re.compile(pattern).finditer
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            at = 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size < CHARACTERS):
                    size += len(texts[end] or "")
                    end += 1
                found = [list(find(t)) if t else [] for t in texts[at:end]]
                counts = np.array([len(f) for f in found])
                matches = [m for f in found for m in f]
                number = np.arange(len(matches)) - np.repeat(np.cumsum(counts) - counts, counts)
                got = {"page_id": ids.take(pa.array(np.repeat(np.arange(at, end), counts))), **columns(matches, number)}
                yield pa.RecordBatch.from_pydict(got)
                at = end

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "text").mapInArrow(run, f"page_id {kind}, {schema}")


Spelling = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def _cut_runs(texts: pa.Array, words: bool, spelling: Spelling | None) -> Iterator[tuple]:
    """(place of the first text, tokens, kinds, first, last, ends of the texts) of the tokens, or words, of each parcel of texts.

    Texts are cut a parcel at a time by the kind of each code point. ``spelling``
    respells a parcel first, in the same worker.
    """
    kind_of = script.kinds()
    for at, held in parcels(texts):
        codes, ends = joined(held)
        if spelling:
            codes, ends = spelling(codes, ends)
        kind = kind_of[codes]
        kind[ends] = END
        edges = np.flatnonzero(np.diff(kind)) + 1
        first, last = np.concatenate(([0], edges)), np.concatenate((edges, [len(kind)]))
        kinds = kind[first]
        mine = kinds == script.WORD if words else kinds != END
        first, last, kinds = first[mine], last[mine], kinds[mine]
        yield at, strings(codes[kind == script.WORD if words else kind != END], np.cumsum(last - first)), kinds, first, last, ends


def _runs(pages: DataFrame, words: bool, spelling: Spelling | None, columns: Callable[[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray], dict], schema: str) -> DataFrame:
    """A row for each token, or word, of every text: page_id and ``columns(tokens, kinds, number within the page, start, end)``."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for at, tokens, kinds, first, last, ends in _cut_runs(batch.column(1), words, spelling):
                page = np.searchsorted(ends, first)
                begun = np.concatenate(([0], ends[:-1] + 1))[page]
                number = np.arange(len(page)) - np.searchsorted(page, page)
                yield pa.RecordBatch.from_pydict({"page_id": ids.take(pa.array(page + at)), **columns(tokens, kinds, number, first - begun, last - begun)})

    of = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "text").mapInArrow(run, f"page_id {of}, {schema}")


def token_table(pages: DataFrame, spelling: Spelling | None = None) -> DataFrame:
    """page_id, pos, start, end, kind, token. Offsets count code points; all tokens together are the text."""

    def columns(tokens, kinds, number, start, end):
        return {"pos": pa.array(number, pa.int32()), "start": pa.array(start, pa.int32()), "end": pa.array(end, pa.int32()), "kind": pa.array(script.KINDS).take(pa.array(kinds)), "token": tokens}

    return _runs(pages, False, spelling, columns, "pos int, start int, end int, kind string, token string")


def word_table(pages: DataFrame, spelling: Spelling | None = None) -> DataFrame:
    """page_id, word_no (from 0), start, end, word of every word."""

    def columns(words, kinds, number, start, end):
        return {"word_no": pa.array(number, pa.int32()), "start": pa.array(start, pa.int32()), "end": pa.array(end, pa.int32()), "word": words}

    return _runs(pages, True, spelling, columns, "word_no int, start int, end int, word string")


def context_table(pages: DataFrame, spelling: Spelling | None = None) -> DataFrame:
    """``word_table`` with the word before, the word after and where that ends, null at a page's ends."""

    def columns(words, kinds, number, start, end):
        n = np.arange(len(number))
        first = np.append(number, 0) == 0  # of the next match too: a page's last word has none after it
        before, after = pa.array(n - 1, mask=first[:-1]), pa.array(n + 1, mask=first[1:])
        return {
            "word_no": pa.array(number, pa.int32()), "start": pa.array(start, pa.int32()), "end": pa.array(end, pa.int32()), "word": words,
            "previous": words.take(before), "next": words.take(after), "next_end": pa.array(end, pa.int32()).take(after),
        }

    return _runs(pages, True, spelling, columns, "word_no int, start int, end int, word string, previous string, next string, next_end int")


def counted_words(pages: DataFrame, spelling: Spelling | None = None) -> DataFrame:
    """word, n: how often each word of a batch of texts occurs there, a word once a batch; no other words leave the worker that cuts them."""

    def run(batches):
        for batch in batches:
            found = pa.chunked_array([tokens for _, tokens, *_ in _cut_runs(batch.column(0), True, spelling)], pa.string()).value_counts()
            yield pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], ["word", "n"])

    return pages.select("text").mapInArrow(run, "word string, n bigint")


def match_table(pages: DataFrame, pattern: str, group: int = 0) -> DataFrame:
    """page_id, start, end, m of every match of a (Python) pattern's group; offsets count code points."""

    def columns(matches, number):
        return {"start": pa.array([m.start(group) for m in matches], pa.int32()), "end": pa.array([m.end(group) for m in matches], pa.int32()), "m": pa.array([m[group] for m in matches], pa.string())}

    return _cut(pages, pattern, columns, "start int, end int, m string")


def words_only(pages: DataFrame) -> DataFrame:
    """page_id and word of every word; no order, so no shuffle."""
    return pages.select("page_id", F.explode(script.words(F.col("text"))).alias("word"))


def word_pairs(pages: DataFrame) -> DataFrame:
    """page_id, w1, w2 of neighbouring words, across marks and lines."""
    w, n = F.col("w"), F.greatest(F.size("w") - 1, F.lit(0))
    pairs = F.arrays_zip(F.slice(w, 1, n).alias("w1"), F.slice(w, 2, n).alias("w2"))
    return pages.select("page_id", script.words(F.col("text")).alias("w")).select("page_id", F.explode(pairs).alias("p")).select("page_id", "p.w1", "p.w2")


def characters(pages: DataFrame) -> DataFrame:
    """page_id and each character but white space."""
    return pages.select("page_id", F.explode(F.split(F.regexp_replace("text", r"[\s\x{85}\x{A0}\x{1c}-\x{1f}]", ""), "")).alias("ch")).where("ch <> ''")
