"""The page store and its ledger: corrections, replacement, search, statistics, contents."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from heapq import heappop, heappush

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fidelmill.functions import script
from fidelmill.operators.tokens import match_table

LEARNED_KINDS = ("manual", "accepted")
#: What Python counts as white space beyond the JVM's ``\\s``.
_SPACES = r"\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
HEADINGS = ("chapter", "heading", "subheading")
FURNITURE = ("running_head", "page_number")


def upsert(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``table`` with ``rows`` in place of those with their keys."""
    return table.join(rows.select(key).distinct(), key, "left_anti").unionByName(rows)


def delete_pages(page_ids: DataFrame, *children: DataFrame) -> list[DataFrame]:
    """Each child table without the rows of the deleted pages."""
    return [c.join(page_ids.select("page_id").distinct(), "page_id", "left_anti") for c in children]


def add_pages(pages: DataFrame, texts: DataFrame) -> DataFrame:
    """New (raw_text) rows numbered from the last index on, in order of ``seq``; one row per added page sees the window."""
    last = pages.agg(F.coalesce(F.max("idx"), F.lit(-1)).alias("last"))
    n = F.row_number().over(Window.orderBy("seq"))
    return texts.crossJoin(F.broadcast(last)).select((F.col("last") + n).cast("int").alias("idx"), F.concat(F.lit("p. "), (F.col("last") + n + 1).cast("string")).alias("label"), "raw_text", F.lit("new").alias("status"))


def edited_text(raw: Column, edited: Column) -> Column:
    return F.coalesce(F.nullif(edited, F.lit("")), raw, F.lit(""))


def rerecognized(raw: Column, edited: Column, new: Column) -> Column:
    """The edited text after a new recognition: only an untouched one follows it."""
    return F.when((edited == "") | (edited == raw), new).otherwise(edited)


def merged_settings(held: Column, new: Column) -> Column:
    """A JSON map with another's entries over it; what is no JSON counts as empty."""
    read = lambda c: F.coalesce(F.from_json(c, "map<string,string>"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.map_concat(F.map_filter(read(held), lambda k, v: ~F.map_contains_key(read(new), k)), read(new))))))


def ledger(edits: DataFrame) -> DataFrame:
    return edits.where("before <> after")


def known_corrections(edits: DataFrame, least: int = 2) -> DataFrame:
    """before, after, n: of each corrected form its most frequent correction; equal counts by the text."""
    counts = ledger(edits).where(F.col("kind").isin(*LEARNED_KINDS)).groupBy("before", "after").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return counts.groupBy("before").agg(F.min_by(F.struct("after", "n"), F.struct(-F.col("n"), F.col("after"))).alias("c")).select("before", "c.after", "c.n")


def _pattern(before: str, whole_word: bool) -> str:
    """As a whole word: white space, a word separator or nothing before; one of these or a mark after."""
    return f"(?<![^\\s\u1361{_SPACES}])\\Q{before}\\E(?![^\\s\u1361-\u1368{_SPACES}])" if whole_word else f"\\Q{before}\\E"


def occurrences_of(text: Column, before: str, whole_word: bool = True) -> Column:
    return F.regexp_count(text, F.lit(_pattern(before, whole_word)))


def replaced(text: Column, before: str, after: str, whole_word: bool = True) -> Column:
    """Every occurrence replaced; the replacement is taken literally."""
    return F.regexp_replace(text, F.lit(_pattern(before, whole_word)), F.lit(re.sub(r"([\\$])", r"\\\1", after)))


def propagate(pages: DataFrame, before: str, after: str, whole_word: bool = True, dry: bool = False) -> DataFrame:
    """page_id, n (and the new text) of the pages that a correction touches."""
    p = pages.select("page_id", "text", occurrences_of(F.col("text"), before, whole_word).alias("n")).where("n > 0")
    return p.select("page_id", "n") if dry else p.select("page_id", "n", replaced(F.col("text"), before, after, whole_word).alias("text"))


def _replaced(text: str, before: str, after: str) -> str:
    """As ``replaced`` does whole words."""
    out, done, i = [], 0, text.find(before)
    while i >= 0:
        end = i + len(before)
        whole = (not i or _apart(text[i - 1])) and (end == len(text) or _apart(text[end]) or "\u1362" <= text[end] <= "\u1368")
        if whole:
            out += text[done:i], after
            done = end
        i = text.find(before, end if whole else i + 1)
    return "".join((*out, text[done:]))


def _apart(c: str) -> bool:
    return c.isspace() or c == script.WORDSPACE


_GAPS = re.compile(r"[\s\u1361]+")


def _first(before: str) -> str:
    """The longest of the runs between spaces that ``before`` is made of, but the last, to which marks may be joined; or the last."""
    runs = [r for r in _GAPS.split(before) if r]
    return max(runs[:-1] if len(runs) > 1 else runs, key=len, default="")


def replay(corrections: list[tuple[str, str]]) -> Callable[[str], str]:
    """A function of a text that applies all corrections, each to what the ones before it left.

    A match stands between spaces, and only marks may follow it at once. So a
    correction without spaces in ``before`` acts on each run between spaces by
    itself: what becomes of a run is worked out once and kept, whatever the length
    of the text. The others (``wide``) are looked for where the text, or what the
    corrections make of its runs, has the longest run of ``before`` as a run of its
    own or as the beginning of a run that goes on with a mark. A text that has none
    is joined of its runs; in one that has, the corrections of runs stop at each.
    """
    single: dict[str, list[int]] = defaultdict(list)
    wide: dict[str, list[int]] = defaultdict(list)
    loose = []
    for rank, (before, _) in enumerate(corrections):
        if not before:
            continue
        if not _GAPS.search(before):
            single[before].append(rank)
        elif _GAPS.match(before[0]) or _GAPS.match(before[-1]) or not _first(before):
            loose.append(rank)  # spaces at its edges: any text may hold it
        else:
            wide[_first(before)].append(rank)

    def heads(run: str) -> Iterator[str]:
        """What a correction may match of a run: all of it, or what stands before a mark."""
        yield run
        for m in _MARKED.finditer(run):
            yield run[: m.start()]

    def corrected(run: str, least: int, most: int) -> tuple[str, frozenset[int]]:
        """A run after the corrections of runs of ranks ``least`` to ``most``, and the wide ones that may match it on the way."""
        seen, out, todo = set(), [], [(run, least)]
        while todo:
            piece, at = todo.pop()
            if wide:
                seen.update(r for h in heads(piece) for r in wide.get(h, ()))
            rank = min((r for h in heads(piece) for r in single.get(h, ()) if at <= r < most), default=None)
            if rank is None:
                out.append(piece)
                continue
            before, after = corrections[rank]
            pieces = _CUT.split(after + piece[len(before) :])
            todo += [(p, rank + 1 if i % 2 == 0 else most) for i, p in enumerate(pieces) if p][::-1]
        return "".join(out), frozenset(seen)

    touched: dict[str, frozenset[int]] = {}

    class Kept(dict):
        """What becomes of pieces of a text; emptied when it is large."""

        def __missing__(self, piece: str) -> str:
            out, seen = corrected(piece, 0, len(corrections))
            if seen:
                touched[piece] = seen
            if len(piece) <= LONG:
                if len(self) >= KEPT:
                    self.clear()
                self[piece] = out
            return out

    kept = Kept()

    def runs_of(text: str, least: int, most: int) -> str:
        return "".join(piece if i % 2 or not piece else corrected(piece, least, most)[0] for i, piece in enumerate(_CUT.split(text)))

    def wide_in(text: str, least: int) -> set[int]:
        found = set().union(*(corrected(r, least, len(corrections))[1] for r in set(_GAPS.split(text)) if r))
        return {r for r in found if r >= least}

    def run(text: str) -> str:
        pieces = _CUT.split(text)
        done = "".join(map(kept.__getitem__, pieces))
        ranks, at = sorted({*loose, *(r for p in pieces for r in touched.get(p, ()))}) if loose or touched else [], 0
        if not ranks:
            return done
        held = set(ranks)
        while ranks:
            rank = heappop(ranks)
            text = runs_of(text, at, rank)
            at = rank + 1
            new = _replaced(text, *corrections[rank])
            if new != text:
                text = new
                for r in wide_in(text, at) - held:  # what was put there may touch what stood beside it
                    held.add(r)
                    heappush(ranks, r)
        return runs_of(text, at, len(corrections))

    return run


#: Runs whose corrected form a worker keeps, and the longest of them.
KEPT, LONG = 100_000, 64
_CUT = re.compile(f"({_GAPS.pattern})")
_MARKED = re.compile("[\u1362-\u1368]")


def apply_ledger(pages: DataFrame, corrections: DataFrame) -> DataFrame:
    """page_id, text after all corrections, one after the other, the commonest first; empty ``before`` is none. The whole ledger goes to every worker."""
    rows = corrections.where("before <> ''").orderBy(F.desc("n"), "before").select("before", "after").collect()
    corrected = replay([tuple(r) for r in rows])

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else corrected(t) for t in texts], dtype=object)

    run = run.asNondeterministic()  # else the filter runs it once more
    return pages.select("page_id", "text", run("text").alias("new")).where("new <> text").select("page_id", F.col("new").alias("text"))


def occurrences(pages: DataFrame, needle: str, folded: bool = False, context: int = 28) -> DataFrame:
    """page_id, offset, excerpt of every occurrence, overlapping ones too; found where a text lies."""
    hay = script.fold(F.col("text")) if folded else F.col("text")
    p = pages.select("page_id", "text", hay.alias("hay")).where(F.col("hay").contains(needle))
    places = match_table(p.select("page_id", F.col("hay").alias("text")), f"(?=({re.escape(needle)}))").select("page_id", F.col("start").alias("offset"))
    lo = F.greatest(F.col("offset") - context, F.lit(0))
    return places.join(p.select("page_id", "text"), "page_id").select("page_id", "offset", F.col("text").substr(lo + 1, F.col("offset") + len(needle) + context - lo).alias("excerpt"))


def first_results(found: DataFrame, pages: DataFrame, limit: int = 500) -> DataFrame:
    """The search panel's first ``limit`` places, in order of page and offset, with labels."""
    rows = found.join(pages.select("page_id", "idx", "label"), "page_id").orderBy("idx", "offset").limit(limit)
    return rows.select("page_id", "label", "offset", F.concat(F.lit("…"), F.replace("excerpt", F.lit("\n"), F.lit(" ")), F.lit("…")).alias("context"))


def excerpt(text: Column, most: int = 40) -> Column:
    t = F.regexp_replace(F.trim(text), "\n", " ")
    return F.when(F.length(t) > most, F.concat(F.substring(t, 1, most - 2), F.lit("…"))).otherwise(t)


def statistics(pages: DataFrame, edits: DataFrame) -> DataFrame:
    p = pages.agg(
        F.count(F.lit(1)).alias("n_pages"), F.count_if(F.col("status") == "verified").alias("n_verified"), F.count_if(F.col("status") == "recognized").alias("n_recognized"),
        F.count_if(F.col("status") == "in_review").alias("n_in_review"), F.coalesce(F.try_divide(F.count_if(F.col("status") == "verified"), F.count(F.lit(1))), F.lit(0.0)).alias("verified_fraction"),
    )
    return p.crossJoin(F.broadcast(edits.agg(F.count(F.lit(1)).alias("n_edits"))))  # one row each


def contents(marks: DataFrame, pages: DataFrame) -> DataFrame:
    """idx, start, kind, title of the heading marks (page_id, start, end, kind)."""
    m = marks.where(F.col("kind").isin(*HEADINGS)).join(pages.select("page_id", "idx", "text"), "page_id")
    title = F.substring(F.trim(F.col("text").substr(F.col("start") + 1, F.col("end") - F.col("start"))), 1, 120)
    return m.select("idx", "start", "kind", title.alias("title"))


def full_text(pieces: DataFrame, key: str, order: str, text: str = "text", between: str = "\n\n") -> DataFrame:
    """The texts of each key in order, joined."""
    s = F.sort_array(F.collect_list(F.struct(order, text)))
    return pieces.groupBy(key).agg(F.array_join(F.transform(s, lambda x: x[text]), between).alias("full_text"))


def filter_mode(quality: DataFrame, mode: str) -> DataFrame:
    """Pages of a list mode: all, new, recognized (or in review), verified, worst (lowest score first; pages without a score count as 0)."""
    conditions = {"all": "true", "new": "status = 'new'", "recognized": "status in ('recognized', 'in_review')", "verified": "status = 'verified'", "worst": "true"}
    q = quality.where(conditions[mode])
    return q.orderBy(F.coalesce("score", F.lit(0.0)), "page_id") if mode == "worst" else q
