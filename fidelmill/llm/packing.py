"""Mixture-controlled packing: deficit round-robin over source queues, without a sequential loop.

Every source is a queue of token ids, documents in stored order. A window takes
from each queue its share; what a queue is owed or has had too much of carries
over to the next window. Served one token at a time to the queue that is owed
most, that schedule has a closed form: token ``t`` of a queue with weight ``w``
is due at virtual time ``(t + 0.5) / w``, and all tokens are served in order of
due time, ties by queue. Window ``k`` holds the tokens served from ``k * size``
on, and a queue's carried deficit at any window is its due count minus its
served count there. So each partition computes the counters of its own windows
exactly, without any partition before it.

The default weights are the queues' token totals: then no queue runs dry before
another and every window mirrors the corpus. With other weights a queue that has
run dry leaves its share to the rest.

Defined results. Null text: the empty text, one piece with the end id. Null
source: a queue of its own. Null or repeated doc_id: each row is packed by
itself. Empty table: no rows. Extra columns are ignored. Every source has its
own queue, however many there are: windows are laid out some ``CELLS`` counters
at a time, so memory does not grow with the sources, but the work of a batch is
its windows times the sources. A batch lays out only the windows its documents
reach, with any weights.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fidelmill.llm.common import BROADCAST_ROWS, arrow_map, column, saved, texts, tune
from fidelmill.llm.tokens import encoder

#: Counters laid out at once; a window costs one for each queue.
CELLS = 1 << 20
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, queue int"


def served(upto: np.ndarray, weights: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Tokens each queue has been served when ``upto[i]`` tokens are served in all: one row per entry, one column per queue."""
    w, n = weights.astype(np.float64), totals.astype(np.int64)

    def due(at: np.ndarray) -> np.ndarray:
        return np.clip(np.ceil(at[:, None] * w - 0.5), 0, n).astype(np.int64)

    lo = np.zeros(len(upto))
    hi = np.full(len(upto), (n / w).max() + 1.0)
    if np.array_equal(w, n):  # then the due count is near the virtual time
        near = upto / w.sum()
        lo, hi = np.maximum(near - (len(w) + 2) / w.sum(), 0), near + (len(w) + 2) / w.sum()
    met = np.zeros(len(upto), bool)
    for _ in range(80):
        mid = (lo + hi) / 2
        n_due = due(mid).sum(1)
        early = n_due <= upto
        if (met | (mid == lo) | (mid == hi)).all():
            break
        met |= n_due == upto  # from then on ``lo`` stands at that very count
        lo, hi = np.where(early, mid, lo), np.where(early, hi, mid)
    took, more = due(lo), due(hi)
    rest = upto - took.sum(1)  # due at the very same time: by queue
    step = more - took
    before = np.cumsum(step, 1) - step
    return took + np.clip(rest[:, None] - before, 0, step)


def pack_rows(queue: np.ndarray, start: np.ndarray, n: np.ndarray, weights: np.ndarray, totals: np.ndarray, size: int):
    """Pieces of documents that lie at ``start`` in their queue and have ``n`` tokens: row, first token, length, window, offset."""
    whole = int(totals.sum())
    last = (whole + size - 1) // size
    rate = weights / weights.sum() * size
    if np.array_equal(weights, totals):
        slack = (len(weights) + 2) * weights[queue] / weights.sum() + 2  # virtual time is that near the due count
        first_k = np.maximum((start - slack) / rate[queue] - 1, 0).astype(np.int64)
        last_k = np.minimum((start + n + slack) / rate[queue] + 2, last).astype(np.int64)
    else:
        w, some = weights.astype(np.float64), max(1, CELLS // len(weights))

        def place(token: np.ndarray) -> np.ndarray:
            """Tokens due when this one is: its place in the one order, but for those due at the same time."""
            at = (token + 0.5) / w[queue]
            return np.concatenate([np.clip(np.ceil(at[i : i + some, None] * w - 0.5), 0, totals).sum(1) for i in range(0, len(at), some)] or [np.zeros(0)])

        slack = len(w) + 2
        first_k = np.clip((place(start) - slack) // size - 1, 0, last).astype(np.int64)
        last_k = np.clip((place(start + n) + slack) // size + 2, 0, last).astype(np.int64)
    spans = np.zeros(last + 2, np.int32) if last < 1 << 22 else None
    if spans is not None:
        np.add.at(spans, first_k, 1)
        np.add.at(spans, last_k + 1, -1)
        ks = np.flatnonzero(np.cumsum(spans)[: last + 1])
    else:
        ks = np.unique(np.concatenate([np.arange(a, b + 1) for a, b in zip(first_k, last_k)]))
    ks = np.union1d(ks, np.minimum(ks + 1, last))
    rows, starts, lengths, windows, offsets = [], [], [], [], []
    step = max(1, CELLS // len(weights))
    for c in range(0, max(len(ks) - 1, 1), step):
        part = ks[c : c + step + 1]  # with the bound where the next part begins
        counts = served(np.minimum(part * size, whole), weights, totals)
        ahead = np.cumsum(np.diff(counts, axis=0), 1) - np.diff(counts, axis=0)
        a, b = np.maximum(start, counts[0, queue]), np.minimum(start + n, counts[-1, queue])
        own = np.flatnonzero(a < b)
        a, b = a[own], b[own]
        used, q = np.unique(queue[own], return_inverse=True)
        far = whole + 1  # keeps the queues' bounds apart in one sorted row
        cuts = (counts[:, used].T + np.arange(len(used))[:, None] * far).ravel()
        i = np.searchsorted(cuts, a + q * far, "right") - 1 - q * len(part)  # the window that has the first token
        many = np.searchsorted(cuts, b + q * far, "left") - q * len(part) - i  # up to the first bound at or after the end
        row = np.repeat(np.arange(len(own)), many)
        k = np.repeat(i, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        of = queue[own][row]
        begin, end = np.maximum(counts[k, of], a[row]), np.minimum(counts[k + 1, of], b[row])
        full = end > begin
        row, k, of, begin, end = row[full], k[full], of[full], begin[full], end[full]
        rows.append(own[row])
        starts.append(begin - start[own[row]])
        lengths.append(end - begin)
        windows.append(part[k])
        offsets.append(ahead[k, of] + begin - counts[k, of])
    join = lambda xs: np.concatenate(xs) if xs else np.zeros(0, np.int64)
    out = [join(x) for x in (rows, starts, lengths, windows, offsets)]
    order = np.lexsort((out[1], out[0]))
    return [x[order] for x in out]


def tokenized(docs: DataFrame, path: str, chunks: str, end_id: int, queues: dict) -> DataFrame:
    """doc_id, queue, part, at (tokens of the queue before it within its part), n, ids (compressed): written to shared storage."""

    def make():
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        had: dict[int, int] = {}
        squeeze = zstandard.ZstdCompressor(level=1).compress

        def handle(batch):
            ids = [np.append(x, np.uint32(end_id)) for x in encoder(path, chunks).encode(texts(batch))]
            sources = column(batch, "source").to_pylist()
            queue = [queues[s] for s in sources]
            at = []
            for q, x in zip(queue, ids):
                at.append(had.get(q, 0))
                had[q] = at[-1] + len(x)
            size = len(ids)
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id").cast(pa.int64()), pa.array(queue, pa.int32()), pa.array([part] * size, pa.int32()), pa.array(at, pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array(map(squeeze, map(narrow, ids)), pa.binary())],
                names=["doc_id", "queue", "part", "at", "n", "ids"],
            )

        return handle

    return saved(arrow_map(docs.select("doc_id", "source", "text"), make, "doc_id long, queue int, part int, at long, n long, ids binary"), "pack-tokens")


def narrow(ids: np.ndarray) -> bytes:
    """32-bit ids as bytes behind a flag, in 16 bits each where all fit."""
    return b"\x02" + ids.astype("<u2").tobytes() if not len(ids) or ids.max() < 65536 else b"\x04" + ids.astype("<u4").tobytes()


def widen(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype("<u4")


def pack(docs: DataFrame, *, path: str, chunks: str = "word", end_id: int = 2, size: int = 4096, weights: dict[str | None, float] | None = None) -> DataFrame:
    """Packs every row of ``docs`` (doc_id, source, text) into sequences of ``size`` tokens; one row per piece.

    ``weights`` gives each source its share of a window (default: its tokens).
    The tokenized rows are written to shared storage once; the counters that
    follow are one row per part and queue, and a lost task reads its part again.
    """
    spark = docs.sparkSession
    tune(spark)
    names = sorted((r[0] for r in docs.select("source").distinct().collect()), key=lambda s: (s is None, s or ""))
    queues = {s: i for i, s in enumerate(names)}
    held = tokenized(docs, path, chunks, end_id, queues)
    parts = held.groupBy("part", "queue").agg(F.sum("n").alias("n"))
    base = parts.withColumn("base", F.sum("n").over(Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    base = base.select("part", "queue", F.coalesce("base", F.lit(0)).alias("base"))
    totals = np.zeros(len(queues), np.int64)
    for q, n in parts.groupBy("queue").agg(F.sum("n")).collect():  # one row per queue
        totals[q] = n
    share = totals.copy()
    if weights is not None:
        share = np.asarray([weights.get(s, 0) for s in queues], float)
        share = np.where(share > 0, share, share[share > 0].min() * 1e-6 if (share > 0).any() else 1.0)
    live = np.flatnonzero(totals)
    place = np.zeros(len(totals), np.int64)
    place[live] = np.arange(len(live))
    share, totals = share[live], totals[live]
    # one row per part and queue: broadcast below a checked size, else joined by shuffle
    base = F.broadcast(base) if base.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else base

    def make():
        grow = zstandard.ZstdDecompressor().decompress

        def handle(batch):
            if not batch.num_rows:
                return
            get = lambda c: column(batch, c).to_numpy()
            n = get("n")
            row, start, length, window, offset = pack_rows(place[get("queue")], get("base") + get("at"), n, share, totals, size)
            ids = [widen(grow(x)) for x in column(batch, "ids").to_pylist()]
            crc = [zlib.crc32(ids[r][s : s + m].data) for r, s, m in zip(row.tolist(), start.tolist(), length.tolist())]
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id").take(take), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), column(batch, "n").take(take), pa.array(window), pa.array(offset), column(batch, "queue").take(take)],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "queue"],
            )

        return handle

    return arrow_map(held.join(base, ["part", "queue"]), make, PIECES)
