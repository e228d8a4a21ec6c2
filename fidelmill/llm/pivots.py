"""Embedding near-duplicates by a pivot-permutation index.

Every vector is described by its ``NEAREST`` nearest reference points in order.
The inverted lists are keyed by two pivots, so the vectors of a list share at
least two; a pair that shares more is counted in one list only, that of the two
least pivots it shares. The way of a pair:

1. *Candidates* are the pairs of a list, found from ids, pivots and a one-byte
   code of each component. The code's rounding error is known for each vector, so
   a pair whose cosine cannot reach the threshold ends here, and no other does.
2. *Verification.* Only vectors with such candidates are sent, to the cells where
   they have one, and their cosines are taken in double precision.

Equal vectors are one class throughout, whatever their number. Lists of more than
``BLOCK`` classes are compared block against block, one task a pair of blocks.
What leaves a task is a link count for each of its vectors and a spanning forest
of its links, never the pairs; there is no cap on lists.

Pivots are data points drawn by hash from a bounded sample, about 4 * sqrt(rows)
(at most ``PIVOT_BYTES`` of them), none within the threshold of another; each
length of vectors has its own. Every vector is indexed. Pairs at a cosine of 0.95
in 64 dimensions share two pivots in more than 0.98 of cases (README has figures).

Defined results. Null or zero vectors and those with null or non-finite
components: no links, their own component. Vectors of different lengths do not
link. Repeated vec_id: each row counts for its own links, rows of an id are one
node. Null vec_id: links count, the component is null. Empty table: no rows.
Labels and extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fidelmill.llm.common import arrow_map, column, saved, shuffled_apart, small, tune
from fidelmill.llm.graph import components
from fidelmill.llm.ngram import forest

NEAREST = 6
#: Fewest pivots, and the most bytes of them (in 32-bit floats).
PIVOTS_MIN, PIVOT_BYTES = 64, 32 << 20
#: Classes of a block of a long list; lists up to SHORT are compared many at a time.
BLOCK, SHORT = 2048, 64
#: Rows of lists that a task holds before it compares them.
HELD = 1 << 15


def usable(embedding: str = "embedding"):
    """Vectors that can link: finite, not zero."""
    e = F.col(embedding)
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return e.isNotNull() & (F.size(e) > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists(e, lambda x: x != 0)


def unit(batch: pa.RecordBatch, name: str) -> np.ndarray:
    lists = column(batch, name)
    x = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def matrix(raw: list[bytes], dtype=np.float64) -> np.ndarray:
    return np.frombuffer(b"".join(raw), dtype).reshape(len(raw), -1)


def chosen(sample: np.ndarray, most: int, threshold: float) -> np.ndarray:
    """Up to ``most`` rows, none of which links with another, in order."""
    out = np.empty((min(most, len(sample)), sample.shape[1]))
    n = 0
    for at in range(0, len(sample), 256):
        part = sample[at : at + 256]
        free = (part @ out[:n].T).max(1) < threshold if n else np.ones(len(part), bool)
        first = n
        for v in part[free]:
            if n < len(out) and (n == first or (out[first:n] @ v).max() < threshold):
                out[n] = v
                n += 1
    return out[:n]


def pivots_of(good: DataFrame, threshold: float) -> dict[int, np.ndarray]:
    """The pivots of each length of vectors, from one bounded sample."""
    counts = {r["d"]: r["count"] for r in good.groupBy(F.size("embedding").alias("d")).count().collect()}  # one row a length
    want = {d: int(min(max(PIVOTS_MIN, PIVOT_BYTES // (4 * d)), max(PIVOTS_MIN, 4 * n**0.5))) for d, n in counts.items()}
    if not want:
        return {}
    rate = F.create_map(*(x for d, k in want.items() for x in (F.lit(d), F.lit(int(min(1.0, 3 * k / counts[d]) * (1 << 30))))))
    drawn = good.where(F.pmod(F.xxhash64("embedding", F.lit(7)), F.lit(1 << 30)) < rate[F.size("embedding")])
    got = drawn.groupBy("embedding").agg(F.min(F.xxhash64("embedding", F.lit(11))).alias("h")).orderBy("h").select("embedding").toArrow()  # about 3 * pivots rows
    by: dict[int, list[np.ndarray]] = {d: [] for d in want}
    for v in got["embedding"]:
        x = v.values.to_numpy(zero_copy_only=False).astype(float)
        by[len(x)].append(x / np.abs(x).max())
    return {d: chosen(x / np.linalg.norm(x, axis=1, keepdims=True), want[d], threshold) for d, xs in by.items() if xs and len(x := np.array(xs))}


def indexed(rows: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """row, vec_id, digest of the unit vector, near (numbers of the nearest pivots, ascending), code, scale, err, unit."""
    names, at = {}, 0
    for d in sorted(pivots):  # numbers of the lengths' pivots do not meet
        names[d] = at
        at += len(pivots[d])
    held = rows.sparkSession.sparkContext.broadcast({d: p.astype(np.float32) for d, p in pivots.items()})  # at most PIVOT_BYTES a length

    def nearest(x: np.ndarray, points: np.ndarray) -> np.ndarray:
        k = min(NEAREST, len(points))
        d = x.astype(np.float32) @ points.T
        return np.sort(np.argpartition(-d, k - 1, axis=1)[:, :k], axis=1).astype(np.int32)

    def make():
        def handle(batch):
            sizes = np.diff(column(batch, "embedding").offsets.to_numpy())
            for d in np.unique(sizes).tolist():
                part = batch.filter(pa.array(sizes == d))
                x = unit(part, "embedding")
                near = nearest(x, held.value[d]) + np.int32(names[d])
                scale = np.abs(x).max(1) / 127
                code = np.rint(x / scale[:, None]).astype(np.int8)
                err = np.sqrt(((x - code * scale[:, None]) ** 2).sum(1)) + 1e-9
                raw = [v.tobytes() for v in x]
                yield pa.RecordBatch.from_arrays(
                    [
                        column(part, "row"), column(part, "vec_id").cast(pa.int64()), pa.array([hashlib.blake2b(v, digest_size=16).digest() for v in raw], pa.binary()), pa.array(list(near), pa.list_(pa.int32())),
                        pa.array([c.tobytes() for c in code], pa.binary()), pa.array(scale), pa.array(err), pa.array(raw, pa.binary()),
                    ],
                    names=["row", "vec_id", "digest", "near", "code", "scale", "err", "unit"],
                )

        return handle

    return arrow_map(rows.select("row", "vec_id", "embedding"), make, "row long, vec_id long, digest binary, near array<int>, code binary, scale double, err double, unit binary")


def first_shared(x: np.ndarray, y: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Whether rows of pivots share none below the second pivot of their list but its first."""
    both = (x[:, :, None] == y[:, None, :]).any(2)
    return (both & (x < (key & 0xFFFFFFFF)[:, None])).sum(1) == (key >> 32 != key & 0xFFFFFFFF)


class Cells:
    """Rows of some whole cells (key, i, j), sorted; ``near`` tells each pair's own list."""

    def __init__(self, columns: dict[str, np.ndarray], near: np.ndarray):
        self.near = near
        self.key, self.i, self.j, self.own = (columns[c] for c in ("key", "i", "j", "own"))
        change = (np.diff(self.key) != 0) | (np.diff(self.i) != 0) | (np.diff(self.j) != 0)
        self.start = np.flatnonzero(np.concatenate([[True], change]))
        self.size = np.diff(np.append(self.start, len(self.key)))

    def pairs(self, alike: Callable[[np.ndarray, np.ndarray], np.ndarray], table: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places (x, y) of the pairs that are alike, each in its own list: short cells many at a time, long ones by a matrix."""
        end = np.repeat(self.start + self.size, self.size)
        pos = np.flatnonzero(np.repeat(self.size <= SHORT, self.size))
        step = 1
        while len(pos):  # partners at distance 1, 2, ... within the cell
            pos = pos[pos + step < end[pos]]
            for at in range(0, len(pos), 1 << 16):
                yield self.kept(pos[at : at + (1 << 16)], pos[at : at + (1 << 16)] + step, alike)
            step += 1
        for s, n in zip(self.start.tolist(), self.size.tolist()):
            if n <= SHORT:
                continue
            rows = np.arange(s, s + n)
            if self.i[s] == self.j[s]:
                a = b = rows
            else:
                a, b = rows[self.own[rows] == self.i[s]], rows[self.own[rows] == self.j[s]]
            for at in range(0, len(a), 256):
                x, y = np.nonzero(table(a[at : at + 256], b))
                x, y = a[at : at + 256][x], b[y]
                if a is b:
                    x, y = x[x < y], y[x < y]
                for c in range(0, len(x), 1 << 16):
                    yield self.kept(x[c : c + (1 << 16)], y[c : c + (1 << 16)], None)

    def kept(self, x: np.ndarray, y: np.ndarray, alike) -> tuple[np.ndarray, np.ndarray]:
        own = (self.i[x] == self.j[x]) | (self.own[x] != self.own[y])
        x, y = x[own], y[own]
        if alike is not None:
            ok = alike(x, y)
            x, y = x[ok], y[ok]
        ok = first_shared(self.near[x], self.near[y], self.key[x])
        return x[ok], y[ok]


CELL = ("key", "i", "j", "own", "cls")


def by_cells(cells: DataFrame, handle: Callable, schema: str) -> DataFrame:
    """``handle(columns, batch)`` of runs of whole cells, about HELD rows at a time."""

    def run(batches):
        held, n = [], 0

        def send(parts, whole: bool):
            table = pa.Table.from_batches(parts).combine_chunks()
            key, i, j = (table[c].to_numpy() for c in ("key", "i", "j"))
            cut = len(key)
            if not whole:  # the last cell may go on
                last = (key == key[-1]) & (i == i[-1]) & (j == j[-1])
                cut = len(key) - int(last.sum())
            if cut:
                part = table.slice(0, cut).combine_chunks()
                yield from handle({c: part[c].to_numpy() for c in CELL}, part)
            rest = table.slice(cut)
            held[:] = rest.to_batches()

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
                if n >= HELD:
                    yield from send(list(held), False)
                    n = sum(b.num_rows for b in held)
        if held:
            yield from send(list(held), True)

    parts = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cells.repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j", "cls").mapInArrow(run, schema)


def groups_of_width(part: pa.Table, name: str, dtype) -> list[tuple[np.ndarray, np.ndarray]]:
    """Places and matrix of the rows of each width: vectors of one cell have one width, a run of cells may have several."""
    raw = part[name].to_pylist()
    sizes = np.array([len(r) for r in raw])
    return [(at, matrix([raw[i] for i in at], dtype)) for at in (np.flatnonzero(sizes == n) for n in np.unique(sizes))]


def padded(part: pa.Table, name: str, dtype) -> np.ndarray:
    """All rows as one matrix; shorter ones end in zeros, which add nothing to a product."""
    found = groups_of_width(part, name, dtype)
    if len(found) == 1:
        return found[0][1]
    out = np.zeros((part.num_rows, max(m.shape[1] for _, m in found)), dtype)
    for at, m in found:
        out[at, : m.shape[1]] = m
    return out


def pivots_in(part: pa.Table) -> np.ndarray:
    lists = part["near"].combine_chunks() if isinstance(part["near"], pa.ChunkedArray) else part["near"]
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.full((len(lists), max(1, sizes.max(initial=1))), np.iinfo(np.int32).max, np.int32)
    out[np.arange(out.shape[1]) < sizes[:, None]] = lists.flatten().to_numpy()
    return out


def candidates(cells: DataFrame, threshold: float) -> DataFrame:
    """key, i, j, own, cls of the classes that have, in that cell, a partner whose cosine may reach the threshold."""

    def handle(columns, part):
        code = padded(part, "code", np.int8).astype(np.float32)
        scale, err = part["scale"].to_numpy(), part["err"].to_numpy()

        def alike(x, y):
            bound = threshold - (err[x] + err[y] + err[x] * err[y]) - 1e-6
            return np.einsum("ij,ij->i", code[x], code[y]) * (scale[x] * scale[y]) >= bound

        def table(a, b):
            bound = threshold - (err[a][:, None] + err[b] + err[a][:, None] * err[b]) - 1e-6
            return (code[a] @ code[b].T) * (scale[a][:, None] * scale[b]) >= bound

        hit = np.zeros(len(code), bool)
        for x, y in Cells(columns, pivots_in(part)).pairs(alike, table):
            hit[x] = hit[y] = True
        at = np.flatnonzero(hit)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(columns[c][at]) for c in CELL], names=list(CELL))

    return by_cells(cells, handle, "key long, i int, j int, own int, cls long")


FOUND = pa.schema([("cls", pa.int64()), ("links", pa.int64()), ("u", pa.int64()), ("v", pa.int64())])


def verified(cells: DataFrame, threshold: float) -> DataFrame:
    """cls, links: vectors linked with each vector of the class; and u, v: classes that join up all links."""

    def handle(columns, part):
        unit_, n = padded(part, "unit", np.float64), part["n"].to_numpy()
        cells_ = Cells(columns, pivots_in(part))
        links = np.zeros(len(n), np.int64)
        xs, ys = [], []

        def shrink():
            x, y = np.concatenate(xs), np.concatenate(ys)
            label = np.arange(len(n))
            while True:
                new = label.copy()
                np.minimum.at(new, x, label[y])
                np.minimum.at(new, y, label[x])
                new = new[new]
                if (new == label).all():
                    break
                label = new
            at = np.flatnonzero(label != np.arange(len(n)))
            xs[:], ys[:] = [at], [label[at]]

        alike = lambda x, y: np.einsum("ij,ij->i", unit_[x], unit_[y]) >= threshold
        table = lambda a, b: unit_[a] @ unit_[b].T >= threshold
        waiting = 0
        for x, y in cells_.pairs(alike, table):
            np.add.at(links, x, n[y])
            np.add.at(links, y, n[x])
            xs.append(x)
            ys.append(y)
            waiting += len(x)
            if waiting > 1 << 20:
                shrink()
                waiting = 0
        at = np.flatnonzero(links)
        if len(at):
            shrink()
            cls = columns["cls"]
            none = lambda k: pa.nulls(k, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(cls[at]), pa.array(links[at]), none(len(at)), none(len(at))], schema=FOUND)
            yield pa.RecordBatch.from_arrays([none(len(xs[0])), none(len(xs[0])), pa.array(cls[xs[0]]), pa.array(cls[ys[0]])], schema=FOUND)

    return by_cells(cells, handle, "cls long, links long, u long, v long")


def near_duplicates(vectors: DataFrame, threshold: float = 0.95) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``vectors`` (vec_id, embedding)."""
    spark = vectors.sparkSession
    tune(spark)
    rows = saved(vectors.select("vec_id", "embedding").withColumn("row", F.monotonically_increasing_id()), "vectors")
    own = rows.select("row", "vec_id")
    pivots = pivots_of(rows.where(usable()), threshold)
    if not pivots:
        return own.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    index = saved(indexed(rows.where(usable()), pivots), "index")
    classes = saved(index.groupBy("digest").agg(F.min("row").alias("cls"), F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n")), "classes")
    one = index.join(classes.select("cls", "n"), F.col("row") == F.col("cls"))

    near = F.col("near")  # every two pivots of a vector; a single one stands for both
    two = F.flatten(F.transform(near, lambda p, i: F.transform(F.slice(near, i + 2, F.size(near)), lambda q: F.shiftleft(p.cast("long"), 32) + q)))
    keys = F.when(F.size(near) > 1, two).otherwise(F.transform(near, lambda p: F.shiftleft(p.cast("long"), 32) + p))
    lists = one.select("cls", F.explode(keys).alias("key"), "near", "code", "scale", "err")
    sizes = saved(lists.groupBy("key").count().where("count > 1").select("key", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")), "lists")
    long = small(sizes.where("blocks > 1"))
    cells = lists.join(long, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = cells.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "cls", "near", "code", "scale", "err")
    flagged = saved(candidates(cells, threshold), "candidates")
    sent = flagged.join(one.select("cls", "n", "near", "unit"), "cls").select(*CELL, "n", "near", "unit")
    found = saved(verified(sent, threshold), "found")

    links = found.where("cls is not null").groupBy("cls").agg(F.sum("links").alias("links"))
    full = saved(classes.join(links, "cls", "left").select("digest", "cls", "least", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")), "class-links")
    of = full.select("cls", "least")
    edges = found.where("u is not null").select("u", "v").join(of.withColumnsRenamed({"cls": "u", "least": "a"}), "u").join(of.withColumnsRenamed({"cls": "v", "least": "b"}), "v").select("a", "b")
    members = saved(shuffled_apart(index.select("row", "vec_id", "digest"), full, "digest", "n").select("row", "vec_id", "least", "n_links"), "members")
    comp = components(edges.union(members.where("vec_id <> least").select("vec_id", "least")), "a", "b")
    out = own.join(members.select("row", "n_links"), "row", "left").join(comp, own["vec_id"] == comp["node"], "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"), F.coalesce("component", "vec_id").eqNullSafe(F.col("vec_id")).alias("kept"))
