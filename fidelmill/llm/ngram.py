"""Exact Jaccard self-join on word shingles by prefix filters under several global token orders.

A document's set is its distinct five-word shingles. Two sets with Jaccard
similarity of at least t share a token among their first
``n - ceil(t n) + 1`` under any order of all tokens; among ``k`` more on either
side they share ``k + 1``. The plan:

1. *Frequencies.* Every task sends its shingles as sorted, delta-coded 40-bit
   ranges (about 2.5 bytes each) to the owner of the range, which counts them
   over all documents. Beyond 2^``COARSE`` ranges a token is dealt twice, by its
   leading bits and then by the rest, so that a parcel keeps some hundred tokens
   at any size. Tokens of ``HEAVY`` documents or more are heavy and come last in
   the first order; at most ``MAX_HEAVY`` of them, the commonest, are known to
   every task.
2. *First order.* Light prefix tokens go, packed, to posting lists, which give
   pairs with shared counts; pairs whose counts cannot reach the threshold end
   there. A list of more than ``HEAVY`` texts gives no pairs: it is a heavy list.
3. *Further orders.* Of every pair only the prefixes under ``ORDERS`` are brought
   together; a pair that shares no token under one of them ends there, before any
   whole set is moved.
4. *Verification.* The whole sets of the remaining pairs are intersected.
5. *Heavy lists.* Every document of a list is paired with the list's least
   document first; lists that are one component after that are done, the others
   are compared in blocks: the prefixes under the further orders first, whole sets
   of the pairs that are left. A block gives a spanning forest and not its pairs.
6. *Components* of verified links and of equal texts.

Exact copies count as one set throughout: a task drops those it sees twice, a
list keeps one of each text. No pair or list of all documents reaches the driver,
and no token, text, list or family of copies is one task's.

Defined results. Null or empty text, or only spaces: no shingles, linked with
nothing. Fewer than five words: the whole sequence is the one shingle. Null
doc_id: not linked, component null. Repeated doc_id: one node of the graph.
Empty table: no rows. Extra columns are ignored. Long texts are taken whole.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fidelmill.llm.common import arrow_map, column, drop_dir, new_dir, saved, shuffled_apart, small, texts, tune
from fidelmill.llm.graph import components
from fidelmill.llm.wordtable import BASE, INVERSE, RUN_BYTES, U, mixed, powers

WORDS = 5
#: Documents from which a token is heavy, and the most heavy tokens that every task knows.
HEAVY, MAX_HEAVY = 32, 1_000_000
#: Bytes of text a range of the frequency count holds, tokens a task gathers before it sends, and bits of a range that are dealt at once.
RANGE_BYTES, FLUSH, COARSE = 16 << 20, 1_000_000, 11
#: Rows of a block of a heavy list.
BLOCK = 512
#: Multipliers of the further orders.
ORDERS = (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)

_SPACES = re.compile(rb"[\x20\t-\r]+")


def normalized(text: str) -> bytes:
    raw = text.encode("utf-8", "replace").lower()
    return _SPACES.sub(b" ", raw).strip(b" ") if len(raw) > RUN_BYTES else b" ".join(raw.split())


def shingle_sets(norms: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of normalized texts."""
    out: list[np.ndarray] = []
    at = 0
    while at < len(norms):
        some, size = [], 0
        while at < len(norms) and (not some or size + len(norms[at]) < 1 << 20):
            some.append(norms[at])
            size += len(norms[at]) + 1
            at += 1
        out += _sets(some)
    return out


def word_hashes(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word of a buffer whose words each end in a space or line end, and whether it ends a text."""
    up, down = powers(len(buf) + 1)
    total = np.zeros(len(buf) + 1, U)
    np.cumsum((buf.astype(U) + U(1)) * up[: len(buf)], out=total[1:])
    ends = np.flatnonzero((buf == 32) | (buf == 10))
    starts = np.concatenate([[0], ends[:-1] + 1])
    return mixed((total[ends] - total[starts]) * down[starts]), buf[ends] == 10


def _sets(norms: list[bytes]) -> list[np.ndarray]:
    whole = b"\n".join(norms) + b"\n"
    got, at = [], 0
    while at < len(whole):  # a long text piece by piece, each ending with a word
        end = len(whole)
        if end - at > 2 * RUN_BYTES:
            end = 1 + min(x for x in (whole.find(b" ", at + RUN_BYTES), whole.find(b"\n", at + RUN_BYTES)) if x >= 0)
        got.append(word_hashes(np.frombuffer(whole, np.uint8, end - at, at)))
        at = end
    word, final = (np.concatenate(x) for x in zip(*got))
    last = np.flatnonzero(final)  # each document's last word
    first = np.concatenate([[0], last[:-1] + 1])
    h = np.zeros(max(0, len(word) - WORDS + 1), U)
    for j in range(WORDS):
        h = mixed(h * BASE + word[j : len(word) - WORDS + 1 + j]) if len(h) else h
    out = []
    for norm, a, b in zip(norms, first.tolist(), last.tolist()):
        n = b - a + 1
        if not norm:
            out.append(np.zeros(0, U))
        elif n >= WORDS:
            out.append(np.unique(h[a : b - WORDS + 2]))
        else:
            x = np.full(1, n, U)
            for w in word[a : b + 1]:
                x = mixed(x * INVERSE + w)
            out.append(x)
    return out


def prefix_length(n, percent: int):
    return n - (n * percent + 99) // 100 + 1


def extension(n, percent: int):
    """Tokens that the index takes beyond the prefix."""
    p = prefix_length(n, percent)
    return np.minimum(p // 2, n - p)


_squeeze = zstandard.ZstdCompressor(level=1)


def pack_sorted(x: np.ndarray) -> bytes:
    """Sorted unsigned integers as deltas, byte plane by byte plane, compressed."""
    d = np.diff(x, prepend=x[:1] * 0).astype("<u8")
    return _squeeze.compress(np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack_sorted(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    return np.cumsum(np.ascontiguousarray(planes.reshape(8, -1).T).view("<u8").ravel(), dtype=U)


def pack_any(x: np.ndarray) -> bytes:
    n = x.dtype.itemsize
    return _squeeze.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, n).T).tobytes())


def unpack_any(raw: bytes, dtype: str) -> np.ndarray:
    n = np.dtype(dtype).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    return np.ascontiguousarray(planes.reshape(n, -1).T).view(dtype).ravel()


def digest(norm: bytes) -> bytes:
    return hashlib.blake2b(norm, digest_size=16).digest()


def batch_of(schema: pa.Schema, **columns) -> pa.RecordBatch:
    """A batch with the given columns, the schema's others null."""
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)


FIRST = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary()), ("n", pa.int64()), ("r", pa.int32()), ("blob", pa.binary())])
SECOND = pa.schema([("r", pa.int32()), ("tok", pa.binary()), ("at", pa.binary()), ("docs", pa.binary()), ("heavy", pa.int64()), ("doc_id", pa.int64()), ("h", pa.int64()), ("n", pa.int64())])
DOC = np.dtype([("id", "<i8"), ("h", "<i8"), ("n", "<i4"), ("hv", "<i4")])


def sized(docs: DataFrame) -> int:
    """Bits of the range number: ranges of about RANGE_BYTES of text."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(3, (total // RANGE_BYTES).bit_length())


def first_pass(docs: DataFrame, bits: int) -> DataFrame:
    """A row for each document (doc_id, digest, n), and the packed tokens of each range."""

    def run(batches):
        held: list[np.ndarray] = []
        count = 0

        def send():
            x = np.sort(np.concatenate(held)) >> U(24)
            cuts = np.searchsorted(x, np.arange(1 << bits).astype(U) << U(40 - bits))
            for r, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(x)])):
                if b > a:
                    yield batch_of(FIRST, r=[r], blob=[pack_sorted(x[a:b])])

        for batch in batches:
            norms = [normalized(t) for t in texts(batch)]
            sets = shingle_sets(norms)
            yield batch_of(FIRST, doc_id=column(batch, "doc_id").to_pylist(), digest=[digest(x) for x in norms], n=[len(s) for s in sets])
            held += sets
            count += sum(map(len, sets))
            if count >= FLUSH:
                yield from send()
                held, count = [], 0
        if count:
            yield from send()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, digest binary, n long, r int, blob binary")


def _cuts(x: np.ndarray, low: int, high: int, bits: int, width: int):
    """(range, from, to) of the ranges ``low`` to ``high`` of ``bits`` bits that sorted tokens of ``width`` bits fall in."""
    cuts = np.searchsorted(x, np.arange(low, high).astype(U) << U(width - bits))
    return [(r, a, b) for r, a, b in zip(range(low, high), cuts.tolist(), [*cuts[1:].tolist(), len(x)]) if b > a]


def dealt_again(packed: DataFrame, bits: int, merge, cut, schema: str) -> DataFrame:
    """Parcels of coarse ranges, merged by task and cut into their fine ranges; as they are where there are no finer ones.

    ``merge(rows)`` gives the sorted tokens of some parcels with what belongs to
    them, ``cut(r, merged, a, b)`` a parcel of a part of them. A coarse range is
    dealt to as many tasks as it has fine ones.
    """
    fine = bits - COARSE
    if fine <= 0:
        return packed
    names = [c for c in packed.columns if c != "salt"]

    def run(batches):
        held, r, n = [], None, 0

        def send():
            merged = merge(held)
            for k, a, b in _cuts(merged[0], r << fine, (r + 1) << fine, bits, merged[-1]):
                yield cut(k, merged, a, b)

        for batch in batches:
            for row in zip(*(column(batch, c).to_pylist() for c in names)):
                if held and (row[0] != r or n >= FLUSH * 32):
                    yield from send()
                    held, n = [], 0
                r = row[0]
                held.append(row[1:])
                n += sum(len(x) for x in row[1:])
        if held:
            yield from send()

    salted = packed.withColumn("salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << fine)))
    parts = max(int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 << min(bits, 17))
    return salted.repartition(parts, "r", "salt").sortWithinPartitions("r").select(*names).mapInArrow(run, schema)


def merged_tokens(rows: list[tuple]) -> tuple[np.ndarray, int]:
    return np.sort(np.concatenate([unpack_sorted(raw) for (raw,) in rows])), 40


def merged_postings(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, int]:
    tok = np.concatenate([unpack_sorted(t) for t, _, _ in rows])
    doc = np.concatenate([unpack_any(d, DOC)[unpack_any(x, "<u4")] for _, x, d in rows])
    order = np.argsort(tok, kind="stable")
    return tok[order], doc[order], 48


def cut_tokens(r: int, merged: tuple, a: int, b: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([pack_sorted(merged[0][a:b])], pa.binary())], names=["r", "blob"])


def cut_postings(r: int, merged: tuple, a: int, b: int) -> pa.RecordBatch:
    own, at = np.unique(merged[1][a:b], return_inverse=True)
    cells = (pack_sorted(merged[0][a:b]), pack_any(at.astype("<u4")), pack_any(own))
    return pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), *(pa.array([x], pa.binary()) for x in cells)], names=["r", "tok", "at", "docs"])


def heavy_tokens(blobs: DataFrame, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The leading 40 bits of the known heavy tokens in order, and their frequency classes."""

    def count(batches):
        held, r = [], None
        schema = pa.schema([("tok", pa.int64()), ("df", pa.int64())])

        def send():
            x, n = np.unique(np.concatenate(held), return_counts=True)
            x, n = x[n >= HEAVY], n[n >= HEAVY]
            return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)), pa.array(n.astype(np.int64))], schema=schema)

        for batch in batches:
            for k, raw in zip(column(batch, "r").to_pylist(), column(batch, "blob")):
                if k != r and held:
                    yield send()
                    held = []
                r = k
                held.append(unpack_sorted(raw.as_buffer()))
        if held:
            yield send()

    blobs = dealt_again(blobs, bits, merged_tokens, cut_tokens, "r int, blob binary")
    found = saved(blobs.repartition(1 << bits, "r").sortWithinPartitions("r").mapInArrow(count, "tok long, df long"), "heavy")
    classes = dict(found.groupBy(F.floor(F.log2("df")).cast("int").alias("c")).count().collect())
    least = HEAVY.bit_length() - 1
    while sum(n for c, n in classes.items() if c >= least) > MAX_HEAVY:
        least += 1
    top = found.where(F.col("df") >= 1 << least).toPandas().sort_values("tok")  # at most MAX_HEAVY rows
    return top["tok"].to_numpy().astype(U), np.log2(top["df"].to_numpy(float)).astype(np.int8)


def second_pass(docs: DataFrame, bits: int, heavy, percent: int) -> DataFrame:
    """Packed light prefix tokens by range, and a row for each heavy token that a document is indexed by."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((heavy[0], heavy[1]))  # at most MAX_HEAVY entries of 9 bytes

    def run(batches):
        names, classes = shared.value
        seen: set[bytes] = set()
        toks: list[np.ndarray] = []
        rows: list[tuple] = []
        count = 0

        def send():
            table = np.array(rows, DOC)
            tok, doc = np.concatenate(toks), np.repeat(np.arange(len(toks)), [len(t) for t in toks])
            order = np.argsort(tok, kind="stable")
            tok, doc = tok[order], doc[order]
            cuts = np.searchsorted(tok, np.arange(1 << bits).astype(U) << U(64 - bits))
            for r, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(tok)])):
                if b > a:
                    own, at = np.unique(doc[a:b], return_inverse=True)
                    yield batch_of(SECOND, r=[r], tok=[pack_sorted(tok[a:b] >> U(16))], at=[pack_any(at.astype("<u4"))], docs=[pack_any(table[own])])

        for batch in batches:
            norms, ids = [], []
            for t, d in zip(texts(batch), column(batch, "doc_id").to_pylist()):
                norm = normalized(t)
                if norm and d is not None and (g := digest(norm)[:8]) not in seen:
                    if len(seen) < 1_000_000:
                        seen.add(g)
                    norms.append(norm)
                    ids.append((d, int.from_bytes(g, "little", signed=True)))
            hs, hd, hh, hn = [], [], [], []
            for (d, g), s in zip(ids, shingle_sets(norms)):
                n = len(s)
                p, k = int(prefix_length(n, percent)), int(extension(n, percent))
                head = s >> U(24)
                at = np.minimum(np.searchsorted(names, head), max(0, len(names) - 1))
                is_heavy = names[at] == head if len(names) else np.zeros(n, bool)
                light = s[~is_heavy][: p + k]
                hv = 0
                if len(light) < p + k:
                    h = s[is_heavy][np.lexsort((s[is_heavy], classes[at[is_heavy]]))][: p + k - len(light)]
                    hv = len(h)
                    spare = int(extension((n * percent + 99) // 100, percent))
                    if hv > spare:
                        hs += h[: hv - spare].view(np.int64).tolist()
                        hd += [d] * (hv - spare)
                        hh += [g] * (hv - spare)
                        hn += [n] * (hv - spare)
                rows.append((d, g, n, hv))
                toks.append(light)
                count += len(light)
            if hs:
                yield batch_of(SECOND, heavy=hs, doc_id=hd, h=hh, n=hn)
            if count >= FLUSH:
                yield from send()
                toks, rows, count = [], [], 0
        if count:
            yield from send()

    return docs.select("doc_id", "text").mapInArrow(run, "r int, tok binary, at binary, docs binary, heavy long, doc_id long, h long, n long")


def light_pairs(packed: DataFrame, bits: int, percent: int) -> DataFrame:
    """Pairs (a, b) with counts (least, shared) of posting lists; lists of more than HEAVY texts as rows (heavy, doc_id, h, n) instead."""
    schema = pa.schema([(c, pa.int64()) for c in ("a", "b", "least", "shared", "heavy", "doc_id", "h", "n")])

    def run(batches):
        held, r = [], None

        def pairs():
            tok = np.concatenate([t for t, _ in held])
            doc = np.concatenate([d for _, d in held])
            order = np.lexsort((doc["id"], doc["h"], tok))
            tok, doc = tok[order], doc[order]
            new = np.ones(len(tok), bool)  # one of each text in a list
            new[1:] = (tok[1:] != tok[:-1]) | (doc["h"][1:] != doc["h"][:-1])
            tok, doc = tok[new], doc[new]
            change = np.flatnonzero(np.concatenate([[True], tok[1:] != tok[:-1]]))
            length = np.diff(np.append(change, len(tok)))
            long = np.flatnonzero(np.repeat(length > HEAVY, length))
            for i in range(0, len(long), 65_536):
                part = long[i : i + 65_536]
                yield batch_of(schema, heavy=tok[part].astype(np.int64), doc_id=doc["id"][part], h=doc["h"][part], n=doc["n"][part].astype(np.int64))
            keep = np.repeat((length > 1) & (length <= HEAVY), length)
            doc, length = doc[keep], length[(length > 1) & (length <= HEAVY)]
            end = np.repeat(np.cumsum(length), length)
            pos = np.arange(len(doc))
            a_all, b_all, c_all, d_all = [], [], [], []
            step = 1
            while len(pos):  # partners at distance 1, 2, ... within the list
                pos = pos[pos + step < end[pos]]
                x, y = doc[pos], doc[pos + step]
                lo, hi = np.minimum(x["n"], y["n"]).astype(np.int64), np.maximum(x["n"], y["n"]).astype(np.int64)
                ok = lo * 100 >= hi * percent
                x, y, lo = x[ok], y[ok], lo[ok]
                a_all.append(np.minimum(x["id"], y["id"]))
                b_all.append(np.maximum(x["id"], y["id"]))
                c_all.append(1 + np.minimum(extension(x["n"], percent), extension(y["n"], percent)) - np.minimum(x["hv"], y["hv"]))
                step += 1
            if not a_all:
                return
            a, b, c = np.concatenate(a_all), np.concatenate(b_all), np.concatenate(c_all)
            order = np.lexsort((b, a))
            a, b, c = a[order], b[order], c[order]
            at = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.zeros(0, int)
            n = np.diff(np.append(at, len(a)))
            for i in range(0, len(at), 65_536):
                s = at[i : i + 65_536]
                yield batch_of(schema, **{name: x.astype(np.int64) for name, x in zip(("a", "b", "least", "shared"), (a[s], b[s], c[s], n[i : i + 65_536]))})

        for batch in batches:
            for k, t, x, d in zip(column(batch, "r").to_pylist(), column(batch, "tok"), column(batch, "at"), column(batch, "docs")):
                if k != r and held:
                    yield from pairs()
                    held = []
                r = k
                held.append((unpack_sorted(t.as_buffer()), unpack_any(d.as_buffer(), DOC.str if DOC.names is None else DOC)[unpack_any(x.as_buffer(), "<u4")]))
        if held:
            yield from pairs()

    packed = dealt_again(packed, bits, merged_postings, cut_postings, "r int, tok binary, at binary, docs binary")
    return packed.repartition(1 << bits, "r").sortWithinPartitions("r").mapInArrow(run, "a long, b long, least long, shared long, heavy long, doc_id long, h long, n long")


def enough_shared(found: DataFrame) -> DataFrame:
    """Pairs (a, b) of documents whose shared prefix tokens can reach the threshold."""
    return found.where("a is not null").groupBy("a", "b").agg(F.max("least").alias("least"), F.sum("shared").alias("shared")).where("shared >= least").select("a", "b")


def prefix_under(s: np.ndarray, multiplier: int, percent: int) -> np.ndarray:
    """The prefix of a set under another order of all tokens."""
    key = mixed(s * U(multiplier))
    p = int(prefix_length(len(s), percent))
    return s if p >= len(s) else s[np.argpartition(key, p - 1)[:p]]


def sets_of(docs: DataFrame, ids: DataFrame, percent: int) -> DataFrame:
    """id, set, and the leading 32 bits of its prefix under each further order, of the documents named: their texts are read again, never shuffled if the names are few."""
    own = docs.select("doc_id", "text").join(small(ids.select(F.col("doc_id")).distinct(), 2_000_000), "doc_id", "left_semi")
    names = [f"p{i}" for i in range(len(ORDERS))]

    def make():
        def handle(batch):
            sets = shingle_sets([normalized(t) for t in texts(batch)])
            prefixes = [pa.array([np.unique((prefix_under(s, m, percent) >> U(32)).astype("<u4")).tobytes() for s in sets], pa.binary()) for m in ORDERS]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id").cast(pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary()), *prefixes], names=["id", "set", *names])

        return handle

    return arrow_map(own, make, "id long, set binary, " + ", ".join(f"{n} binary" for n in names))


def both_sides(pairs: DataFrame, sets: DataFrame, columns: list[str]) -> DataFrame:
    """a, b and the columns of either side, as x_... and y_...."""
    side = lambda end, lead: sets.select(F.col("id").alias(end), *(F.col(c).alias(f"{lead}_{c}") for c in columns))
    return pairs.join(side("b", "y"), "b").join(side("a", "x"), "a").select("a", "b", *(f"{lead}_{c}" for c in columns for lead in "xy"))


def kept_pairs(joined: DataFrame, test, names: tuple[str, str] = ("a", "b")) -> DataFrame:
    """The pairs whose cells pass ``test``."""

    def make():
        def handle(batch):
            cells = [column(batch, c) for c in batch.schema.names[2:]]
            ok = pa.array([test(*row) for row in zip(*cells)], pa.bool_())
            yield pa.RecordBatch.from_arrays([column(batch, "a").filter(ok), column(batch, "b").filter(ok)], names=list(names))

        return handle

    return arrow_map(joined, make, f"{names[0]} long, {names[1]} long")


def share_prefixes(*cells) -> bool:
    """Whether both sides share a token among their prefixes under every further order."""
    read = lambda cell: np.frombuffer(cell.as_buffer(), "<u4")
    return all(len(np.intersect1d(read(x), read(y), assume_unique=True)) for x, y in zip(cells[::2], cells[1::2]))


def verified(docs: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are links: those that share prefixes under all orders, whose whole sets are then intersected."""
    sets = saved(sets_of(docs, pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")), percent), "sets")
    passed = saved(kept_pairs(both_sides(pairs, sets, [f"p{i}" for i in range(len(ORDERS))]), share_prefixes), "passed")

    def similar(x, y) -> bool:
        x, y = (np.frombuffer(c.as_buffer(), U) for c in (x, y))
        if min(len(x), len(y)) * 100 < max(len(x), len(y)) * percent:
            return False
        both = len(np.intersect1d(x, y, assume_unique=True))
        return 100 * both >= percent * (len(x) + len(y) - both)

    return saved(kept_pairs(both_sides(passed, sets, ["set"]), similar, ("u", "v")), "links")


def forest(link: np.ndarray) -> np.ndarray:
    """Of a symmetric link matrix: each row's least linked row, by label propagation."""
    label = np.arange(len(link))
    while True:
        new = np.minimum(label, np.where(link, label[None, :], len(link)).min(1, initial=len(link)))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many tokens each two sets share, some thousand tokens at a time."""
    tok, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, col, count = np.unique(tok, return_inverse=True, return_counts=True)
    keep = count[col] > 1
    col, row = col[keep], row[keep]
    used, col = np.unique(col, return_inverse=True)
    both = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(col, kind="stable")
    col, row = col[order], row[order]
    for at in range(0, len(used), 4096):
        a, b = np.searchsorted(col, [at, at + 4096])
        m = np.zeros((len(sets), min(4096, len(used) - at)), np.float32)
        m[row[a:b], col[a:b] - at] = 1
        both += m @ m.T
    return both


def block_links(ids: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among a cell's documents: pairs that share prefixes under all orders are verified."""
    n = np.array([len(s) for s in sets])
    pair = np.minimum(n[:, None], n) * 100 >= np.maximum(n[:, None], n) * percent
    np.fill_diagonal(pair, False)
    for m in ORDERS:
        pair &= shared_counts([prefix_under(s, m, percent) for s in sets]) > 0
    left = np.flatnonzero(pair.any(1))
    if not len(left):
        return []
    pair, n, ids = pair[np.ix_(left, left)], n[left], ids[left]
    both = shared_counts([sets[i] for i in left]).astype(np.int64)
    label = forest(pair & (100 * both >= percent * (n[:, None] + n - both)))
    return [(int(ids[i]), int(ids[j])) for i, j in enumerate(label) if i != j and ids[i] != ids[j]]


def cells_of(rows: DataFrame) -> DataFrame:
    """heavy (cell number), doc_id, blocks: the lists as they are, or whole families of lists where that sends fewer sets.

    Lists of one family hold much the same documents. A family that shared
    documents connect is one cell if its documents times its blocks are fewer
    than the rows of its lists times theirs, so the cells are never more.
    """
    least = rows.groupBy("heavy").agg(F.min("doc_id").alias("m"), F.count(F.lit(1)).alias("k"))
    family = components(shuffled_apart(rows, least, "heavy", "k").where("doc_id > m").select("doc_id", "m").distinct(), "doc_id", "m")
    rows = saved(rows.join(family, rows["doc_id"] == family["node"]).select("heavy", "doc_id", "blocks", F.col("component").alias("family")), "family-rows")
    whole = saved(rows.groupBy("family", "doc_id").agg(F.sum("blocks").alias("cost"), F.count(F.lit(1)).alias("k")), "families")
    sizes = whole.groupBy("family").agg(F.sum("cost").alias("cost"), F.count(F.lit(1)).alias("docs"), F.sum("k").alias("k")).withColumn("needs", F.ceil(F.col("docs") / BLOCK).cast("int"))
    sizes = saved(sizes, "family-sizes")
    cheap = sizes.where(F.col("docs") * F.col("needs") <= F.col("cost")).select("family", "needs", "docs")
    dear = sizes.where(F.col("docs") * F.col("needs") > F.col("cost")).select("family", "k")
    # numbers of families and of lists may meet: the flag keeps them apart
    one = shuffled_apart(whole.select("family", "doc_id"), cheap, "family", "docs").select(F.col("family").alias("heavy"), F.lit(True).alias("is_family"), "doc_id", F.col("needs").alias("blocks"))
    return one.union(shuffled_apart(rows, dear, "family", "k").select("heavy", F.lit(False).alias("is_family"), "doc_id", "blocks"))


def heavy_links(docs: DataFrame, rows: DataFrame, links: DataFrame, percent: int) -> DataFrame:
    """Links of heavy lists that are more than one component, block against block."""
    comp = components(links)
    # one of each text in a list; its component from what is linked so far
    rows = rows.groupBy("heavy", "h").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"))
    rows = saved(rows.join(comp, rows["doc_id"] == comp["node"], "left").select("heavy", "doc_id", "n", F.coalesce("component", "doc_id").alias("c")), "heavy-texts")
    lists = rows.groupBy("heavy").agg(F.count(F.lit(1)).alias("size"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("heavy", "size", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    lists = saved(lists, "heavy-lists")
    if lists.isEmpty():
        return links.where("false")
    rows = saved(shuffled_apart(rows, lists, "heavy", "size").select("heavy", "doc_id", "blocks"), "heavy-rows")
    rows = saved(cells_of(rows).withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")), "cells")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    cells = rows.withColumn("other", other).select("heavy", "is_family", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "doc_id")
    sets = saved(sets_of(docs, rows, percent).select("id", "set"), "sets")
    joined = cells.join(sets, cells["doc_id"] == sets["id"]).select("heavy", "is_family", "i", "j", "doc_id", "set")
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches):
        held, cell = [], None

        def send():
            found = block_links(np.array([h[0] for h in held]), [np.frombuffer(h[1], U) for h in held], percent)
            return pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], schema=schema)

        for batch in batches:
            for *at, d, s in zip(*(column(batch, c).to_pylist() for c in ("heavy", "is_family", "i", "j", "doc_id", "set"))):
                if at != cell and held:
                    yield send()
                    held = []
                cell = at
                held.append((d, s))
        if held:
            yield send()

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return saved(joined.repartition(parts, "heavy", "is_family", "i", "j").sortWithinPartitions("heavy", "is_family", "i", "j").mapInArrow(run, "u long, v long"), "links")


def join_classes(docs: DataFrame, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    tune(spark)
    docs = docs.select("doc_id", "text")
    bits = sized(docs)
    first = min(bits, COARSE)
    path = new_dir(spark, "first-pass")
    first_pass(docs, first).write.parquet(path)
    held = spark.read.schema("doc_id long, digest binary, n long, r int, blob binary").parquet(path)
    rows = saved(held.where("blob is null").select("doc_id", "digest", "n"), "rows")
    heavy = heavy_tokens(held.where("blob is not null").select("r", "blob"), bits)
    drop_dir(spark, path)

    path = new_dir(spark, "second-pass")
    second_pass(docs, first, heavy, percent).write.parquet(path)
    held = spark.read.schema("r int, tok binary, at binary, docs binary, heavy long, doc_id long, h long, n long").parquet(path)
    found = saved(light_pairs(held.where("r is not null").select("r", "tok", "at", "docs"), bits, percent), "postings")
    listed = saved(held.where("heavy is not null").select("heavy", "doc_id", "h", "n").union(found.where("heavy is not null").select("heavy", "doc_id", "h", "n")), "heavy-rows")
    pairs, some_heavy = enough_shared(found), not listed.isEmpty()
    if some_heavy:
        least = saved(listed.groupBy("heavy").agg(F.min(F.struct("doc_id", "n")).alias("m"), F.count(F.lit(1)).alias("k")), "heavy-least")
        star = shuffled_apart(listed, least, "heavy", "k").where("doc_id > m.doc_id and least(n, m.n) * 100 >= greatest(n, m.n) * %d" % percent).select(F.col("m.doc_id").alias("a"), F.col("doc_id").alias("b")).distinct()
        pairs = pairs.union(star).distinct()
    pairs = saved(pairs, "pairs")
    drop_dir(spark, path)

    links = verified(docs, pairs, percent)
    more = heavy_links(docs, listed, links, percent) if some_heavy else links.where("false")
    equal = saved(rows.where("n > 0 and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("v"), F.count(F.lit(1)).alias("k")).where("k > 1"), "equal")
    equal = shuffled_apart(rows.where("n > 0").select("doc_id", "digest"), equal, "digest", "k").where("doc_id > v").select(F.col("doc_id").alias("u"), "v")
    comp = components(links.union(more).union(equal))
    return rows.join(comp, rows["doc_id"] == comp["node"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stand for their group: the least doc_id of each, and rows without id."""
    classes = join_classes(docs, percent)
    gone = classes.where("doc_id > component_id").select("doc_id").distinct()
    return docs.join(small(gone), "doc_id", "left_anti").select(*docs.columns)
