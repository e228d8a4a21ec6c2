"""Token-id files with fixed-width bit packing.

A shard file holds the ids of a run of documents in ascending doc_id order:

- magic ``FMBITS01``;
- blocks of ``BLOCK_IDS`` ids, each id in the least bits that hold the
  vocabulary, least significant bit first, every block padded to whole bytes;
- the document index: ids (int64), a null flag (uint8) and first token (uint64)
  of each document, with one more entry for the end;
- the offset of every block (uint64);
- a footer: bits, ids a block, documents, ids, blocks, index offset, magic.

Any id range is read by seeking to its blocks. Unpacking is one numpy call a
block. Texts are dealt to shards by range of (doc_id, hash of the text), so rows
of one id are split too and no task holds more than a shard's rows; each task
encodes and writes its shard as it reads it. The ids before a shard come from the
manifest, one row a shard.

Defined results. Null text: the empty text, the end id alone. Null doc_id: first
in order. Repeated doc_id: each row stays, in order of the texts' hashes (equal
texts have equal ids, so their order does not show). An id beyond the vocabulary
is an error, never cut. Empty table: no files, no rows. Extra columns are ignored.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fidelmill.llm.common import arrow_map, column, new_dir, texts, trim, tune
from fidelmill.llm.tokens import encoder, vocabulary_size

MAGIC = b"FMBITS01"
BLOCK_IDS = 65_536
FOOTER = struct.Struct("<IIQQQQ8s")


def width(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"id {int(ids.max())} does not fit in {bits} bits")
    planes = (ids.astype("<u4")[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(planes.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack_bits(raw: bytes, bits: int, n: int) -> np.ndarray:
    planes = np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little", count=n * bits).reshape(n, bits)
    full = np.zeros((n, 32), np.uint8)
    full[:, :bits] = planes
    return np.packbits(full.ravel(), bitorder="little").view("<u4")


class Writer:
    """Writes one shard; only a block of ids and the document index are held."""

    def __init__(self, out, vocabulary: int):
        self.out, self.bits = out, width(vocabulary)
        self.at = len(MAGIC)
        out.write(MAGIC)
        self.rest: list[np.ndarray] = []
        self.waiting = self.ids = 0
        self.docs: list[int | None] = []
        self.starts: list[int] = []
        self.blocks: list[int] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id)
        self.starts.append(self.ids)
        self.ids += len(ids)
        self.rest.append(ids)
        self.waiting += len(ids)
        if self.waiting >= BLOCK_IDS:
            whole = np.concatenate(self.rest)
            cut = len(whole) // BLOCK_IDS * BLOCK_IDS
            for at in range(0, cut, BLOCK_IDS):
                self._block(whole[at : at + BLOCK_IDS])
            self.rest, self.waiting = [whole[cut:]], len(whole) - cut

    def _block(self, ids: np.ndarray) -> None:
        raw = pack_bits(ids, self.bits)
        self.blocks.append(self.at)
        self.at += len(raw)
        self.out.write(raw)

    def close(self) -> None:
        if self.waiting:
            self._block(np.concatenate(self.rest))
        index = np.asarray([x or 0 for x in self.docs], "<i8").tobytes() + np.asarray([x is None for x in self.docs], np.uint8).tobytes()
        index += np.asarray([*self.starts, self.ids], "<u8").tobytes() + np.asarray(self.blocks, "<u8").tobytes()
        self.out.write(index + FOOTER.pack(self.bits, BLOCK_IDS, len(self.docs), self.ids, len(self.blocks), self.at, MAGIC))


class Reader:
    """Reads one shard from a seekable file."""

    def __init__(self, file):
        self.file = file
        size = file.size() if hasattr(file, "size") and callable(file.size) else file.seek(0, 2)
        file.seek(size - FOOTER.size)
        self.bits, self.block_ids, n, self.ids, blocks, at, magic = FOOTER.unpack(file.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a token file")
        file.seek(at)
        raw = file.read(n * 17 + 8 + blocks * 8)
        self.docs = np.frombuffer(raw, "<i8", n)
        self.null = np.frombuffer(raw, np.uint8, n, n * 8).astype(bool)
        self.starts = np.frombuffer(raw, "<u8", n + 1, n * 9).astype(np.int64)
        self.offsets = np.frombuffer(raw, "<u8", blocks, n * 17 + 8).astype(np.int64)

    def block(self, k: int) -> np.ndarray:
        n = min(self.block_ids, self.ids - k * self.block_ids)
        self.file.seek(int(self.offsets[k]))
        return unpack_bits(self.file.read((n * self.bits + 7) // 8), self.bits, n)

    def read(self, start: int, n: int) -> np.ndarray:
        """Ids ``start`` to ``start + n`` of the shard."""
        if not n:
            return np.zeros(0, "<u4")
        first, last = start // self.block_ids, (start + n - 1) // self.block_ids
        got = np.concatenate([self.block(k) for k in range(first, last + 1)])
        return got[start - first * self.block_ids :][:n]

    def documents(self):
        """(place, ids) of every document in order, each block unpacked once."""
        held, base, k = np.zeros(0, "<u4"), 0, 0
        for i in range(len(self.docs)):
            a, b = int(self.starts[i]), int(self.starts[i + 1])
            more = [held[a - base :]]
            base = a
            have = len(more[0])
            while have < b - a:
                more.append(self.block(k))
                have += len(more[-1])
                k += 1
            held = np.concatenate(more) if len(more) > 1 else more[0]
            yield i, held[: b - a]


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    """The folder's file system: local paths and file:, else whatever its scheme names (hdfs, s3, gs)."""
    if folder.startswith("file:"):
        return fs.LocalFileSystem(), folder[5:].replace("///", "/", 1)
    return (fs.LocalFileSystem(), folder) if folder.startswith("/") else fs.FileSystem.from_uri(folder)


#: Bytes of text of a shard, about, and the fewest rows for which a shard is cut smaller.
SHARD_BYTES, SHARD_ROWS = 256 << 20, 1024


def write_ids(docs: DataFrame, *, path: str, end_id: int, vocabulary: int | None = None, chunks: str = "byte", shard_bytes: int = SHARD_BYTES, folder: str | None = None) -> tuple[str, list[tuple[int, int, int]]]:
    """Encodes every text and writes the shard files. Returns the folder and the manifest (shard, documents, ids).

    ``vocabulary`` defaults to the tokenizer's. A shard is written under an own
    name and then renamed, so a task that is lost and runs again leaves one whole
    file.
    """
    spark = docs.sparkSession
    tune(spark)
    vocabulary = vocabulary or vocabulary_size(path)
    rows, size = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = max(1, size // shard_bytes, min(parts, rows // SHARD_ROWS))
    folder = folder or new_dir(spark, "token-ids")

    def write(batches):
        from pyspark import TaskContext

        context = TaskContext.get()
        shard, attempt = context.partitionId(), context.taskAttemptId()
        where, top = opened(folder)
        name, writer = f"{top}/.writing-{shard:08d}-{attempt}", None
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                where.create_dir(top, recursive=True)
                writer = Writer(where.open_output_stream(name), vocabulary)
            for d, x in zip(column(batch, "doc_id").cast(pa.int64()).to_pylist(), encoder(path, chunks).encode(texts(batch))):
                writer.add(d, np.append(x, np.uint32(end_id)))
        if writer:
            writer.close()
            writer.out.close()
            where.move(name, f"{top}/shard-{shard:08d}.fmb")
            yield pa.RecordBatch.from_pydict({"shard": [shard], "docs": [len(writer.docs)], "ids": [writer.ids]}, pa.schema([("shard", pa.int32()), ("docs", pa.int64()), ("ids", pa.int64())]))
        trim()

    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("row"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie"), F.col("row")]
    dealt = keyed.repartitionByRange(shards, *order).sortWithinPartitions(*order).select("doc_id", "text")
    return folder, sorted(tuple(r) for r in dealt.mapInArrow(write, "shard int, docs long, ids long").collect())  # one row a shard


def read_ids(spark: SparkSession, folder: str, manifest: list[tuple[int, int, int]]) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone but for the ids before each shard."""
    before = np.cumsum([0, *(m[2] for m in manifest)]).tolist()
    todo = spark.createDataFrame([(m[0], b) for m, b in zip(manifest, before)], "shard int, before long").repartition(max(1, len(manifest)))

    def make():
        where, top = opened(folder)

        def handle(batch):
            for shard, base in zip(*(column(batch, c).to_pylist() for c in ("shard", "before"))):
                with where.open_input_file(f"{top}/shard-{shard:08d}.fmb") as file:
                    reader = Reader(file)
                    crc = pa.array([zlib.crc32(ids.tobytes()) for _, ids in reader.documents()], pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(reader.docs, mask=reader.null), pa.array(reader.starts[:-1] + base), pa.array(np.diff(reader.starts)), crc], names=["doc_id", "start", "n_tokens", "ids_crc32"])

        return handle

    return arrow_map(todo, make, "doc_id long, start long, n_tokens long, ids_crc32 long")
