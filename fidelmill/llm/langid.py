"""Language identification by nearest clustered centroids of TF-IDF n-gram vectors.

A text is the counts of its hashed byte trigrams (letters in lower case, all
else as single spaces), damped by a logarithm, weighted by inverse document
frequency and scaled to length 1. Each language is ``CLUSTERS`` centroids from
spherical k-means; a text goes to the language of its nearest centroid by
cosine. A text whose cosine is less than ``SLACK`` of that of nearly all training
texts of that language (all but ``STRAYS`` of them) is rejected: it is no text of
a known language, or hardly any text.

The fit draws about ``TRAIN_PER_LANG`` labelled texts of each language by hash
of the id; prediction covers every whole text, and only text is its input.

Defined results. Null text or no letter: ``und``, score 0, rejected. No labelled
text at all: ``und`` for all. Null doc_id: crc32 of the empty text decides about
held_out. Equal cosines: the language first in order. Repeated rows: each by
itself. Empty table: no rows. Extra columns are ignored, or kept by ``keep_known``.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructType

from fidelmill.llm.common import arrow_map, column, crc_remainder, saved, small, tune

#: Labelled texts of each language that the fit draws, about.
TRAIN_PER_LANG = 400
CLUSTERS, ROUNDS = 4, 10
#: Share of a language's texts that a cluster has at least.
LEAST_SHARE = 0.02
#: Hash buckets of the trigrams.
DIMENSIONS = 1 << 13
#: Share of a language's training texts that may lie anywhere, and share of the least cosine of the others below which a text is rejected.
STRAYS, SLACK = 0.01, 0.25
UNKNOWN = "und"
#: Bytes of a text that are counted at once.
SLICE = 1 << 20
LETTER = re.compile(r"[^\W\d_]")
_SPACED = bytes(i if i >= 128 or chr(i).isalpha() else 32 for i in range(256))


def trigrams(text: str) -> np.ndarray:
    """Counts of the hashed trigrams of one text."""
    raw = b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(_SPACED).split()) + b" "
    if len(raw) < 3:
        return np.zeros(DIMENSIONS, np.int64)
    if len(raw) > SLICE:  # slices overlap by two bytes: each trigram begins in one
        return sum(_counted(raw[at : at + SLICE + 2]) for at in range(0, len(raw) - 2, SLICE))
    return _counted(raw)


def _counted(raw: bytes) -> np.ndarray:
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    h = (b[:-2] * np.uint32(0x9E3779B1)) ^ (b[1:-1] * np.uint32(0x85EBCA77)) ^ (b[2:] * np.uint32(0xC2B2AE3D))
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return np.bincount((h >> np.uint32(32 - 13)).astype(np.int64), minlength=DIMENSIONS)


def vectors(parts: list[str], idf: np.ndarray) -> np.ndarray:
    x = np.empty((len(parts), DIMENSIONS), np.float32)
    for i, t in enumerate(parts):
        x[i] = trigrams(t)
    np.log1p(x, out=x)
    x *= idf
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.maximum(norm, 1e-12)


def centroids(x: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means of rows in a fixed order.

    The rows are first put in order of their cosine with the mean, and the first
    centres are the means of ``k`` equal runs of that order, so that no single odd
    text seeds one. Clusters of less than ``LEAST_SHARE`` of the rows are left out.
    """
    x = x.astype(np.float64)
    runs = np.array_split(np.argsort(-(x @ x.mean(0)), kind="stable"), min(k, len(x)))
    scaled = lambda c: c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    c = scaled(np.array([x[r].mean(0) for r in runs]))
    for _ in range(ROUNDS):
        own = (x @ c.T).argmax(1)
        c = scaled(np.array([x[own == i].mean(0) if (own == i).any() else c[i] for i in range(len(c))]))
    size = np.bincount((x @ c.T).argmax(1), minlength=len(c))
    return c[size >= max(1, LEAST_SHARE * len(x))]


class Model:
    def __init__(self, langs: list[str], owner: np.ndarray, points: np.ndarray, idf: np.ndarray, floor: np.ndarray):
        self.langs, self.owner, self.points, self.idf, self.floor = langs, owner, points, idf, floor

    def predict(self, parts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and rejection of each text."""
        out, score, rejected = [UNKNOWN] * len(parts), np.zeros(len(parts)), np.ones(len(parts), bool)
        at = [i for i, t in enumerate(parts) if t and LETTER.search(t)] if self.langs else []
        for s in range(0, len(at), 256):
            some = at[s : s + 256]
            cosine = vectors([parts[i] for i in some], self.idf) @ self.points.T
            best = np.zeros((len(some), len(self.langs)), np.float32) - 1
            for j, o in enumerate(self.owner):
                best[:, o] = np.maximum(best[:, o], cosine[:, j])
            top = best.argmax(1)
            for r, (i, k) in enumerate(zip(some, top.tolist())):
                out[i] = self.langs[k]
                score[i] = min(1.0, max(0.0, float(best[r, k])))
                rejected[i] = best[r, k] < self.floor[k]
        return out, score, rejected


def fit(docs: DataFrame, modulus: int = 4, held: int = 2, per_lang: int = TRAIN_PER_LANG) -> Model:
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_remainder("doc_id", modulus) != held)).select("doc_id", "lang")
    rates = known.groupBy("lang").count().select("lang", F.least(F.lit(1.0), F.lit(float(per_lang)) / F.col("count")).alias("rate"))
    drawn = docs.select("doc_id", "lang", "text").where(F.col("text").isNotNull() & (crc_remainder("doc_id", modulus) != held)).join(small(rates), "lang")
    drawn = saved(drawn.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30)) < F.col("rate") * (1 << 30)).select("lang", "text"), "langid-sample")

    def document_counts(batches):
        seen, n = np.zeros(DIMENSIONS, np.int64), 0
        for batch in batches:
            for t in column(batch, "text").to_pylist():
                if LETTER.search(t):
                    seen += trigrams(t) > 0
                    n += 1
        yield pa.RecordBatch.from_pydict({"n": [n], "df": [seen.tobytes()]})

    parts = drawn.select("text").mapInArrow(document_counts, "n long, df binary").collect()  # one row a task, of a bounded sample
    total = sum(p["n"] for p in parts)
    df = sum((np.frombuffer(p["df"], np.int64) for p in parts), np.zeros(DIMENSIONS, np.int64))
    idf = np.log((1 + total) / (1 + df)).astype(np.float32) + np.float32(0.1)

    def of_language(part: pd.DataFrame) -> pd.DataFrame:
        own = sorted(t for t in part["text"] if LETTER.search(t))  # rows arrive in any order
        if not own:
            return pd.DataFrame({"lang": [], "points": [], "floor": []})
        x = vectors(own, idf)
        c = centroids(x, CLUSTERS)
        return pd.DataFrame({"lang": [part["lang"].iloc[0]], "points": [c.astype(np.float32).tobytes()], "floor": [float(np.quantile((x @ c.T).max(1), STRAYS)) * SLACK]})

    found = sorted(drawn.groupBy("lang").applyInPandas(of_language, "lang string, points binary, floor double").collect())  # one row a language
    points = [np.frombuffer(r["points"], np.float32).reshape(-1, DIMENSIONS) for r in found]
    owner = np.repeat(np.arange(len(found)), [len(p) for p in points])
    return Model([r["lang"] for r in found], owner, np.concatenate(points) if points else np.zeros((0, DIMENSIONS), np.float32), idf, np.array([r["floor"] for r in found]))


def identify(docs: DataFrame, *, modulus: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every row."""
    tune(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, modulus, held))  # a few vectors a language

    def make():
        def handle(batch):
            lang, score, rejected = model.value.predict(column(batch, "text").to_pylist())
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)], names=["doc_id", "lang_pred", "score", "rejected"])

        return handle

    schema = StructType([docs.schema["doc_id"]]).add("lang_pred", StringType()).add("score", DoubleType()).add("rejected", BooleanType())
    out = arrow_map(docs.select("doc_id", "text"), make, schema)
    return out.select("doc_id", (crc_remainder("doc_id", modulus) == held).alias("held_out"), "lang_pred", "score", "rejected")


def keep_known(docs: DataFrame, *, modulus: int = 4, held: int = 2) -> DataFrame:
    """The rows of ``docs`` whose text is of a known language, with their columns."""
    tune(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, modulus, held))

    def make():
        def handle(batch):
            yield batch.filter(pa.array(~model.value.predict(column(batch, "text").to_pylist())[2]))

        return handle

    return arrow_map(docs, make, docs.schema)
