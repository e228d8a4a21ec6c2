"""Counterfactual-regularised toxicity classifier.

A logistic model over the distinct words of a text and their leading letters
(so that inflected forms share evidence), fitted with an L1 penalty, which
leaves a few hundred features: the length of a text by itself moves no score.

Counterfactual regularisation: every labelled text that names a group is paired
with copies in which the group's name is swapped for others of its kind, and
the squared change of the score's logit is added to the loss. A name's own
weight can then not carry the label of the texts that mention it, which is what
makes neutral mentions score high otherwise.

The fit takes at most about ``TRAIN_PER_CLASS`` labelled texts a class, drawn by
hash of the id; scoring covers every whole text, and only text is its input.

Defined results. Null or empty text: the score of a text without known words.
Labels of one class only: every text scores that class's share, (toxic + 1) / (all + 2). No
labels at all: every score is 0. Contradicting labels of one doc_id: toxic. Null doc_id: crc32 of the empty text
decides about held_out. Repeated rows: each scored by itself. Empty table: no
rows. Rows of ``labels`` without a label or without a document are ignored;
extra columns too.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from fidelmill.llm.common import arrow_map, column, crc_remainder, saved, small, texts, tune
from fidelmill.llm.wordtable import U, pieces, plain_words, runs, span_hashes

#: Labelled texts of each class that the fit draws, about.
TRAIN_PER_CLASS = 3_000
#: Features that enter the fit, and copies with a swapped name of each text that names a group.
MAX_FEATURES, SWAPS = 8_192, 4
L1, COUNTERFACTUAL, STEPS = 0.002, 1.0, 300
PREFIXES = (4, 5)

#: Names of groups, by kind; a swap stays within its row. Fixed values.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("female", "male", "transgender", "nonbinary"),
    ("gay", "straight", "lesbian", "bisexual", "queer"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics"),
    ("black", "white", "asian", "latino", "arab", "african", "european"),
    ("immigrants", "refugees", "foreigners", "locals"),
    ("deaf", "blind", "disabled", "autistic"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("muslime", "christen", "juden", "hindus"),
    ("ausländer", "flüchtlinge", "einheimische"),
    ("femmes", "hommes", "filles", "garçons"),
    ("musulmans", "chrétiens", "juifs", "hindous"),
    ("étrangers", "réfugiés", "immigrés"),
    ("mujeres", "hombres", "niñas", "niños"),
    ("musulmanes", "cristianos", "judíos", "hindúes"),
    ("extranjeros", "refugiados", "inmigrantes"),
)

#: What separates words: every ASCII character but letters.
_SPACED = bytes(i if i >= 128 or chr(i).isalpha() else 32 for i in range(256))


def _raw(text: str) -> bytes:
    return text.lower().encode("utf-8", "replace").translate(_SPACED)


def features(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, 64-bit feature) of every word and word beginning of a run of texts, with repeats."""
    buf = np.frombuffer(b"".join(parts), np.uint8)
    bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, U)
    starts, ends = plain_words(buf, bounds)
    text = np.searchsorted(bounds, starts, "right") - 1
    all_text, all_hash = [text], [span_hashes(buf, starts, ends)]
    for k in PREFIXES:
        long = ends - starts > k
        all_text.append(text[long])
        all_hash.append(span_hashes(buf, starts[long], starts[long] + k) ^ U(k))
    return np.concatenate(all_text), np.concatenate(all_hash)


def word_features(word: str) -> np.ndarray:
    return features([_raw(word)])[1]


def swapped(raw: bytes) -> list[tuple[np.ndarray, np.ndarray]]:
    """For a text that names groups: features lost and won by each of up to SWAPS swaps."""
    words = set(raw.split())
    out = []
    for row in IDENTITY_TERMS:
        named = [t for t in row if t.encode() in words]
        for t in named:
            for other in [o for o in row if o not in named][: SWAPS - len(out)]:
                out.append((word_features(t), word_features(other)))
    return out[:SWAPS]


def fit(rows: list[tuple[list[int], float, list]]) -> tuple[np.ndarray, np.ndarray, float]:
    """Sorted feature hashes, their weights, and the intercept, from (distinct features, label, swaps)."""
    y = np.array([r[1] for r in rows], float)
    if not len(y) or y.min() == y.max():  # no evidence but the share of the one class, with one text of each added
        ones = float(y.sum())
        return np.zeros(0, U), np.zeros(0), float(np.log((ones + 1) / (len(y) - ones + 1))) if len(y) else -np.inf
    size = np.array([len(r[0]) for r in rows])
    value = np.concatenate([np.asarray(r[0], np.int64).view(U) for r in rows]) if size.sum() else np.zeros(0, U)
    row = np.repeat(np.arange(len(rows)), size)
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))  # both classes weigh the same
    keys, col, count = np.unique(value, return_inverse=True, return_counts=True)
    lift = np.abs(np.bincount(col, weights=(np.where(y == 1, 1, -1) * weight)[row], minlength=len(keys)))
    named = np.isin(keys, np.concatenate([word_features(t) for r in IDENTITY_TERMS for t in r]))
    chosen = np.argsort(-np.where(named, 2.0, np.where(count > 1, lift, 0)), kind="stable")[:MAX_FEATURES]
    place = np.full(len(keys), -1)
    place[np.sort(chosen)] = np.arange(len(chosen))
    keys = keys[np.sort(chosen)]
    kept = place[col] >= 0
    row, col = row[kept], place[col][kept]
    pair, sign_col, sign = [], [], []
    pairs = 0
    for r in rows:
        for lost, won in r[2]:
            for s, f in ((-1.0, lost), (1.0, won)):
                at = np.searchsorted(keys, f)
                at = at[(at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] == f)]
                pair += [pairs] * len(at)
                sign_col += at.tolist()
                sign += [s] * len(at)
            pairs += 1
    pair, sign_col, sign = np.array(pair, int), np.array(sign_col, int), np.array(sign)
    # accelerated proximal gradient; the step follows from the rows' sizes
    per_row = np.bincount(row, minlength=len(y))
    step = 1.0 / (0.25 * (weight * (per_row + 1)).sum() + 2 * COUNTERFACTUAL * (np.bincount(pair).max() if len(pair) else 0) + 1e-9)
    w, b = np.zeros(len(keys)), 0.0
    v, vb, t = w.copy(), b, 1.0
    for _ in range(STEPS):
        z = np.bincount(row, weights=v[col], minlength=len(y)) + vb
        g = weight * (1 / (1 + np.exp(-np.clip(z, -35, 35))) - y)
        grad = np.bincount(col, weights=g[row], minlength=len(keys))
        if pairs:
            change = np.bincount(pair, weights=sign * v[sign_col], minlength=pairs)
            grad += 2 * COUNTERFACTUAL / pairs * np.bincount(sign_col, weights=sign * change[pair], minlength=len(keys))
        new = v - step * grad
        new = np.sign(new) * np.maximum(np.abs(new) - step * L1, 0)
        new_b = vb - step * g.sum()
        nt = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, vb = new + (t - 1) / nt * (new - w), new_b + (t - 1) / nt * (new_b - b)
        w, b, t = new, new_b, nt
    live = w != 0
    return keys[live], w[live], float(b)


def training_rows(docs: DataFrame, labels: DataFrame, modulus: int, per_class: int) -> list:
    """(distinct features, label, swaps) of the drawn labelled texts, in a fixed order.

    Which features enter the fit is counted over the cluster, so a text brings the
    driver at most MAX_FEATURES and the names' numbers, however long it is.
    """
    known = labels.where("toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(crc_remainder("doc_id", modulus) != 0)
    sizes = dict(known.groupBy("toxic").count().collect())
    if not sizes:
        return []
    rate = F.create_map(*(x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, per_class / n) * (1 << 30)))))
    drawn = known.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 30)) < rate[F.col("toxic")])
    texts_of = docs.select("doc_id", "text").join(small(drawn), "doc_id")

    def make():
        def handle(batch):
            raw = [_raw(t) for t in texts(batch)]
            got: list[np.ndarray] = []
            for r in raw:
                some = [features([p])[1] for p in pieces(r)]
                got.append(np.unique(np.concatenate([np.unique(x) for x in some])).view(np.int64))
            swaps = [[[x.view(np.int64).tolist() for x in pair] for pair in swapped(r)] for r in raw]
            yield pa.RecordBatch.from_arrays(
                [pa.array(got, pa.list_(pa.int64())), column(batch, "toxic").cast(pa.float64()), pa.array(swaps, pa.list_(pa.list_(pa.list_(pa.int64()))))], names=["features", "label", "swaps"]
            )

        return handle

    sample = saved(arrow_map(texts_of.select("text", "toxic"), make, "features array<long>, label double, swaps array<array<array<long>>>"), "toxic-sample")
    share = {k: 0.5 / max(1, n) for k, n in sample.groupBy("label").count().collect()}
    lift = F.abs(F.sum(F.when(F.col("label") == 1, F.lit(share.get(1.0, 0.0))).otherwise(-F.lit(share.get(0.0, 0.0)))))
    counted = sample.select(F.explode("features").alias("f"), "label").groupBy("f").agg(F.count(F.lit(1)).alias("n"), F.round(lift, 9).alias("lift"))
    best = [r[0] for r in counted.where("n > 1").orderBy(F.desc("lift"), "f").limit(MAX_FEATURES).select("f").collect()]
    names = np.concatenate([word_features(t) for r in IDENTITY_TERMS for t in r]).view(np.int64)
    chosen = np.unique(np.concatenate([np.asarray(best, np.int64), names]))

    def cut():
        def handle(batch):
            kept = [x.values.to_numpy()[np.isin(x.values.to_numpy(), chosen, assume_unique=True)] for x in column(batch, "features")]
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.list_(pa.int64())), column(batch, "label"), column(batch, "swaps")], names=["features", "label", "swaps"])

        return handle

    table = arrow_map(sample, cut, "features array<long>, label double, swaps array<array<array<long>>>").toArrow()
    rows = [
        (f.values.to_numpy(), label, [[np.asarray(x, np.int64).view(U) for x in p] for p in swaps])
        for f, label, swaps in zip(table["features"], table["label"].to_pylist(), table["swaps"].to_pylist())
    ]
    return sorted(rows, key=lambda r: (r[1], r[0].tobytes()))  # rows arrive in any order


class Scorer:
    def __init__(self, model: tuple[np.ndarray, np.ndarray, float]):
        self.keys, self.weights, self.intercept = model
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(self.keys >> U(48)).astype(np.int64)] = True

    def scores(self, parts: list[str]) -> np.ndarray:
        raw = [_raw(t) for t in parts]
        z = np.full(len(raw), self.intercept)
        if len(self.keys):
            cut = [pieces(r) for r in raw]
            owner = np.repeat(np.arange(len(raw)), [len(c) for c in cut])
            every = [p for c in cut for p in c]
            found = [np.zeros(0, np.int64)]
            for a, b in runs(every):
                text, h = features(every[a:b])
                near = self.maybe[(h >> U(48)).astype(np.int64)]
                text, h = text[near], h[near]
                at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
                hit = self.keys[at] == h
                found.append(np.unique(owner[a:b][text[hit]] * len(self.keys) + at[hit]))
            both = np.unique(np.concatenate(found))  # a feature counts once a text
            z += np.bincount(both // len(self.keys), weights=self.weights[both % len(self.keys)], minlength=len(raw))
        return 1 / (1 + np.exp(-np.clip(z, -700, 700)))


def _model(docs: DataFrame, labels: DataFrame, modulus: int, per_class: int):
    tune(docs.sparkSession)
    return docs.sparkSession.sparkContext.broadcast(fit(training_rows(docs, labels, modulus, per_class)))  # at most MAX_FEATURES weights


def score(docs: DataFrame, labels: DataFrame, *, modulus: int = 5, per_class: int = TRAIN_PER_CLASS) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    model = _model(docs, labels, modulus, per_class)

    def make():
        scorer = Scorer(model.value)

        def handle(batch):
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(scorer.scores(texts(batch)), pa.float64())], names=["doc_id", "score"])

        return handle

    out = arrow_map(docs.select("doc_id", "text"), make, StructType([docs.schema["doc_id"]]).add("score", DoubleType()))
    return out.select("doc_id", (crc_remainder("doc_id", modulus) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, *, modulus: int = 5, per_class: int = TRAIN_PER_CLASS) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with their columns."""
    model = _model(docs, labels, modulus, per_class)

    def make():
        scorer = Scorer(model.value)

        def handle(batch):
            yield batch.filter(pa.array(scorer.scores(texts(batch)) < threshold))

        return handle

    return arrow_map(docs, make, docs.schema)
