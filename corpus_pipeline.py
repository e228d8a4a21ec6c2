"""The corpus pipeline: toxicity, language, near-duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next one's documents. A stage works on all rows
that its predecessor kept. All but the last return the columns of documents; the
last returns one row per packed piece. A document that the mix takes more than
once is that many rows, each packed by itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fidelmill.llm import langid, mixing, ngram, packing, toxicity
from fidelmill.llm.common import load, saved
from fidelmill.llm.tokens import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go. Null text scores as the empty text and stays or goes like it."""
    return toxicity.keep_clean(docs, load(spark, sf_dir, "labels"))


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or far from every language's centroids, go."""
    return langid.keep_known(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that Jaccard links of 0.8 connect, the least doc_id stays."""
    return ngram.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as its source's rate and its draw say."""
    return mixing.emit(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 4096 tokens, each filled in proportion to the sources' tokens."""
    return packing.pack(docs, path=tokenizer_path("word_bpe_49k.json")).drop("queue")


STAGES = [
    ("toxicity", drop_toxic),
    ("language ID", drop_unknown_language),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack_windows),
]

#: Trained scores and tokenizers are not expressible in SQL; the tests hold run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the last stage's rows."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
