"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fidelmill.llm import bitpack, counts, html, langid, media, mixing, ngram, oracles, packing, pivots, toxicity
from fidelmill.llm.common import load
from fidelmill.llm.tokens import tokenizer_path


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(load(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(load(spark, sf_dir, "pages"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.round_trip(load(spark, sf_dir, "documents"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(load(spark, sf_dir, "documents"))


def op6_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.near_duplicates(load(spark, sf_dir, "embeddings"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram.join_classes(load(spark, sf_dir, "documents"))


def op8_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, manifest = bitpack.write_ids(load(spark, sf_dir, "documents"), path=tokenizer_path("byte_bpe_50k.json"), end_id=0)
    return bitpack.read_ids(spark, folder, manifest)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.count_tokens(load(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(load(spark, sf_dir, "documents"), path=tokenizer_path("word_bpe_49k.json")).drop("queue")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix": op1_mix,
    "op2_main_text": op2_main_text,
    "op3_toxicity": op3_toxicity,
    "op4_media": op4_media,
    "op5_language": op5_language,
    "op6_pivots": op6_pivots,
    "op7_ngram_join": op7_ngram_join,
    "op8_token_ids": op8_token_ids,
    "op9_token_counts": op9_token_counts,
    "op10_packing": op10_packing,
}

ORACLES: dict[str, str] = {"op1_mix": mixing.ORACLE, "op6_pivots": oracles.PIVOTS, "op7_ngram_join": oracles.NGRAM}
