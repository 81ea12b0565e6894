"""The registered queries of this subpackage: each applies an operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import additive, bitpack, bm25, bpe_trie, brown, licenses, mixing, oracle, packing, prefix_trie, setsketch, suffix_dedup, toxicity, whitening
from ._common import crc_mod, table


def tokenizer_path(name: str) -> str:
    """Where the installed public vocabulary files are; every operator takes the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_passages(table(spark, sf_dir, "documents"), words=50)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = toxicity.training_labels(table(spark, sf_dir, "labels"))
    scored = toxicity.score_documents(table(spark, sf_dir, "documents"), marks)
    return scored.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", "predicted", "evidence")


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_documents(table(spark, sf_dir, "documents"))


def op4_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.score_texts(table(spark, sf_dir, "documents"), modulus=7, rest=2)


def op5_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    file = bitpack.token_table(spark, table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return file.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op7_additive_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return additive.nearest(table(spark, sf_dir, "embeddings"), every=100, k=10)


def op8_bpe_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe_trie.encode_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op9_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85)


def op10_bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.similar_documents(table(spark, sf_dir, "documents"), every=20, k=10)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), components=16)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"), block=100, heads=6)


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, repeats=2)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_suffix_dedup, op2_toxicity, op3_licenses, op4_brown_lm, op5_token_file, op6_packing, op7_additive_ann, op8_bpe_trie, op9_setsketch, op10_bm25_topk, op11_whitening, op12_prefix_trie, op13_mixing)}


def oracle_sql() -> dict[str, str]:
    return {"op1_suffix_dedup": oracle.SUFFIX_DEDUP, "op9_setsketch": oracle.NEAR_DUPLICATES, "op10_bm25_topk": oracle.BM25, "op12_prefix_trie": oracle.PREFIX_TRIE}
