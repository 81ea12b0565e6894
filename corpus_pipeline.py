"""A training-data pipeline over ``documents``: toxic documents go, one document of each near-duplicate group stays, repeated
passages are cut, and what remains is packed into sequences. Each stage calls one operator of ``corpuscraft.llm``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscraft.llm import packing, setsketch, suffix_dedup, toxicity
from corpuscraft.llm._common import Scratch, table
from corpuscraft.llm.queries import tokenizer_path

def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents scored 0.5 or more, learning from the labels outside the held-out fifth."""
    marks = toxicity.training_labels(table(spark, sf_dir, "labels"))
    return toxicity.clean_documents(docs, marks)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the rows of the smallest id of each group linked by a similarity of 0.8 or more on five-word shingles."""
    return setsketch.drop_near_duplicates(docs, shingle=5, percent=80)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 50 words or more that repeat earlier ones; n_chars follows the text. No document goes."""
    trimmed = suffix_dedup.remove_repeats(docs, words=50)
    if "n_chars" in docs.columns:
        trimmed = trimmed.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return trimmed.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 2048 ids."""
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", cut_repeats),
    ("packing", pack),
]
#: Toxicity and packing cannot be expressed in SQL, so neither can run(); tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each result is written to the shared folder and read again as the next one's documents."""
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.put(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
