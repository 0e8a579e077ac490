"""Documents to packed training sequences: five stages, each an operator of ``twinweave.llm``.

``STAGES`` names them in order. A stage takes the documents its predecessor kept and returns those it keeps, with the columns of ``documents``; the last
returns pieces of packed sequences. Between stages the documents are written as Parquet to the shared folder and read again.

Defined cases: a document with a null or empty text, or without any letter, goes in the first stage; a null language becomes the one the network finds, other
languages stay as they are; a null id is an id like others (it is the largest where ids are ordered, and of a group of near-duplicates it stays only if there
is no other); of repeated rows one stays; a document of which the substring stage leaves no word goes; a benchmark item without an id counts, one without a
text does not; very long texts are read whole; columns beyond those of ``documents`` stay, whatever they are called; with empty ``documents`` every stage is empty, with
an empty ``benchmark`` nothing is removed by it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from twinweave.llm import decontaminate, langid, packing, repeats, simhash, tokens
from twinweave.llm.ship import ship
from twinweave.session import durable

#: SQL has neither the network, nor XXH64 fingerprints, nor the tokenizer.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known, null languages filled in; learned from documents with a language that are not held out."""
    ship(spark)
    return langid.keep_known(docs, langid.train(docs, ~langid.held_out(F.col("doc_id"), 4, 2)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: three-word shingles, fingerprints within two bits."""
    ship(spark)
    return simhash.deduplicate(docs, size=3, half=1)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of twenty words and more that also start earlier."""
    ship(spark)
    return repeats.without_repeats(docs, size=20).withColumn("n_chars", F.length("text").cast("long"))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of ten words of a benchmark item."""
    ship(spark)
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), size=10, action="document")


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens, packed along the space-filling curve."""
    ship(spark)
    pieces = packing.pack(docs, tokens.path("byte_bpe_50k.json"), spaced=True, width=2048, added=True)
    return pieces.select(F.col("id").alias("doc_id"), "start", "length", "ids_crc32", "doc_tokens", F.col("sequence").alias("sequence_id"), "offset")


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language", language), ("near_duplicates", near_duplicates), ("substrings", substrings), ("benchmark", benchmark), ("packing", sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
