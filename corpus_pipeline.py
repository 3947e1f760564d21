"""From raw documents to packed training sequences, in five stages.

Each stage takes the documents its predecessor kept, written as Parquet and read again, and returns documents; the last
returns the token pieces of the packed sequences.  No stage looks at anything but what it is given and the labels.

Nulls: a row with a null text fails the base test of the quality rules; a null key never drops a row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from waybill.llm.common import Scratch, bounded_batches, table
from waybill.llm.jaccard import keep_one
from waybill.llm.packing import pack_documents
from waybill.llm.quality_rules import keep_good
from waybill.llm.repeats import remove_repeats
from waybill.llm.toxicity import keep_ordinary
from waybill.llm.vocab import default_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the class-conditional models do not call toxic."""
    bounded_batches(spark)
    return keep_ordinary(docs, table(spark, sf_dir, "labels"))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that weak supervision calls good."""
    bounded_batches(spark)
    return keep_good(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each class of near copies: five words, similarity 0.8 or more."""
    bounded_batches(spark)
    return keep_one(docs, n=5, percent=80)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings of 100 bytes that also start earlier; n_chars follows the text."""
    bounded_batches(spark)
    cut = remove_repeats(docs, length=100)
    return cut.select(*[
        F.col("kept_text").alias("text") if c == "text" else
        F.char_length("kept_text").cast("bigint").alias("n_chars") if c == "n_chars" else F.col(f"`{c}`")
        for c in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents in sequences of 2,048 tokens."""
    bounded_batches(spark)
    return pack_documents(docs, default_path("byte_bpe_50k.json"), size=2048)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("quality rules", drop_poor),
    ("n-gram Jaccard join", drop_near_copies),
    ("suffix-array dedup", cut_repeats),
    ("best-fit packing", pack_sequences),
]

#: Models, classes and suffix order are beyond one SQL statement; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = scratch.put(stage(spark, docs, sf_dir), f"stage{i}")
        if i:
            scratch.drop(f"stage{i - 1}")
    return docs
