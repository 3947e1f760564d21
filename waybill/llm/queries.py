"""The registered queries: each operator over its whole table, with the columns of its contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import bounded_batches, table
from .vocab import default_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _registered(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return table(spark, sf_dir, "documents")


@_registered
def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of 2,048 tokens, as few as hierarchical best fit finds."""
    from .packing import pack_documents

    return pack_documents(_documents(spark, sf_dir), default_path("byte_bpe_50k.json"))


@_registered
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count of every document."""
    from .tokencount import count_tokens

    return count_tokens(_documents(spark, sf_dir), default_path("byte_bpe_50k.json")).select(
        "doc_id", "n_bytes", "n_tokens", "over_limit")


@_registered
def op8_byte_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoding and decoding digests of every document."""
    import public_tokenizers

    from .bpecodec import round_trip

    return round_trip(_documents(spark, sf_dir), default_path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@_registered
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures of every document, the base test, and the verdict of weak supervision."""
    from .quality_rules import judge

    return judge(_documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good")


@_registered
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    from .toxicity import classify

    return classify(_documents(spark, sf_dir), table(spark, sf_dir, "labels")).select(
        "doc_id", "held_out", "score", "predicted")


@_registered
def op10_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth vector."""
    from pyspark.sql import functions as F

    from .vectors import search

    bounded_batches(spark)
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where(F.col("vec_id") % 20 == 0))


@_registered
def op6_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance of every document towards labelled good text; as large a share is selected as is good among labels."""
    from pyspark.sql import functions as F

    from .resampling import select

    docs = _documents(spark, sf_dir)
    labels = table(spark, sf_dir, "labels").where(F.col("quality").isNotNull())
    n, good = labels.agg(F.count("*"), F.coalesce(F.sum("quality"), F.lit(0))).first()
    # One way of joining at every size: what is shuffled follows the input.
    target = docs.select("doc_id", "text").join(
        labels.where("quality = 1").select("doc_id").distinct().hint("merge"), "doc_id", "left_semi")
    return select(docs, target, share=good / max(n, 1))


@_registered
def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in every document."""
    from .licenses import scan

    return scan(_documents(spark, sf_dir))


@_registered
def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without its repeated strings of 100 bytes."""
    from .repeats import remove_repeats

    return remove_repeats(_documents(spark, sf_dir).select("doc_id", "text"), length=100, digest_only=True).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@_registered
def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents whose 4-word shingles have a Jaccard similarity of 0.85 or more."""
    from .jaccard import link_texts

    return link_texts(_documents(spark, sf_dir), n=4, percent=85)


@_registered
def op11_language_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by rank-order profiles."""
    from .langid import predict_languages

    return predict_languages(_documents(spark, sf_dir))


@_registered
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trie of all conversations, rebuilt on the heads of others."""
    from .trie import branched, ordered_turns, prefix_trie

    bounded_batches(spark)
    return prefix_trie(branched(ordered_turns(table(spark, sf_dir, "conversations"))))


@_registered
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector; every seventh row carries the label after its own."""
    from pyspark.sql import functions as F

    from .negatives import mine

    bounded_batches(spark)
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").withColumn("label", moved)
    return mine(vectors, F.col("vec_id") % 100 == 0)


@_registered
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of corpus_pipeline over the documents."""
    from corpus_pipeline import run

    return run(spark, sf_dir)


def _add_oracles() -> None:
    from . import oracles
    from .licenses import oracle

    ORACLES["op9_license_scan"] = oracle()
    ORACLES["op11_language_profiles"] = oracles.LANGUAGES
    ORACLES["op12_prefix_trie"] = oracles.PREFIX_TRIE
    ORACLES["op13_hard_negatives"] = oracles.HARD_NEGATIVES


_add_oracles()
