"""Quality selection by importance resampling.

Two generative models of hashed word n-grams (single words and pairs) are counted: one over target texts, one over the raw
texts.  A document's importance is the log-ratio of its likelihoods.  Adding Gumbel noise to the log-importance and taking
the largest k is sampling without replacement in proportion to the importance.

The models are two count vectors of a fixed number of buckets.  The k-th largest key is found by counting in ever finer
ranges of the key, 65,536 ranges at a time, so no rank is computed over all rows and no row reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import Scratch, map_texts, shingle_hashes, word_hashes
from .toxicity import fold


def buckets(data: bytes, n: int) -> np.ndarray:
    """Hash buckets of the words and word pairs of a text, A-Z folded."""
    words = word_hashes(data, lower=True)
    pairs = shingle_hashes(words, 2) if len(words) > 1 else words[:0]
    return (np.concatenate((words, pairs)) % np.uint64(n)).astype(np.int64)


def bucket_counts(docs: DataFrame, n: int, text: str = "text") -> np.ndarray:
    """Counts of every bucket over all rows: one row per bucket and task is shuffled, ``n`` rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n, np.int64)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                total += np.bincount(buckets(t, n), minlength=n)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    picked = docs.select(F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("t"))
    rows = picked.mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(n, np.int64)
    out[rows["bucket"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return out


def log_ratio(target: np.ndarray, raw: np.ndarray, smoothing: float = 1.0) -> np.ndarray:
    def log_share(c: np.ndarray) -> np.ndarray:
        return np.log((c + smoothing) / (c.sum() + smoothing * len(c)))

    return log_share(target) - log_share(raw)


def gumbel(key: str, seed: int) -> Column:
    """Gumbel noise of a row, from a hash of its key: the same in every run; a null key has its own hash."""
    bits = F.shiftrightunsigned(F.xxhash64(F.col(key), F.lit(seed)), 11)
    uniform = (bits.cast("double") + 0.5) / F.lit(float(1 << 53))
    return -F.log(-F.log(uniform))


def ordered(value: Column) -> Column:
    """A bigint that grows with a double, as far as 2^-20 of its unit; beyond +-2^42 all values are alike."""
    return F.round(F.least(F.greatest(value, F.lit(-2.0**42)), F.lit(2.0**42)) * 2.0**20).cast("bigint")


def kth_largest(values: DataFrame, column: str, k: int) -> int | None:
    """The k-th largest of a bigint column between -2^63 and 2^63 - 1; None if there are fewer rows."""
    low, shift = -(1 << 63), 48
    while True:
        place = F.shiftright(F.col(column) - F.lit(low), shift) if shift < 48 else (F.shiftright(column, 48) + (1 << 15))
        inside = values if shift == 48 else values.where(
            (F.col(column) >= low) & (F.col(column) <= low + (1 << (shift + 16)) - 1))
        counts = inside.groupBy(place.alias("place")).count().collect()  # at most 65,536 rows
        left = k
        for place_, n in sorted(((r[0], r[1]) for r in counts), reverse=True):
            if n >= left:
                break
            left -= n
        else:
            return None
        low += place_ << shift
        if not shift:
            return low
        k, shift = left, shift - 16


def select(docs: DataFrame, target: DataFrame, share: float | None = None, k: int | None = None, key: str = "doc_id",
           text: str = "text", n_buckets: int = 1 << 17, seed: int = 5) -> DataFrame:
    """``key, n_words, log_weight, noisy, selected`` for every row; ``k`` rows (or ``share`` of all) are selected.

    Rows that tie with the k-th key are all selected; keys are compared to 2^-20.  A null or empty text has log-weight 0.
    Repeated rows share their noise.  With an empty target the weights only reflect smoothing.  An empty table gives an
    empty result.  Further columns are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    ratio = docs.sparkSession.sparkContext.broadcast(
        log_ratio(bucket_counts(target, n_buckets, text), bucket_counts(docs, n_buckets, text)))
    kind = docs.schema[key].dataType.simpleString()

    def run(keys: list, texts: list[bytes]) -> dict:
        rows = [buckets(t, n_buckets) for t in texts]
        return {key: keys, "n_words": [(len(b) + 1) // 2 for b in rows],
                "log_weight": [float(ratio.value[b].sum()) for b in rows]}

    weighed = map_texts(docs, run, f"{key} {kind}, n_words bigint, log_weight double", key, text)
    weighed = scratch.put(weighed.withColumn("noisy", F.col("log_weight") + gumbel(key, seed)).withColumn(
        "place", ordered(F.col("noisy"))), "weighed")
    if k is None:
        k = round((share or 0.0) * weighed.count())
    bar = kth_largest(weighed, "place", k) if k > 0 else 1 << 62
    chosen = F.lit(True) if bar is None else F.col("place") >= bar
    return weighed.select(key, "n_words", "log_weight", "noisy", chosen.alias("selected"))
