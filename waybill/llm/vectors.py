"""Nearest neighbours by inner product, through randomly rotated one-bit codes.

Vectors are assigned to lists around centres fitted on a bounded sample.  What is left of a vector after its centre is
taken off is normalised, rotated by a random orthogonal matrix and stored as the signs of its coordinates, packed to bits,
with three correction scalars: the length of the residual, the inner product of the code with the unit residual, and the
error scale that follows from it.  A query searches the lists with the nearest centres.  It estimates all inner products of
a block from the bits, drops what even the upper error bound keeps below the k-th best lower bound, and reranks the rest
exactly in double precision.  The nearest few lists go first: the k-th best found there is the bar that anything in the
other lists has to pass, so these give out little and rerank little.

Vectors travel in blocks of bounded size: candidates by list and a salt, queries by list.  A list that holds a third of all
rows is many blocks in many tasks.  Every vector is indexed and every given query is answered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .common import Scratch


def usable(vector: str) -> Column:
    """Not null, not zero, all components finite; NaN, infinities and null components rule a vector out."""
    finite = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(F.col(vector), lambda x: x != 0) & F.col(vector).isNotNull(), F.lit(False))


def rotation(dim: int, seed: int = 7) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def fit_centres(sample: np.ndarray, n: int, rounds: int = 12, seed: int = 11) -> np.ndarray:
    """Centres of k-means over a bounded sample."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), min(n, len(sample)), replace=False)]
    for _ in range(rounds):
        near = nearest_centres(sample, centres, 1)[:, 0]
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        counts = np.bincount(near, minlength=len(centres))
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def nearest_centres(x: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """Numbers of the ``n`` centres at the smallest distance, nearest first."""
    distance = (centres**2).sum(axis=1) - 2 * x @ centres.T
    n = min(n, len(centres))
    part = np.argpartition(distance, n - 1, axis=1)[:, :n] if n < len(centres) else np.tile(np.arange(n), (len(x), 1))
    return np.take_along_axis(part, np.argsort(np.take_along_axis(distance, part, 1), axis=1, kind="stable"), 1)


def encode(x: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed sign bits, residual lengths, and inner products of code and unit residual."""
    residual = (x - centre) @ turn
    length = np.linalg.norm(residual, axis=1)
    unit = residual / np.maximum(length, 1e-300)[:, None]
    fidelity = np.abs(unit).sum(axis=1) / np.sqrt(x.shape[1])
    return np.packbits(residual > 0, axis=1), length, np.where(length > 0, fidelity, 1.0)


def estimate(queries: np.ndarray, bits: np.ndarray, length: np.ndarray, fidelity: np.ndarray, centre: np.ndarray,
             turn: np.ndarray, sure: float) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products (queries, vectors) and the half-width of their error bounds.

    The error of a unit vector's estimate is below ``sure`` * sqrt((1 - f^2) / f^2 / (dim - 1)) times the query's length
    with a probability that grows exponentially in ``sure``.
    """
    dim = queries.shape[1]
    signs = (2.0 * np.unpackbits(bits, axis=1, count=dim) - 1.0) / np.sqrt(dim)
    turned = queries @ turn
    found = (turned @ signs.T) * (length / fidelity)
    spread = np.sqrt(np.maximum(1 - fidelity**2, 0.0)) / fidelity / np.sqrt(max(dim - 1, 1))
    size = np.linalg.norm(turned, axis=1)[:, None]
    width = sure * size * (spread * length)[None, :] + 1e-12 * size * (length + np.linalg.norm(centre))  # rounding
    return found + (queries @ centre)[:, None], width


def search_block(queries: np.ndarray, query_ids: np.ndarray, ids: np.ndarray, x: np.ndarray, bits: np.ndarray,
                 length: np.ndarray, fidelity: np.ndarray, centre: np.ndarray, turn: np.ndarray, k: int, sure: float,
                 bars: np.ndarray, bar_ids: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query the ids and exact inner products of its ``k`` best in this block, ties to smaller ids.

    Only what comes before the query's bar (a score and an id) is given.
    """
    about, width = estimate(queries, bits, length, fidelity, centre, turn, sure)
    for i, q in enumerate(queries):
        own = ids == query_ids[i]
        low, high = about[i] - width[i], about[i] + width[i]
        low[own] = -np.inf
        others = len(ids) - int(own.sum())
        bar = -np.partition(-low, k - 1)[k - 1] if others > k else -np.inf
        chosen = np.flatnonzero((high >= max(bar, bars[i])) & ~own)
        exact = inner(q, x[chosen])
        before = (exact > bars[i]) | ((exact == bars[i]) & (ids[chosen] < bar_ids[i]))
        chosen, exact = chosen[before], exact[before]
        best = np.lexsort((ids[chosen], -exact))[:k]
        yield i, ids[chosen][best], exact[best]


def inner(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products in double precision; each is summed alone, so equal vectors have equal scores."""
    return (x * q).sum(axis=1)


def search(vectors: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 20,
           list_rows: int = 2048, max_lists: int = 4096, probe_share: float = 0.6, min_probes: int = 24,
           first_lists: int = 4, sample_rows: int = 20_000, block_rows: int = 4096, sure: float = 3.0) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest of every query among all other vectors.

    ``queries`` has the columns of ``vectors``.  There is one list for about ``list_rows`` vectors, up to ``max_lists``;
    a query probes ``probe_share`` of the lists, at least ``min_probes``, the ``first_lists`` nearest before the others
    (the share is set for vectors without clusters, whose neighbours lie in many lists).  Centres are fitted on at most
    ``sample_rows`` vectors.  Vectors that are null, zero or hold null or non-finite components take no part, nor do rows
    with a null key or of another dimension than most of the sample.  Rows that repeat a key are one vector (the first in
    order of its components).  With fewer than ``k`` candidates all are returned; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)

    def cleaned(df: DataFrame) -> DataFrame:
        single = df.schema[vector].dataType.elementType.typeName() == "float"  # travels as it is: half the bytes
        v = F.col(vector) if single else F.transform(F.col(vector), lambda x: x.cast("double"))
        return (df.where(F.col(key).isNotNull() & usable(vector)).select(F.col(key).cast("bigint").alias("id"), v.alias("x"))
                .groupBy("id").agg(F.min("x").alias("x")))

    base = scratch.put(cleaned(vectors), "vectors")
    total = base.count()
    share = min(1.0, 1.2 * sample_rows / max(total, 1))
    some = base.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).limit(sample_rows)
    rows = [r[0] for r in some.select("x").collect()]
    if not rows:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    dim = int(pd.Series([len(r) for r in rows]).mode()[0])
    sample = np.array([r for r in rows if len(r) == dim], float)
    n_lists = int(min(max_lists, max(1, -(-total // list_rows))))
    probes = int(min(n_lists, max(min_probes, round(probe_share * n_lists))))
    shared = spark.sparkContext.broadcast((fit_centres(sample, n_lists), rotation(dim)))

    def assign(df: DataFrame, start: int, stop: int) -> DataFrame:
        """``df`` with a row for each of the ``start``-th to ``stop``-th nearest lists, numbered in column ``list``."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = np.array(batch.column(1).to_pylist(), float).reshape(-1, dim)
                near = nearest_centres(x, shared.value[0], stop)[:, start:]
                rows = batch.take(pa.array(np.repeat(np.arange(len(x)), near.shape[1])))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(near.ravel().astype(np.int32))],
                                                 names=[*rows.schema.names, "list"])

        return df.mapInArrow(run, StructType([*df.schema.fields, StructField("list", IntegerType())]))

    same = F.size("x") == dim
    members = scratch.put(assign(base.where(same), 0, 1), "members")
    asked = scratch.put(cleaned(queries).where(same), "queries")
    # A list is split into salts of about block_rows vectors; its queries go to each of them.  At most max_lists rows.
    salts = {r[0]: r[1] for r in members.groupBy("list").agg(
        F.ceil(F.count("*") / F.lit(block_rows)).cast("int")).collect()}
    sizes = F.broadcast(spark.createDataFrame([(i, salts.get(i, 1)) for i in range(n_lists)], "list int, n int"))
    left = members.join(sizes, "list").select("id", "x", "list", F.pmod(F.xxhash64("id"), F.col("n")).cast("int").alias("salt"))

    def block(key_: tuple, candidates: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if len(candidates) and len(wanted):
            centres, turn = shared.value
            centre = centres[key_[0]]
            x = np.array(candidates["x"].tolist(), float)
            ids = candidates["id"].to_numpy(np.int64)
            codes = encode(x, centre, turn)
            for start in range(0, len(wanted), 256):
                part = wanted.iloc[start: start + 256]
                query_ids = part["id"].to_numpy(np.int64)
                for i, found, score in search_block(
                        np.array(part["x"].tolist(), float), query_ids, ids, x, *codes, centre, turn, k, sure,
                        part["bar"].to_numpy(float), part["bar_id"].to_numpy(np.int64)):
                    out.append((np.full(len(found), query_ids[i]), found, score))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)]
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), cols, strict=True)))

    def look(wanted: DataFrame, start: int, stop: int) -> DataFrame:
        right = assign(wanted, start, stop).join(sizes, "list").select(
            "id", "x", "bar", "bar_id", "list", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("salt"))
        return left.groupBy("list", "salt").cogroup(right.groupBy("list", "salt")).applyInPandas(
            block, "query_id bigint, vec_id bigint, score double")

    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))

    def best(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
            "query_id", "rank", "vec_id", "score")

    lowest, last_id = F.lit(float("-inf")), F.lit((1 << 63) - 1)
    early = min(first_lists, probes)
    near = best(look(asked.withColumns({"bar": lowest, "bar_id": last_id}), 0, early))
    if early == probes:
        return near
    near = scratch.put(near, "near")
    bars = near.where(F.col("rank") == k).select(
        F.col("query_id").alias("id"), F.col("score").alias("bar"), F.col("vec_id").alias("bar_id"))
    barred = asked.join(bars.hint("merge"), "id", "left").select(
        "id", "x", F.coalesce("bar", lowest).alias("bar"), F.coalesce("bar_id", last_id).alias("bar_id"))
    return best(near.drop("rank").unionByName(look(barred, early, probes)))
