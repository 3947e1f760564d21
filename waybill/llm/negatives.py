"""Hard negatives by exact inner products in a residue number system.

Vectors become integers.  Their products are taken in float32 matrix multiplications, one for each of several small primes:
residues lie around zero and are so small that no sum leaves the integers that float32 holds exactly.  The Chinese
remainder theorem, in mixed radix form, gives back the exact signed scores; as many primes are used as the largest possible
score needs.

Vectors travel in blocks of bounded bytes, and every block of anchors meets every block of candidates as one row of an equi
join on numbered slots of blocks.  A first pass over these tiles finds the anchors' positives, a second one the negatives in each
positive's window of scores.  A tile gives out its best few; the best of all tiles are taken by a window that limits its
groups before they are shuffled, so equal vectors and labels that hold most rows meet in no task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import Scratch

#: Components multiplied in one go; longer vectors are summed up piece by piece.
_PIECE = 1024
#: Scores up to here leave room for the window's bounds in 64 bits.
LARGEST_SCORE = 1 << 56


@cache
def primes(dim: int, bound: int) -> tuple[int, ...]:
    """Distinct primes whose product exceeds 2 * ``bound`` + 1, each exact for ``dim`` components in float32."""
    n, out, product = 2 * min(isqrt(((1 << 24) - 1) // min(max(dim, 1), _PIECE)), 2000) + 1, [], 1
    while product <= 2 * bound + 1:
        while n > 2 and any(n % d == 0 for d in range(2, int(n**0.5) + 1)):
            n -= 1
        if n <= 2:
            raise ValueError(f"no residue system for {dim} components and scores up to {bound}")
        out.append(n)
        product *= n
        n -= 1
    return tuple(out)


def _centred(x: np.ndarray, p: int) -> np.ndarray:
    """Residues from -(p - 1) / 2 to (p - 1) / 2."""
    return (x + p // 2) % p - p // 2


def exact_scores(a: np.ndarray, b: np.ndarray, bound: int) -> np.ndarray:
    """All inner products of the integer rows of ``a`` and ``b``, none of them beyond ``bound``."""
    dim = a.shape[1]
    total = np.zeros((len(a), len(b)), np.int64)
    digits: list[np.ndarray] = []
    system = primes(dim, bound)
    for i, p in enumerate(system):
        residue = np.zeros(total.shape, np.int64)
        for start in range(0, dim, _PIECE):
            left, right = (_centred(x[:, start: start + _PIECE], p).astype(np.float32) for x in (a, b))
            residue += (left @ right.T).astype(np.int64)
        # the next digit: what the digits so far leave, divided by the product of their primes, modulo p
        weight = 1
        for q, digit in zip(system, digits):
            residue -= digit * (weight % p)
            weight *= q
        digits.append(_centred(residue % p * pow(weight, -1, p), p))
    for p, digit in zip(reversed(system), reversed(digits), strict=True):
        total = total * p + digit
    return total


def first_best(scores: np.ndarray, chosen: np.ndarray, k: int) -> np.ndarray:
    """Of the positions ``chosen``, the ``k`` with the highest scores, ties to the earlier position."""
    found = scores[chosen]
    if len(found) > k:
        bar = np.partition(found, len(found) - k)[len(found) - k]
        keep = found >= bar
        chosen, found = chosen[keep], found[keep]
    return chosen[np.argsort(-found, kind="stable")[:k]]


def packed(rows: DataFrame, dim: int, block_bytes: int, numbers: tuple[str, ...] = ()) -> DataFrame:
    """Blocks of the rows of each partition: ``ids``, ``labels``, ``x`` and ``numbers`` (lists of numbers of one length).

    Rows are sorted by id within a block, so that earlier positions are smaller ids.
    """
    width = 8 + 8 + 4 * dim
    names = ["ids", "labels", "x", *numbers]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0

        def give() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).sort_by("id")
            columns = [t["id"].to_numpy().astype(np.int64), t["label"].to_numpy().astype(np.int64),
                       t["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int32)]
            columns += [t[c].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in numbers]
            return pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in columns], names=names)

        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n * width >= block_bytes:
                yield give()
                held, n = [], 0
        if n:
            yield give()

    return rows.select("id", "label", "x", *numbers).mapInArrow(run, ", ".join(f"{n} binary" for n in names))


def tiles(candidates: DataFrame, anchors: DataFrame, blocks_a_slot: int = 32) -> DataFrame:
    """A row for every block of anchors (columns ``a_...``) and every block of candidates.

    Blocks are dealt to slots; a block of candidates goes to every slot of anchors, a block of anchors to every slot of
    candidates.  So a slot of the join holds about one block of anchors and ``blocks_a_slot`` of candidates at any size,
    and anchors that the planner measures as small are broadcast instead.
    """
    n_candidates, n_anchors = candidates.count(), anchors.count()
    columns, rows = max(1, -(-n_candidates // blocks_a_slot)), max(1, n_anchors)

    def slot(n: int) -> Column:
        return F.pmod(F.xxhash64("ids"), F.lit(n)).cast("int")

    left = candidates.select("ids", "labels", "x", slot(columns).alias("column"),
                             F.explode(F.sequence(F.lit(0), F.lit(rows - 1))).alias("row"))
    right = anchors.select(*[F.col(c).alias(f"a_{c}") for c in anchors.columns], slot(rows).alias("row"),
                           F.explode(F.sequence(F.lit(0), F.lit(columns - 1))).alias("column"))
    return left.join(right, ["row", "column"]).drop("row", "column")


def best_of(found: DataFrame, by: tuple[str, ...], key: str, score: str, k: int) -> DataFrame:
    """``found`` with ``rank`` from 1 among the rows of equal ``by``: highest score, then smallest key, the first ``k``."""
    order = Window.partitionBy(*by).orderBy(F.col(score).desc(), key)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _positives(bound: int, dim: int, k: int):
    """Tiles to ``anchor_id, positive_id, positive_score``: the best ``k`` others of the anchor's label in each tile."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _opened(batches):
            scores = exact_scores(t["a_x"].reshape(-1, dim), t["x"].reshape(-1, dim), bound)
            out = []
            for i, (anchor, label) in enumerate(zip(t["a_ids"], t["a_labels"], strict=True)):
                best = first_best(scores[i], np.flatnonzero((t["labels"] == label) & (t["ids"] != anchor)), k)
                out.append((np.full(len(best), anchor), t["ids"][best], scores[i][best]))
            yield _batch(out, ("anchor_id", "positive_id", "positive_score"))

    return run


def _negatives(bound: int, dim: int, k: int, low: int, high: int, slots: int):
    """Tiles to the best ``k`` rows of other labels in the window of each positive."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _opened(batches):
            scores = exact_scores(t["a_x"].reshape(-1, dim), t["x"].reshape(-1, dim), bound)
            positives, marks = (t[c].reshape(-1, slots) for c in ("a_positives", "a_marks"))
            numbers = t["a_n_positives"]
            lowest, highest = -(-low * marks // 100), high * marks // 100  # the integers that the window holds
            out = []
            for i, anchor in enumerate(t["a_ids"]):
                others = np.flatnonzero(t["labels"] != t["a_labels"][i])
                found = scores[i][others]
                for j in range(numbers[i]):
                    inside = others[(found >= lowest[i, j]) & (found <= highest[i, j])]
                    best = first_best(scores[i], inside, k)
                    out.append((np.full(len(best), anchor), np.full(len(best), positives[i, j]),
                                np.full(len(best), marks[i, j]), t["ids"][best], scores[i][best]))
            yield _batch(out, ("anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"))

    return run


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    for batch in batches:
        for i in range(len(batch)):
            yield {name: np.frombuffer(batch.column(name)[i].as_py(), np.int32 if name in ("x", "a_x") else np.int64)
                   for name in batch.schema.names}


def _batch(parts: list[tuple], names: tuple[str, ...]) -> pa.RecordBatch:
    columns = zip(*parts, strict=True) if parts else [()] * len(names)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate([np.zeros(0, np.int64), *c]).astype(np.int64)) for c in columns], names=list(names))


def integers(vector: str, scale: int) -> Column:
    """Components times ``scale`` in double precision, rounded down; null unless all are finite."""
    x = F.transform(F.col(vector), lambda v: F.floor(v.cast("double") * F.lit(float(scale))))
    fine = F.forall(F.col(vector), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.when(F.coalesce(fine, F.lit(False)), x)


def mine(vectors: DataFrame, anchors: Column, key: str = "vec_id", vector: str = "embedding", label: str = "label",
         scale: int = 256, n_positive: int = 5, n_negative: int = 10, low: int = 30, high: int = 90,
         block_bytes: int = 2 << 20, anchor_bytes: int = 1 << 17) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``anchors`` picks the rows that are asked for (an expression over the columns of ``vectors``).  An anchor's positives
    are the ``n_positive`` rows of its (integer) label with the highest scores, its negatives for each of them the
    ``n_negative`` highest of another label from ``low`` to ``high`` percent of the positive's score; ties go to smaller
    keys.  A negative positive score has an empty window.  Rows with a null key, label or vector, with null or non-finite
    components, or of another dimension than most rows (of equally frequent ones the largest) take no part.  Rows that
    repeat a key are one row, the smallest by label and components.  Anchors without positives or negatives have no row,
    and an empty table gives an empty result.  Scores that could pass 2^56 raise an error, as they leave 64 bits once
    multiplied by a percentage.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    rows = vectors.select(
        F.col(key).cast("bigint").alias("id"), F.col(label).cast("bigint").alias("label"), integers(vector, scale).alias("x"),
        F.coalesce(anchors, F.lit(False)).alias("asked"))
    base = scratch.put(
        rows.where("id IS NOT NULL AND label IS NOT NULL AND x IS NOT NULL").groupBy("id").agg(
            F.min(F.struct("label", "x")).alias("row"), F.max("asked").alias("asked"))
        .select("id", "row.label", "row.x", "asked"), "rows")
    largest = F.coalesce(F.array_max(F.transform("x", lambda v: F.abs(v))), F.lit(0))
    shape = base.groupBy(F.size("x").alias("dim")).agg(F.count("*").alias("n"), F.max(largest).alias("largest")).orderBy(
        F.col("n").desc(), F.col("dim").desc()).first()
    if shape is None:
        return spark.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, "
                                         "positive_score bigint, negative_score bigint")
    dim, bound = shape["dim"], max(1, shape["dim"] * shape["largest"] ** 2)
    if bound > LARGEST_SCORE:
        raise ValueError(f"scores up to {bound} are possible, more than {LARGEST_SCORE}")
    base = base.where(F.size("x") == dim)
    asked = base.where("asked")
    candidates = scratch.put(packed(base, dim, block_bytes), "candidates")
    blocks = scratch.put(packed(asked, dim, anchor_bytes), "anchors")
    positives = scratch.put(best_of(
        tiles(candidates, blocks).mapInArrow(
            _positives(bound, dim, n_positive), "anchor_id bigint, positive_id bigint, positive_score bigint"),
        ("anchor_id",), "positive_id", "positive_score", n_positive), "positives")
    # Of each anchor its few positives, in lists filled up to one length.
    listed = F.array_sort(F.collect_list(F.struct("rank", "positive_id", "positive_score")))

    def filled(name: str) -> Column:
        return F.concat(F.col(f"found.{name}"), F.array_repeat(F.lit(0).cast("bigint"), F.lit(n_positive) - F.size("found")))

    windows = positives.groupBy(F.col("anchor_id").alias("id")).agg(listed.alias("found")).select(
        "id", filled("positive_id").alias("positives"), filled("positive_score").alias("marks"),
        F.array(F.size("found").cast("bigint")).alias("n_positives"))
    with_windows = scratch.put(packed(asked.join(windows, "id"), dim, anchor_bytes, ("positives", "marks", "n_positives")),
                               "windows")
    found = tiles(candidates, with_windows).mapInArrow(
        _negatives(bound, dim, n_negative, low, high, n_positive),
        "anchor_id bigint, positive_id bigint, positive_score bigint, negative_id bigint, negative_score bigint")
    return best_of(found, ("anchor_id", "positive_id"), "negative_id", "negative_score", n_negative).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
