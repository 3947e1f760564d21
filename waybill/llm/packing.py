"""Best-fit packing by hierarchical residual packing.

Documents become token pieces; pieces are packed by best fit, longest first, inside bounded groups.  Bins that are nearly
full leave as sequences, and so do those into which not even the smallest bin left anywhere would fit.  Underfull bins are
the items of the next round, in fewer, merged groups, and so on up the tree, as long as a merged group stays within a
bound.  Groups are dealt by hash, so each holds the same mixture; where the bound ends the tree early, a group of that size
leaves a few underfull bins more than a single one would.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import Scratch, map_texts
from .vocab import json_encoder

MEMBERS = "array<struct<doc_id:bigint,piece:int,start:bigint,length:bigint,ids_crc32:bigint,offset:bigint>>"


def token_pieces(docs: DataFrame, path: str, size: int, end_id: int = 0, key: str = "doc_id",
                 text: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: a document's ids and ``end_id``, cut only where longer than ``size``.

    Of a longer document the first piece takes the remainder, so all others are full.
    """

    def run(keys: list, texts: list[bytes]) -> dict:
        encoder, end = json_encoder(path), np.uint32(end_id).astype("<u4").tobytes()
        out: dict[str, list] = {n: [] for n in ("doc_id", "piece", "start", "length", "ids_crc32")}
        for k, t in zip(keys, texts, strict=True):
            ids = encoder.ids(t.decode("utf-8", "replace")) + end
            total = len(ids) // 4
            first = total % size or size
            cuts = [0, *range(min(first, total), total, size), total]
            for piece, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                for name, value in zip(out, (k, piece, a, b - a, zlib.crc32(ids[4 * a: 4 * b])), strict=True):
                    out[name].append(value)
        return out

    return map_texts(docs.withColumn("doc_id", F.col(key).cast("bigint")), run,
                     "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint", "doc_id", text)


def best_fit(levels: np.ndarray, size: int) -> np.ndarray:
    """Bin number of each item: longest first, into the fullest bin that still takes it.

    Rooms are whole numbers up to ``size``, so one bit per room finds the tightest bin in constant time.
    """
    bins = np.empty(len(levels), np.int64)
    open_bins: list[list[int]] = [[] for _ in range(size + 1)]
    mask, made = 0, 0
    for i in np.argsort(-levels, kind="stable").tolist():
        need = int(levels[i])
        fits = mask >> need
        if fits:
            room = need + (fits & -fits).bit_length() - 1
            b = open_bins[room].pop()
            if not open_bins[room]:
                mask &= ~(1 << room)
        else:
            room, b, made = size, made, made + 1
        bins[i] = b
        left = room - need
        if left:
            open_bins[left].append(b)
            mask |= 1 << left
    return bins


def _pack_group(size: int, number: int):
    """The function that packs one group of round ``number``; members get their place in the new bin."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("place", kind="stable")
        levels = frame["level"].to_numpy(np.int64)
        made = best_fit(levels, size)
        members: list[list] = [[] for _ in range(int(made.max()) + 1)]
        level = [0] * len(members)
        for b, own, m in zip(made.tolist(), levels.tolist(), frame["members"], strict=True):
            for x in m:
                x["offset"] += level[b]
            members[b].extend(m)
            level[b] += own
        ids = (number << 56) + (int(frame["bucket"].iloc[0]) << 28) + np.arange(len(level))
        return pd.DataFrame({"level": level, "members": members, "place": ids})

    return run


def pack(pieces: DataFrame, size: int, group_rows: int = 10_000, fan_in: int = 8, nearly_full: float = 0.998,
         most_rows: int = 40_000) -> DataFrame:
    """Sequences of at most ``size`` tokens: the pieces with ``sequence_id`` and ``offset``.

    ``group_rows`` is what one task packs at first; each further round merges ``fan_in`` groups, fewer where a group would
    pass ``most_rows``, and the round in which nothing merges any more is the last.  A bin whose fill is at least
    ``nearly_full`` leaves at once.  Every piece comes out exactly once; repeated rows are packed row by row.
    """
    spark = pieces.sparkSession
    scratch = Scratch(spark)
    pieces = scratch.put(pieces, "pieces")
    full = pieces.where(F.col("length") >= size)
    rest = pieces.where(F.col("length") < size)
    # Rows are dealt out by their place in the written table: even, whatever their keys, and the same when repeated.
    zero = F.lit(0).cast("bigint").alias("offset")
    items = rest.select(F.col("length").alias("level"), F.array(F.struct(*pieces.columns, zero)).alias("members"),
                        F.monotonically_increasing_id().alias("place"))
    groups = max(1, -(-rest.count() // group_rows))
    finished, number, merging = [], 0, True
    while merging:
        packed = scratch.put(
            items.withColumn("bucket", F.pmod(F.xxhash64("place"), F.lit(groups)).cast("int"))
            .groupBy("bucket").applyInPandas(_pack_group(size, number), f"level bigint, members {MEMBERS}, place bigint"),
            f"round{number}")
        open_bins = packed.where(F.col("level") < nearly_full * size)
        least = open_bins.agg(F.min("level")).first()[0]
        # a bin is done if it is nearly full, or if even the smallest one left would not fit into it
        done = (F.col("level") >= nearly_full * size) | (F.col("level") + F.lit(least or 0) > size)
        left = packed.where(~done).count()
        fewer = max(-(-groups // fan_in), -(-left // most_rows))
        merging = left > 0 and fewer < groups
        finished.append(packed.where(done) if merging else packed)
        items, groups, number = packed.where(~done).select("level", "members", "place"), fewer, number + 1

    done = finished[0]
    for more in finished[1:]:
        done = done.unionByName(more)
    placed = done.select(F.col("place").alias("sequence_id"), F.explode("members").alias("m")).select("sequence_id", "m.*")
    alone = full.select(
        (F.lit(127 << 56) + F.monotonically_increasing_id()).alias("sequence_id"), *pieces.columns,
        F.lit(0).cast("bigint").alias("offset"))
    return placed.unionByName(alone)


def pack_documents(docs: DataFrame, path: str, size: int = 2048, **options) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` per piece of every document.

    A null text is an empty document: the end id alone.  Null keys and repeated rows are packed like any other row.
    """
    return pack(token_pieces(docs, path, size), size, **options)
