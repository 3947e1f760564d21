"""Exact distinct counts that merge: one bitmap of order numbers per day, joined to weeks, months and totals.

Counts of distinct orders of two days cannot be added up: an order may have rows on both.  Bitmaps can be joined, so each
day is read once and every coarser figure comes out of the small table of bitmaps.  Numbers are given per first day of
an order, which keeps the orders of a day side by side: its bitmaps are full, and later days do not touch them.

A bitmap holds only its words of 64 bits that are in use, so it never has more words than orders: where orders have rows
on far days, most bitmaps hold one or two.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

SLOT = ["number_day", "number_part"]
BLOCK = [*SLOT, "block"]  # 32,768 numbers
CELL = [*BLOCK, "places"]  # the words in use; each flag has as many
WORD = 64


def order_numbers(orders: DataFrame, code: str, day: str, known: DataFrame | None = None, parts: int = 16) -> DataFrame:
    """``code, number_day, number_part, number``: orders numbered from 1 within their first day and part of it.

    A day is cut into ``parts`` by the hash of the code, so that no day is numbered by one task.  ``known`` holds the
    numbers given earlier: only new codes are returned then, numbered after those of the same day, to be appended.  Rows
    without a code get no number; a code without a day is numbered among those without one.
    """
    fresh = orders.where(F.col(code).isNotNull()).groupBy(code).agg(F.min(day).alias("number_day"))
    fresh = fresh.withColumn("number_part", F.pmod(F.xxhash64(code), F.lit(parts)).cast("int"))
    order = Window.partitionBy(*SLOT).orderBy(code)
    if known is None:
        return fresh.withColumn("number", F.row_number().over(order).cast("bigint"))
    used = known.groupBy(F.col("number_day").alias("__day"), F.col("number_part").alias("__part")).agg(
        F.max("number").alias("__used"))
    fresh = fresh.join(known.select(code), code, "left_anti").withColumn("number", F.row_number().over(order).cast("bigint"))
    same_slot = F.col("number_day").eqNullSafe(F.col("__day")) & (F.col("number_part") == F.col("__part"))
    return fresh.join(used, same_slot, "left").withColumn(
        "number", F.col("number") + F.coalesce("__used", F.lit(0))).drop("__day", "__part", "__used")


def daily_bitmaps(orders: DataFrame, numbers: DataFrame, code: str, keys: Sequence[str],
                  flags: Mapping[str, Column]) -> DataFrame:
    """Per combination of ``keys`` (a day and any areas) and cell of the numbering, one bitmap per flag.

    A bit is set if any row of the order in that group satisfies the flag.  Copies of a row are collapsed before the
    numbers are joined, so an order with very many rows is one row per group there.
    """
    marked = orders.where(F.col(code).isNotNull()).select(
        code, *keys, *[F.coalesce(c, F.lit(False)).alias(f"__is_{n}") for n, c in flags.items()])
    once = marked.groupBy(code, *keys).agg(*[F.max(f"__is_{n}").alias(f"__is_{n}") for n in flags])
    numbered = once.join(numbers.select(code, *SLOT, "number"), code)
    position = F.bitmap_bit_position("number")
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (position % WORD).cast("int"))
    words = numbered.select(
        *keys, *SLOT, F.bitmap_bucket_number("number").alias("block"), (position / WORD).cast("smallint").alias("places"),
        *[F.when(F.col(f"__is_{n}"), bit).otherwise(0).alias(n) for n in flags])
    return _bitmaps(words.repartition(*keys, *BLOCK), keys, flags)


def _merged_words(words: DataFrame, keys: Sequence[str], flags: Sequence[str]) -> DataFrame:
    return words.groupBy(*keys, *CELL).agg(*[F.bit_or(n).alias(n) for n in flags])


def _bitmaps(words: DataFrame, keys: Sequence[str], flags: Sequence[str]) -> DataFrame:
    """Words of a bitmap side by side; rows are expected where their block is, so nothing is moved here."""
    columns = ["places", *flags]
    packed = _merged_words(words, keys, flags).groupBy(*keys, *BLOCK).agg(F.collect_list(F.struct(*columns)).alias("__words"))
    return packed.select(*keys, *BLOCK, *[F.col("__words").getField(c).alias(c) for c in columns])


def _words(bitmaps: DataFrame, keys: Mapping[str, Column], flags: Sequence[str]) -> DataFrame:
    """Words of all bitmaps of a block in one task: merging them over any groups needs no further exchange."""
    groups = [c.alias(n) for n, c in keys.items()]
    return bitmaps.repartition(*BLOCK).select(*groups, *BLOCK, F.inline(F.arrays_zip("places", *flags)))


def merge_bitmaps(bitmaps: DataFrame, keys: Mapping[str, Column], flags: Sequence[str]) -> DataFrame:
    """Bitmaps of coarser groups; ``keys`` maps output -> column.  The result can be merged again, in any order."""
    return _bitmaps(_words(bitmaps, keys, flags), list(keys), flags)


def distinct_counts(bitmaps: DataFrame, keys: Mapping[str, Column], flags: Sequence[str]) -> DataFrame:
    """Distinct orders per group and flag.  Without keys it is one row, with 0 for an empty table."""
    merged = _merged_words(_words(bitmaps, keys, flags), list(keys), flags)
    return merged.groupBy(*keys).agg(*[F.coalesce(F.sum(F.bit_count(n)), F.lit(0)).alias(n) for n in flags])
