"""Distinct orders by bitmaps: exact at every grain, over a year's end, merged in any order, numbered day by day."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from waybill.functions.times import period_start
from waybill.operators import bitmaps

NAMES = ["orders", "late"]


def flags():
    return dict(zip(NAMES, (F.lit(True), F.col("late"))))


@pytest.fixture(scope="module")
def orders(spark):
    pick = random.Random(3)
    start = dt.date(2023, 12, 4)
    rows = [(pick.choice([None] * 3 + [f"o{pick.randrange(900)}"] * 60 + ["hot"] * 30), start + dt.timedelta(pick.randrange(60)),
             pick.choice([True, False, None]), pick.choice(["a", "b", None])) for _ in range(6000)]
    rows += [("o1", None, True, "a"), ("only without a day", None, False, "b")]
    return spark.createDataFrame(rows, "code string, day date, late boolean, area string")


@pytest.fixture(scope="module")
def numbers(orders):
    return bitmaps.order_numbers(orders, "code", "day", parts=3)


def plain(orders, key):
    return sorted(map(repr, orders.where("code IS NOT NULL").groupBy(key.alias("k")).agg(
        F.count_distinct("code").alias("orders"), F.count_distinct(F.when(F.col("late"), F.col("code"))).alias("late")).collect()))


def test_numbers_are_dense_and_unique(orders, numbers):
    rows = numbers.collect()
    assert len(rows) == len({r.code for r in rows}) == orders.where("code IS NOT NULL").select("code").distinct().count()
    slots = {}
    for r in rows:
        slots.setdefault((r.number_day, r.number_part), []).append(r.number)
    assert all(sorted(n) == list(range(1, len(n) + 1)) for n in slots.values())


@pytest.mark.parametrize("grain", ["day", "week", "month", "total"])
def test_counts_at_every_grain(orders, numbers, grain):
    daily = bitmaps.daily_bitmaps(orders, numbers, "code", ["day"], flags())
    key = F.lit("total") if grain == "total" else period_start("day", grain)
    got = bitmaps.distinct_counts(daily, {"k": key}, NAMES)
    assert sorted(map(repr, got.collect())) == plain(orders, key)


def test_areas_merge_into_a_total(orders, numbers):
    daily = bitmaps.daily_bitmaps(orders, numbers, "code", ["day", "area"], flags())
    by_area = bitmaps.merge_bitmaps(daily, {"area": F.col("area")}, NAMES)
    assert sorted(map(repr, bitmaps.distinct_counts(by_area, {"k": F.col("area")}, NAMES).collect())) == plain(
        orders, F.col("area"))
    total = bitmaps.distinct_counts(by_area, {}, NAMES).first()
    assert total.orders == orders.select("code").where("code IS NOT NULL").distinct().count()


def test_day_by_day_equals_one_pass(spark, orders, tmp_path):
    """Numbers and bitmaps kept as tables; the days come in a mixed order, each once."""
    known, daily = str(tmp_path / "numbers"), str(tmp_path / "bitmaps")
    cut = [F.col("day") >= "2024-01-10", F.col("day") < "2023-12-20",
           F.col("day").isNull() | ((F.col("day") >= "2023-12-20") & (F.col("day") < "2024-01-10"))]
    for n, part in enumerate(cut):
        rows = orders.where(part)
        before = spark.read.parquet(known) if n else None
        bitmaps.order_numbers(rows, "code", "day", before, parts=3).write.mode("append").parquet(known)
        bitmaps.daily_bitmaps(rows, spark.read.parquet(known), "code", ["day"], flags()).write.mode("append").parquet(daily)
    kept = spark.read.parquet(known)
    assert kept.count() == kept.select("code").distinct().count() == kept.select(*bitmaps.SLOT, "number").distinct().count()
    for grain in ("week", "month"):
        key = period_start("day", grain)
        got = bitmaps.distinct_counts(spark.read.parquet(daily), {"k": key}, NAMES)
        assert sorted(map(repr, got.collect())) == plain(orders, key)


def test_more_numbers_than_one_bitmap_holds(spark):
    many = spark.range(70_000).select(F.col("id").cast("string").alias("code"), F.lit(dt.date(2024, 1, 1)).alias("day"),
                                      (F.col("id") % 3 == 0).alias("late"))
    numbers = bitmaps.order_numbers(many, "code", "day", parts=1)
    daily = bitmaps.daily_bitmaps(many, numbers, "code", ["day"], flags())
    assert daily.count() == 3  # cells of 32,768 numbers
    assert bitmaps.distinct_counts(daily, {}, NAMES).first().asDict() == {"orders": 70_000, "late": 23_334}


def test_orders_with_rows_on_far_days(spark):
    """Most cells hold one order then: a bitmap takes room for its orders, not for all numbers of its block."""
    pick, start = random.Random(5), dt.date(2023, 1, 1)
    rows = [(f"o{n}", start + dt.timedelta(pick.randrange(700)), pick.random() < 0.3) for n in range(800) for _ in range(3)]
    far = spark.createDataFrame(rows, "code string, day date, late boolean")
    daily = bitmaps.daily_bitmaps(far, bitmaps.order_numbers(far, "code", "day"), "code", ["day"], flags())
    assert daily.count() > 2000
    assert daily.select(F.max(F.length(F.to_json(F.struct(*NAMES))))).first()[0] < 200
    for grain in ("day", "week", "month"):
        key = period_start("day", grain)
        assert sorted(map(repr, bitmaps.distinct_counts(daily, {"k": key}, NAMES).collect())) == plain(far, key)
    weekly = bitmaps.merge_bitmaps(daily, {"week": period_start("day", "week")}, NAMES)
    assert sorted(map(repr, bitmaps.distinct_counts(weekly, {"k": F.lit("total")}, NAMES).collect())) == plain(far, F.lit("total"))


def test_empty(orders, numbers):
    none = orders.limit(0)
    daily = bitmaps.daily_bitmaps(none, bitmaps.order_numbers(none, "code", "day"), "code", ["day"], flags())
    assert bitmaps.distinct_counts(daily, {"k": F.col("day")}, NAMES).count() == 0
    assert bitmaps.distinct_counts(daily, {}, NAMES).first().asDict() == {"orders": 0, "late": 0}
