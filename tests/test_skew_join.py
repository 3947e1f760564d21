"""Joins on skewed keys: hot keys are found and split, null keys dealt out, nothing else copied."""

import statistics

import pytest
from pyspark.sql import functions as F

from waybill.operators import lookups

N, SHOPS = 60_000, 3000


@pytest.fixture()
def sort_merge(spark):
    """No broadcast and no run-time help: what a task gets is what the join itself gives it."""
    keys = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false",
            "spark.sql.shuffle.partitions": "24"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def orders(spark, hot_share=3, null_of_100=0):
    """One shop holds a third of the rows; of 100 rows some have no key."""
    i = F.col("id")
    shop = F.when(i % 100 < null_of_100, None).when(F.lit(hot_share > 0) & (i % 3 == 0), 7).otherwise(i % SHOPS + 10)
    return spark.range(N).select(i.alias("order_id"), shop.cast("int").alias("shop_id"))


def shops(spark):
    return spark.range(SHOPS + 20).select(F.col("id").alias("shop"), (F.col("id") * 2).alias("name"))


def per_task(df):
    return [r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()]


def same(a, b):
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_hot_shop_is_split(spark, sort_merge):
    big, small = orders(spark), shops(spark)
    hot = lookups.hot_keys(big, ["shop_id"])
    joined = lookups.skew_join(big, small, {"shop_id": "shop"}, ["name"], ["order_id"], hot)
    plain = big.join(small, big.shop_id == small.shop, "left").select("order_id", "shop_id", "name")
    assert same(joined.select("order_id", "shop_id", "name"), plain)
    tasks = per_task(joined)
    assert max(tasks) <= 3 * statistics.median(tasks)
    assert max(per_task(plain)) > 6 * statistics.median(per_task(plain))


def test_rows_without_a_key_are_dealt_out(spark, sort_merge):
    big, small = orders(spark, 0, 95), shops(spark)
    joined = lookups.skew_join(big, small, {"shop_id": "shop"}, ["name"], ["order_id"])
    plain = big.join(small, big.shop_id == small.shop, "left").select("order_id", "shop_id", "name")
    assert same(joined.select("order_id", "shop_id", "name"), plain)
    tasks = per_task(joined)
    assert max(tasks) <= 3 * statistics.median(tasks) and max(per_task(plain)) > 0.9 * N
    inner = lookups.skew_join(big, small, {"shop_id": "shop"}, ["name"], ["order_id"], how="inner")
    assert inner.count() == plain.where("name IS NOT NULL").count()


def test_only_hot_keys_are_copied(spark):
    small, on = shops(spark), {"shop_id": "shop"}

    def copies(big):
        types = {"shop_id": big.schema["shop_id"].dataType}
        return lookups.copied_for(small, types, on, ["name"], lookups.hot_keys(big, ["shop_id"]), 16).count()

    assert copies(orders(spark, hot_share=0)) == small.count()
    assert copies(orders(spark)) == small.count() + 15
    assert copies(orders(spark, 0, 95)) == small.count()  # null is no key
    assert copies(orders(spark).where("false")) == small.count()


def test_sketch_finds_every_hot_key(spark):
    rows = spark.range(N).select(F.when(F.col("id") % 5 < 2, F.col("id") % 5).otherwise(F.col("id") + 10).alias("k"),
                                 F.lit("x").alias("s"))
    found = spark.range(1).select(lookups.hot_keys(rows, ["k", "s"], share=0.05).alias("hot"))
    want = spark.createDataFrame([(0, "x"), (1, "x")], "k bigint, s string").select(F.xxhash64("k", "s"))
    assert set(found.first()[0]) == {r[0] for r in want.collect()}
    with pytest.raises(ValueError):
        lookups.hot_keys(rows, ["k"], share=0.001, most=10)


def test_sketch_runs_once(spark):
    big = orders(spark)
    joined = lookups.skew_join(big, shops(spark), {"shop_id": "shop"}, ["name"], ["order_id"],
                               lookups.hot_keys(big, ["shop_id"]))
    joined.collect()
    text = joined._jdf.queryExecution().executedPlan().toString()
    assert "ReusedSubquery" in text
