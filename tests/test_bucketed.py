"""Tables in buckets: no shuffle between the log's aggregate and the parcel join; hot keys are not put into buckets."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from checks.views import Views
from waybill.operators import milestones as mst
from waybill.sources import bucketed, scans


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def marts(spark, sf_dir):
    spark.sql("CREATE DATABASE IF NOT EXISTS waybill_buckets")
    v = Views(spark, sf_dir)
    yield {"log": v.tracking, "parcel": v.parcel, "views": v}
    spark.sql("DROP DATABASE waybill_buckets CASCADE")


@pytest.fixture(scope="module")
def tables(spark, marts):
    for name in ("log", "parcel"):
        assert bucketed.write_bucketed(marts[name], f"waybill_buckets.{name}", "log_id", 8, share=0.2)
        assert bucketed.bucketed_on(spark, f"waybill_buckets.{name}") == ["log_id"]
    return {name: scans.read_table(spark, f"waybill_buckets.{name}") for name in ("log", "parcel")}


def joined(log, parcel):
    return mst.milestones(log, mst.DELIVERY).join(parcel.select("log_id", "lm_tracking_no", "order_id"), "log_id")


def test_no_exchange_between_log_and_parcels(spark, marts, tables):
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")}
    try:
        for k in before:
            spark.conf.set(k, "-1")
        stored, loose = joined(tables["log"], tables["parcel"]), joined(marts["log"], marts["parcel"])
        assert "Exchange" not in plan(stored) and "SortMergeJoin" in plan(stored)
        assert "Exchange" in plan(loose)
        got, want = (sorted(map(repr, df.select(sorted(df.columns)).collect())) for df in (stored, loose))
    finally:
        for k, value in before.items():
            spark.conf.set(k, value)
    assert got == want and got


@pytest.mark.parametrize("key", ["CASE WHEN id % 3 = 0 THEN 7 ELSE id END", "CASE WHEN id % 3 > 0 THEN id END"])
def test_hot_and_missing_keys_are_saved_plainly(spark, marts, key):
    rows = spark.range(3000).select(F.expr(key).alias("log_id"), F.col("id").alias("n"))
    assert not bucketed.write_bucketed(rows, "waybill_buckets.hot", "log_id", 8)
    kept = scans.read_table(spark, "waybill_buckets.hot")
    assert bucketed.bucketed_on(spark, "waybill_buckets.hot") == []
    assert kept.count() == 3000 and kept.agg(F.sum("n")).first()[0] == 3000 * 2999 // 2


def test_one_file_per_bucket_and_empty_tables(spark, marts):
    rows = spark.range(5000).select(F.col("id").alias("log_id"))
    assert bucketed.write_bucketed(rows, "waybill_buckets.even", "log_id", 4)
    kept = scans.read_table(spark, "waybill_buckets.even")
    assert len(kept.inputFiles()) == 4 and kept.count() == 5000
    assert bucketed.write_bucketed(rows.limit(0), "waybill_buckets.none", "log_id", 4)
    assert scans.read_table(spark, "waybill_buckets.none").count() == 0


@pytest.mark.parametrize("values", [[], [1], ["2", "3"], [None], [1, None], list(range(5000))])
def test_parameter_lists(spark, values):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (None, "d")], "`an id` int, name string")
    got = scans.restrict_by_parameter(df, "an id", values)
    wanted = {int(v) for v in values if v is not None}
    assert sorted(r[0] for r in got.collect()) == sorted(n for n in (1, 2, 3) if n in wanted)
    assert got.columns == df.columns


def test_parameter_lists_of_text_are_values_only(spark):
    df = spark.createDataFrame([("a'); DROP", 1), ("b", 2)], "code string, n int")
    assert [r.n for r in scans.restrict_by_parameter(df, "code", ["a'); DROP"]).collect()] == [1]
    days = spark.createDataFrame([(dt.date(2024, 1, 5),), (dt.date(2024, 1, 6),)], "d date")
    assert scans.restrict_by_parameter(days, "d", [dt.date(2024, 1, 6)]).count() == 1
