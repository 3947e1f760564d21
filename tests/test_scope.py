"""Partitions that reports read: snapshots, ranges, and days that are known only from data."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from checks.views import Views
from waybill.functions import times
from waybill.operators import milestones as mst
from waybill.plans import delivery, penalty
from waybill.sources import scans
from waybill.sources.scans import Scope

AS_OF = dt.date(2024, 1, 31)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def files_read(df):
    """Files of all scans that ran, by the metrics of the executed plan."""
    df.collect()
    node, total = df._jdf.queryExecution().executedPlan(), 0
    todo = [node]
    while todo:
        at = todo.pop()
        name = at.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(at.executedPlan())
            continue
        if name.endswith("QueryStageExec"):
            todo.append(at.plan())
            continue
        if name == "FileSourceScanExec":
            total += at.metrics().apply("numFiles").value()
        children = at.children()
        todo += [children.apply(i) for i in range(children.size())]
    return total


@pytest.fixture(scope="module")
def views(spark, sf_dir):
    return Views(spark, sf_dir)


@pytest.fixture(scope="module")
def daily(spark, views, tmp_path_factory):
    """The marts as they are kept: snapshots by day, orders and the log by the day of their rows."""
    top = str(tmp_path_factory.mktemp("marts"))
    yesterday, before = (F.lit(AS_OF - dt.timedelta(days=n)) for n in (1, 2))

    def stored(name, df):
        df.write.partitionBy("grass_date").parquet(f"{top}/{name}")
        return spark.read.parquet(f"{top}/{name}")

    def snapshots(name, df):  # the older one lacks half of the rows
        return stored(name, df.withColumn("grass_date", yesterday).unionByName(
            df.where("log_id % 2 = 0").withColumn("grass_date", before)))

    scans.write_by_day(views.tracking, f"{top}/log", F.to_date(F.timestamp_seconds("actual_time")), spread="log_id", files=2)
    orders = views.fx_orders.withColumn("grass_date", F.to_date(F.timestamp_seconds("create_timestamp")))
    scans.write_by_day(orders, f"{top}/orders", F.col("grass_date"), files=1)
    return {"log": spark.read.parquet(f"{top}/log"), "orders": spark.read.parquet(f"{top}/orders"),
            "parcel": snapshots("parcel", views.parcel), "fulfilment": snapshots("fulfilment", views.fulfilment)}


def report(v, orders, fulfilment, parcel, log, scope=None):
    facts = delivery.parcel_facts(orders, fulfilment, parcel, log, scope=scope)
    base = delivery.with_allowance(facts, v.sla, v.extend, v.routes, v.holiday)
    return delivery.weekly_delivery(base, "2024-01-01", "2024-02-20")


def rows(df):
    return sorted(map(repr, df.collect()))


def test_report_over_partitioned_marts(views, daily):
    scope = Scope(AS_OF, orders_since=dt.date(2023, 1, 1), log_since=dt.date(2024, 1, 1))
    scoped = report(views, daily["orders"], daily["fulfilment"], daily["parcel"], daily["log"], scope)
    plain = report(views, views.fx_orders, views.fulfilment, views.parcel, views.tracking)
    assert plan(scoped).count("PartitionFilters: [isnotnull(grass_date") == 4
    assert rows(scoped) == rows(plain)
    assert rows(report(views, views.fx_orders, views.fulfilment, views.parcel, views.tracking, scope)) == rows(plain)


def test_scope_bounds_what_is_read(views, daily):
    scope = Scope(AS_OF, orders_since=dt.date(2024, 1, 10), log_since=dt.date(2024, 1, 5), log_until=dt.date(2024, 1, 6))
    assert {r.grass_date for r in scope.snapshot(daily["parcel"]).select("grass_date").distinct().collect()} == {
        AS_OF - dt.timedelta(days=1)}
    assert files_read(scope.log(daily["log"]).groupBy().count()) <= 2 * 2
    assert scope.orders(daily["orders"]).agg(F.min("grass_date")).first()[0] == dt.date(2024, 1, 11)
    assert scope.snapshot(daily["parcel"].drop("grass_date")).count() == daily["parcel"].count()


def test_days_known_from_data_prune_the_log(spark, daily, tmp_path):
    """A month of a date table: the semi join reads the directories of its days only."""
    dates = spark.range(60).select(F.date_add(F.lit("2023-12-20").cast("date"), F.col("id").cast("int")).alias("day"))
    dates.withColumn("week", F.weekofyear("day")).write.parquet(str(tmp_path / "dates"))
    days = scans.days_of(spark.read.parquet(str(tmp_path / "dates")), F.col("week") == 2)
    question = mst.milestones(scans.restrict_to_days(daily["log"], days), mst.DELIVERY)
    text = plan(question)
    assert "dynamicpruning" in text.split("PartitionFilters: [", 1)[1].split("]", 1)[0]
    every = daily["log"].select(F.input_file_name()).distinct().count()
    read = files_read(question)
    assert read <= 7 * 2 + 1 < every
    first, last = dt.date(2024, 1, 8), dt.date(2024, 1, 14)
    direct = mst.milestones(daily["log"].where(F.col("grass_date").between(F.lit(first), F.lit(last))), mst.DELIVERY)
    assert rows(question) == rows(direct)


def test_months_before():
    assert times.months_before(dt.date(2024, 3, 31), 1) == dt.date(2024, 2, 29)
    assert times.months_before(dt.date(2024, 1, 15), 3, whole=True) == dt.date(2023, 10, 1)
    assert times.months_before(dt.date(2024, 12, 5), 12) == dt.date(2023, 12, 5)
    assert times.months_before(dt.date(2024, 5, 5), 0) == dt.date(2024, 5, 5)


def test_creation_bound_reaches_the_scan(spark, views, tmp_path):
    views.fx_orders.write.parquet(str(tmp_path / "orders"))
    stored = spark.read.parquet(str(tmp_path / "orders"))
    times_ = mst.milestones(views.tracking, mst.EXPRESS_PENALTY, listed_only=True)
    base = penalty.penalty_base(stored, views.logistic, views.logistic_data, times_, views.oms, views.warehouse, 50015, False,
                                dt.date(2024, 1, 5))
    bound = (dt.date(2024, 1, 5) - dt.date(1970, 1, 1)).days * 86_400 + 3600  # midnight of the report clock
    old = spark.conf.get("spark.sql.maxMetadataStringLength")
    try:
        spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
        assert f"GreaterThanOrEqual(create_timestamp,{bound})" in plan(base)
    finally:
        spark.conf.set("spark.sql.maxMetadataStringLength", old)
