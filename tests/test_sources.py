"""Scans over catalog tables, partitioned files and exported sheets."""

import datetime as dt

import pytest

from waybill.session import build_session, use_report_clock
from waybill.sources import marts, scans


@pytest.fixture(scope="module")
def daily(spark, tmp_path_factory):
    """Three daily snapshots of two regions, partitioned as in the marts."""
    path = str(tmp_path_factory.mktemp("mart") / "parcel")
    rows = [(i, day, region) for i in range(4) for day in (
        dt.date(2024, 1, 28), dt.date(2024, 1, 29), dt.date(2024, 1, 30))
        for region in ("VN", "TH")]
    spark.createDataFrame(rows, "log_id int, grass_date date, grass_region string") \
        .write.partitionBy("grass_date", "grass_region").parquet(path)
    return spark.read.parquet(path)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_snapshot_lags(daily):
    as_of = dt.date(2024, 1, 31)
    assert {r.grass_date for r in scans.snapshot(daily, as_of).collect()} == {
        dt.date(2024, 1, 30)}
    assert {r.grass_date for r in scans.snapshot(daily, as_of, lag=2).collect()} == {
        dt.date(2024, 1, 29)}
    assert scans.snapshot(daily, as_of, lag=9).count() == 0


def test_range_prunes_partitions(daily):
    kept = scans.partition_range(daily, dt.date(2024, 1, 28), "VN", inclusive=False)
    assert {(r.grass_date.day, r.grass_region) for r in kept.collect()} == {(29, "VN"), (30, "VN")}
    text = plan(kept)
    assert "PartitionFilters: [" in text and "PushedFilters: []" in text
    assert scans.partition_range(daily, dt.date(2024, 1, 29)).count() == 16


@pytest.mark.parametrize("fmt, options", [
    ("csv", {"header": "true"}), ("json", {}), ("orc", {}), ("parquet", {})])
def test_sheet_formats(spark, tmp_path, daily, fmt, options):
    path = str(tmp_path / fmt)
    spark.createDataFrame([("1",), ("3",)], "order_code string").write.format(fmt).options(
        **options).save(path)
    sheet = scans.read_files(spark, path, fmt, "order_code string", **options)
    kept = scans.restrict_to_ids(
        daily.withColumn("code", daily.log_id.cast("string")), "code", sheet)
    assert {r.log_id for r in kept.collect()} == {1, 3} and kept.count() == 12


def test_catalog_table(spark, daily):
    daily.createOrReplaceTempView("parcel_daily")
    assert scans.read_table(spark, "parcel_daily").count() == 24


def test_calendar_is_broadcast(spark, daily):
    days = scans.calendar(spark, ["2024-01-29", "2024-01-29", "2024-01-30"])
    assert days.count() == 2
    joined = daily.join(days, daily.grass_date == days.sla_date)
    assert "BroadcastHashJoin" in plan(joined) and "SortMergeJoin" not in plan(joined)


def test_latest_version_subquery_is_reused(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b")], "ingestion_timestamp int, k string")
    assert sorted(r.k for r in scans.latest_version(df).collect()) == ["a", "b"]


def test_addresses_and_order_numbers(spark):
    df = spark.createDataFrame(
        [("s", "c", ["SN1", "SN2"])],
        "seller_shipping_address_state string, buyer_shipping_address_city string, "
        "ordersn_list array<string>")
    assert marts.short_addresses(df).columns[:2] == ["seller_state", "buyer_city"]
    assert marts.single_order_sn(df).head().order_sn == "SN1, SN2"


def test_session_settings(spark):
    session = build_session("again")
    assert session.conf.get("spark.sql.adaptive.skewJoin.enabled") == "true"
    session.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    assert use_report_clock(session).conf.get("spark.sql.session.timeZone") == "UTC"
