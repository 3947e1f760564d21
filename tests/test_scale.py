"""Plan shapes and behaviour under skew."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from checks.views import Views
from waybill.operators import attempts, delivery, lookups, milestones as mst, pickup


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def views(spark, sf_dir):
    return Views(spark, sf_dir)


def test_milestones_shuffle_once(views):
    text = plan(mst.milestones(views.tracking, mst.ALL_GAPS))
    assert text.count("Exchange") == 1 and text.count("FileScan") == 1
    assert "partial_min" in text and "SortAggregate" not in text


def test_snapshot_filter_reaches_the_scan(spark, sf_dir):
    text = plan(entry.queries()["scan_snapshot"](spark, sf_dir))
    assert "PushedFilters: [IsNotNull(l_shipdate), EqualTo(l_shipdate" in text
    assert "l_extendedprice" not in text


def test_partition_pruning(spark, tmp_path):
    from waybill.sources.scans import snapshot
    day = dt.date(2024, 1, 30)
    spark.createDataFrame([(1, day), (2, dt.date(2024, 1, 29))], "id int, grass_date date") \
        .write.partitionBy("grass_date").parquet(str(tmp_path / "t"))
    df = snapshot(spark.read.parquet(str(tmp_path / "t")), dt.date(2024, 1, 31))
    assert "PartitionFilters: [isnotnull(grass_date" in plan(df)
    assert [r.id for r in df.collect()] == [1]


def test_attempts_are_limited_before_the_shuffle(views):
    text = plan(attempts.attempts_wide(views.tracking, "F650"))
    assert "Partial" in text and text.count("WindowGroupLimit") == 2
    assert text.count("FileScan") == 1


def test_dashboard_reads_orders_once(spark, sf_dir):
    assert plan(entry.queries()["dom_pu_dashboard"](spark, sf_dir)).count("FileScan") == 1
    assert plan(entry.queries()["dom_pu_scorecard"](spark, sf_dir)).count("FileScan") == 1


HOT = 20000


@pytest.fixture(scope="module")
def hot_log(spark):
    """A third of the log belongs to parcel 7."""
    ids = spark.range(3 * HOT)
    return ids.select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 5000 + 10).alias("log_id"),
        F.lit("F650").alias("tracking_code"), (F.col("id") + 100).alias("actual_time"),
        (F.col("id") + 50).alias("ctime"),
        F.concat(F.lit("r"), F.col("id") % 4).alias("reason_description"))


def test_hot_parcel_attempts(hot_log):
    row = attempts.attempts_wide(hot_log, "F650").where("log_id = 7").head()
    got = [int((row[f"dli_{i}_time"] - dt.datetime(1970, 1, 1)).total_seconds()) + 3600
           for i in (1, 2, 3)]
    assert got == [100, 103, 106]


def test_hot_key_lookups_agree(spark, hot_log):
    dim = spark.range(6000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    plain = hot_log.join(dim, hot_log.log_id == dim.k, "left").agg(F.sum("v"), F.count("*")).head()
    spread = lookups.spread_join(hot_log, dim, {"log_id": "k"}, ["v"], hot_log.columns, salts=8)
    assert tuple(spread.agg(F.sum("v"), F.count("*")).head()) == tuple(plain)
    assert set(spread.columns) == set(hot_log.columns) | {"v"}


def test_count_by_key_equals_window(spark, hot_log):
    from pyspark.sql import Window
    keyed = hot_log.withColumn("g", F.when(F.col("log_id") == 7, None).otherwise(
        F.col("log_id") % 3))
    ours = lookups.count_by_key(keyed, ["g"], "n")
    windowed = keyed.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("g")))
    assert ours.groupBy("g").agg(F.max("n"), F.count("*")).exceptAll(
        windowed.groupBy("g").agg(F.max("n"), F.count("*"))).count() == 0


SHUFFLED = ["rep_weekly_delivery", "rep_yearly_all_carriers", "rep_economy_penalty",
            "rep_express_penalty", "dom_fee_recon", "rep_case_sheet", "rep_backlog_detail",
            "dom_pending_pick", "win_count_partition", "join_role_dims"]


@pytest.mark.parametrize("name", SHUFFLED)
def test_same_rows_without_broadcast(spark, sf_dir, name):
    """Beyond the broadcast threshold every lookup is a sort-merge join."""
    run = entry.queries()[name]
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = {k: spark.conf.get(k) for k in keys}
    want = sorted(map(str, run(spark, sf_dir).collect()))
    try:
        for k in keys:
            spark.conf.set(k, "-1")
        df = run(spark, sf_dir)
        assert "BroadcastExchange" not in plan(df)
        assert sorted(map(str, df.collect())) == want
    finally:
        for k, value in before.items():
            spark.conf.set(k, value)


def test_area_matches_equal_the_pairwise_join(spark, views):
    orders = views.fx_orders
    listed = orders.where("seller_city = 'City 1'")
    by_pair = delivery.area_exposure_listed(orders, listed, {"s": F.col("seller_state")})
    pairs = orders.select("seller_state", *[F.col(c).alias(f"o_{c}") for c in delivery.PAIR]).join(
        listed.select(*[F.col(c).alias(f"l_{c}") for c in delivery.PAIR]),
        [F.col(f"o_{c}") == F.col(f"l_{c}") for c in delivery.PAIR], "left")
    direct = pairs.groupBy("seller_state").agg(F.count("l_seller_state").alias("n"))
    assert {(r[0], r[1]) for r in by_pair.collect()} == {(r[0], r[1]) for r in direct.collect()}


def test_empty_scope(spark, views):
    rows = pickup.breakdown(views.created, "week", ["fromprovince"], dt.date(2030, 1, 1),
                            dt.date(2029, 1, 1), dt.date(2029, 2, 1))
    assert rows.count() == 0
