"""Figures that have to agree with each other, on the test tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from checks.catalog import domain
from checks.views import Views
from waybill.operators import delivery as dlv
from waybill.operators import pickup as pu
from waybill.plans import delivery as rep

AS_OF = dt.date(2024, 1, 31)


@pytest.fixture(scope="module")
def views(spark, sf_dir):
    return Views(spark, sf_dir)


def test_detail_reaggregates_to_kpis(views):
    base = domain.base(views)
    detail = rep.delivery_detail(base, "2023-01-01", "2025-01-01")
    weekly = rep.weekly_delivery(base, "2023-01-01", "2025-01-01")
    on_time = detail.where(F.col("check_late") == "Giao đúng hẹn").count()
    assert weekly.agg(F.sum("gross_ontime_deli_1st")).head()[0] == on_time
    assert weekly.agg(F.sum("gross_deli_request")).head()[0] == detail.count()


def test_kpi_order(views):
    rows = dlv.delivery_kpis(domain.base(views), ["shipping_carrier"]).collect()
    for r in rows:
        assert r.gross_ontime_deli_1st <= r.gross_deli_request
        assert r.gross_ontime_deli_done <= r.gross_deli_done
        assert r.gross_1st_deli_done <= r.gross_deli_done


def test_classes_are_complete(views):
    classes = domain.classified(views)
    counts = {r[0]: r[1] for r in classes.groupBy("check_delivery_ontime").count().collect()}
    assert sum(counts.values()) == classes.count()


def test_total_row_is_sum_of_regions(views):
    base = pu.daily_base(pu.in_scope(views.created), {"ok": pu.ontime_first_v3()},
                         ["fromregionshortname"])
    rolled = pu.with_total(base.withColumn("time", F.weekofyear("order_day")), ["time"],
                           "fromregionshortname", "T", {"ok": "ok"}).collect()
    sums = {r.time: r for r in base.groupBy(F.weekofyear("order_day").alias("time")).agg(
        F.sum("ok").alias("ok"), F.sum("orders").alias("orders")).collect()}
    totals = [r for r in rolled if r.is_total]
    assert len(totals) == len(sums)
    for r in totals:
        assert r.ok == pytest.approx(sums[r.time].ok / sums[r.time].orders, abs=1e-4)


def test_late_and_on_time_add_up(views):
    rows = pu.pending_pick(views.created, views.ward, AS_OF).collect()
    assert rows and all(r.ontime_orders + r.late_orders == r.total_orders for r in rows)


def test_contributions_add_up_to_the_late_share(views):
    table = pu.breakdown(views.created, "month", ["fromprovince"], AS_OF, dt.date(2024, 1, 1),
                         dt.date(2024, 1, 30))
    r = table.agg(F.sum("first_contribution").alias("c"),
                  (1 - F.sum("first_ok") / F.sum("volume_created")).alias("late")).head()
    assert r.c == pytest.approx(r.late, abs=1e-3)
