"""Hand-made rows at the edges of the rules."""

import datetime as dt

import pytest
from pyspark.sql import Row, functions as F

from waybill.functions import classify, times as t
from waybill.operators import attempts as att
from waybill.operators import delivery as dlv
from waybill.operators import milestones as mst
from waybill.operators import penalty, pickup as pu
from waybill.operators import sla as sl
from waybill.plans.pickup import last_week
from waybill.sources import marts, scans

AS_OF = dt.date(2024, 1, 31)


def ts(text):
    return dt.datetime.fromisoformat(text) if text else None


def one(spark, column, **values):
    """Value of a column expression over one row of timestamps or scalars."""
    schema = ", ".join(
        f"{k} {'timestamp' if isinstance(v, (dt.datetime, type(None))) else 'double'}"
        for k, v in values.items())
    return spark.createDataFrame([Row(**values)], schema).select(column.alias("x")).head()["x"]


# --- clocks -----------------------------------------------------------------------

@pytest.mark.parametrize("actual, ctime, expected", [
    (100, 200, 100), (200, 100, 100), (100, 100, 100), (None, 50, 50), (50, None, None),
    (None, None, None)])
def test_event_epoch(spark, actual, ctime, expected):
    df = spark.createDataFrame([(actual, ctime)], "a bigint, c bigint")
    assert df.select(t.event_epoch("a", "c")).head()[0] == expected


def test_unset_schedule(spark):
    df = spark.createDataFrame([(0,), (None,), (1704067200,)], "p bigint")
    assert [r[0] for r in df.select(t.is_set("p", -3600)).collect()] == [False, None, True]
    assert [r[0] for r in df.select(t.is_unset("p", -3600)).collect()] == [True, None, False]
    assert [r[0] for r in df.select(classify.is_dropoff("p")).collect()] == [1, 1, 0]


# --- calendar rules ---------------------------------------------------------------

@pytest.mark.parametrize("start, end, expected", [
    ("2024-01-03 10:00:00", "2024-01-03 20:00:00", 0),   # same Wednesday
    ("2024-01-03 10:00:00", "2024-01-07 09:00:00", 1),   # ends on Sunday
    ("2024-01-05 10:00:00", "2024-01-08 09:00:00", 1),   # weekday went round
    ("2024-01-07 10:00:00", "2024-01-07 12:00:00", 1),   # within one Sunday
    ("2024-01-07 10:00:00", "2024-01-09 12:00:00", 1),   # starts on Sunday: 2 < 7
    ("2024-01-03 10:00:00", "2024-01-10 10:00:00", 1),   # exactly seven days
    ("2024-01-07 10:00:00", "2024-01-14 10:00:00", 1),   # Sunday to Sunday
    ("2024-01-03 10:00:00", "2024-01-14 10:00:00", 0),   # ends on Sunday after a week
    ("2024-01-03 10:00:00", "2024-01-25 10:00:00", 3),   # three weeks
    ("2024-01-10 10:00:00", "2024-01-03 10:00:00", -1),  # end before start
    (None, "2024-01-03 10:00:00", 0), ("2024-01-03 10:00:00", None, 0)])
def test_sundays_between(spark, start, end, expected):
    assert one(spark, t.sundays_between("a", "b"), a=ts(start), b=ts(end)) == expected


@pytest.mark.parametrize("days, expected", [
    (2.5, "2024-01-06 10:00:00"), (2.4, "2024-01-05 10:00:00"), (0.5, "2024-01-04 10:00:00"),
    (-0.5, "2024-01-03 10:00:00")])
def test_due_date_rounds_halves_up(spark, days, expected):
    got = one(spark, t.due_date("p", F.col("d")), p=ts("2024-01-03 10:00:00"), d=days)
    assert got == ts(expected)


def test_due_date_midnight(spark):
    got = one(spark, t.due_date_midnight("p", F.lit(2.0)), p=ts("2024-01-03 10:00:00"))
    assert got == ts("2024-01-06 00:00:00")


@pytest.mark.parametrize("at, expected", [
    ("2024-01-03 11:59:59", "2024-01-03 12:00:00"), ("2024-01-03 12:00:00", "2024-01-04 00:00:00"),
    ("2024-01-03 00:00:00", "2024-01-03 12:00:00"), (None, None)])
def test_noon_adjust(spark, at, expected):
    assert one(spark, t.noon_adjust("p"), p=ts(at)) == ts(expected)


@pytest.mark.parametrize("at, expected", [
    ("2024-01-03 12:00:00", 1), ("2024-01-03 12:00:01", 2), ("2024-01-03 12:00:00.5", 2),
    ("2024-01-03 18:00:00", 2), ("2024-01-03 18:00:01", 3), (None, None)])
def test_cutoff_tier(spark, at, expected):
    assert one(spark, sl.cutoff_tier("p"), p=ts(at)) == expected


def test_elapsed_is_not_boundaries(spark):
    a, b = ts("2024-01-03 23:00:00"), ts("2024-01-04 22:59:59")
    assert one(spark, t.elapsed("day", "a", "b"), a=a, b=b) == 0
    assert one(spark, t.leadtime_days("a", "b"), a=a, b=b) == 0
    assert one(spark, t.leadtime_days("b", "a"), a=a, b=b) == 0


# --- milestones and attempts --------------------------------------------------------

def log(spark, rows):
    return spark.createDataFrame(
        rows, "log_id bigint, tracking_code string, actual_time bigint, ctime bigint, "
              "reason_description string")


def test_milestones_keep_parcels_without_events(spark):
    df = log(spark, [(1, "F100", 7200, 3600, None), (1, "F510", 1000, 9000, None),
                     (2, "XXXX", 5, 5, None)])
    spec = {"pku": mst.Milestone(("F100", "F510"))}
    got = {r.log_id: r.pku for r in mst.milestones(df, spec, shift=0).collect()}
    assert got == {1: dt.datetime(1970, 1, 1, 0, 16, 40), 2: None}
    assert [r.log_id for r in mst.milestones(df, spec, listed_only=True).collect()] == [1]


def test_rank_ties_skip(spark):
    df = log(spark, [(1, "F650", 100, 0, "b"), (1, "F650", 100, 0, "a"), (1, "F650", 100, 0, "a"),
                     (1, "F650", 200, 0, "c"), (2, "F650", 10, 0, "x"), (2, "F650", 20, 0, "y")])
    first = {(r.log_id, r.tracking_detail_reason)
             for r in att.nth_attempt(df, "F650", 1).collect()}
    assert first == {(1, "a"), (1, "b"), (2, "x")}
    # three events share rank 1, so ranks 2 and 3 are skipped for parcel 1
    assert {r.log_id for r in att.nth_attempt(df, "F650", 2).collect()} == {2}
    assert att.nth_attempt(df, "F650", 3).count() == 0
    assert {r.tracking_detail_reason for r in att.nth_attempt(df, "F650", 4).collect()} == {"c"}
    wide = {r.log_id: r for r in att.attempts_wide(df, "F650").collect()}
    assert (wide[1].dli_1_reason, wide[1].dli_2_time, wide[2].dli_2_reason) == ("a", None, "y")


def attempt_row(spark, *times, reasons=("x", "x", "x")):
    row = Row(**{f"dli_{i}_time": ts(x) for i, x in enumerate(times, 1)},
              **{f"dli_{i}_reason": x for i, x in enumerate(reasons, 1)})
    return spark.createDataFrame([row], ", ".join(
        [f"dli_{i}_time timestamp" for i in (1, 2, 3)]
        + [f"dli_{i}_reason string" for i in (1, 2, 3)]))


@pytest.mark.parametrize("times, gap, count", [
    (("2024-01-03 10:00:00", "2024-01-03 10:14:59", None), "Gọi 2 lần trong vòng 15 phút", 2),
    (("2024-01-03 10:00:00", "2024-01-03 13:00:00", None), "2 ca sáng chiều", 2),
    (("2024-01-03 13:00:00", "2024-01-03 16:00:00", None), "Không hợp lệ", 2),
    (("2024-01-03 13:00:00", "2024-01-03 18:00:00", None), "Hợp lệ", 2),
    (("2024-01-03 13:00:00", "2024-01-04 10:00:00", "2024-01-04 10:10:00"),
     "Gọi 2 lần trong vòng 15 phút", 3),
    ((None, None, None), "Hợp lệ", 1)])
def test_attempt_gap(spark, times, gap, count):
    row = attempt_row(spark, *times).select(att.attempt_gap_class(), att.attempt_count()).head()
    assert tuple(row) == (gap, count)


def test_third_evening(spark):
    df = attempt_row(spark, "2024-01-03 10:00:00", "2024-01-04 10:00:00", "2024-01-05 22:00:00")
    assert df.select(att.abnormal_hour()).head()[0] == "Bất thường"
    assert df.select(att.abnormal_hour(check_third_evening=False)).head()[0] == "Bình thường"


@pytest.mark.parametrize("times, reasons, kept", [
    (("2024-01-03 10:00:00", "2024-01-04 10:00:00", None), ("hen lai", "qua xa", None), True),
    (("2024-01-03 10:00:00", "2024-01-04 10:00:00", None), ("tu choi", "qua xa", None), False),
    (("2024-01-03 10:00:00", "2024-01-04 10:00:00", None), (None, "qua xa", None), False),
    (("2024-01-03 10:00:00", None, None), ("qua xa", None, None), False)])
def test_fake_attempts(spark, times, reasons, kept):
    df = attempt_row(spark, *times, reasons=reasons)
    assert (att.fake_attempts(df).count() == 1) == kept


def test_bounded_pending(spark):
    base = {c: None for c in (
        "sls_pickup_done", "sls_return_time", "sls_delivery_done", "sls_del_failed",
        "sls_del_pending_sub")}
    cases = [
        dict(base, sls_pickup_done=ts("2024-01-01"), sls_del_pending_sub=ts("2024-01-02"),
             sls_delivery_done=ts("2024-01-03")),
        dict(base, sls_pickup_done=ts("2024-01-01"), sls_return_time=ts("2024-01-02"),
             sls_del_pending_sub=ts("2024-01-03"), sls_del_failed=ts("2024-01-04")),
        dict(base, sls_return_time=ts("2024-01-02"), sls_del_pending_sub=ts("2024-01-02"),
             sls_del_failed=ts("2024-01-04")),
    ]
    df = spark.createDataFrame([Row(n=i, **c) for i, c in enumerate(cases)],
                               "n int, " + ", ".join(f"{c} timestamp" for c in base))
    got = {r.n: r for r in mst.bounded_pending(df).collect()}
    assert got[0].sls_first_delivery_attempt == ts("2024-01-02")
    assert got[1].sls_first_delivery_attempt is None
    assert got[1].sls_return_pending == ts("2024-01-03")
    assert got[2].sls_return_pending is None  # strictly after the return began


# --- service levels -------------------------------------------------------------------

def test_two_holidays_in_a_window(spark):
    cal = spark.createDataFrame(
        [("ABC", "delivery", "2024-01-02", "1", 2), ("abc", "delivery", "2024-01-04", "2", 2),
         ("ABC", "delivery", "2024-01-04", "2", 2), ("ABC", "delivery", "2024-01-03", "9", 1),
         ("ABC", "return", "2024-01-03", "5", 2)],
        "shipping_carrier string, type string, holiday_start string, nb_holiday string, "
        "ingestion_timestamp int")
    facts = spark.createDataFrame(
        [(1, "abc", ts("2024-01-02 23:00:00"), ts("2024-01-04 01:00:00")),
         (2, "abc", ts("2024-01-05 00:00:00"), ts("2024-01-06 00:00:00")),
         (3, None, ts("2024-01-01 00:00:00"), None)],
        "id int, carrier string, a timestamp, b timestamp")
    rows = sl.holiday_days(facts, cal, "carrier", F.col("a"), t.day("b"))
    assert sorted((r.id, r.d_holidays) for r in rows.collect()) == [
        (1, 1.0), (1, 2.0), (2, 0.0), (3, 0.0)]
    summed = sl.holiday_days(facts, cal, "carrier", F.col("a"), t.day("b"), mode="sum")
    assert sorted((r.id, r.d_holidays) for r in summed.collect()) == [(1, 3.0), (2, 0.0), (3, 0.0)]


def test_latest_version_and_rejects(spark):
    df = spark.createDataFrame([("a", "1", 1), ("a", "x", 2), ("b", None, 2)],
                               "k string, n string, ingestion_timestamp int")
    latest = scans.latest_version(df)
    assert {r.k for r in latest.collect()} == {"a", "b"} and latest.count() == 2
    assert [r.n for r in sl.unreadable(latest, ["n"]).collect()] == ["x"]
    assert {r[0] for r in latest.select(sl.number("n")).collect()} == {0.0}


# --- on-time classes --------------------------------------------------------------------

def test_ontime_class_nulls(spark):
    df = spark.createDataFrame(
        [(ts("2024-01-03 23:00:00"), ts("2024-01-03 01:00:00")),
         (ts("2024-01-04 00:00:00"), ts("2024-01-03 23:00:00")), (None, ts("2024-01-03")),
         (ts("2024-01-03"), None)], "a timestamp, d timestamp")
    got = [r[0] for r in df.select(dlv.ontime_class("a", "d")).collect()]
    assert got == ["Ontime", "Late", None, None]


def test_kpis_of_null_milestones(spark):
    df = spark.createDataFrame([("x",) + (None,) * 6], "g string, pku_done_time timestamp, "
                               "deli_1st_time timestamp, deli_done_time timestamp, "
                               "deli_failed_time timestamp, dli_pending_tracking_time timestamp, "
                               "expected_delivery timestamp")
    assert tuple(dlv.delivery_kpis(df, ["g"]).head()) == ("x", 0, 0, 0, 0, 0, 0)


# --- pickup -------------------------------------------------------------------------------

NOTE = "Nhân viên gặp sự cố"
ORDER = ("orderdate timestamp, firstupdatedpickeduptime timestamp, "
         "secondupdatedpickeduptime timestamp, secondcreatedpickeduptime timestamp, "
         "endpicktime timestamp, firstfailpicknote string, currentstatus string, "
         "canceltime timestamp")


def order(spark, at, first=None, second=None, created=None, end=None, note=None,
          status="delivered", cancel=None):
    return spark.createDataFrame(
        [(ts(at), ts(first), ts(second), ts(created), ts(end), note, status, ts(cancel))], ORDER)


@pytest.mark.parametrize("at, first, expected", [
    ("2024-01-03 17:59:59", "2024-01-04 00:00:00", 0),
    ("2024-01-03 18:00:00", "2024-01-04 23:59:59", 1),
    ("2024-01-03 18:00:00", "2024-01-05 00:00:00", 0),
    ("2024-01-03 17:59:59", "2024-01-03 23:59:59", 1),
    ("2024-01-30 18:00:00", None, 1),   # open: counts as contacted today
    ("2024-01-30 17:00:00", None, 0)])
def test_first_contact_cutoff(spark, at, first, expected):
    assert order(spark, at, first).select(pu.ontime_first_v1(AS_OF)).head()[0] == expected


def test_incident_is_never_on_time(spark):
    df = order(spark, "2024-01-03 10:00:00", "2024-01-03 12:00:00", created="2024-01-04 09:00:00",
               note=NOTE)
    assert df.select(pu.ontime_first_v1(AS_OF), pu.ontime_first_v2(AS_OF)).head() == (1, 0)
    same_day = order(spark, "2024-01-03 10:00:00", "2024-01-03 12:00:00",
                     created="2024-01-03 19:00:00", note=NOTE)
    assert same_day.select(pu.ontime_first_v2(AS_OF)).head()[0] == 1
    unknown = order(spark, "2024-01-03 10:00:00", "2024-01-03 12:00:00", note=NOTE)
    assert unknown.select(pu.ontime_first_v2(AS_OF)).head()[0] == 1


def test_incident_second_contact_counts(spark):
    df = order(spark, "2024-01-03 19:00:00", "2024-01-03 20:00:00", "2024-01-04 20:00:00",
               note=NOTE)
    assert df.select(pu.ontime_first_v3(), pu.ontime_first_v4()).head() == (1, 0)
    no_second = order(spark, "2024-01-03 10:00:00", "2024-01-03 11:00:00", note=NOTE)
    assert no_second.select(pu.ontime_first_v3()).head()[0] == 0
    ended = order(spark, "2024-01-03 10:00:00", end="2024-01-03 11:00:00", note=NOTE)
    assert ended.select(pu.ontime_first_v3()).head()[0] == 1


def test_open_pickup_success(spark):
    assert order(spark, "2024-01-30 18:00:00").select(pu.ontime_success(AS_OF)).head()[0] == 1
    assert order(spark, "2024-01-30 17:00:00").select(pu.ontime_success(AS_OF)).head()[0] == 0
    assert order(spark, "2024-01-29 18:00:00").select(pu.ontime_success(AS_OF)).head()[0] == 0


@pytest.mark.parametrize("status, cancel, kept", [
    ("cancel", "2024-01-03 23:00:00", 0), ("cancel", "2024-01-04 00:00:00", 1),
    ("cancel", None, 0), ("delivered", None, 1), ("delivered", "2024-01-03 23:00:00", 1)])
def test_same_day_cancel(spark, status, cancel, kept):
    df = order(spark, "2024-01-03 10:00:00", status=status, cancel=cancel)
    assert df.where(pu.not_cancelled_same_day()).count() == kept


def test_event_day_grace(spark):
    df = order(spark, "2024-01-05 18:00:00", "2024-01-07 10:00:00")
    grace = pu.on_event_day(["2024-01-05"])
    assert df.select(pu.ontime_first_v1(AS_OF), pu.ontime_first_v1(AS_OF, grace)).head() == (0, 1)
    assert df.select(pu.ontime_first_v1(AS_OF, grace, cutoff=False)).head()[0] == 0


def test_null_region_is_not_the_total(spark):
    base = spark.createDataFrame(
        [(1, None, 2, 1), (1, "A", 2, 2)], "time int, region string, orders int, ok int")
    rows = {(r.region, r.is_total): r.x for r in pu.with_total(
        base, ["time"], "region", "Total", {"x": "ok"}).collect()}
    assert rows == {(None, 0): 0.5, ("A", 0): 1.0, ("Total", 1): 0.75}


def test_last_week():
    assert last_week(dt.date(2024, 1, 31)) == (dt.date(2024, 1, 22), dt.date(2024, 1, 28))
    assert last_week(dt.date(2024, 1, 29)) == (dt.date(2024, 1, 22), dt.date(2024, 1, 28))


# --- penalties, lists ------------------------------------------------------------------------

def test_overall_penalty_replaces_half(spark):
    row = dict(total_sla=2.0, delivery_w_weekend=0.0, return_w_weekend=0.0,
               nb_delivery_holiday=0.0, nb_return_holiday=0.0, nb_delivery_holiday_overall=0.0,
               nb_return_holiday_overall=0.0, added_leadtime=0, is_dropoff=0, del_leadtime=3.0,
               return_leadtime=None, del_leadtime_overall=16.0, return_leadtime_overall=None,
               sls_first_pickup_attempt=ts("2024-01-04"), fe_schedule_pickup=ts("2024-01-03"))
    schema = ", ".join(
        f"{k} {'timestamp' if k.startswith(('sls', 'fe')) else 'int' if k in ('added_leadtime', 'is_dropoff') else 'double'}"
        for k in row)
    df = spark.createDataFrame([Row(**row)], schema)
    assert penalty.penalties(df, 15).head().final_penalty == "50% trễ lấy-100% trễ giao-"
    assert penalty.penalties(df, 16).head().final_penalty == "50% trễ lấy-50% trễ giao-"
    clean = df.withColumns({"is_dropoff": F.lit(1), "del_leadtime": F.lit(1.0),
                            "del_leadtime_overall": F.lit(1.0)})
    assert penalty.penalties(clean, 15).count() == 0
    assert penalty.penalties(clean, 15, keep_all=True).head().final_penalty == ""


def test_lists_and_names(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "id string, n int")
    ids = spark.createDataFrame([("b",), ("b",), ("z",), (None,)], "code string")
    assert scans.restrict_to_ids(df, "id", ids).count() == 2
    assert scans.restrict_to_values(df, "id", []).count() == 0
    listed = scans.enrich_list(ids, df, "code", "id", ["n"])
    assert sorted((r.code, r.n or 0) for r in listed.collect()) == [
        ("b", 2), ("b", 2), ("b", 3), ("b", 3), ("z", 0)]
    assert marts.unique_names(["a", "b", "a", "a"]) == ["a", "b", "a_2", "a_3"]
