"""Pickup performance over the wide order table."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from waybill.functions import codes
from waybill.operators import bitmaps
from waybill.operators import pickup as pu
from waybill.plans import pickup as rep
from waybill.sources import scans

from ..oracle_views import day
from ..registry import query

AS_OF = dt.date(2024, 1, 31)
FIRST, LAST = dt.date(2024, 1, 3), dt.date(2024, 1, 30)
TODAY = "DATE '2024-01-31'"
D, FU, SU, EP = (day(c) for c in (
    "orderdate", "firstupdatedpickeduptime", "secondupdatedpickeduptime", "endpicktime"))
SC = day("secondcreatedpickeduptime")
EVENT_DAYS = ("2024-01-05", "2024-01-06", "2024-01-07", "2024-01-14", "2024-01-28")

SCOPE = "clientid = 18692 AND isexpecteddropoff = false AND NOT channel = 'WH - Shopee'"
LIVE = f"{SCOPE} AND currentstatus <> 'cancel'"
RANGE = f"{D} BETWEEN DATE '2024-01-03' AND DATE '2024-01-30'"
NOTE = f"firstfailpicknote IS NOT DISTINCT FROM '{codes.INCIDENT_NOTE}'"
INCIDENT = f"({NOTE} AND coalesce({FU} <> {SC} AND {FU} >= {D}, false))"
EVENT = f"list_contains({list(EVENT_DAYS)}, CAST({D} AS VARCHAR))"
# days of slack: one for orders from 18:00 on, one on event days
LATE, GRACE = "CAST(hour(orderdate) >= 18 AS INTEGER)", f"CAST({EVENT} AS INTEGER)"


def within(x, slack="0"):
    """1 when date x is at most ``slack`` days after the order day."""
    return f"CAST(coalesce(date_diff('day', {D}, {x}) <= {slack}, false) AS INTEGER)"


def unless_incident(flag):
    return f"if({INCIDENT}, 0, {flag})"


TOUCH = f"coalesce({FU}, {EP}, {TODAY})"
V1 = within(TOUCH, LATE)
V2 = unless_incident(V1)
V2_OPEN = unless_incident(within(f"coalesce({FU}, {EP})", LATE))
CONTACT = f"if({NOTE}, {SU}, coalesce({FU}, {SU}))"
V3 = f"greatest({within(EP)}, {within(CONTACT, LATE)})"
V4 = f"greatest({within(EP)}, {within(CONTACT)})"
SUCCESS = within(f"if({LATE} = 1, coalesce({EP}, {TODAY}), {EP})", LATE)
SUCCESS2 = unless_incident(SUCCESS)
PICKED = "CAST(endpicktime IS NOT NULL AS INTEGER)"
JUDGED = f"NOT (currentstatus = 'cancel' AND {day('canceltime')} <= {D})"
PEN1 = within(TOUCH, f"{LATE} + {GRACE}")
PEN2 = unless_incident(PEN1)
PEN_DAY = within(TOUCH, GRACE)


def start(grain, x="orderdate"):
    return f"CAST(date_trunc('{grain}', {x}) AS DATE)"


def per_order(name, flag_sql, build):
    """Row-level query: order code and one flag."""
    query(name, "ordercode:i flag:i", f"""
        SELECT ordercode, {flag_sql} AS flag FROM fx_created WHERE {SCOPE}""")(
        lambda v: pu.in_scope(v.created).select("ordercode", build().alias("flag")))


per_order("dom_pu_ontime_v1", V1, lambda: pu.ontime_first_v1(AS_OF))
per_order("dom_pu_late_v1", f"1 - {V1}", lambda: pu.late(pu.ontime_first_v1(AS_OF)))
per_order("dom_pu_ontime_v2", V2, lambda: pu.ontime_first_v2(AS_OF))
per_order("dom_pu_ontime_v2_open", V2_OPEN, lambda: pu.ontime_first_v2(None))
per_order("dom_pu_ontime_v3", V3, pu.ontime_first_v3)
per_order("dom_pu_ontime_v4", V4, pu.ontime_first_v4)


@query("dom_pu_success", "ordercode:i success:i success2:i same_day:i picked:i late:i label:s", f"""
    SELECT ordercode, {SUCCESS} AS success, {SUCCESS2} AS success2, {within(EP)}
      AS same_day, {PICKED} AS picked, 1 - {SUCCESS} AS late,
      CASE WHEN {V3} = 1 THEN 'Ontime' ELSE 'Late' END AS label
    FROM fx_created WHERE {SCOPE}""")
def dom_pu_success(v):
    return pu.in_scope(v.created).select(
        "ordercode", pu.ontime_success(AS_OF).alias("success"),
        pu.ontime_success_v2(AS_OF).alias("success2"),
        pu.ontime_success_same_day().alias("same_day"), pu.picked().alias("picked"),
        pu.late(pu.ontime_success(AS_OF)).alias("late"), pu.ontime_label_v3().alias("label"))


@query("dom_pu_penalty", "ordercode:i cutoff:i incident:i by_day:i", f"""
    SELECT ordercode, {PEN1} AS cutoff, {PEN2} AS incident, {PEN_DAY} AS by_day
    FROM fx_created WHERE {SCOPE} AND {JUDGED}""")
def dom_pu_penalty(v):
    rows = pu.in_scope(v.created).where(pu.not_cancelled_same_day())
    event = pu.on_event_day(EVENT_DAYS)
    return rows.select(
        "ordercode", pu.ontime_first_v1(AS_OF, event).alias("cutoff"),
        pu.ontime_first_v2(AS_OF, event).alias("incident"),
        pu.ontime_first_v1(AS_OF, event, cutoff=False).alias("by_day"))


@query("dom_pu_sunday", "period:d volume:i ontime:i late:i", f"""
    SELECT {start('week')} AS period, count(*) AS volume, sum({V4}) AS ontime,
      count(*) - sum({V4}) AS late FROM fx_created WHERE {LIVE} AND isodow(orderdate) = 7
    GROUP BY 1""")
def dom_pu_sunday(v):
    base = pu.daily_base(pu.in_scope(v.created, keep_cancelled=False),
                         {"ok": pu.ontime_first_v4()})
    weekly = pu.regroup(base, "week", [], ["ok"], only=F.weekday("order_day") == 6)
    return weekly.select("period", F.col("orders").alias("volume"), F.col("ok").alias("ontime"),
                         (F.col("orders") - F.col("ok")).alias("late"))


SCORE = ("period:d time:i total_volume:i ontime_first_normal:f ontime_first_penalty:f "
         "ontime_success_normal:f pickup_success_normal:f ontime_first_sunday:f")


def score_sql(grain, first, success, penalty, number):
    return f"""
    WITH t AS (SELECT {start(grain)} AS p, count(*) AS n FROM fx_created
      WHERE clientid = 18692 AND {RANGE} GROUP BY 1),
    a AS (SELECT {start(grain)} AS p, round(sum({first}) / count(*), 4) AS f,
      round(sum({success}) / count(*), 4) AS s, round(sum({PICKED}) / count(*), 4) AS k
      FROM fx_created WHERE {SCOPE} AND {RANGE} GROUP BY 1),
    e AS (SELECT {start(grain)} AS p, round(sum({penalty}) / count(*), 4) AS f FROM fx_created
      WHERE {SCOPE} AND {RANGE} AND {JUDGED} GROUP BY 1),
    s AS (SELECT {start(grain)} AS p, round(sum({first}) / count(*), 4) AS f FROM fx_created
      WHERE {SCOPE} AND {RANGE} AND isodow(orderdate) = 7 GROUP BY 1)
    SELECT t.p AS period, {number}(t.p) AS time, t.n AS total_volume, a.f AS ontime_first_normal,
      e.f AS ontime_first_penalty, a.s AS ontime_success_normal, a.k AS pickup_success_normal,
      s.f AS ontime_first_sunday
    FROM a JOIN t ON t.p = a.p JOIN e ON e.p = a.p LEFT JOIN s ON s.p = a.p"""


@query("dom_pu_scorecard", SCORE, score_sql("week", V1, SUCCESS, PEN1, "week"))
def dom_pu_scorecard(v):
    return pu.scorecard(v.created, "week", AS_OF, EVENT_DAYS, FIRST, LAST, version=1)


@query("rep_scorecard_monthly", SCORE, score_sql("month", V2, SUCCESS2, PEN2, "month"))
def rep_scorecard_monthly(v):
    return pu.scorecard(v.created, "month", AS_OF, EVENT_DAYS, FIRST, LAST, version=2)


WEEKLY = ("period:d time:i total_orders:i ontime_first:f ontime_penalty:f ontime_success:f "
          "success:f ontime_sunday:f")


def weekly_sql(grain, number):
    since = f"{D} BETWEEN DATE '2024-01-01' AND DATE '2024-01-30'"
    return f"""
    WITH d AS (SELECT {start(grain)} AS p, count(DISTINCT ordercode) AS n, sum({V4}) AS f,
      sum({within(EP)}) AS s, sum({PICKED}) AS k FROM fx_created
      WHERE {LIVE} AND {since} GROUP BY 1),
    e AS (SELECT {start(grain)} AS p, count(DISTINCT ordercode) AS n, sum({PEN_DAY}) AS f
      FROM fx_created WHERE {SCOPE} AND {JUDGED}
        AND {D} BETWEEN DATE '2024-01-08' AND DATE '2024-01-30' GROUP BY 1),
    s AS (SELECT {start(grain)} AS p, count(DISTINCT ordercode) AS n, sum({V4}) AS f
      FROM fx_created WHERE {LIVE} AND {since} AND isodow(orderdate) = 7 GROUP BY 1)
    SELECT d.p AS period, {number}(d.p) AS time, d.n AS total_orders,
      round(d.f / d.n, 4) AS ontime_first, round(e.f / e.n, 4) AS ontime_penalty,
      round(d.s / d.n, 4) AS ontime_success, round(d.k / d.n, 4) AS success,
      round(s.f / s.n, 4) AS ontime_sunday
    FROM d LEFT JOIN e ON e.p = d.p LEFT JOIN s ON s.p = d.p"""


@query("rep_weekly_scorecard", WEEKLY, weekly_sql("week", "week"))
def rep_weekly_scorecard(v):
    return pu.weekly_scorecard(v.created, "week", AS_OF, EVENT_DAYS, dt.date(2024, 1, 1),
                               dt.date(2024, 1, 8))


@query("rep_weekly_scorecard_month", WEEKLY, weekly_sql("month", "month"))
def rep_weekly_scorecard_month(v):
    return pu.weekly_scorecard(v.created, "month", AS_OF, EVENT_DAYS, dt.date(2024, 1, 1),
                               dt.date(2024, 1, 8))


def distinct_sql(grain, number):
    """Distinct orders on both sides; every seventh order also has a row twenty days earlier, over the year's end."""
    def orders(flag):
        return f"count(DISTINCT CASE WHEN {flag} THEN ordercode END)"
    live = f"{LIVE} AND {D} BETWEEN DATE '2023-12-05' AND DATE '2024-01-30'"
    judged = f"{SCOPE} AND {JUDGED} AND {D} BETWEEN DATE '2023-12-18' AND DATE '2024-01-30'"
    sunday = f"{live} AND isodow(orderdate) = 7"
    return f"""
    WITH r AS (SELECT * FROM fx_created UNION ALL
      SELECT * REPLACE (orderdate - INTERVAL 20 DAY AS orderdate) FROM fx_created WHERE ordercode % 7 = 0)
    SELECT {start(grain)} AS period, {number}({start(grain)}) AS time, {orders(live)} AS total_orders,
      round({orders(f"{live} AND {V4} = 1")} / {orders(live)}, 4) AS ontime_first,
      round({orders(f"{judged} AND {PEN_DAY} = 1")} / nullif({orders(judged)}, 0), 4) AS ontime_penalty,
      round({orders(f"{live} AND {within(EP)} = 1")} / {orders(live)}, 4) AS ontime_success,
      round({orders(f"{live} AND {PICKED} = 1")} / {orders(live)}, 4) AS success,
      round({orders(f"{sunday} AND {V4} = 1")} / nullif({orders(sunday)}, 0), 4) AS ontime_sunday
    FROM r GROUP BY 1, 2 HAVING {orders(live)} > 0"""


def distinct_bitmaps(v):
    again = v.created.where("ordercode % 7 = 0").withColumn("orderdate", F.col("orderdate") - F.expr("INTERVAL 20 DAYS"))
    orders = v.created.unionByName(again)
    numbers = bitmaps.order_numbers(orders.withColumn("order_day", F.to_date("orderdate")), "ordercode", "order_day")
    return pu.order_bitmaps(orders, numbers, AS_OF, EVENT_DAYS, dt.date(2023, 12, 5), dt.date(2023, 12, 18))


@query("rep_distinct_scorecard", WEEKLY, distinct_sql("week", "week"))
def rep_distinct_scorecard(v):
    return pu.distinct_scorecard(distinct_bitmaps(v), "week")


@query("rep_distinct_scorecard_month", WEEKLY, distinct_sql("month", "month"))
def rep_distinct_scorecard_month(v):
    return pu.distinct_scorecard(distinct_bitmaps(v), "month")


def breakdown_columns(dims):
    return ("period:d time:i " + " ".join(f"{d}:s" for d in dims) + " volume_created:i "
            "ontime_first_normal:f first_contribution:f ontime_success_normal:f "
            "success_contribution:f ontime_first_sunday:f sunday_contribution:f "
            "first_ok:i success_ok:i sunday:i sunday_ok:i")


def breakdown_sql(grain, dims, first, success, number):
    names = ", ".join(dims)
    match = " AND ".join(f"n.{d} IS NOT DISTINCT FROM s.{d}" for d in dims)
    cols = ", ".join(f"n.{d}" for d in dims)
    return f"""
    WITH t AS (SELECT {start(grain)} AS p, count(*) AS n FROM fx_created
      WHERE {SCOPE} AND {RANGE} GROUP BY 1),
    n AS (SELECT {start(grain)} AS p, {names}, count(*) AS n, sum({first}) AS f,
      sum({success}) AS s FROM fx_created WHERE {SCOPE} AND {RANGE} GROUP BY p, {names}),
    s AS (SELECT {start(grain)} AS p, {names}, count(*) AS n, sum({first}) AS f FROM fx_created
      WHERE {SCOPE} AND {RANGE} AND isodow(orderdate) = 7 GROUP BY p, {names})
    SELECT n.p AS period, {number}(n.p) AS time, {cols}, n.n AS volume_created,
      n.f AS first_ok, n.s AS success_ok, s.n AS sunday, s.f AS sunday_ok,
      round(n.f / n.n, 4) AS ontime_first_normal, round((n.n - n.f) / t.n, 6)
        AS first_contribution,
      round(n.s / n.n, 4) AS ontime_success_normal, round((n.n - n.s) / t.n, 6)
        AS success_contribution,
      round(s.f / s.n, 4) AS ontime_first_sunday, round((s.n - s.f) / t.n, 6)
        AS sunday_contribution
    FROM n JOIN t ON t.p = n.p LEFT JOIN s ON s.p = n.p AND {match}"""


REGION, PROVINCE = ["fromregionshortname"], ["fromregionshortname", "fromprovince"]
DISTRICT = ["fromprovince", "fromdistrict"]


@query("dom_pu_breakdown", breakdown_columns(REGION),
       breakdown_sql("month", REGION, V2, SUCCESS2, "month"))
def dom_pu_breakdown(v):
    return pu.breakdown(v.created, "month", REGION, AS_OF, FIRST, LAST)


@query("rep_breakdown_province", breakdown_columns(PROVINCE),
       breakdown_sql("month", PROVINCE, V2, SUCCESS2, "month"))
def rep_breakdown_province(v):
    return pu.breakdown(v.created, "month", PROVINCE, AS_OF, FIRST, LAST)


@query("rep_breakdown_province_v1", breakdown_columns(PROVINCE),
       breakdown_sql("month", PROVINCE, V1, SUCCESS, "month"))
def rep_breakdown_province_v1(v):
    return pu.breakdown(v.created, "month", PROVINCE, AS_OF, FIRST, LAST, version=1)


TABLE = ("period:d time:i fromprovince:s fromdistrict:s volume_created:i first_ok:i "
         "success_ok:i sunday:i sunday_ok:i")


@query("rep_district_monthly", TABLE, breakdown_sql("month", DISTRICT, V2, SUCCESS2, "month"))
def rep_district_monthly(v):
    return rep.district_table(v.created, "month", AS_OF, FIRST, LAST)


@query("rep_district_weekly", TABLE, breakdown_sql("week", DISTRICT, V2, SUCCESS2, "week"))
def rep_district_weekly(v):
    return rep.district_table(v.created, "week", AS_OF, FIRST, LAST)


@query("rep_district_weekly_v1", TABLE, breakdown_sql("week", DISTRICT, V1, SUCCESS, "week"))
def rep_district_weekly_v1(v):
    return rep.district_table(v.created, "week", AS_OF, FIRST, LAST, version=1)


DASH = ("time_type:s time_period:s region:s is_total:i ontime_success:f ontime_first:f")


def dash_sql(kind, grain, since):
    return f"""
    SELECT '{kind}' AS time_type, CAST({start(grain)} AS VARCHAR) AS time_period,
      CASE WHEN grouping(fromregionshortname) = 1 THEN 'Nationwide Total'
        ELSE fromregionshortname END AS region, grouping(fromregionshortname) AS is_total,
      round(sum({SUCCESS}) * 1.0 / count(*), 4) AS ontime_success,
      round(sum({V3}) * 1.0 / count(*), 4) AS ontime_first
    FROM fx_created WHERE {LIVE} AND {D} >= DATE '{since}' AND {D} <= DATE '2024-01-30'
    GROUP BY GROUPING SETS (({start(grain)}, fromregionshortname), ({start(grain)}))"""


@query("dom_pu_dashboard", DASH, " UNION ALL ".join([
    dash_sql("Daily", "day", "2024-01-21"), dash_sql("Weekly", "week", "2024-01-22"),
    dash_sql("Monthly", "month", "2023-12-01")]))
def dom_pu_dashboard(v):
    return pu.dashboard(v.created, AS_OF)


def week_sql(rule, first, last):
    return f"""
    SELECT week(orderdate) AS time, CASE WHEN grouping(fromregionshortname) = 1 THEN 'XXX_Total'
        ELSE fromregionshortname END AS region, grouping(fromregionshortname) AS is_total,
      round(sum({rule}) * 1.0 / count(*), 4) AS ontime
    FROM fx_created WHERE {SCOPE} AND {D} BETWEEN DATE '{first}' AND DATE '{last}'
    GROUP BY GROUPING SETS ((week(orderdate), fromregionshortname), (week(orderdate)))"""


WEEK = "time:i region:s is_total:i ontime:f"


@query("dom_pu_weekly", WEEK, week_sql(SUCCESS, "2024-01-22", "2024-01-28"))
def dom_pu_weekly(v):
    return rep.weekly_success(v.created, AS_OF)


@query("rep_weekly_shifted", WEEK, week_sql(SUCCESS, "2024-01-23", "2024-01-29"))
def rep_weekly_shifted(v):
    return rep.weekly_success(v.created, AS_OF, shift_days=1)


@query("rep_weekly_first", WEEK, week_sql(V2, "2024-01-22", "2024-01-28"))
def rep_weekly_first(v):
    return rep.weekly_first_contact(v.created, AS_OF)


@query("rep_overall_first", "total_orders:i ontime_first:i share:f", f"""
    SELECT count(*) AS total_orders, sum({V2}) AS ontime_first,
      round(sum({V2}) / NULLIF(count(*), 0), 4) AS share FROM fx_created
    WHERE {SCOPE} AND {RANGE}""")
def rep_overall_first(v):
    return rep.overall_first_contact(v.created, AS_OF, FIRST, LAST)


@query("dom_hub_type", "ordercode:i type_kh:s hub_group:s", """
    SELECT ordercode, CASE WHEN pickwh LIKE '%Ahamove%' THEN 'Ahamove'
        WHEN pickwarehouseid IN (1297, 1327) THEN 'KHL' WHEN w.warehouse_id IS NOT NULL THEN 'GXT'
        ELSE 'BC' END AS type_kh,
      CASE WHEN lower(pickwh) LIKE 'bưu cục%' THEN 'Vùng' ELSE 'KHL/GXT' END AS hub_group
    FROM fx_created c LEFT JOIN (SELECT warehouse_id FROM fx_dim_warehouse
      WHERE department_name = 'Freight Operations Department'
        OR warehouse_name LIKE '%Kho Chuyển Tiếp %') w ON w.warehouse_id = c.pickwarehouseid""")
def dom_hub_type(v):
    return pu.hub_type(v.created, v.dim_warehouse).withColumn("hub_group", pu.hub_group())


@query("dom_pending_pick", "order_day:d fromprovince:s fromdistrict:s ward_name:s pickwh:s "
       "type_kh:s pending_pick:i total_orders:i ontime_orders:i late_orders:i", f"""
    SELECT {D} AS order_day, fromprovince, fromdistrict, w.ward_name, pickwh,
      CASE WHEN lower(pickwh) LIKE 'bưu cục%' THEN 'Vùng' ELSE 'KHL/GXT' END AS type_kh,
      sum(CASE WHEN currentstatus IN ('ready_to_pick', 'picking') THEN 1 ELSE 0 END)
        AS pending_pick, count(*) AS total_orders, sum({V3}) AS ontime_orders,
      count(*) - sum({V3}) AS late_orders
    FROM fx_created c LEFT JOIN fx_ward w ON w.ward_id = c.fromwardcode
    WHERE {LIVE} AND {D} BETWEEN DATE '2024-01-17' AND DATE '2024-01-30' GROUP BY ALL""")
def dom_pending_pick(v):
    return pu.pending_pick(v.created, v.ward, AS_OF)


@query("dom_latest_order", "fromwardcode:s clientcontactname:s ordercode:i region_shortname:s "
       "province_name:s district_name:s ward_name:s", """
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fromwardcode, clientcontactname
        ORDER BY CAST(orderdate AS DATE) DESC, ordercode DESC) AS rn FROM fx_created
      WHERE clientid = 18692 AND pickwarehouseid IN (1297, 1327) AND NOT channel = 'WH - Shopee') c
    JOIN fx_ward w ON w.ward_id = c.fromwardcode WHERE rn = 1""")
def dom_latest_order(v):
    return pu.latest_order(v.created, v.ward)


@query("dom_hub_ontime", "order_day:d hub_name:s ontime:f", f"""
    SELECT {D} AS order_day, CASE WHEN fromprovince = 'NATION_0'
        THEN 'Key Account Warehouse Ho Chi Minh' ELSE 'Key Account Warehouse Ha Noi' END
        AS hub_name, round(sum({V2_OPEN}) / count(*), 4) AS ontime
    FROM fx_created WHERE {SCOPE} AND fromprovince IN ('NATION_0', 'NATION_10')
      AND pickwarehouseid IN (1297, 1327)
      AND {D} BETWEEN DATE '2024-01-24' AND DATE '2024-01-30' GROUP BY 1, 2""")
def dom_hub_ontime(v):
    return pu.hub_ontime(v.created, AS_OF, ["NATION_0", "NATION_10"], "NATION_0")


@query("rep_order_check", "order_day:d ordercode:i type_kh:s fromdistrict:s pickwh:s "
       "firstupdatedpickeduptime:t endpicktime:t is_ontime:s firstfailpicknote:s fromprovince:s", f"""
    SELECT {D} AS order_day, ordercode, firstfailpicknote, fromprovince, CASE WHEN lower(pickwh) LIKE 'bưu cục%' THEN 'Vùng'
        ELSE 'KHL/GXT' END AS type_kh, fromdistrict, pickwh, firstupdatedpickeduptime, endpicktime,
      CASE WHEN {V3} = 1 THEN 'Ontime' ELSE 'Late' END AS is_ontime
    FROM fx_created WHERE {LIVE} AND fromprovince = 'NATION_3'
      AND {D} BETWEEN DATE '2024-01-23' AND DATE '2024-01-30'""")
def rep_order_check(v):
    return rep.order_check(v.created, AS_OF, 8, "NATION_3")


@query("rep_open_pickups", "order_day:d ordercode:i type_kh:s ward_name:s currentstatus:s "
       "is_ontime:s clientcontactname:s endpicktime:t firstfailpicknote:s firstupdatedpickeduptime:t "
       "fromdistrict:s fromprovince:s pickwh:s", f"""
    SELECT {D} AS order_day, ordercode, clientcontactname, endpicktime, firstfailpicknote,
      firstupdatedpickeduptime, fromdistrict, fromprovince, pickwh,
      CASE WHEN lower(pickwh) LIKE 'bưu cục%' THEN 'Vùng' ELSE 'KHL/GXT' END AS type_kh, w.ward_name, currentstatus,
      CASE WHEN {V3} = 1 THEN 'Ontime' ELSE 'Late' END AS is_ontime
    FROM fx_created c LEFT JOIN fx_ward w ON w.ward_id = c.fromwardcode
    WHERE {LIVE} AND currentstatus IN ('ready_to_pick', 'picking')
      AND fromprovince IN ('NATION_3', 'NATION_4')""")
def rep_open_pickups(v):
    return rep.open_pickups(v.created, v.ward, ["NATION_3", "NATION_4"])


@query("rep_enrich_list", "ordercode:i clientid:i endpicktime:d status:s numdeliver:i numreturn:i",
       """
    SELECT e.event_id AS ordercode, c.clientid, CAST(c.endpicktime AS DATE) AS endpicktime,
      c.currentstatus AS status, c.numdeliver, c.numreturn FROM events e
    LEFT JOIN fx_created c ON c.ordercode = e.event_id AND c.clientid = 18692
    WHERE e.event_type = 'error'""")
def rep_enrich_list(v):
    listed = v.events.where(F.col("event_type") == "error").select("event_id")
    known = v.created.where(F.col("clientid") == codes.PICKUP_CLIENT_ID)
    return scans.enrich_list(
        listed, known, "ordercode", "ordercode",
        [F.to_date("endpicktime").alias("endpicktime"), F.col("clientid"),
         F.col("currentstatus").alias("status"), F.col("numdeliver"), F.col("numreturn")])
