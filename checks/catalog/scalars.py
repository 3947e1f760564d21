"""Scalar functions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from waybill.functions import times as t
from waybill.sources.marts import single_order_sn

from ..registry import query


@query("fn_case", "o_orderkey:i low:s up:s", """
    SELECT o_orderkey, lower(o_orderpriority) AS low, upper(o_orderpriority) AS up FROM orders""")
def fn_case(v):
    return v.orders.select("o_orderkey", F.lower("o_orderpriority").alias("low"),
                           F.upper("o_orderpriority").alias("up"))


@query("fn_concat", "order_id:i address:s reason:s", """
    SELECT order_id, lower(seller_state || '-' || seller_city || '-' || seller_district)
      AS address, 'why: ' || cancel_reason AS reason FROM fx_orders""")
def fn_concat(v):
    return v.fx_orders.select(
        "order_id", F.lower(F.concat_ws("-", "seller_state", "seller_city", "seller_district"))
        .alias("address"), F.concat(F.lit("why: "), "cancel_reason").alias("reason"))


@query("fn_substr", "event_id:i hub:s", """
    SELECT event_id, substr(description, 20) AS hub FROM fx_tracking""")
def fn_substr(v):
    return v.tracking.select("event_id", F.expr("substring(description, 20)").alias("hub"))


@query("fn_array_join", "log_id:i order_sn:s", """
    SELECT log_id, array_to_string(ordersn_list, ', ') AS order_sn FROM fx_parcel""")
def fn_array_join(v):
    return single_order_sn(v.parcel)


@query("fn_json", "event_id:i k:i weight:f", """
    SELECT e.event_id, CAST(json_extract_string(e.props, '$.k') AS INTEGER) AS k,
      CAST(json_extract_string(e.props, '$.k') AS DOUBLE) / 1000 AS weight FROM events e""")
def fn_json(v):
    k = F.get_json_object("props", "$.k")
    return v.events.select("event_id", k.cast("int").alias("k"),
                           (k.cast("double") / 1000).alias("weight"))


@query("fn_struct_field", "order_id:i district:s", """
    SELECT order_id, extinfo.seller_address.district AS district FROM fx_order_logistics""")
def fn_struct_field(v):
    return v.order_logistics.select(
        "order_id", F.col("extinfo.seller_address.district").alias("district"))


@query("fn_from_epoch", "event_id:i at:t", """
    SELECT event_id, make_timestamp((actual_time - 3600) * 1000000) AS at FROM fx_tracking""")
def fn_from_epoch(v):
    return v.tracking.select("event_id", t.from_epoch("actual_time", -3600).alias("at"))


@query("fn_to_epoch", "event_id:i micros:i", """
    SELECT event_id, epoch_us(ts) AS micros FROM events""")
def fn_to_epoch(v):
    seconds = t.to_epoch(F.col("ts").cast("timestamp"))
    return v.events.select("event_id", F.round(seconds * 1000000).alias("micros"))


@query("fn_date", "event_id:i day:d", "SELECT event_id, CAST(ts AS DATE) AS day FROM events")
def fn_date(v):
    return v.events.select("event_id", t.day("ts").alias("day"))


@query("fn_date_parts", "event_id:i h:i y:i m:i w:i", """
    SELECT event_id, hour(ts) AS h, year(ts) AS y, month(ts) AS m, week(ts) AS w FROM events""")
def fn_date_parts(v):
    return v.events.select("event_id", F.hour("ts").alias("h"), F.year("ts").alias("y"),
                           F.month("ts").alias("m"), t.iso_week("ts").alias("w"))


@query("fn_dow_iso", "o_orderkey:i dow:i", """
    SELECT o_orderkey, isodow(o_orderdate) AS dow FROM orders""")
def fn_dow_iso(v):
    return v.orders.select("o_orderkey", t.iso_dow("o_orderdate").alias("dow"))


@query("fn_extract", "event_id:i h:i mi:i us:i", """
    SELECT event_id, extract(hour FROM ts) AS h, extract(minute FROM ts) AS mi,
      extract(microsecond FROM ts) AS us FROM events""")
def fn_extract(v):
    return v.events.select("event_id", F.extract(F.lit("HOUR"), "ts").alias("h"),
                           F.extract(F.lit("MINUTE"), "ts").alias("mi"),
                           (F.extract(F.lit("SECOND"), "ts") * 1000000).alias("us"))


@query("fn_date_trunc", "event_id:i day:t week:d month:d", """
    SELECT event_id, date_trunc('day', ts) AS day, date_trunc('week', ts) AS week,
      date_trunc('month', ts) AS month FROM events""")
def fn_date_trunc(v):
    return v.events.select("event_id", F.date_trunc("day", "ts").alias("day"),
                           t.period_start("ts", "week").alias("week"),
                           t.period_start("ts", "month").alias("month"))


@query("fn_date_add", "event_id:i plus:d minus:d hours:t", """
    SELECT event_id, CAST(ts AS DATE) + 15 AS plus, CAST(ts AS DATE) - 7 AS minus,
      ts + to_hours(24) AS hours FROM events""")
def fn_date_add(v):
    return v.events.select("event_id", F.date_add(t.day("ts"), 15).alias("plus"),
                           F.date_add(t.day("ts"), -7).alias("minus"),
                           F.timestamp_add("HOUR", F.lit(24), F.col("ts")).alias("hours"))


@query("fn_date_diff", "ordercode:i s:i h:i d:i w:i", """
    SELECT ordercode, datesub('second', orderdate, endpicktime) AS s,
      datesub('hour', orderdate, endpicktime) AS h, datesub('day', endpicktime,
        TIMESTAMP '2024-01-31') AS d, datesub('week', orderdate, TIMESTAMP '2024-01-31') AS w
    FROM fx_created""")
def fn_date_diff(v):
    today = F.lit(dt.date(2024, 1, 31)).cast("timestamp")
    return v.created.select(
        "ordercode", t.elapsed("second", "orderdate", "endpicktime").alias("s"),
        t.elapsed("hour", "orderdate", "endpicktime").alias("h"),
        t.elapsed("day", F.col("endpicktime"), today).alias("d"),
        t.elapsed("week", F.col("orderdate"), today).alias("w"))


@query("fn_weekday_name", "o_orderkey:i name:s", """
    SELECT o_orderkey, dayname(o_orderdate) AS name FROM orders""")
def fn_weekday_name(v):
    return v.orders.select("o_orderkey", F.date_format("o_orderdate", "EEEE").alias("name"))


@query("fn_interval", "event_id:i a:t b:t c:d", """
    SELECT event_id, ts + INTERVAL 12 HOUR AS a, ts - INTERVAL 1 DAY AS b,
      CAST(ts AS DATE) - INTERVAL 1 MONTH AS c FROM events""")
def fn_interval(v):
    return v.events.select(
        "event_id", (F.col("ts") + F.expr("INTERVAL 12 HOURS")).alias("a"),
        (F.col("ts") - F.expr("INTERVAL 1 DAY")).alias("b"),
        (F.to_date("ts") - F.expr("INTERVAL 1 MONTH")).alias("c"))


@query("fn_as_of", "week:i orders:i", """
    SELECT week(ts) AS week, count(*) AS orders FROM events
    WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-31' - 10 AND DATE '2024-01-31' - 1 GROUP BY 1""")
def fn_as_of(v):
    as_of = F.lit(dt.date(2024, 1, 31))
    recent = v.events.where(t.day("ts").between(F.date_sub(as_of, 10), F.date_sub(as_of, 1)))
    return recent.groupBy(t.iso_week("ts").alias("week")).agg(F.count(F.lit(1)).alias("orders"))


@query("fn_int_div", "ordercode:i whole:f real:f", """
    SELECT ordercode, CAST(datesub('hour', orderdate, endpicktime) // 24 AS DOUBLE) AS whole,
      datesub('second', orderdate, endpicktime) / 86400.0 AS real FROM fx_created""")
def fn_int_div(v):
    return v.created.select("ordercode", t.leadtime_days("orderdate", "endpicktime").alias("whole"),
                            t.elapsed_days_real("orderdate", "endpicktime").alias("real"))


@query("fn_round_floor", "order_id:i r0:f r1:f fl:i", """
    SELECT order_id, round(gmv * 0.022, 0) AS r0, round(gmv / 7, 1) AS r1,
      floor(gmv / 7.1) AS fl FROM fx_orders""")
def fn_round_floor(v):
    return v.fx_orders.select("order_id", F.round(F.col("gmv") * 0.022, 0).alias("r0"),
                              F.round(F.col("gmv") / 7, 1).alias("r1"),
                              F.floor(F.col("gmv") / 7.1).alias("fl"))


@query("fn_cast_round", "start_state:s end_state:s start_city:s end_city:s days:i", """
    SELECT start_state, end_state, start_city, end_city,
      CAST(floor(CAST(best AS DOUBLE) + 0.5) AS BIGINT) AS days FROM fx_sla""")
def fn_cast_round(v):
    return v.sla.select(
        "start_state", "end_state", "start_city", "end_city",
        t.round_half_up(F.col("best").cast("double")).alias("days"))


@query("fn_ci_equal", "state:s orders:i", """
    SELECT r.state, count(*) AS orders FROM fx_orders o JOIN fx_regions r
    ON lower(o.buyer_state) = lower(r.state) GROUP BY 1""")
def fn_ci_equal(v):
    return v.fx_orders.join(v.regions.select("state"), F.lower("buyer_state") == F.lower("state")).groupBy("state").agg(
        F.count(F.lit(1)).alias("orders"))
