"""Joins, aggregates, windows, sorting, limits and unions."""

from __future__ import annotations

import datetime as dt
import functools

from pyspark.sql import DataFrame, Window, functions as F

from waybill.functions.times import iso_week, period_start
from waybill.operators import attempts, bitmaps, delivery, lookups, milestones, pickup
from waybill.operators import orders as ord_
from waybill.operators.holidays import holidays_by_totals
from waybill.operators.sla import holiday_days, route_lookup, sla_region
from waybill.sources import scans

from ..registry import query

AS_OF = dt.date(2024, 1, 31)


# --- joins ---------------------------------------------------------------------

@query("join_inner", "log_id:i order_id:i weight:f", """
    SELECT p.log_id, p.order_id, f.parcel_chargeable_weight AS weight
    FROM fx_parcel p JOIN fx_fulfilment f ON p.log_id = f.log_id""")
def join_inner(v):
    side = v.fulfilment.select("log_id", F.col("parcel_chargeable_weight").alias("weight"))
    return v.parcel.join(side, "log_id")


@query("join_left", "order_id:i refund_id:i premium:f", """
    SELECT o.order_id, r.refund_id, i.premium FROM fx_orders o
    LEFT JOIN fx_refund r ON r.order_id = o.order_id
    LEFT JOIN fx_insurance i ON i.order_id = o.order_id""")
def join_left(v):
    return v.fx_orders.select("order_id").join(v.refund, "order_id", "left").join(
        v.insurance, "order_id", "left")


@query("join_lower_multikey", "order_id:i route:s", """
    SELECT o.order_id, r.route FROM fx_orders o LEFT JOIN (SELECT DISTINCT * FROM fx_routes
        WHERE ingestion_timestamp = (SELECT max(ingestion_timestamp) FROM fx_routes)) r
      ON lower(r.start_state) = lower(o.seller_state) AND lower(r.start_city) = lower(o.seller_city)
     AND lower(r.end_state) = lower(o.buyer_state) AND lower(r.end_city) = lower(o.buyer_city)""")
def join_lower_multikey(v):
    return route_lookup(v.fx_orders, v.routes)


@query("join_computed_key", "log_id:i order_id:i added:s", """
    SELECT p.log_id, o.order_id, r.added_leadtime AS added FROM fx_parcel p
    JOIN fx_orders o ON o.order_sn = array_to_string(p.ordersn_list, ', ')
    LEFT JOIN fx_oms m ON CAST(m.forder_id AS VARCHAR) = CAST(p.log_id AS VARCHAR)
    LEFT JOIN fx_remote r ON r.buyer_address = lower(o.buyer_state || '-' || o.buyer_city)
      AND r.ingestion_timestamp = 2""")
def join_computed_key(v):
    parcels = v.parcel.select("log_id", F.array_join("ordersn_list", ", ").alias("sn"))
    joined = parcels.join(v.fx_orders, F.col("sn") == F.col("order_sn"))
    remote = v.remote.where(F.col("ingestion_timestamp") == 2).select(
        "buyer_address", F.col("added_leadtime").alias("added"))
    key = F.lower(F.concat("buyer_state", F.lit("-"), "buyer_city"))
    return joined.join(remote, key == F.col("buyer_address"), "left")


HOLIDAY_SQL = """(SELECT DISTINCT shipping_carrier, type, CAST(holiday_start AS DATE) AS d,
      CAST(nb_holiday AS INTEGER) AS nb FROM fx_holiday WHERE ingestion_timestamp =
        (SELECT max(ingestion_timestamp) FROM fx_holiday))"""


@query("join_range", "log_id:i nb:i", f"""
    SELECT DISTINCT p.log_id, coalesce(h.nb, 0) AS nb FROM fx_parcel p
    LEFT JOIN {HOLIDAY_SQL} h ON lower(h.shipping_carrier) = lower(p.lm_shipment_company)
      AND h.type = 'delivery' AND h.d BETWEEN CAST(make_timestamp(p.first_time * 1000000) AS DATE)
        AND CAST(make_timestamp((p.first_time + 900000) * 1000000) AS DATE)""")
def join_range(v):
    p = v.parcel.withColumns({"a": F.timestamp_seconds("first_time"),
                              "b": F.timestamp_seconds(F.col("first_time") + 900000)})
    return holiday_days(p, v.holiday, "lm_shipment_company", F.col("a"), F.to_date("b"),
                        output="nb")


@query("join_interval", "log_id:i nb:i", f"""
    SELECT p.log_id, coalesce(sum(h.nb), 0) AS nb FROM fx_parcel p
    LEFT JOIN {HOLIDAY_SQL} h ON lower(h.shipping_carrier) = lower(p.lm_shipment_company)
      AND h.type = 'return' AND h.d BETWEEN CAST(make_timestamp(p.first_time * 1000000) AS DATE)
        AND CAST(make_timestamp(p.first_time * 1000000) AS DATE) + CAST(p.log_id % 15 AS INTEGER)
    GROUP BY 1""")
def join_interval(v):
    p = v.parcel.withColumn("a", F.timestamp_seconds("first_time"))
    end = F.date_add(F.to_date("a"), (F.col("log_id") % 15).cast("int"))
    return holiday_days(p, v.holiday, "lm_shipment_company", F.col("a"), end, kind="return",
                        output="nb", mode="sum")


@query("join_range_numbered", "log_id:i nb:i", f"""
    SELECT DISTINCT p.log_id, coalesce(h.nb, 0) AS nb FROM fx_parcel p
    LEFT JOIN {HOLIDAY_SQL} h ON lower(h.shipping_carrier) = lower(p.lm_shipment_company)
      AND h.type = 'return' AND h.d BETWEEN CAST(make_timestamp(p.first_time * 1000000) AS DATE)
        AND CAST(make_timestamp(p.first_time * 1000000) AS DATE) + CAST(p.log_id % 40 AS INTEGER)""")
def join_range_numbered(v):
    """A range join as two lookups of running totals and one of entry numbers."""
    p = v.parcel.withColumn("a", F.timestamp_seconds("first_time"))
    end = F.date_add(F.to_date("a"), (F.col("log_id") % 40).cast("int"))
    return holidays_by_totals(p, v.holiday, "lm_shipment_company", {"nb": ("return", F.col("a"), end)}, "rows")


@query("join_on_constant", "order_id:i added:s", """
    SELECT o.order_id, r.added_leadtime AS added FROM fx_orders o LEFT JOIN fx_remote r
      ON r.buyer_address = lower(o.buyer_state || '-' || o.buyer_city)
     AND r.ingestion_timestamp = 1""")
def join_on_constant(v):
    side = v.remote.where(F.col("ingestion_timestamp") == 1).select(
        "buyer_address", F.col("added_leadtime").alias("added"))
    key = F.lower(F.concat("buyer_state", F.lit("-"), "buyer_city"))
    return v.fx_orders.join(side, key == F.col("buyer_address"), "left")


@query("join_on_scalar_subquery", "order_id:i region:s", """
    SELECT o.order_id, r.region FROM fx_orders o LEFT JOIN fx_regions r
      ON lower(o.buyer_state) = r.state
     AND r.ingestion_timestamp = (SELECT max(ingestion_timestamp) FROM fx_regions)""")
def join_on_scalar_subquery(v):
    return lookups.ci_lookup(v.fx_orders, scans.latest_version(v.regions),
                             {"buyer_state": "state"}, ["region"])


@query("join_role_dims", "order_id:i seller_user:s buyer_user:s", """
    SELECT o.order_id, s.username AS seller_user, b.username AS buyer_user FROM fx_orders o
    LEFT JOIN fx_account s ON s.shopid = o.shop_id
    LEFT JOIN fx_account b ON b.userid = o.buyer_id""")
def join_role_dims(v):
    seller = v.account.where(F.col("shopid").isNotNull()).select(
        F.col("shopid"), F.col("username").alias("seller_user"))
    buyer = v.account.select(F.col("userid").alias("buyer_id"),
                             F.col("username").alias("buyer_user"))
    # one shop may hold a large part of the orders: such keys are found and split
    return lookups.skew_join(
        v.fx_orders, seller, {"shop_id": "shopid"}, ["seller_user"], ["order_id"],
        lookups.hot_keys(v.fx_orders, ["shop_id"])).join(buyer, "buyer_id", "left")


@query("join_by_status", "orderid:i picked:t delivered:t failed:t lost:t", """
    WITH a AS (SELECT orderid, new_status, make_timestamp(min(ctime) * 1000000) AS t FROM fx_audit
      GROUP BY 1, 2), k AS (SELECT DISTINCT orderid FROM a WHERE new_status IN (2, 5, 6, 11))
    SELECT k.orderid, p.t AS picked, d.t AS delivered, f.t AS failed, l.t AS lost FROM k
    LEFT JOIN a p ON p.orderid = k.orderid AND p.new_status = 2
    LEFT JOIN a d ON d.orderid = k.orderid AND d.new_status = 5
    LEFT JOIN a f ON f.orderid = k.orderid AND f.new_status = 6
    LEFT JOIN a l ON l.orderid = k.orderid AND l.new_status = 11""")
def join_by_status(v):
    return milestones.audit_wide(
        v.audit, {"picked": 2, "delivered": 5, "failed": 6, "lost": 11})


@query("join_dim_chain", "order_id:i seller_region:s buyer_region:s sla:s", """
    SELECT o.order_id, s.region AS seller_region, b.region AS buyer_region, r.sla FROM fx_orders o
    LEFT JOIN fx_regions s ON s.state = lower(o.seller_state) AND s.ingestion_timestamp = 2
    LEFT JOIN fx_regions b ON b.state = lower(o.buyer_state) AND b.ingestion_timestamp = 2
    LEFT JOIN fx_region_route r ON r.ship_from = s.region AND r.ship_to = b.region
      AND r.ingestion_timestamp = 2""")
def join_dim_chain(v):
    return sla_region(v.fx_orders, v.regions, v.region_route)


@query("join_aggregates", "week:i total:i sunday:i", """
    WITH a AS (SELECT week(orderdate) AS week, count(*) AS total FROM fx_created GROUP BY 1),
    b AS (SELECT week(orderdate) AS week, count(*) AS sunday FROM fx_created
      WHERE isodow(orderdate) = 7 GROUP BY 1)
    SELECT a.week, total, sunday FROM a LEFT JOIN b ON a.week = b.week""")
def join_aggregates(v):
    # both sides of the period join come out of one aggregate
    base = pickup.daily_base(v.created, {})
    return base.groupBy(F.weekofyear("order_day").alias("week")).agg(
        F.sum("orders").alias("total"),
        F.sum(F.when(F.weekday("order_day") == 6, F.col("orders"))).alias("sunday"))


@query("join_self", "order_id:i order_sn:s log_id:i", """
    SELECT o.order_id, x.order_sn, r.slo_id AS log_id FROM fx_orders o
    JOIN fx_orders x ON x.order_id = o.order_id
    JOIN fx_logistic r ON r.ordersn = x.order_sn WHERE o.fulfilment_channel_id = 50015""")
def join_self(v):
    # the second read of the order table only adds columns, so one read serves
    head = v.fx_orders.where(F.col("fulfilment_channel_id") == 50015).select(
        "order_id", "order_sn")
    request = v.logistic.select(F.col("ordersn").alias("order_sn"),
                                F.col("slo_id").alias("log_id"))
    return head.join(request, "order_sn")


@query("join_fanout", "week_:i carrier:s matches:i", """
    WITH ado AS (SELECT seller_state, seller_city, buyer_state, buyer_city FROM fx_orders
      WHERE (seller_state = 'NATION_3' AND seller_city = 'City 0')
         OR (buyer_state = 'NATION_3' AND buyer_city = 'City 0'))
    SELECT week(make_timestamp((o.create_timestamp - 3600) * 1000000)) AS week_,
      o.fulfilment_shipping_carrier AS carrier, count(a.seller_state) AS matches
    FROM fx_orders o LEFT JOIN ado a ON a.seller_state = o.seller_state
      AND a.seller_city = o.seller_city AND a.buyer_state = o.buyer_state
      AND a.buyer_city = o.buyer_city GROUP BY 1, 2""")
def join_fanout(v):
    orders = v.fx_orders
    listed = orders.where(
        ((F.col("seller_state") == "NATION_3") & (F.col("seller_city") == "City 0"))
        | ((F.col("buyer_state") == "NATION_3") & (F.col("buyer_city") == "City 0")))
    week = iso_week(F.timestamp_seconds(F.col("create_timestamp") - 3600))
    return delivery.area_exposure_listed(
        orders, listed, {"week_": week, "carrier": F.col("fulfilment_shipping_carrier")})


@query("join_semi", "ordercode:i", """
    SELECT ordercode FROM fx_created WHERE pickwarehouseid IN (SELECT warehouse_id
      FROM fx_dim_warehouse WHERE department_name = 'Freight Operations Department')""")
def join_semi(v):
    freight = v.dim_warehouse.where(
        F.col("department_name") == "Freight Operations Department").select("warehouse_id")
    return scans.restrict_to_ids(v.created, "pickwarehouseid", freight)


@query("join_outer_to_inner", "carrier:s n:i", """
    SELECT o.fulfilment_shipping_carrier AS carrier, count(*) AS n FROM fx_orders o
    LEFT JOIN fx_parcel p ON p.order_id = o.order_id WHERE p.inbound_type = 1 GROUP BY 1""")
def join_outer_to_inner(v):
    joined = v.fx_orders.join(v.parcel.select("order_id", "inbound_type"), "order_id", "left")
    return joined.where(F.col("inbound_type") == 1).groupBy(
        F.col("fulfilment_shipping_carrier").alias("carrier")).agg(
        F.count(F.lit(1)).alias("n"))


# --- aggregates ----------------------------------------------------------------

@query("agg_count", "o_orderpriority:s n:i with_total:i", """
    SELECT o_orderpriority, count(*) AS n, count(o_totalprice) AS with_total FROM orders
    GROUP BY 1""")
def agg_count(v):
    return v.orders.groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("n"), F.count("o_totalprice").alias("with_total"))


@query("agg_count_distinct", "l_returnflag:s orders:i", """
    SELECT l_returnflag, count(DISTINCT l_orderkey) AS orders FROM lineitem GROUP BY 1""")
def agg_count_distinct(v):
    return v.lineitem.groupBy("l_returnflag").agg(F.count_distinct("l_orderkey").alias("orders"))


@query("agg_distinct_bitmaps", "grain:s since:d orders:i returned:i", """
    SELECT g AS grain, CASE WHEN g <> 'total' THEN CAST(date_trunc(replace(g, 'total', 'year'), l_shipdate) AS DATE) END AS since,
      count(DISTINCT l_orderkey) AS orders, count(DISTINCT CASE WHEN l_returnflag = 'R' THEN l_orderkey END) AS returned
    FROM lineitem CROSS JOIN (VALUES ('day'), ('week'), ('month'), ('total')) t(g) GROUP BY 1, 2""")
def agg_distinct_bitmaps(v):
    """Distinct orders at four grains out of one table of daily bitmaps."""
    flags = {"orders": F.lit(True), "returned": F.col("l_returnflag") == "R"}
    lines = v.lineitem.withColumn("ship_day", F.to_date("l_shipdate"))
    numbers = bitmaps.order_numbers(lines, "l_orderkey", "ship_day")
    daily = bitmaps.daily_bitmaps(lines, numbers, "l_orderkey", ["ship_day"], flags)
    views = [bitmaps.distinct_counts(daily, {"grain": F.lit(g), "since": period_start("ship_day", g)}, list(flags))
             for g in ("day", "week", "month")]
    total = bitmaps.distinct_counts(daily, {"grain": F.lit("total"), "since": F.lit(None).cast("date")}, list(flags))
    return functools.reduce(DataFrame.unionByName, [*views, total])


@query("agg_count_distinct_if", "time:i volume:i ontime:i", """
    SELECT month(orderdate) AS time, count(DISTINCT ordercode) AS volume, count(DISTINCT CASE
        WHEN CAST(coalesce(firstupdatedpickeduptime, endpicktime, TIMESTAMP '2024-01-31') AS DATE)
          <= CAST(orderdate AS DATE) THEN ordercode END) AS ontime
    FROM fx_created GROUP BY 1""")
def agg_count_distinct_if(v):
    # one row per order first, so no set of codes is held per month
    flag = pickup.ontime_first_v1(AS_OF, cutoff=False)
    per_order = v.created.groupBy(F.month("orderdate").alias("time"), "ordercode").agg(
        F.max(flag).alias("ok"))
    return per_order.groupBy("time").agg(
        F.count("ordercode").alias("volume"), F.sum("ok").alias("ontime"))


@query("agg_basic", "l_returnflag:s l_linestatus:s s:f a:f lo:f hi:f", """
    SELECT l_returnflag, l_linestatus, sum(l_quantity) AS s, avg(l_extendedprice) AS a,
      min(l_discount) AS lo, max(l_extendedprice) AS hi FROM lineitem GROUP BY 1, 2""")
def agg_basic(v):
    return v.lineitem.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("s"), F.avg("l_extendedprice").alias("a"),
        F.min("l_discount").alias("lo"), F.max("l_extendedprice").alias("hi"))


@query("agg_sum_if", "o_orderpriority:s done:i open:i", """
    SELECT o_orderpriority, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS done,
      sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS open FROM orders GROUP BY 1""")
def agg_sum_if(v):
    return v.orders.groupBy("o_orderpriority").agg(
        delivery.flag_sum(F.col("o_orderstatus") == "F").alias("done"),
        delivery.flag_sum(F.col("o_orderstatus") == "O").alias("open"))


@query("agg_min_if", "log_id:i pku:t done:t", """
    SELECT log_id,
      make_timestamp((min(CASE WHEN tracking_code IN ('F100', 'F510') THEN actual_time END) - 3600)
        * 1000000) AS pku,
      make_timestamp((min(CASE WHEN tracking_code = 'F980' THEN actual_time END) - 3600)
        * 1000000) AS done FROM fx_tracking GROUP BY 1""")
def agg_min_if(v):
    return milestones.milestones(v.tracking, {
        "pku": milestones.Milestone(("F100", "F510"), "actual"),
        "done": milestones.Milestone(("F980",), "actual")})


@query("agg_max_if", "log_id:i last_pending:t", """
    SELECT log_id, make_timestamp((max(CASE WHEN status = 13 THEN actual_time END) - 3600)
      * 1000000) AS last_pending FROM fx_legacy GROUP BY 1""")
def agg_max_if(v):
    return milestones.milestones(v.legacy, {
        "last_pending": milestones.Milestone((13,), "actual", "last", "status")})


@query("agg_percentile", "event_type:s p80:f p95:f", """
    SELECT event_type, quantile_disc(value, 0.8) AS p80, quantile_disc(value, 0.95) AS p95
    FROM events GROUP BY 1""")
def agg_percentile(v):
    return v.events.groupBy("event_type").agg(
        delivery.percentile("value", 0.8, 1_000_000).alias("p80"),
        delivery.percentile("value", 0.95, 1_000_000).alias("p95"))


@query("agg_having", "order_id:i nb_parcels:i", """
    SELECT order_id, count(DISTINCT forder_id) AS nb_parcels FROM fx_oms WHERE whs_id IS NOT NULL
    GROUP BY 1 HAVING count(DISTINCT forder_id) > 1""")
def agg_having(v):
    return ord_.multi_parcel(v.oms, "order_id", "forder_id", F.col("whs_id").isNotNull())


@query("agg_group_expr", "month_:s prio:s big:i n:i total:f", """
    SELECT month(o_orderdate) || '/' || year(o_orderdate) AS month_,
      substr(o_orderpriority, 1, 1) AS prio, CASE WHEN o_totalprice > 200000 THEN 1 ELSE 0 END
      AS big, count(*) AS n, sum(round(o_totalprice)) AS total FROM orders GROUP BY 1, 2, 3""")
def agg_group_expr(v):
    month = F.concat(F.month("o_orderdate").cast("string"), F.lit("/"),
                     F.year("o_orderdate").cast("string"))
    return v.orders.groupBy(
        month.alias("month_"), F.substring("o_orderpriority", 1, 1).alias("prio"),
        F.when(F.col("o_totalprice") > 200000, 1).otherwise(0).alias("big")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.round("o_totalprice")).alias("total"))


@query("agg_grouping_sets", "time:i region:s is_total:i share:f", """
    SELECT week(orderdate) AS time,
      CASE WHEN grouping(fromregionshortname) = 1 THEN 'XXX_Total' ELSE fromregionshortname END
        AS region, grouping(fromregionshortname) AS is_total,
      round(sum(CASE WHEN endpicktime IS NOT NULL THEN 1 ELSE 0 END) * 1.0 / count(*), 4) AS share
    FROM fx_created GROUP BY GROUPING SETS ((week(orderdate), fromregionshortname),
      (week(orderdate)))""")
def agg_grouping_sets(v):
    base = pickup.daily_base(v.created, {"ok": pickup.picked()}, ["fromregionshortname"])
    base = base.withColumn("time", F.weekofyear("order_day"))
    return pickup.with_total(base, ["time"], "fromregionshortname", "XXX_Total", {"share": "ok"})


@query("agg_two_level", "order_id:i item_amount:f weight:f width:f length:f height:f", """
    SELECT order_id, sum(item_amount) AS item_amount, sum(weight) AS weight, max(width) AS width,
      max(length) AS length, max(height) AS height FROM (
        SELECT i.order_id, i.item_id, sum(CAST(d.weight AS DOUBLE) * i.item_amount) AS weight,
          max(CAST(d.dim_width AS DOUBLE)) AS width, max(CAST(d.dim_length AS DOUBLE)) AS length,
          sum(CAST(d.dim_height AS DOUBLE)) AS height, sum(i.item_amount) AS item_amount
        FROM fx_item_dims d JOIN fx_items i ON i.item_id = d.item_id GROUP BY 1, 2) GROUP BY 1""")
def agg_two_level(v):
    return ord_.order_dims(v.items, v.item_dims)


@query("agg_distinct_group", "log_id:i received:t", """
    SELECT DISTINCT log_id, make_timestamp((min(CASE WHEN tracking_code = 'F000' THEN actual_time
      END) - 3600) * 1000000) AS received FROM fx_tracking GROUP BY 1""")
def agg_distinct_group(v):
    # grouped rows are already unique: no second shuffle for the DISTINCT
    return milestones.milestones(v.tracking, {
        "received": milestones.Milestone(("F000",), "actual")})


@query("agg_ratio", "region:s share:f", """
    SELECT fromregionshortname AS region, round(sum(CASE WHEN endpicktime IS NOT NULL THEN 1 ELSE 0
      END) * 1.0 / NULLIF(count(*), 0), 4) AS share FROM fx_created GROUP BY 1""")
def agg_ratio(v):
    base = pickup.daily_base(v.created, {"ok": pickup.picked()}, ["fromregionshortname"])
    return base.groupBy(F.col("fromregionshortname").alias("region")).agg(
        F.sum("ok").alias("ok"), F.sum("orders").alias("orders")).select(
        "region", pickup.ratio("ok", "orders").alias("share"))


@query("agg_contribution", "time:i region:s contribution:f", """
    WITH t AS (SELECT week(orderdate) AS time, count(*) AS total FROM fx_created GROUP BY 1),
    d AS (SELECT week(orderdate) AS time, fromregionshortname AS region,
      sum(CASE WHEN endpicktime IS NULL THEN 1 ELSE 0 END) AS late FROM fx_created GROUP BY 1, 2)
    SELECT d.time, region, avg(late) / avg(total) AS contribution FROM d
    JOIN t ON t.time = d.time GROUP BY 1, 2""")
def agg_contribution(v):
    base = pickup.daily_base(v.created, {"ok": pickup.picked()}, ["fromregionshortname"])
    areas = base.groupBy(F.weekofyear("order_day").alias("time"),
                         F.col("fromregionshortname").alias("region")).agg(
        F.sum("orders").alias("orders"), F.sum("ok").alias("ok"))
    # the window runs over regions x weeks, not over orders
    total = F.sum("orders").over(Window.partitionBy("time"))
    return areas.select("time", "region",
                        ((F.col("orders") - F.col("ok")) / total).alias("contribution"))


@query("agg_min_coalesce", "order_id:i first_attempt:i", """
    SELECT order_id, min(coalesce(lm_first_attempt_delivery_timestamp, lm_delivered_timestamp,
      lm_first_failed_delivery_attempt_timestamp, lm_delivery_failed_timestamp,
      return_initiated_timestamp)) AS first_attempt FROM fx_parcel GROUP BY 1""")
def agg_min_coalesce(v):
    return v.parcel.groupBy("order_id").agg(F.min(F.coalesce(
        "lm_first_attempt_delivery_timestamp", "lm_delivered_timestamp",
        "lm_first_failed_delivery_attempt_timestamp", "lm_delivery_failed_timestamp",
        "return_initiated_timestamp")).alias("first_attempt"))


# --- windows -------------------------------------------------------------------

@query("win_rank_nth", "log_id:i reason:s time:t rnk:i", """
    SELECT DISTINCT log_id, reason_description AS reason,
      make_timestamp((actual_time - 3600) * 1000000) AS time, rnk
    FROM (SELECT *, rank() OVER (PARTITION BY log_id ORDER BY actual_time) AS rnk
      FROM fx_tracking WHERE tracking_code = 'F650') WHERE rnk = 2""")
def win_rank_nth(v):
    return attempts.nth_attempt(v.tracking, "F650", 2).withColumnsRenamed(
        {"tracking_detail_reason": "reason", "tracking_time": "time"})


@query("win_row_number_latest", "ward:s shop:s ordercode:i", """
    SELECT fromwardcode AS ward, clientcontactname AS shop, ordercode FROM (
      SELECT *, row_number() OVER (PARTITION BY fromwardcode, clientcontactname
        ORDER BY CAST(orderdate AS DATE) DESC, ordercode DESC) AS rn FROM fx_created) WHERE rn = 1
    """)
def win_row_number_latest(v):
    # a maximum is combined per task; a row_number would sort whole shops
    return v.created.groupBy(F.col("fromwardcode").alias("ward"),
                             F.col("clientcontactname").alias("shop")).agg(
        F.max(F.struct(F.to_date("orderdate"), "ordercode")).getField("ordercode").alias(
            "ordercode"))


@query("win_count_partition", "ordercode:i time:i region:s volume:i", """
    SELECT ordercode, week(orderdate) AS time, fromregionshortname AS region,
      count(ordercode) OVER (PARTITION BY week(orderdate), fromregionshortname) AS volume
    FROM fx_created""")
def win_count_partition(v):
    rows = v.created.select("ordercode", F.weekofyear("orderdate").alias("time"),
                            F.col("fromregionshortname").alias("region"))
    return lookups.count_by_key(rows, ["time", "region"], "volume", "ordercode")


# --- sort, limit, union --------------------------------------------------------

@query("sort_multi", "kind:s period:d region:s n:i", """
    SELECT 'Daily' AS kind, CAST(orderdate AS DATE) AS period, fromregionshortname AS region,
      count(*) AS n FROM fx_created GROUP BY 1, 2, 3 ORDER BY 1, 2 DESC, 3 DESC NULLS LAST""")
def sort_multi(v):
    base = pickup.daily_base(v.created, {}, ["fromregionshortname"])
    return base.select(F.lit("Daily").alias("kind"), F.col("order_day").alias("period"),
                       F.col("fromregionshortname").alias("region"),
                       F.col("orders").alias("n")).orderBy(
        "kind", F.col("period").desc_nulls_last(), F.col("region").desc_nulls_last())


@query("sort_ordinal", "o_orderstatus:s o_orderpriority:s n:i", """
    SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2
    ORDER BY 1, 2""")
def sort_ordinal(v):
    return v.orders.groupBy("o_orderstatus", "o_orderpriority").agg(
        F.count(F.lit(1)).alias("n")).orderBy(
        F.asc_nulls_last("o_orderstatus"), F.asc_nulls_last("o_orderpriority"))


@query("sort_by_agg", "buyer_state:s buyer_city:s total:i", """
    SELECT buyer_state, buyer_city, count(DISTINCT order_sn) AS total FROM fx_orders
    GROUP BY 1, 2 ORDER BY total DESC""")
def sort_by_agg(v):
    return v.fx_orders.groupBy("buyer_state", "buyer_city").agg(
        F.count_distinct("order_sn").alias("total")).orderBy(F.desc("total"))


@query("limit_n", "o_orderkey:i o_totalprice:f", """
    SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'
    ORDER BY o_totalprice DESC, o_orderkey LIMIT 100""")
def limit_n(v):
    return v.orders.where(F.col("o_orderstatus") == "F").orderBy(
        F.desc("o_totalprice"), "o_orderkey").limit(100)


@query("union_all", "kind:s period:s n:i", """
    SELECT 'Daily' AS kind, CAST(CAST(orderdate AS DATE) AS VARCHAR) AS period, count(*) AS n
    FROM fx_created GROUP BY ALL
    UNION ALL SELECT 'Weekly', CAST(CAST(date_trunc('week', orderdate) AS DATE) AS VARCHAR),
      count(*) FROM fx_created GROUP BY ALL
    UNION ALL SELECT 'Monthly', CAST(CAST(date_trunc('month', orderdate) AS DATE) AS VARCHAR),
      count(*) FROM fx_created GROUP BY ALL""")
def union_all(v):
    base = pickup.daily_base(v.created, {})
    views = [
        pickup.regroup(base, grain, [], []).select(
            F.lit(kind).alias("kind"), F.col("period").cast("string").alias("period"),
            F.col("orders").alias("n"))
        for kind, grain in (("Daily", "day"), ("Weekly", "week"), ("Monthly", "month"))]
    return views[0].unionByName(views[1]).unionByName(views[2])
