"""Domain operators over parcels and orders."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from waybill.functions import classify, codes
from waybill.functions import times as t
from waybill.operators import attempts as att
from waybill.operators import delivery as dlv
from waybill.operators import fees, penalty, volume
from waybill.operators import milestones as mst
from waybill.operators import orders as ord_
from waybill.operators import parcel_state as pst
from waybill.operators import sla as sl
from waybill.operators.holidays import holidays_by_totals
from waybill.operators.pickup import pickup_kpis
from waybill.plans import cases
from waybill.plans import delivery as rep
from waybill.plans import penalty as pen
from waybill.plans import pickup as pu_rep
from waybill.sources import scans

from ..oracle_views import CARRIER_LABEL, ORDER_STATE, PARCEL_STATE, day, kpis, sundays, ts
from ..registry import query

AS_OF = dt.date(2024, 1, 31)
CAMPAIGNS = (("2024-01-05", "2024-01-08", "first"), ("2024-01-12", "2024-01-16", "second"),
             ("2024-01-25", "2024-02-02", "third"))
CAMPAIGN_SQL = """CASE WHEN {x} BETWEEN DATE '2024-01-05' AND DATE '2024-01-08' THEN 'first'
      WHEN {x} BETWEEN DATE '2024-01-12' AND DATE '2024-01-16' THEN 'second'
      WHEN {x} BETWEEN DATE '2024-01-25' AND DATE '2024-02-02' THEN 'third' END"""


def base(v, channels=rep.BOTH, bonus=0.0):
    facts = rep.parcel_facts(v.fx_orders, v.fulfilment, v.parcel, v.tracking, channels=channels)
    return rep.with_allowance(facts, v.sla, v.extend, v.routes, v.holiday, bonus)


def detail_base(v):
    facts = rep.parcel_facts(
        v.fx_orders, v.fulfilment, v.parcel, v.tracking, mst.ALL_GAPS,
        order_columns=["gmv", "payment_method"], keep_id=True,
        fulfilment_columns=["parcel_chargeable_weight", "order_arrange_shipping_timestamp"])
    return rep.with_allowance(facts, v.sla, v.extend, v.routes, v.holiday)


def resolved(v):
    return mst.resolve_milestones(
        mst.milestones(v.tracking, mst.BACKLOG), v.parcel, v.fulfilment, v.audit)


def all_base(v, as_of=None):
    return rep.all_carrier_base(resolved(v), v.fx_orders, v.oms, v.warehouse, v.routes, as_of)


def classified(v, as_of=None):
    return rep.all_carrier_classified(
        all_base(v, as_of), v.sla, v.sla, v.extend, v.extend, v.holiday)


def schedule(v, carriers=None):
    return pu_rep.schedule_facts(v.fulfilment, v.parcel, v.tracking, v.logistic_data,
                                 v.fx_orders, mst.ALL_GAPS, carriers)


def eco_base(v, created_since=None):
    times = mst.bounded_pending(mst.milestones(v.legacy, mst.LEGACY, listed_only=True))
    return pen.penalty_base(v.fx_orders, v.logistic, v.logistic_data, times, v.oms, v.warehouse,
                            codes.ECONOMY_CHANNEL, True, created_since)


def exp_base(v, created_since=None):
    times = mst.milestones(v.tracking, mst.EXPRESS_PENALTY, listed_only=True)
    return pen.penalty_base(v.fx_orders, v.logistic, v.logistic_data, times, v.oms, v.warehouse,
                            codes.EXPRESS_CHANNEL, False, created_since)


def case_facts(v, ids=None, extra=()):
    times = mst.milestones(v.tracking, mst.ANOMALY, listed_only=True)
    return cases.case_base(v.fx_orders, v.logistic, v.parcel, v.fulfilment, times, extra, ids)


# --- clocks and milestones -------------------------------------------------------

@query("dom_event_clock", "event_id:i reconciled:t plain:t audit:t", f"""
    SELECT event_id, {ts('rec')} AS reconciled, {ts('act')} AS plain, {ts('ctime')} AS audit
    FROM ox_clock""")
def dom_event_clock(v):
    return v.tracking.select(
        "event_id", t.event_time("actual_time", "ctime").alias("reconciled"),
        t.event_time("actual_time").alias("plain"), t.from_epoch("ctime").alias("audit"))


MS_COLUMNS = ("log_id:i pku_done_time:t pku_1st_time:t pku_failed_time:t deli_done_time:t "
              "deli_failed_time:t deli_1st_time:t dli_pending_tracking_time:t")


@query("dom_milestones", MS_COLUMNS, "SELECT * FROM ox_ms")
def dom_milestones(v):
    return mst.milestones(v.tracking, mst.ALL_GAPS)


@query("dom_milestones_listed", "log_id:i pku_done_time:t deli_done_time:t", """
    SELECT log_id, pku_done_time, deli_done_time FROM ox_ms
    WHERE pku_done_time IS NOT NULL OR deli_done_time IS NOT NULL""")
def dom_milestones_listed(v):
    spec = {k: mst.DELIVERY[k] for k in ("pku_done_time", "deli_done_time")}
    return mst.milestones(v.tracking, spec, listed_only=True)


@query("dom_first_time", "log_id:i tracking_time:t", f"""
    SELECT log_id, {ts('min(actual_time) - 3600')} AS tracking_time FROM fx_tracking
    WHERE tracking_code = 'F100' GROUP BY 1""")
def dom_first_time(v):
    return mst.first_time(v.tracking, ["F100"])


LEGACY_COLUMNS = ("log_id:i sls_received_time:t sls_first_pickup_attempt:t sls_pickup_done:t "
                  "sls_delivery_done:t sls_return_time:t sls_del_failed:t sls_del_pending_sub:t")


@query("dom_milestones_legacy", LEGACY_COLUMNS, "SELECT * FROM ox_legacy_ms")
def dom_milestones_legacy(v):
    return mst.milestones(v.legacy, mst.LEGACY)


@query("dom_bounded_pending", "log_id:i sls_first_delivery_pending:t "
       "sls_first_delivery_attempt:t sls_return_pending:t sls_first_return_attempt:t",
       "SELECT * FROM ox_bounded")
def dom_bounded_pending(v):
    return mst.bounded_pending(mst.milestones(v.legacy, mst.LEGACY))


WIDE = " ".join(f"dli_{i}_time:t dli_{i}_reason:s" for i in (1, 2, 3))


@query("dom_nth_attempt", f"log_id:i {WIDE}", "SELECT * FROM ox_wide")
def dom_nth_attempt(v):
    return att.attempts_wide(v.tracking, "F650", 3)


@query("dom_nth_return", "log_id:i reason:s time:t", f"""
    SELECT DISTINCT log_id, json_extract_string(tracking_detail, '$.k') AS reason,
      {ts('actual_time - 3600')} AS time FROM (SELECT *, rank() OVER (PARTITION BY log_id
        ORDER BY actual_time) AS rnk FROM fx_tracking WHERE resource_status = '25')
    WHERE rnk = 1""")
def dom_nth_return(v):
    return att.nth_attempt(
        v.tracking, codes.RESOURCE_RETURN, 1, column="resource_status",
        reason=F.get_json_object("tracking_detail", "$.k")).withColumnsRenamed(
        {"tracking_detail_reason": "reason", "tracking_time": "time"})


def arrivals(v):
    """The log in three disjoint parts, by the day an event arrived; late events come with a later part."""
    at = F.to_date(F.timestamp_seconds("ctime"))
    early, late = F.lit("2024-01-10").cast("date"), F.lit("2024-01-20").cast("date")
    return [v.tracking.where(at < early), v.tracking.where((at >= early) & (at < late)), v.tracking.where(at >= late)]


@query("dom_state_milestones", MS_COLUMNS, """
    SELECT * FROM ox_ms WHERE coalesce(pku_done_time, deli_done_time, deli_failed_time, deli_1st_time,
      dli_pending_tracking_time, pku_1st_time, pku_failed_time) IS NOT NULL""")
def dom_state_milestones(v):
    days = [pst.day_state(part, mst.ALL_GAPS, "F650") for part in arrivals(v)]
    return pst.state_milestones(pst.merge_states(days, mst.ALL_GAPS), mst.ALL_GAPS)


@query("dom_state_attempts", f"log_id:i {WIDE}", "SELECT * FROM ox_wide")
def dom_state_attempts(v):
    first, second, third = [pst.day_state(part, mst.ALL_GAPS, "F650") for part in arrivals(v)]
    yesterday = pst.merge_states([third, first], mst.ALL_GAPS)  # in any order
    return pst.state_attempts(pst.merge_states([yesterday, second], mst.ALL_GAPS))


@query("dom_attempt_count", "log_id:i attempt_count:i", "SELECT * FROM ox_attempts")
def dom_attempt_count(v):
    return att.attempts_wide(v.tracking, "F650").withColumn("attempt_count", att.attempt_count())


@query("dom_attempt_gap", "log_id:i attempt_gap:s", "SELECT * FROM ox_attempts")
def dom_attempt_gap(v):
    return att.attempts_wide(v.tracking, "F650").withColumn("attempt_gap", att.attempt_gap_class())


@query("dom_attempt_hour", "log_id:i attempt_hour:s attempt_hour_two:s pending:s", """
    SELECT a.*, CASE WHEN hour(m.dli_pending_tracking_time) > 21 THEN 'Sau 21h'
      WHEN hour(m.dli_pending_tracking_time) < 6 THEN 'Trước 6h' ELSE 'Bình thường' END AS pending
    FROM ox_attempts a JOIN ox_ms m ON m.log_id = a.log_id""")
def dom_attempt_hour(v):
    wide = att.attempts_wide(v.tracking, "F650")
    pending = mst.milestones(v.tracking, {"p": mst.DELIVERY["dli_pending_tracking_time"]})
    return wide.join(pending, "log_id").withColumns({
        "attempt_hour": att.abnormal_hour(),
        "attempt_hour_two": att.abnormal_hour(check_third_evening=False),
        "pending": att.pending_hour("p")})


@query("dom_fake_attempts", f"log_id:i {WIDE}", "SELECT * FROM ox_fake")
def dom_fake_attempts(v):
    return att.fake_attempts(att.attempts_wide(v.tracking, "F650"))


@query("dom_hub_arrival", "log_id:i lm_hub:s lm_hub_ib_time:t", "SELECT * FROM ox_hub")
def dom_hub_arrival(v):
    return mst.hub_arrival(v.tracking)


@query("dom_audit_times", "orderid:i status:i first:t last:t", f"""
    SELECT f.orderid, f.new_status AS status, f.t AS first, l.last FROM (
      SELECT orderid, new_status, {ts('min(ctime)')} AS t FROM fx_audit
      WHERE {day(ts('ctime - 3600'))} >= DATE '2024-01-03' GROUP BY 1, 2) f
    JOIN (SELECT orderid, {ts('max(ctime) - 3600')} AS last FROM fx_audit GROUP BY 1) l
      ON l.orderid = f.orderid""")
def dom_audit_times(v):
    first = mst.audit_first(v.audit, dt.date(2024, 1, 3)).withColumnRenamed("min_ctime", "first")
    return first.join(mst.audit_last(v.audit, "last"), "orderid")


@query("dom_fallback_milestones", "log_id:i order_id:i lm_tracking_no:s is_drop_off:i "
       "schedule_time:t pickup_done_time:t delivery_done_time:t first_attempt_delivery_time:t "
       "failed_delivery_time:t dli_pending_tracking_time:t", "SELECT * FROM ox_resolved")
def dom_fallback_milestones(v):
    return resolved(v)


# --- orders ------------------------------------------------------------------------

@query("dom_multi_parcel", "key:s id:s nb:i", """
    SELECT 'order' AS key, CAST(order_id AS VARCHAR) AS id, count(DISTINCT forder_id) AS nb
    FROM fx_oms WHERE whs_id IS NOT NULL GROUP BY 2 HAVING count(DISTINCT forder_id) > 1
    UNION ALL SELECT 'consignment', CAST(order_id AS VARCHAR), count(DISTINCT consignment_no)
    FROM fx_fulfilment WHERE is_reverse = 0 GROUP BY 2 HAVING count(DISTINCT consignment_no) > 1
    UNION ALL SELECT 'parcel', CAST(order_id AS VARCHAR), count(DISTINCT lm_tracking_no)
    FROM fx_parcel WHERE whs_id IS NOT NULL GROUP BY 2
    HAVING count(DISTINCT lm_tracking_no) > 1""")
def dom_multi_parcel(v):
    variants = {
        "order": ord_.multi_parcel(v.oms, "order_id", "forder_id", F.col("whs_id").isNotNull()),
        "consignment": ord_.multi_parcel(v.fulfilment, "order_id", "consignment_no",
                                         F.col("is_reverse") == 0),
        "parcel": ord_.multi_parcel(v.parcel, "order_id", "lm_tracking_no",
                                    F.col("whs_id").isNotNull()),
    }
    parts = [df.select(F.lit(k).alias("key"), F.col("order_id").cast("string").alias("id"),
                       F.col("nb_parcels").alias("nb")) for k, df in variants.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("dom_group_shipment", "kind:s id:s total_group:i label:s", """
    SELECT kind, id, total_group, CASE WHEN total_group > 1 THEN 'Grouped' ELSE 'Not grouped' END
      AS label FROM (
      SELECT 'order' AS kind, CAST(order_id AS VARCHAR) AS id, count(oms_forder_id) AS total_group
      FROM fx_fulfilment GROUP BY 2
      UNION ALL SELECT 'tracking', p.lm_tracking_no, count(DISTINCT f.ofg_id) FROM fx_parcel p
      LEFT JOIN fx_fulfilment f ON f.log_id = p.log_id
      LEFT JOIN fx_orders o ON o.order_id = f.order_id
      WHERE o.is_cb_shop = 0 AND p.is_reverse = 0
        AND p.lm_shipment_company NOT IN ('Standard Express') GROUP BY 2)""")
def dom_group_shipment(v):
    by_order = ord_.group_size(v.fulfilment, "order_id", "oms_forder_id").select(
        F.lit("order").alias("kind"), F.col("order_id").cast("string").alias("id"), "total_group")
    by_tracking = ord_.group_shipment_by_tracking(v.parcel, v.fulfilment, v.fx_orders).select(
        F.lit("tracking").alias("kind"), F.col("lm_tracking_no").alias("id"), "total_group")
    return by_order.unionByName(by_tracking).withColumn("label", ord_.group_label("total_group"))


@query("dom_order_dims", "order_id:i item_amount:f length:f width:f height:f big:i", """
    SELECT order_id, sum(item_amount) AS item_amount, max(length) AS length, max(width) AS width,
      max(height) AS height, CASE WHEN max(height) > 50 THEN 1 ELSE 0 END AS big FROM (
        SELECT i.order_id, i.item_id, max(CAST(d.dim_width AS DOUBLE)) AS width,
          max(CAST(d.dim_length AS DOUBLE)) AS length, sum(CAST(d.dim_height AS DOUBLE)) AS height,
          sum(i.item_amount) AS item_amount
        FROM fx_item_dims d JOIN fx_items i ON i.item_id = d.item_id GROUP BY 1, 2) GROUP BY 1""")
def dom_order_dims(v):
    return ord_.order_dims(v.items, v.item_dims).withColumn(
        "big", F.when(F.col("height") > 50, 1).otherwise(0))


@query("dom_origin_override", "log_id:i state:s city:s snapshot_state:s", """
    SELECT p.log_id,
      CASE WHEN o.is_cb_shop = 1 AND p.lm_shipment_provider IN ('VN_JNT', 'VN_CB_SPX_N')
          THEN 'Hà Nội'
        WHEN o.is_cb_shop = 1 AND p.lm_shipment_provider IN ('VN_JNT_S', 'VN_CB_SPX_S')
          THEN 'TP. Hồ Chí Minh'
        WHEN m.order_id IS NOT NULL THEN w.state WHEN p.whs_id = 'VNN' THEN 'Hà Nội'
        WHEN p.whs_id IN ('VNS', 'VNW') THEN 'TP. Hồ Chí Minh' ELSE o.seller_state END AS state,
      CASE WHEN o.is_cb_shop = 1 AND p.lm_shipment_provider IN ('VN_JNT', 'VN_CB_SPX_N')
          THEN 'Quận Long Biên'
        WHEN o.is_cb_shop = 1 AND p.lm_shipment_provider IN ('VN_JNT_S', 'VN_CB_SPX_S')
          THEN 'Huyện Củ Chi'
        WHEN m.order_id IS NOT NULL THEN w.city WHEN p.whs_id = 'VNN' THEN 'Quận Long Biên'
        WHEN p.whs_id IN ('VNS', 'VNW') THEN 'Huyện Củ Chi' ELSE o.seller_city END AS city,
      CASE WHEN p.whs_id = 'VNN' THEN 'Hà Nội' WHEN p.whs_id IN ('VNS', 'VNW')
        THEN 'TP. Hồ Chí Minh' ELSE p.seller_address_state END AS snapshot_state
    FROM fx_parcel p JOIN fx_orders o ON o.order_id = p.order_id
    LEFT JOIN ox_multi_wh m ON m.order_id = p.order_id
    LEFT JOIN fx_oms s ON s.forder_id = p.log_id LEFT JOIN fx_warehouse w ON w.whs_id = s.whs_id""")
def dom_origin_override(v):
    multi = ord_.multi_parcel(v.oms, "order_id", "forder_id", F.col("whs_id").isNotNull())
    depot = v.oms.select(F.col("forder_id").alias("log_id"), F.col("whs_id").alias("w"))
    places = v.warehouse.select(F.col("whs_id").alias("w"), F.col("state").alias("ws"),
                                F.col("city").alias("wc"))
    head = v.fx_orders.select("order_id", "is_cb_shop", "seller_state", "seller_city")
    joined = (v.parcel.join(head, "order_id").join(multi, "order_id", "left")
              .join(depot, "log_id", "left").join(places, "w", "left"))
    many = F.col("nb_parcels").isNotNull()
    return joined.select(
        "log_id", classify.origin_address("state", "seller_state", "ws", many).alias("state"),
        classify.origin_address("city", "seller_city", "wc", many).alias("city"),
        classify.warehouse_state("seller_address_state").alias("snapshot_state"))


@query("dom_carrier_label", "log_id:i carrier:s tpl_name:s tpl_call:s area:s", f"""
    SELECT p.log_id, {CARRIER_LABEL} AS carrier,
      CASE WHEN o.is_cb_shop = 1 AND p.lm_shipment_provider IN ('VN_JNT', 'VN_JNT_S')
          THEN 'J&T Express'
        WHEN o.is_cb_shop = 1 AND p.lm_shipment_provider IN ('VN_CB_SPX_N', 'VN_CB_SPX_S')
          THEN 'Shopee Express' ELSE o.fulfilment_shipping_carrier END AS tpl_name,
      CASE WHEN o.is_cb_shop = 1 AND p.lm_shipment_provider IN ('VN_JNT', 'VN_JNT_S')
          THEN 'J&T - CB'
        WHEN o.is_cb_shop = 1 AND p.lm_shipment_provider IN ('VN_CB_SPX_N', 'VN_CB_SPX_S')
          THEN 'SPX - CB' WHEN o.fulfilment_channel_id = 50021 THEN 'Shopee Xpress'
        ELSE o.fulfilment_shipping_carrier END AS tpl_call,
      CASE o.fulfilment_channel_id WHEN 50024 THEN 'BEST Express' WHEN 50021 THEN 'Shopee Express'
        WHEN 50010 THEN 'Viettel Post' WHEN 50012 THEN 'Giao Hàng Tiết Kiệm'
        WHEN 50015 THEN 'VNPost Nhanh' WHEN 50016 THEN 'VNPost Tiết Kiệm'
        ELSE CASE o.shipping_method_id WHEN 5001 THEN 'Giao Hàng Nhanh'
          WHEN 5002 THEN 'Giao Hàng Nhanh - ECO' ELSE 'no' END END AS area
    FROM fx_parcel p JOIN fx_orders o ON o.order_id = p.order_id""")
def dom_carrier_label(v):
    joined = v.parcel.select("log_id", "order_id", "lm_shipment_provider").join(
        v.fx_orders, "order_id")
    return joined.select(
        "log_id", classify.carrier_label(provider="lm_shipment_provider").alias("carrier"),
        classify.tpl_name().alias("tpl_name"), classify.tpl_call().alias("tpl_call"),
        classify.area_carrier_label().alias("area"))


@query("dom_status_decode", "order_id:i log_id:i order_state:s parcel_state:s", f"""
    SELECT o.order_id, p.log_id, {ORDER_STATE.format(x='o.logistics_status_id')} AS order_state,
      {PARCEL_STATE.format(x='p.parcel_logistics_status_code')} AS parcel_state
    FROM fx_orders o LEFT JOIN fx_parcel p ON p.order_id = o.order_id""")
def dom_status_decode(v):
    joined = v.fx_orders.select("order_id", "logistics_status_id").join(
        v.parcel.select("order_id", "log_id", "parcel_logistics_status_code"), "order_id", "left")
    return joined.select(
        "order_id", "log_id", classify.order_state("logistics_status_id").alias("order_state"),
        classify.parcel_state("parcel_logistics_status_code").alias("parcel_state"))


@query("dom_classifiers", "log_id:i payment:s payment_id:s tier:s ship:s ship1:s dropoff:i", f"""
    SELECT p.log_id, CASE WHEN o.payment_method = 'PAY_COD' THEN 'COD' ELSE 'CC' END AS payment,
      CASE WHEN o.payment_method_id = 6 THEN 'COD' ELSE 'CC' END AS payment_id,
      CASE WHEN o.is_preferred_shop = 1 THEN 'preferred_shop' WHEN o.is_preferred_plus_shop = 1
        THEN 'preferred_plus_shop' WHEN o.is_official_shop = 1 THEN 'shop Mall' ELSE 'no' END
        AS tier,
      CASE WHEN rd.pickup_time - 3600 >= 31536000 THEN 'pickup'
        WHEN rd.pickup_time - 3600 < 31536000 THEN 'drop-off' END AS ship,
      CASE p.inbound_type WHEN 1 THEN 'pickup' WHEN 2 THEN 'dropoff' END AS ship1,
      CASE WHEN year({ts('rd.pickup_time - 3600')}) > 1970 THEN 0 ELSE 1 END AS dropoff
    FROM fx_parcel p JOIN fx_orders o ON o.order_id = p.order_id
    LEFT JOIN fx_logistic_data rd ON rd.log_id = p.log_id""")
def dom_classifiers(v):
    joined = v.parcel.join(v.logistic_data, "log_id", "left").join(v.fx_orders.drop("order_sn"),
                                                                   "order_id")
    return joined.select(
        "log_id", classify.payment_type().alias("payment"),
        classify.payment_type_by_id().alias("payment_id"), classify.seller_tier().alias("tier"),
        classify.shipment_type("pickup_time", "first_time").alias("ship"),
        classify.shipment_type_inbound().alias("ship1"),
        classify.is_dropoff("pickup_time").alias("dropoff"))


# --- service levels ------------------------------------------------------------------

@query("dom_route_lookup", "lm_tracking_no:s route:s", "SELECT * FROM ox_base_bonus")
def dom_route_lookup(v):
    facts = rep.parcel_facts(v.fx_orders, v.fulfilment, v.parcel, v.tracking,
                             channels=[codes.EXPRESS_CHANNEL])
    return sl.route_lookup(facts, v.routes)


@query("dom_sla_lookup", "lm_tracking_no:s sla:f sla_bonus:f delivery_area:s", """
    SELECT b.lm_tracking_no, b.sla, x.sla AS sla_bonus, b.delivery_area FROM ox_base b
    LEFT JOIN (SELECT DISTINCT lm_tracking_no, sla FROM ox_base_bonus) x
      ON x.lm_tracking_no = b.lm_tracking_no GROUP BY ALL""")
def dom_sla_lookup(v):
    facts = sl.route_lookup(rep.parcel_facts(
        v.fx_orders, v.fulfilment, v.parcel, v.tracking), v.routes)
    plain = sl.sla_days(facts, v.sla, v.extend, "fulfillment_channel_id")
    with_bonus = sl.sla_days(
        facts.where(F.col("fulfillment_channel_id") == codes.EXPRESS_CHANNEL), v.sla, v.extend,
        "fulfillment_channel_id", 0.5).select("lm_tracking_no", F.col("sla").alias("sla_bonus"))
    return plain.join(with_bonus, "lm_tracking_no", "left")


@query("dom_sla_multi", "log_id:i order_id:i total_sla:f", """
    SELECT log_id, order_id, total_sla FROM ox_allsla""")
def dom_sla_multi(v):
    return sl.sla_days_multi(all_base(v), v.sla, v.sla, v.extend, v.extend)


@query("dom_sla_region", "kind:s order_id:i log_id:i ship_from:s ship_to:s total_sla:f", """
    SELECT 'region' AS kind, order_id, log_id, ship_from, ship_to, total_sla FROM ox_eco_sla
    UNION ALL SELECT 'express', order_id, log_id, ship_from, ship_to, total_sla FROM ox_exp_sla""")
def dom_sla_region(v):
    keep = ["order_id", "log_id", "ship_from", "ship_to"]
    region = sl.sla_region(eco_base(v), v.regions, v.region_route).select(
        F.lit("region").alias("kind"), *keep, F.col("sla").cast("double").alias("total_sla"))
    express = sl.sla_express(exp_base(v), v.area, v.express_route, v.rural).select(
        F.lit("express").alias("kind"), *keep, "total_sla")
    return region.unionByName(express)


@query("dom_sundays", "lm_tracking_no:s d_sundays:f", "SELECT * FROM ox_base_detail")
def dom_sundays(v):
    facts = rep.parcel_facts(v.fx_orders, v.fulfilment, v.parcel, v.tracking)
    return facts.withColumn("d_sundays", t.sundays_between("pku_done_time", "deli_1st_time"))


@query("dom_sundays_orders", "ordercode:i sundays:f", """
    SELECT ordercode, """ + sundays("orderdate", "TIMESTAMP '2024-01-31 10:00:00'")
       + " AS sundays FROM fx_created")
def dom_sundays_orders(v):
    end = F.lit("2024-01-31 10:00:00").cast("timestamp")
    return v.created.select("ordercode", t.sundays_between("orderdate", end).alias("sundays"))


@query("dom_holidays", "lm_tracking_no:s d_holidays:f", """
    SELECT DISTINCT lm_tracking_no, d_holidays FROM ox_base""")
def dom_holidays(v):
    return base(v).select("lm_tracking_no", "d_holidays")


@query("dom_holidays_sum", "log_id:i d_holidays:f", f"""
    SELECT p.log_id, coalesce(sum(h.nb), 0) AS d_holidays FROM fx_parcel p
    LEFT JOIN ox_ms m ON m.log_id = p.log_id
    LEFT JOIN ox_holiday h ON h.type = 'delivery' AND h.carrier = lower(p.lm_shipment_company)
      AND h.d BETWEEN {day('m.pku_done_time')} AND {day('m.deli_1st_time')} GROUP BY 1""")
def dom_holidays_sum(v):
    facts = mst.milestones(v.tracking, mst.DELIVERY).join(v.parcel, "log_id")
    return sl.holiday_days(facts, v.holiday, "lm_shipment_company", F.col("pku_done_time"),
                           t.day("deli_1st_time"), mode="sum")


@query("dom_holidays_totals", "log_id:i delivery:f back:f", f"""
    SELECT p.log_id, coalesce(sum(h.nb) FILTER (h.type = 'delivery' AND h.d BETWEEN {day('m.pku_done_time')}
        AND {day('m.deli_1st_time')}), 0) AS delivery,
      coalesce(sum(h.nb) FILTER (h.type = 'return' AND h.d BETWEEN {day('m.pku_done_time')}
        AND {day('m.pku_done_time')} + 15), 0) AS back
    FROM fx_parcel p LEFT JOIN ox_ms m ON m.log_id = p.log_id
    LEFT JOIN ox_holiday h ON h.carrier = lower(p.lm_shipment_company) GROUP BY 1""")
def dom_holidays_totals(v):
    facts = v.parcel.join(mst.milestones(v.tracking, mst.DELIVERY), "log_id", "left")
    return holidays_by_totals(facts, v.holiday, "lm_shipment_company", {
        "delivery": ("delivery", F.col("pku_done_time"), t.day("deli_1st_time")),
        "back": ("return", F.col("pku_done_time"), F.date_add(t.day("pku_done_time"), 15))}, "sum")


@query("dom_due_date", "lm_tracking_no:s expected_delivery:t", "SELECT * FROM ox_base")
def dom_due_date(v):
    return base(v)


@query("dom_due_date_all", "log_id:i order_id:i expected_delivery:t", """
    SELECT DISTINCT log_id, order_id, expected_delivery FROM ox_class""")
def dom_due_date_all(v):
    return classified(v)


@query("dom_ontime_class", "log_id:i order_id:i check_delivery_ontime:s", """
    SELECT log_id, order_id, check_delivery_ontime FROM ox_class
    GROUP BY log_id, order_id, check_delivery_ontime, d_holidays""")
def dom_ontime_class(v):
    return classified(v)


# --- KPIs ------------------------------------------------------------------------------
KPI = ("gross_deli_request:i gross_ontime_deli_1st:i gross_deli_done:i gross_ontime_deli_done:i "
       "gross_failed:i gross_1st_deli_done:i")


@query("dom_delivery_kpis", f"shipping_carrier:s route:s {KPI}", f"""
    SELECT shipping_carrier, route, {kpis()} FROM ox_base GROUP BY 1, 2""")
def dom_delivery_kpis(v):
    return dlv.delivery_kpis(base(v), ["shipping_carrier", "route"])


@query("dom_pickup_schedule", "log_id:i scheduled_date1:t shipment_type:s shipment_type1:s "
       "gross_pickup_request:i ontime_pickup_done:i ontime_pickup:i gross_pickup_done:i "
       "gross_pickup_failed:i pickup_leadtime:i", "SELECT * FROM ox_schedule")
def dom_pickup_schedule(v):
    return schedule(v)


@query("dom_pickup_kpis", "carrier:s gross_pickup:i gross_pickup_done:i gross_pickup_failed:i "
       "gross_ontime_pu_done:i gross_ontime_pu:i gap_time:f", """
    SELECT fulfilment_shipping_carrier AS carrier, sum(gross_pickup_request) AS gross_pickup,
      sum(gross_pickup_done) AS gross_pickup_done, sum(gross_pickup_failed) AS gross_pickup_failed,
      sum(ontime_pickup_done) AS gross_ontime_pu_done, sum(ontime_pickup) AS gross_ontime_pu,
      round(quantile_disc((epoch(pku_done_time) - epoch(pku_1st_time)) / 86400, 0.95), 3)
        AS gap_time FROM ox_schedule GROUP BY 1""")
def dom_pickup_kpis(v):
    gap = (t.to_epoch("pku_done_time") - t.to_epoch("pku_1st_time")) / F.lit(86400)
    return pickup_kpis(schedule(v), [F.col("fulfilment_shipping_carrier").alias("carrier")], gap)


@query("dom_campaign", "lm_tracking_no:s cp:s cp_no:s", f"""
    SELECT lm_tracking_no, {CAMPAIGN_SQL.format(x=day('expected_delivery'))} AS cp,
      coalesce({CAMPAIGN_SQL.format(x=day('expected_delivery'))}, 'no') AS cp_no FROM ox_base""")
def dom_campaign(v):
    return base(v).select(
        "lm_tracking_no", classify.campaign_bucket("expected_delivery", CAMPAIGNS).alias("cp"),
        classify.campaign_bucket("expected_delivery", CAMPAIGNS, "no").alias("cp_no"))


@query("dom_leadtime_gaps", "lm_tracking_no:s created_time:t gap_created_to_first_pu:f "
       "gap_first_pu_to_pu_done:f gap_pu_done_to_first_deli:f gap_first_deli_to_deli_done:f", f"""
    SELECT DISTINCT lm_tracking_no, {ts('order_arrange_shipping_timestamp')} AS created_time,
      round((epoch(pku_1st_time) - order_arrange_shipping_timestamp) / 86400, 3)
        AS gap_created_to_first_pu,
      round((epoch(pku_done_time) - epoch(pku_1st_time)) / 86400, 3) AS gap_first_pu_to_pu_done,
      round((epoch(deli_1st_time) - epoch(pku_done_time)) / 86400, 3) AS gap_pu_done_to_first_deli,
      round((epoch(deli_done_time) - epoch(deli_1st_time)) / 86400, 3)
        AS gap_first_deli_to_deli_done FROM ox_base_detail""")
def dom_leadtime_gaps(v):
    return rep.leadtime_gap_detail(detail_base(v)).distinct()


@query("dom_leadtime_days", "lm_tracking_no:s deli_done_leadtime:i deli_1st_leadtime:i", """
    SELECT lm_tracking_no,
      trunc(datesub('hour', pku_done_time, deli_done_time) / 24.0) AS deli_done_leadtime,
      trunc(datesub('hour', pku_done_time, deli_1st_time) / 24.0) AS deli_1st_leadtime
    FROM ox_base""")
def dom_leadtime_days(v):
    return base(v).withColumns(rep.leadtime_columns())


STATS = "avg_time:f percentile_80:f percentile_95:f order_:i"


@query("dom_leadtime_stats", f"shipping_carrier:s route:s {STATS}", """
    SELECT shipping_carrier, route, round(avg(deli_1st_leadtime), 1) AS avg_time,
      round(quantile_disc(deli_1st_leadtime, 0.8), 1) AS percentile_80,
      round(quantile_disc(deli_1st_leadtime, 0.95), 1) AS percentile_95,
      count(DISTINCT lm_tracking_no) AS order_ FROM ox_lead GROUP BY 1, 2""")
def dom_leadtime_stats(v):
    lead = base(v).withColumn(
        "deli_1st_leadtime", t.gap_days("pku_done_time", "deli_1st_time", 1))
    return dlv.leadtime_stats(lead, ["shipping_carrier", "route"])


P1, P2 = ("2024-01-08", "2024-01-14"), ("2024-01-15", "2024-01-21")


@query("dom_compare_periods", "shipping_carrier:s buyer_state:s avg_1:f avg_2:f "
       "percentile_80_1:f percentile_80_2:f percentile_95_1:f percentile_95_2:f", f"""
    WITH p AS (SELECT *, CASE WHEN {day('expected_delivery')} BETWEEN DATE '{P1[0]}' AND
        DATE '{P1[1]}' THEN 1 WHEN {day('expected_delivery')} BETWEEN DATE '{P2[0]}' AND
        DATE '{P2[1]}' THEN 2 END AS n FROM ox_lead)
    SELECT shipping_carrier, buyer_state, """ + ", ".join(
        f"round(avg(deli_1st_leadtime) FILTER (n = {i}), 1) AS avg_{i}, "
        f"round(quantile_disc(deli_1st_leadtime, 0.8) FILTER (n = {i}), 1) AS percentile_80_{i}, "
        f"round(quantile_disc(deli_1st_leadtime, 0.95) FILTER (n = {i}), 1) AS percentile_95_{i}"
        for i in (1, 2)) + " FROM p WHERE n IS NOT NULL GROUP BY 1, 2")
def dom_compare_periods(v):
    return rep.leadtime_two_periods(base(v), P1, P2)


@query("dom_compare_periods_joined", "week_:i shipping_carrier:s buyer_state:s avg_1:f avg_2:f "
       "percentile_80_1:f percentile_80_2:f percentile_95_1:f percentile_95_2:f", f"""
    WITH d1 AS (SELECT * FROM ox_lead WHERE {day('expected_delivery')}
        BETWEEN DATE '{P1[0]}' AND DATE '{P1[1]}'),
    d2 AS (SELECT * FROM ox_lead WHERE {day('expected_delivery')}
        BETWEEN DATE '{P2[0]}' AND DATE '{P2[1]}')
    SELECT week(d1.expected_delivery) + 1 AS week_, d1.shipping_carrier, d1.buyer_state,
      round(avg(d1.deli_1st_leadtime), 3) AS avg_1, round(avg(d2.deli_1st_leadtime), 3) AS avg_2,
      round(quantile_disc(d1.deli_1st_leadtime, 0.8), 1) AS percentile_80_1,
      round(quantile_disc(d2.deli_1st_leadtime, 0.8), 1) AS percentile_80_2,
      round(quantile_disc(d1.deli_1st_leadtime, 0.95), 1) AS percentile_95_1,
      round(quantile_disc(d2.deli_1st_leadtime, 0.95), 1) AS percentile_95_2
    FROM d1 LEFT JOIN d2 ON d1.shipping_carrier = d2.shipping_carrier GROUP BY 1, 2, 3""")
def dom_compare_periods_joined(v):
    return rep.leadtime_two_periods(base(v), P1, P2, faithful=True, digits=3)


# --- backlog, pending, exposure ------------------------------------------------------------

@query("dom_backlog", "buyer_state:s buyer_city:s aging_6_days:i aging_6_11_days:i "
       "aging_12_days:i total_backlog:i", """
    SELECT buyer_state, buyer_city, sum(CASE WHEN age <= 6 THEN 1 ELSE 0 END) AS aging_6_days,
      sum(CASE WHEN age > 6 AND age <= 11 THEN 1 ELSE 0 END) AS aging_6_11_days,
      sum(CASE WHEN age > 11 THEN 1 ELSE 0 END) AS aging_12_days,
      count(DISTINCT lm_tracking_no) AS total_backlog FROM ox_open GROUP BY 1, 2""")
def dom_backlog(v):
    names = ["aging_6_days", "aging_6_11_days", "aging_12_days"]
    rows = rep.backlog_detail(v.fx_orders, v.parcel, v.tracking, AS_OF, "2000-01-01").select(
        "lm_tracking_no", "buyer_state", "buyer_city", *names).distinct()
    return dlv.backlog_by_area(rows, ["buyer_state", "buyer_city"], names)


@query("dom_pending", "log_id:i kind:s", """
    SELECT log_id, CASE WHEN pku_done_time IS NULL AND seller_state = 'NATION_3'
      AND logistics_status_id <> 4 THEN 'Pending pickup' ELSE 'Pending Deli' END AS kind
    FROM ox_case WHERE logistics_status_id NOT IN (7, 8, 10, 11)""")
def dom_pending(v):
    rows = case_facts(v).where(~F.col("logistics_status_id").isin(7, 8, 10, 11))
    return rows.select("log_id", dlv.pending_kind("NATION_3").alias("kind"))


@query("dom_area_exposure", "week_:i carrier:s touching:i as_seller:i as_buyer:i", f"""
    SELECT week({ts('create_timestamp - 3600')}) AS week_, fulfilment_shipping_carrier AS carrier,
      sum(CASE WHEN (seller_state = 'NATION_3' AND seller_city = 'City 0')
        OR (buyer_state = 'NATION_3' AND buyer_city = 'City 0') THEN 1 ELSE 0 END) AS touching,
      sum(CASE WHEN seller_state = 'NATION_3' AND seller_city = 'City 0' THEN 1 ELSE 0 END)
        AS as_seller,
      sum(CASE WHEN buyer_state = 'NATION_3' AND buyer_city = 'City 0' THEN 1 ELSE 0 END)
        AS as_buyer FROM fx_orders GROUP BY 1, 2""")
def dom_area_exposure(v):
    return dlv.area_exposure(v.fx_orders, "NATION_3", "City 0", [
        t.iso_week(t.from_epoch("create_timestamp", -3600)).alias("week_"),
        F.col("fulfilment_shipping_carrier").alias("carrier")])


# --- penalties -------------------------------------------------------------------------------

@query("dom_noon_adjust", "order_id:i log_id:i adjusted_pickup:t adjusted_return:t",
       "SELECT * FROM ox_eco_base")
def dom_noon_adjust(v):
    return eco_base(v)


@query("dom_weekend_allowance", "order_id:i log_id:i delivery_w_weekend:f return_w_weekend:f", """
    SELECT DISTINCT order_id, log_id, delivery_w_weekend, return_w_weekend FROM ox_eco""")
def dom_weekend_allowance(v):
    df = sl.sla_region(eco_base(v), v.regions, v.region_route)
    return penalty.lead_times(df.withColumn("total_sla", F.col("sla").cast("double")))


@query("dom_holidays_window", "order_id:i log_id:i nb_delivery_holiday:i nb_return_holiday:i "
       "nb_delivery_holiday_overall:i nb_return_holiday_overall:i", """
    SELECT DISTINCT order_id, log_id, nb_d AS nb_delivery_holiday, nb_r AS nb_return_holiday,
      nb_do AS nb_delivery_holiday_overall, nb_ro AS nb_return_holiday_overall FROM ox_exp""")
def dom_holidays_window(v):
    return pen.express_penalty(exp_base(v), v.area, v.express_route, v.rural, v.remote,
                               v.holiday, keep_all=True)


@query("dom_remote_addon", "order_id:i log_id:i added_leadtime:i", "SELECT * FROM ox_eco_sla")
def dom_remote_addon(v):
    return sl.remote_addon(eco_base(v), v.remote)


PENALTY = ("order_id:i log_id:i limit_leadtime_delivery:f limit_leadtime_return:f del_leadtime:f "
           "return_leadtime:f is_delay_pickup:s is_delay_delivery:s is_delay_return:s "
           "is_delay_delivery_overall:s is_delay_return_overall:s final_penalty:s")


@query("dom_penalties", PENALTY, "SELECT * FROM ox_eco WHERE final_penalty <> ''")
def dom_penalties(v):
    return pen.economy_penalty(eco_base(v), v.regions, v.region_route, v.remote, v.holiday)


@query("dom_terminal_date", "order_id:i be_delivered_time:t be_delivery_failed_lost_time:t "
       "filter_date:t", f"""
    SELECT *, coalesce(be_delivered_time, be_delivery_failed_lost_time) AS filter_date FROM (
      SELECT order_id, CASE WHEN logistics_status_id = 5 THEN {ts('complete_timestamp')} END
        AS be_delivered_time, CASE WHEN cancel_reason LIKE 'CANCEL_REASON_LO%'
        THEN {ts('cancel_timestamp')} END AS be_delivery_failed_lost_time FROM fx_orders)
    WHERE {day('be_delivered_time')} BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'
       OR {day('be_delivery_failed_lost_time')} BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'""")
def dom_terminal_date(v):
    rows = v.fx_orders.withColumns(ord_.terminal_times())
    return ord_.terminal_between(rows, "2024-01-05", "2024-01-20").withColumn(
        "filter_date", F.coalesce("be_delivered_time", "be_delivery_failed_lost_time"))


# --- fees, volumes, cases ------------------------------------------------------------------------

FEE = ("order_id:i lm_tracking_no:s consignment_no:s payment_method:s seller_user_name:s "
       "buyer_name:s seller_transaction_fee:f comm_fee:f service_fee:f cogs:f cogs_item:f "
       "check_cogs:s check_multi_wh:s check_group:i refund_id:i premium:f "
       "buyer_paid_insurance_premium:f total_cogs:f shipping_carrier:s payment_channel:s buyer_id:i "
       "order_sn:s created_date:t order_be_status:s logistics_status:s shop_id:i cod_amount:f "
       "escrow_to_seller:f seller_voucher_rebate:f buyer_shipping_fee:f bank_card_rebate:f "
       "platform_card_rebate:f coin_rebate:f platform_voucher_rebate:f esf:f asf:f seller_shipping_rebate:f "
       "coin_earned_shop:f voucher_discount_platform:f seller_userid:i seller_transaction_fee_item:f "
       "insurance_premium_by_buyer_amt:f premium_after_discount:f")
FEE_SQL = f"""
    WITH g AS (SELECT p.lm_tracking_no, count(DISTINCT f.ofg_id) AS n FROM fx_parcel p
        JOIN fx_fulfilment f ON f.log_id = p.log_id JOIN fx_orders o ON o.order_id = f.order_id
        WHERE o.is_cb_shop = 0 AND p.is_reverse = 0
          AND p.lm_shipment_company <> 'Standard Express' GROUP BY 1),
    m AS (SELECT order_id FROM fx_fulfilment WHERE is_reverse = 0 GROUP BY 1
        HAVING count(DISTINCT consignment_no) > 1),
    i AS (SELECT order_id, sum(commission_fee) AS comm_fee, sum(service_fee) AS service_fee,
        sum(cogs) AS cogs_item, sum(seller_txn_fee) AS txn, sum(insurance_premium_by_buyer_amt) AS ins
        FROM fx_items GROUP BY 1)
    SELECT o.order_id, p.lm_tracking_no, p.consignment_no,
      CASE WHEN o.payment_method_id = 6 THEN 'COD' ELSE 'CC' END AS payment_method,
      s.username AS seller_user_name, b.username AS buyer_name,
      CASE WHEN payment_be_channel_id IN (51000, 50020, 50021) THEN 0
        WHEN payment_be_channel_id IS NOT NULL AND {day(ts('o.create_timestamp - 3600'))}
          < DATE '2022-04-01' THEN round(o.gmv * 0.022, 0)
        WHEN payment_be_channel_id IS NOT NULL THEN round(o.gmv * 0.025, 0) END
        AS seller_transaction_fee,
      i.comm_fee, i.service_fee, f.items_sales_value_local AS cogs, i.cogs_item,
      CASE WHEN o.gmv - 20 + o.card_rebate_by_bank_amt + o.sv_rebate_by_seller_amt
          + o.pv_rebate_by_seller_amt + o.card_rebate_by_platform_amt + o.coin_used_cash_amt
          + o.sv_rebate_by_platform_amt + o.pv_rebate_by_platform_amt
          - f.items_sales_value_local = 0 THEN 'True' ELSE 'False' END AS check_cogs,
      CASE WHEN m.order_id IS NOT NULL THEN 'Multi WH' ELSE 'Not Multi WH' END AS check_multi_wh,
      g.n AS check_group, r.refund_id, n.premium, e.buyer_paid_insurance_premium,
      f.items_sales_value_local AS total_cogs, o.shipping_carrier, o.payment_channel, o.buyer_id, o.order_sn,
      {ts('o.create_timestamp - 3600')} AS created_date, o.order_be_status, o.logistics_status, o.shop_id,
      o.gmv AS cod_amount, o.escrow_to_seller_amt AS escrow_to_seller,
      o.sv_rebate_by_seller_amt + o.pv_rebate_by_seller_amt AS seller_voucher_rebate,
      o.buyer_paid_shipping_fee AS buyer_shipping_fee, o.card_rebate_by_bank_amt AS bank_card_rebate,
      o.card_rebate_by_platform_amt AS platform_card_rebate, o.coin_used_cash_amt AS coin_rebate,
      o.sv_rebate_by_platform_amt + o.pv_rebate_by_platform_amt AS platform_voucher_rebate,
      o.estimate_shipping_fee AS esf, o.actual_shipping_fee AS asf,
      o.actual_shipping_rebate_by_seller_amt AS seller_shipping_rebate,
      o.sv_coin_earn_by_seller_amt AS coin_earned_shop, o.pv_rebate_by_platform_amt AS voucher_discount_platform,
      s.userid AS seller_userid, i.txn AS seller_transaction_fee_item, i.ins AS insurance_premium_by_buyer_amt,
      n.premium_after_discount
    FROM fx_orders o LEFT JOIN fx_fulfilment f ON f.order_id = o.order_id
    LEFT JOIN fx_parcel p ON p.log_id = f.log_id LEFT JOIN fx_account s ON s.shopid = o.shop_id
    LEFT JOIN fx_account b ON b.userid = o.buyer_id LEFT JOIN i ON i.order_id = o.order_id
    LEFT JOIN fx_escrow e ON e.order_id = o.order_id
    LEFT JOIN fx_insurance n ON n.order_id = o.order_id
    LEFT JOIN fx_refund r ON r.order_id = o.order_id LEFT JOIN m ON m.order_id = o.order_id
    LEFT JOIN g ON g.lm_tracking_no = p.lm_tracking_no"""


def fee_rows(v):
    return fees.fee_recon(
        v.fx_orders, v.fulfilment, v.parcel, v.items, v.account, v.escrow, v.insurance, v.refund,
        ord_.multi_parcel(v.fulfilment, "order_id", "consignment_no", F.col("is_reverse") == 0),
        ord_.group_shipment_by_tracking(v.parcel, v.fulfilment, v.fx_orders))


@query("dom_fee_recon", FEE, FEE_SQL)
def dom_fee_recon(v):
    return fee_rows(v)


@query("dom_volume", "month_:s g_cate:s nb_order:i cod_order:i cc_order:i", f"""
    SELECT month({ts('o.create_timestamp - 3600')}) || '/' || year({ts('o.create_timestamp - 3600')})
      AS month_, i.global_be_category AS g_cate, count(DISTINCT o.order_sn) AS nb_order,
      sum(CASE WHEN o.payment_method = 'PAY_COD' THEN 1 ELSE 0 END) AS cod_order,
      sum(CASE WHEN o.payment_method NOT IN ('PAY_COD') THEN 1 ELSE 0 END) AS cc_order
    FROM fx_orders o LEFT JOIN fx_items i ON i.order_id = o.order_id
    WHERE {day(ts('o.create_timestamp - 3600'))} BETWEEN DATE '2023-12-01' AND DATE '2024-01-31'
    GROUP BY 1, 2""")
def dom_volume(v):
    return volume.volume_mix(v.fx_orders, v.items, "2023-12-01", "2024-01-31")


@query("dom_seq_anomaly", "lm_tracking_number:s order_id:i pku_done_time:t", """
    SELECT lm_tracking_number, order_id, pku_done_time FROM ox_case
    WHERE pickup_failed_time2 > pickup_done_time2 AND logistics_status_id = 2""")
def dom_seq_anomaly(v):
    return mst.picked_then_failed(case_facts(v)).where(F.col("logistics_status_id") == 2)


@query("dom_enrich_list", "id:s inbound_type:i whs_id:s", """
    SELECT i.id, p.inbound_type, p.whs_id FROM fx_ids i
    LEFT JOIN fx_parcel p ON p.lm_tracking_no = i.id""")
def dom_enrich_list(v):
    return scans.enrich_list(v.ids, v.parcel, "id", "lm_tracking_no", ["inbound_type", "whs_id"])


CASE = ("lm_tracking_number:s order_id:i order_sn:s consignment_no:s logistics_status:s "
        "order_be_status:s sls_status:s seller_state:s seller_city:s seller_district:s buyer_state:s "
        "buyer_city:s buyer_district:s carrier:s "
        "logistics_request_created:t pku_done_time:t return_initiated_time:t payment:s")


@query("dom_case_detail", f"{CASE} lost_update_time:t", f"""
    SELECT c.*, l.t AS lost_update_time FROM ox_case c LEFT JOIN (SELECT orderid,
      {ts('max(ctime) - 3600')} AS t FROM fx_audit GROUP BY 1) l ON l.orderid = c.order_id
    WHERE lm_tracking_number IN (SELECT id FROM fx_ids)""")
def dom_case_detail(v):
    return cases.case_detail(case_facts(v, v.ids), v.audit)
