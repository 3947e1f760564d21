"""Reports: delivery, cases, penalties, pickup schedules, fees, volumes."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from waybill.functions import codes
from waybill.functions.times import months_before
from waybill.operators import attempts as att
from waybill.operators import volume
from waybill.operators.orders import terminal_between
from waybill.operators.sla import region_route
from waybill.plans import cases
from waybill.plans import delivery as rep
from waybill.plans import penalty as pen
from waybill.plans import pickup as pu_rep
from waybill.sources.scans import restrict_to_ids

from ..oracle_views import day, kpis, ts
from ..registry import query
from .domain import (
    CAMPAIGN_SQL, CAMPAIGNS, CASE, FEE, FEE_SQL, KPI, base, case_facts, classified,
    detail_base, eco_base, exp_base, fee_rows, schedule,
)

AS_OF = dt.date(2024, 1, 31)
FIRST, LAST = "2024-01-01", "2024-02-20"
DUE = f"{day('expected_delivery')} BETWEEN DATE '{FIRST}' AND DATE '{LAST}'"


# --- delivery --------------------------------------------------------------------

@query("rep_campaign_delivery",
       f"cp:s shipping_carrier:s buyer_state:s buyer_city:s route:s {KPI}", f"""
    SELECT {CAMPAIGN_SQL.format(x=day('expected_delivery'))} AS cp, shipping_carrier, buyer_state,
      buyer_city, route, {kpis()} FROM ox_base
    WHERE {CAMPAIGN_SQL.format(x=day('expected_delivery'))} IS NOT NULL
      AND fulfillment_channel_id = 50015 GROUP BY ALL""")
def rep_campaign_delivery(v):
    return rep.campaign_delivery(base(v, [codes.EXPRESS_CHANNEL]), CAMPAIGNS)


@query("rep_weekly_delivery", "week_start:d week_:i shipping_carrier:s buyer_state:s buyer_city:s "
       f"route:s {KPI}", f"""
    SELECT CAST(date_trunc('week', expected_delivery) AS DATE) AS week_start,
      week(expected_delivery) AS week_, shipping_carrier, buyer_state, buyer_city, route, {kpis()}
    FROM ox_base WHERE {DUE} GROUP BY ALL""")
def rep_weekly_delivery(v):
    return rep.weekly_delivery(base(v), FIRST, LAST)


@query("rep_monthly_route_volume", "month_:s route:s vol:i", f"""
    SELECT month(expected_delivery) || '/' || year(expected_delivery) AS month_, route,
      count(lm_tracking_no) AS vol FROM ox_base WHERE {DUE} GROUP BY 1, 2""")
def rep_monthly_route_volume(v):
    return rep.monthly_volume_by_route(base(v), FIRST, LAST)


@query("rep_sla_check", f"month_:s buyer_state:s route:s {KPI}", f"""
    SELECT month(expected_delivery) || '/' || year(expected_delivery) AS month_, buyer_state, route,
      {kpis()} FROM ox_base_bonus WHERE {DUE} GROUP BY 1, 2, 3""")
def rep_sla_check(v):
    return rep.monthly_sla_check(base(v, [codes.EXPRESS_CHANNEL], 0.5), FIRST, LAST)


@query("rep_delivery_detail", "week_:i shipping_carrier:s lm_tracking_no:s seller_state:s seller_city:s "
       "buyer_state:s buyer_city:s route:s check_late:s check_outcome:s pku_done_time:t first_delivery_day:d "
       "due_day:d sla:f d_sundays:f d_holidays:f", f"""
    SELECT week(expected_delivery) AS week_, *, CASE WHEN {day('deli_1st_time')} <=
        {day('expected_delivery')} THEN 'Giao đúng hẹn' ELSE 'Trễ giao' END AS check_late,
      CASE WHEN deli_failed_time IS NOT NULL THEN 'Phát hoàn thành công' WHEN deli_done_time
        IS NOT NULL THEN 'Đơn giao thành công' ELSE 'Đơn tồn giao' END AS check_outcome,
      {day('deli_1st_time')} AS first_delivery_day, {day('expected_delivery')} AS due_day
    FROM ox_base WHERE {DUE}""")
def rep_delivery_detail(v):
    return rep.delivery_detail(base(v), FIRST, LAST)


@query("rep_contact_detail", "shipping_carrier:s lm_tracking_no:s expected_delivery:t "
       "first_contact:s first_try:s returned:s delivered:s gap_time:f buyer_state:s buyer_city:s buyer_district:s "
       "deli_1st_time:t deli_done_time:t deli_failed_time:t", f"""
    SELECT shipping_carrier, lm_tracking_no, expected_delivery, buyer_state, buyer_city, buyer_district,
      deli_1st_time, deli_done_time, deli_failed_time,
      CASE WHEN deli_1st_leadtime <= sla THEN 'Liên hệ lần đầu đúng hẹn'
        ELSE 'Liên hệ lần đầu trễ' END AS first_contact,
      CASE WHEN deli_done_time IS NOT NULL AND dli_pending_tracking_time IS NULL
        THEN 'Giao thành công lần đầu' ELSE 'Giao không thành công lần đầu' END AS first_try,
      CASE WHEN deli_failed_time IS NOT NULL THEN 'Hoàn thành công' ELSE 'Đơn không hoàn' END
        AS returned,
      CASE WHEN deli_done_time IS NOT NULL THEN 'Giao thành công' ELSE 'Không giao thành công' END
        AS delivered, avg(deli_1st_leadtime) AS gap_time
    FROM ox_lead WHERE {day('deli_done_time')} BETWEEN DATE '{FIRST}' AND DATE '{LAST}'
    GROUP BY ALL""")
def rep_contact_detail(v):
    return rep.contact_detail(base(v), FIRST, LAST)


@query("rep_deep_dive", "lm_tracking_no:s shipping_carrier:s route:s actual_weight:s "
       "grand_total:s payment_method:s delivery_hour:s attempt_gap:s seller_state:s seller_city:s "
       "buyer_state:s buyer_city:s", """
    SELECT b.lm_tracking_no, b.shipping_carrier, b.route, b.seller_state, b.seller_city, b.buyer_state, b.buyer_city,
      CASE WHEN parcel_chargeable_weight <= 1000 THEN '<1kg'
        WHEN parcel_chargeable_weight <= 2000 THEN '1-2kg'
        WHEN parcel_chargeable_weight <= 3000 THEN '2-3kg'
        WHEN parcel_chargeable_weight <= 4000 THEN '3-4kg'
        WHEN parcel_chargeable_weight <= 5000 THEN '4-5kg' ELSE '>5kg' END AS actual_weight,
      CASE WHEN gmv <= 100000 THEN '<100k' WHEN gmv <= 200000 THEN '100-200k' ELSE '>200k' END
        AS grand_total,
      CASE WHEN payment_method = 'PAY_COD' THEN 'COD' ELSE 'CC' END AS payment_method,
      CASE WHEN hour(dli_pending_tracking_time) > 21 THEN 'Sau 21h'
        WHEN hour(dli_pending_tracking_time) < 6 THEN 'Trước 6h' ELSE 'Bình thường' END
        AS delivery_hour, coalesce(a.attempt_gap, 'Hợp lệ') AS attempt_gap
    FROM ox_base_detail b LEFT JOIN ox_attempts a ON a.log_id = b.log_id""")
def rep_deep_dive(v):
    return rep.deep_dive(detail_base(v), att.attempts_wide(v.tracking, "F650"))


@query("rep_leadtime_by_route", "shipping_carrier:s route:s avg_time:f percentile_80:f "
       "percentile_95:f order_:i", f"""
    SELECT shipping_carrier, route, round(avg(deli_1st_leadtime), 1) AS avg_time,
      round(quantile_disc(deli_1st_leadtime, 0.8), 1) AS percentile_80,
      round(quantile_disc(deli_1st_leadtime, 0.95), 1) AS percentile_95,
      count(DISTINCT lm_tracking_no) AS order_ FROM ox_lead WHERE {DUE} GROUP BY 1, 2""")
def rep_leadtime_by_route(v):
    return rep.leadtime_by_route(base(v), FIRST, LAST)


@query("rep_leadtime_region_route", "shipping_carrier:s route:s avg_time:f percentile_80:f "
       "percentile_95:f order_:i", f"""
    WITH r AS (SELECT DISTINCT lower(state) AS state, region FROM fx_regions),
    t AS (SELECT DISTINCT ship_from, ship_to, route FROM fx_region_route),
    x AS (SELECT DISTINCT b.* EXCLUDE (route), t.route FROM ox_lead b
      LEFT JOIN r s ON s.state = lower(b.seller_state) LEFT JOIN r d ON d.state = lower(b.buyer_state)
      LEFT JOIN t ON t.ship_from = s.region AND t.ship_to = d.region WHERE {DUE})
    SELECT shipping_carrier, route, round(avg(deli_1st_leadtime), 3) AS avg_time,
      round(quantile_disc(deli_1st_leadtime, 0.8), 3) AS percentile_80,
      round(quantile_disc(deli_1st_leadtime, 0.95), 3) AS percentile_95,
      count(DISTINCT lm_tracking_no) AS order_ FROM x GROUP BY 1, 2""")
def rep_leadtime_region_route(v):
    facts = rep.parcel_facts(v.fx_orders, v.fulfilment, v.parcel, v.tracking)
    routed = region_route(facts, v.regions, v.region_route).distinct()
    with_due = rep.with_allowance(routed, v.sla, v.extend, None, v.holiday)
    return rep.leadtime_by_route(with_due, FIRST, LAST, digits=3)


@query("rep_area_exposure", "week_:i carrier:s matches:i", f"""
    WITH ado AS (SELECT seller_state, seller_city, buyer_state, buyer_city FROM fx_orders
      WHERE (seller_state = 'NATION_3' AND seller_city = 'City 0')
         OR (buyer_state = 'NATION_3' AND buyer_city = 'City 0'))
    SELECT week({ts('o.create_timestamp - 3600')}) AS week_,
      CASE o.fulfilment_channel_id WHEN 50024 THEN 'BEST Express' WHEN 50021 THEN 'Shopee Express'
        WHEN 50010 THEN 'Viettel Post' WHEN 50012 THEN 'Giao Hàng Tiết Kiệm'
        WHEN 50015 THEN 'VNPost Nhanh' WHEN 50016 THEN 'VNPost Tiết Kiệm'
        ELSE CASE o.shipping_method_id WHEN 5001 THEN 'Giao Hàng Nhanh'
          WHEN 5002 THEN 'Giao Hàng Nhanh - ECO' ELSE 'no' END END AS carrier,
      sum(CASE WHEN o.seller_state = a.seller_state AND o.seller_city = a.seller_city THEN 1
        ELSE 0 END) AS matches
    FROM fx_orders o LEFT JOIN ado a ON a.seller_state = o.seller_state
      AND a.seller_city = o.seller_city AND a.buyer_state = o.buyer_state
      AND a.buyer_city = o.buyer_city
    WHERE {day(ts('o.create_timestamp - 3600'))} BETWEEN DATE '2024-01-31' - 30
      AND DATE '2024-01-31' GROUP BY 1, 2""")
def rep_area_exposure(v):
    return rep.area_report(v.fx_orders, "NATION_3", "City 0", AS_OF, 30, faithful=True)


@query("rep_area_touching", "week_:i carrier:s touching:i as_seller:i as_buyer:i", f"""
    SELECT week({ts('create_timestamp - 3600')}) AS week_,
      CASE fulfilment_channel_id WHEN 50024 THEN 'BEST Express' WHEN 50021 THEN 'Shopee Express'
        WHEN 50010 THEN 'Viettel Post' WHEN 50012 THEN 'Giao Hàng Tiết Kiệm'
        WHEN 50015 THEN 'VNPost Nhanh' WHEN 50016 THEN 'VNPost Tiết Kiệm'
        ELSE CASE shipping_method_id WHEN 5001 THEN 'Giao Hàng Nhanh'
          WHEN 5002 THEN 'Giao Hàng Nhanh - ECO' ELSE 'no' END END AS carrier,
      count(*) FILTER ((seller_state = 'NATION_3' AND seller_city = 'City 0')
        OR (buyer_state = 'NATION_3' AND buyer_city = 'City 0')) AS touching,
      count(*) FILTER (seller_state = 'NATION_3' AND seller_city = 'City 0') AS as_seller,
      count(*) FILTER (buyer_state = 'NATION_3' AND buyer_city = 'City 0') AS as_buyer
    FROM fx_orders WHERE {day(ts('create_timestamp - 3600'))} BETWEEN DATE '2024-01-31' - 60
      AND DATE '2024-01-31' GROUP BY 1, 2""")
def rep_area_touching(v):
    return rep.area_report(v.fx_orders, "NATION_3", "City 0", AS_OF)


ALL_ROW = ("SELECT DISTINCT lm_tracking_no, pickup_done_time, buyer_state, buyer_city, tpl_call, "
           "first_attempt_delivery_time, delivery_done_time, delivery_failed, "
           "dli_pending_tracking_time, check_delivery_ontime, route, expected_delivery "
           f"FROM ox_class WHERE {DUE}")


@query("rep_yearly_all_carriers", "month_start:d buyer_state:s buyer_city:s tpl_call:s route:s "
       "deli_request:i deli_done:i ontime_delivery:i late_delivery:i deli_done_1st_time:i "
       "deli_failed:i", f"""
    SELECT CAST(date_trunc('month', expected_delivery) AS DATE) AS month_start, buyer_state,
      buyer_city, tpl_call, route, count(pickup_done_time) AS deli_request,
      count(delivery_done_time) AS deli_done,
      sum(CASE WHEN check_delivery_ontime = 'Ontime' THEN 1 ELSE 0 END) AS ontime_delivery,
      sum(CASE WHEN check_delivery_ontime = 'Late' THEN 1 ELSE 0 END) AS late_delivery,
      sum(CASE WHEN dli_pending_tracking_time IS NULL AND delivery_done_time IS NOT NULL THEN 1
        ELSE 0 END) AS deli_done_1st_time, count(delivery_failed) AS deli_failed
    FROM ({ALL_ROW}) WHERE {day('first_attempt_delivery_time')} BETWEEN DATE '2024-01-10'
      AND DATE '2024-07-10' GROUP BY ALL""")
def rep_yearly_all_carriers(v):
    return rep.yearly_all_carriers(classified(v, dt.date(2024, 7, 10)), FIRST, LAST)


@query("rep_all_carrier_detail", "week_:i lm_tracking_no:s buyer_state:s buyer_city:s tpl_call:s "
       "route:s check_delivery_ontime:s expected_delivery:t pickup_done_time:t first_attempt_delivery_time:t "
       "delivery_done_time:t delivery_failed:t dli_pending_tracking_time:t",
       f"SELECT week(expected_delivery) AS week_, * FROM ({ALL_ROW})")
def rep_all_carrier_detail(v):
    return rep.all_carrier_detail(classified(v), FIRST, LAST)


# --- attempts and backlog ----------------------------------------------------------

@query("rep_attempts", "order_sn:s order_id:i lm_tracking_no:s consignment_no:s "
       "created_datetime:t pickup_done:t dli_1_time:t dli_2_time:t dli_3_time:t dli_1_reason:s "
       "dli_2_reason:s dli_3_reason:s attempt_count:i attempt_gap:s attempt_hour:s "
       "buyer_state:s buyer_city:s buyer_district:s", f"""
    WITH k AS (SELECT log_id, {ts("min(CASE WHEN tracking_code = 'F100' THEN actual_time END) - 3600")}
        AS pickup_done,
      {ts("min(CASE WHEN tracking_code = 'F999' THEN actual_time END) - 3600")} AS failed
      FROM fx_tracking GROUP BY 1)
    SELECT o.order_sn, o.order_id, p.lm_tracking_no, p.consignment_no,
      {ts('o.create_timestamp - 3600')} AS created_datetime, k.pickup_done, o.buyer_state, o.buyer_city,
      o.buyer_district, f.*
    FROM fx_orders o JOIN fx_parcel p ON o.order_sn = array_to_string(p.ordersn_list, ', ')
    JOIN ox_fake f ON f.log_id = p.log_id JOIN k ON k.log_id = p.log_id
    WHERE {day('k.failed')} BETWEEN DATE '2024-01-01' AND DATE '2024-01-31'""")
def rep_attempts(v):
    carriers = [r for r in (
        "VNPost Nhanh", "VNPost Tiết Kiệm", "Shopee Express", "Standard Express VN",
        "BEST Express", "Giao Hàng Tiết Kiệm", "Viettel Post")]
    return rep.attempts_report(v.fx_orders, v.parcel, v.tracking, "2024-01-01", "2024-01-31",
                               carriers, status=None)


@query("rep_backlog_detail", "lm_tracking_no:s fulfilment_shipping_carrier:s buyer_state:s "
       "buyer_city:s buyer_district:s lm_hub:s lm_hub_ib_time:t pku_done_tracking_time:t "
       "first_delivery_attempt:t aging_6_days:i aging_6_11_days:i aging_12_days:i", f"""
    SELECT DISTINCT o.*, h.lm_hub, h.lm_hub_ib_time, CASE WHEN age <= 6 THEN 1 ELSE 0 END
        AS aging_6_days, CASE WHEN age > 6 AND age <= 11 THEN 1 ELSE 0 END AS aging_6_11_days,
      CASE WHEN age > 11 THEN 1 ELSE 0 END AS aging_12_days
    FROM ox_open o LEFT JOIN ox_hub h ON h.log_id = o.log_id
    WHERE {day(ts('create_timestamp - 3600'))} > DATE '2023-12-25'""")
def rep_backlog_detail(v):
    return rep.backlog_detail(v.fx_orders, v.parcel, v.tracking, AS_OF, "2023-12-25")


@query("rep_backlog_dashboard", "buyer_state:s buyer_city:s aging_5_days:i aging_5_7_days:i "
       "aging_7_days:i total_backlog:i", f"""
    SELECT buyer_state, buyer_city, sum(CASE WHEN age < 5 THEN 1 ELSE 0 END) AS aging_5_days,
      sum(CASE WHEN age >= 5 AND age <= 7 THEN 1 ELSE 0 END) AS aging_5_7_days,
      sum(CASE WHEN age > 7 THEN 1 ELSE 0 END) AS aging_7_days,
      count(DISTINCT lm_tracking_no) AS total_backlog
    FROM (SELECT DISTINCT lm_tracking_no, fulfilment_shipping_carrier, buyer_state, buyer_city,
      pku_done_tracking_time, first_delivery_attempt, logistics_status, age FROM ox_open
      WHERE is_reverse = 0 AND logistics_status = 'PICKUP DONE'
        AND {day('pku_done_tracking_time')} BETWEEN DATE '2024-01-11' AND DATE '2024-01-31')
    GROUP BY 1, 2""")
def rep_backlog_dashboard(v):
    return rep.backlog_dashboard(v.fx_orders, v.parcel, v.tracking, AS_OF, days=20)


@query("rep_pending", f"{CASE} shipment_type:s scheduled_pickup_time:t check_pending:s", """
    SELECT *, CASE WHEN pku_done_time IS NULL AND seller_state = 'NATION_8'
      AND logistics_status_id <> 4 THEN 'Pending pickup' ELSE 'Pending Deli' END AS check_pending
    FROM ox_case WHERE logistics_status_id NOT IN (7, 8, 10, 11)
      AND fulfilment_channel_id IN (50015, 50016)
      AND ((pku_done_time IS NULL AND seller_state = 'NATION_8' AND seller_city = 'City 1'
        AND logistics_status_id <> 4) OR (logistics_status_id = 2 AND buyer_state = 'NATION_8'
        AND buyer_city = 'City 1'))""")
def rep_pending(v):
    return cases.pending_parcels(case_facts(v), "NATION_8", "City 1")


@query("rep_sequence_anomalies", f"{CASE} lost_update_time:t escrow_paid_datetime:t escrow_created_datetime:t", f"""
    SELECT c.*, l.t AS lost_update_time, o.escrow_paid_datetime, o.escrow_created_datetime
    FROM ox_case c JOIN fx_orders o ON o.order_id = c.order_id
    LEFT JOIN (SELECT orderid, {ts('max(ctime) - 3600')} AS t FROM fx_audit GROUP BY 1) l ON l.orderid = c.order_id
    WHERE pickup_failed_time2 > pickup_done_time2
      AND c.logistics_status_id = 2 AND c.fulfilment_channel_id IN (50015, 50016, 50021, 50011)""")
def rep_sequence_anomalies(v):
    facts = case_facts(v, None, ["escrow_paid_datetime", "escrow_created_datetime"])
    return cases.sequence_anomalies(facts, v.audit, [50015, 50016, 50021, 50011])


@query("rep_case_sheet", f"{CASE} lost_update_time:t escrow_to_seller_amt:f", f"""
    SELECT c.*, o.escrow_to_seller_amt, l.t AS lost_update_time
    FROM ox_case c JOIN fx_orders o ON o.order_id = c.order_id
    LEFT JOIN (SELECT orderid, {ts('max(ctime) - 3600')} AS t FROM fx_audit GROUP BY 1) l ON l.orderid = c.order_id
    WHERE lm_tracking_number IN (SELECT id FROM fx_ids)""")
def rep_case_sheet(v):
    facts = case_facts(v, v.ids, ["escrow_to_seller_amt"])
    return cases.case_detail(facts, v.audit, ["escrow_to_seller_amt"])


@query("rep_shipping_fee_check", f"{CASE} charged_weight:f actual_weight:f cogs_parcel:f "
       "item_amount:f length:f width:f height:f check_multi_wh:s check_group_shipment:s "
       "grand_total:f order_created:t", f"""
    WITH d AS (SELECT order_id, sum(a) AS item_amount, max(l) AS length, max(w) AS width,
        max(h) AS height FROM (SELECT i.order_id, i.item_id, sum(i.item_amount) AS a,
          max(CAST(dim_length AS DOUBLE)) AS l, max(CAST(dim_width AS DOUBLE)) AS w,
          sum(CAST(dim_height AS DOUBLE)) AS h FROM fx_items i JOIN fx_item_dims x
          ON x.item_id = i.item_id GROUP BY 1, 2) GROUP BY 1),
    m AS (SELECT log_id FROM fx_parcel WHERE whs_id IS NOT NULL GROUP BY 1
      HAVING count(DISTINCT lm_tracking_no) > 1),
    g AS (SELECT order_id, count(oms_forder_id) AS n FROM fx_fulfilment GROUP BY 1)
    SELECT c.*, d.item_amount, d.length, d.width, d.height, o.gmv AS grand_total,
      {ts('o.create_timestamp - 3600')} AS order_created,
      CASE WHEN m.log_id IS NOT NULL THEN 'Multi WH' ELSE 'Not Multi WH' END AS check_multi_wh,
      CASE WHEN g.n > 1 THEN 'Grouped' ELSE 'Not grouped' END AS check_group_shipment
    FROM ox_case c JOIN fx_orders o ON o.order_id = c.order_id
    LEFT JOIN d ON d.order_id = c.order_id LEFT JOIN m ON m.log_id = c.log_id
    LEFT JOIN g ON g.order_id = c.order_id
    WHERE c.lm_tracking_number IN (SELECT id FROM fx_ids)""")
def rep_shipping_fee_check(v):
    return cases.shipping_fee_check(case_facts(v, v.ids, ["gmv", "create_timestamp"]), v.parcel, v.fulfilment, v.items,
                                    v.item_dims)


@query("rep_open_ready_orders", "lm_tracking_number:s order_id:i order_sn:s consignment_no:s "
       "logistics_status:s order_be_status:s sls_status:s shop_id:i seller_id:i shop_name:s "
       "fulfilment_shipping_carrier:s", """
    SELECT c.*, 'Shop ' || (c.order_id % 100) AS shop_name FROM ox_case c WHERE fulfilment_shipping_carrier IN ('VNPost Nhanh',
      'VNPost Tiết Kiệm', 'Viettel Post', 'BEST Express') AND logistics_status_id = 9
      AND CAST(auto_cancel_arrange_ship_datetime AS DATE) BETWEEN DATE '2023-12-30' AND
        DATE '2023-12-30'""")
def rep_open_ready_orders(v):
    facts = case_facts(v, None, ["auto_cancel_arrange_ship_datetime", "shop_id", "seller_id", "shop_name"])
    return cases.open_ready_orders(
        facts, "2023-12-30",
        ["VNPost Nhanh", "VNPost Tiết Kiệm", "Viettel Post", "BEST Express"])


# --- pickup schedules ------------------------------------------------------------------
PK = ("gross_pickup:i gross_pickup_done:i gross_pickup_failed:i gross_ontime_pu_done:i "
      "gross_ontime_pu:i")
PK_SQL = """sum(gross_pickup_request) AS gross_pickup, sum(gross_pickup_done) AS gross_pickup_done,
      sum(gross_pickup_failed) AS gross_pickup_failed,
      sum(ontime_pickup_done) AS gross_ontime_pu_done, sum(ontime_pickup) AS gross_ontime_pu"""
TWO = "('VNPost Nhanh', 'VNPost Tiết Kiệm')"


@query("rep_campaign_pickup", f"cp:s fulfilment_shipping_carrier:s {PK}", f"""
    SELECT {CAMPAIGN_SQL.format(x=day('scheduled_date1'))} AS cp, fulfilment_shipping_carrier,
      {PK_SQL} FROM ox_schedule WHERE shipment_type1 = 'pickup'
      AND fulfilment_shipping_carrier IN {TWO}
      AND {CAMPAIGN_SQL.format(x=day('scheduled_date1'))} IS NOT NULL GROUP BY 1, 2""")
def rep_campaign_pickup(v):
    return pu_rep.campaign_pickup(
        schedule(v, [codes.EXPRESS_CARRIER, codes.ECONOMY_CARRIER]), CAMPAIGNS)


@query("rep_monthly_pickup", "week_start:d fulfilment_shipping_carrier:s seller_state:s "
       f"seller_city:s {PK} gap_time:f", f"""
    SELECT CAST(date_trunc('week', scheduled_date1) AS DATE) AS week_start,
      fulfilment_shipping_carrier, seller_state, seller_city, {PK_SQL},
      round(quantile_disc((epoch(pku_done_time) - epoch(pku_1st_time)) / 86400, 0.95), 3)
        AS gap_time FROM ox_schedule WHERE shipment_type1 = 'pickup'
      AND fulfilment_shipping_carrier IN {TWO} AND {day('scheduled_date1')}
        BETWEEN DATE '2024-01-01' AND DATE '2024-01-31' GROUP BY 1, 2, 3, 4""")
def rep_monthly_pickup(v):
    return pu_rep.monthly_pickup(
        schedule(v, [codes.EXPRESS_CARRIER, codes.ECONOMY_CARRIER]), "2024-01-01", "2024-01-31")


@query("rep_pickup_gap", "fulfilment_shipping_carrier:s seller_state:s seller_city:s gap_time:f",
       f"""
    SELECT fulfilment_shipping_carrier, seller_state, seller_city, round(quantile_disc(
      (epoch(pku_1st_time) - order_arrange_shipping_timestamp) / 86400, 0.95), 3) AS gap_time
    FROM ox_schedule WHERE shipment_type1 = 'pickup' AND {day('scheduled_date1')}
      BETWEEN DATE '2024-01-01' AND DATE '2024-01-31' GROUP BY 1, 2, 3""")
def rep_pickup_gap(v):
    return pu_rep.pickup_gap(schedule(v), "2024-01-01", "2024-01-31")


@query("rep_gap_detail", "lm_tracking_no:s shipping_carrier:s created_time:t pku_1st_time:t "
       "deli_done_time:t gap_created_to_first_pu:f gap_first_pu_to_pu_done:f seller_state:s seller_city:s "
       "buyer_state:s buyer_city:s pku_done_time:t deli_1st_time:t gap_pu_done_to_first_deli:f "
       "gap_first_deli_to_deli_done:f", f"""
    SELECT lm_tracking_no, seller_state, seller_city, buyer_state, buyer_city, pku_done_time, deli_1st_time,
      round((epoch(deli_1st_time) - epoch(pku_done_time)) / 86400, 3) AS gap_pu_done_to_first_deli,
      round((epoch(deli_done_time) - epoch(deli_1st_time)) / 86400, 3) AS gap_first_deli_to_deli_done, fulfilment_shipping_carrier AS shipping_carrier,
      {ts('order_arrange_shipping_timestamp')} AS created_time, pku_1st_time, deli_done_time,
      round((epoch(pku_1st_time) - order_arrange_shipping_timestamp) / 86400, 3)
        AS gap_created_to_first_pu,
      round((epoch(pku_done_time) - epoch(pku_1st_time)) / 86400, 3) AS gap_first_pu_to_pu_done
    FROM ox_schedule WHERE lm_tracking_no IN (SELECT id FROM fx_ids)""")
def rep_gap_detail(v):
    facts = schedule(v).withColumn("shipping_carrier", F.col("fulfilment_shipping_carrier"))
    return rep.leadtime_gap_detail(restrict_to_ids(facts, "lm_tracking_no", v.ids))


# --- penalties ---------------------------------------------------------------------------

PEN_SHEET = """order_id:i is_multi_parcel:i consignment:s order_sn:s shipping_traceno:s lm_tracking_number:s log_id:i
    fulfilment_shipping_carrier:s shop_id:i seller_id:i buyer_id:i be_bpsf:f be_esf:f be_asf:f sls_asf:f sls_esf:f
    seller_state:s seller_city:s seller_district:s buyer_state:s buyer_city:s buyer_district:s multi_arranged_time:t
    multi_delivered_time:t order_weight:f be_delivered_time:t be_delivery_failed_lost_time:t day_of_week_delivery:f
    day_of_week_return:f logistics_status:s added_leadtime:i ship_from:s ship_to:s sls_first_return_attempt:t
    sls_first_delivery_attempt:t total_sla:f is_dropoff:i sls_received_time:t fe_schedule_pickup:t
    sls_first_pickup_attempt:t sls_pickup_done:t adjusted_pickup:t sls_first_delivery_pending:t sls_delivery_done:t
    sls_return_time:t adjusted_return:t sls_return_pending:t sls_del_failed:t sla:f pickup:f inter:f intra:f
    delivery_w_weekend:f nb_delivery_holiday:f disaster:i return_w_weekend:f nb_return_holiday:f limit_leadtime_delivery:f
    del_leadtime:f total_leadtime_delivery:f del_leadtime_overall:f limit_leadtime_return:f return_leadtime:f
    total_leadtime_return:f return_leadtime_overall:f is_delay_pickup:s is_delay_delivery:s is_delay_delivery_overall:s
    is_delay_return:s is_delay_return_overall:s final_penalty:s"""


def printed(source: str, overall: int, more: str) -> str:
    """The sheet over the verdicts: what is derived from them, the rest as it is."""
    return f"""(SELECT * EXCLUDE (sla), CAST(sla AS DOUBLE) AS sla, lm_tracking_number AS shipping_traceno,
      isodow(adjusted_pickup) + 1 AS day_of_week_delivery, isodow(adjusted_return) + 1 AS day_of_week_return,
      nb_d AS nb_delivery_holiday, nb_r AS nb_return_holiday, 0 AS disaster, {more},
      {overall} + nb_d + added_leadtime AS total_leadtime_delivery,
      {overall} + nb_r + added_leadtime AS total_leadtime_return FROM {source}) AS sheet"""


def distinct_sheet(spec: str) -> str:
    return ", ".join(part.rsplit(":", 1)[0] for part in spec.split())


ECO_SHEET = f"{PEN_SHEET} seller_region:s buyer_region:s"
EXP_SHEET = f"{PEN_SHEET} concat_seller_address:s concat_buyer_address:s filter_date:t"
NO_ADDONS = "0 AS pickup, 0 AS inter, 0 AS intra"
EXP_MORE = """lower(seller_state || '-' || seller_city || '-' || seller_district) AS concat_seller_address,
      lower(buyer_state || '-' || buyer_city || '-' || buyer_district) AS concat_buyer_address,
      coalesce(be_delivered_time, be_delivery_failed_lost_time) AS filter_date"""
MONTH = (f"({day('be_delivered_time')} BETWEEN DATE '2024-01-01' AND DATE '2024-01-31' OR "
         f"{day('be_delivery_failed_lost_time')} BETWEEN DATE '2024-01-01' AND DATE '2024-01-31')")
#: Orders created in the three months up to the month of the report; December's are out.
REPORT_DAY = dt.date(2024, 4, 15)
CREATED = (f"order_id IN (SELECT order_id FROM fx_orders "
           f"WHERE {day(ts('create_timestamp - 3600'))} >= DATE '2024-01-01')")


@query("rep_economy_penalty", ECO_SHEET, f"""
    SELECT DISTINCT {distinct_sheet(ECO_SHEET)} FROM {printed('ox_eco', 15, NO_ADDONS)}
    WHERE {MONTH} AND final_penalty <> '' AND {CREATED}""")
def rep_economy_penalty(v):
    recent = eco_base(v, months_before(REPORT_DAY, 3, whole=True))
    scoped = terminal_between(recent, "2024-01-01", "2024-01-31")
    return pen.economy_sheet(pen.economy_penalty(
        scoped, v.regions, v.region_route, v.remote, v.holiday))


@query("rep_express_penalty", EXP_SHEET, f"""
    SELECT DISTINCT {distinct_sheet(EXP_SHEET)} FROM {printed('ox_exp', 11, EXP_MORE)}
    WHERE final_penalty <> '' AND {CREATED}""")
def rep_express_penalty(v):
    return pen.express_sheet(pen.express_penalty(
        exp_base(v, months_before(REPORT_DAY, 3, whole=True)), v.area, v.express_route, v.rural, v.remote, v.holiday))


@query("rep_penalty_check", ECO_SHEET, f"""
    SELECT DISTINCT {distinct_sheet(ECO_SHEET)} FROM {printed('ox_eco_check', 15, NO_ADDONS)}""")
def rep_penalty_check(v):
    return pen.economy_sheet(pen.economy_penalty(
        eco_base(v), v.regions, v.region_route, v.remote, v.holiday, keep_all=True))


# --- fees and volumes ------------------------------------------------------------------------

@query("rep_fee_recon", FEE, f"SELECT * FROM ({FEE_SQL}) WHERE lm_tracking_no IN "
       "(SELECT id FROM fx_ids)")
def rep_fee_recon(v):
    return restrict_to_ids(fee_rows(v), "lm_tracking_no", v.ids)


@query("rep_pickup_volume", "month_start:d month:i fulfilment_shipping_carrier:s nb_order:i", f"""
    SELECT date_trunc('month', {day(ts('p.scheduled_pickup_timestamp - 3600'))}) AS month_start,
      month({day(ts('p.scheduled_pickup_timestamp - 3600'))}) AS month,
      o.fulfilment_shipping_carrier, count(DISTINCT o.order_sn) AS nb_order
    FROM fx_orders o LEFT JOIN fx_parcel p ON p.order_id = o.order_id
    WHERE {day(ts('p.scheduled_pickup_timestamp - 3600'))} BETWEEN DATE '2024-01-01'
      AND DATE '2024-03-31' GROUP BY 1, 2, 3""")
def rep_pickup_volume(v):
    return volume.pickup_volume(v.fx_orders, v.parcel, "2024-01-01", "2024-03-31")
