"""Logistics marts as projections of the test tables.

Every view is derived from the given Parquet tables, so its size follows
theirs.  A view is stated once, as SQL expressions that both Spark and the
oracle engine understand; the few functions that differ come from a dialect.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "labels")


SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
                "c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
            "p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
                "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
                "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
              "value double, props string",
}


class SparkDialect:
    def idiv(self, a, b): return f"(({a}) div ({b}))"
    def epoch(self, ts): return f"unix_seconds(CAST({ts} AS TIMESTAMP))"
    def plus_hours(self, ts, h): return f"(CAST({ts} AS TIMESTAMP) + make_dt_interval(0, CAST({h} AS INT)))"
    def ts(self, x): return f"CAST({x} AS TIMESTAMP)"
    def text(self, x): return f"CAST({x} AS STRING)"
    def epoch_ts(self, x): return f"timestamp_seconds({x})"
    def array1(self, x): return f"array({x})"
    def struct3(self, x): return f"named_struct('seller_address', named_struct('district', {x}))"

    def repeat(self, base, n, name):
        return f"(SELECT *, explode(sequence(0, {n} - 1)) AS {name} FROM {base})"


class DuckDialect(SparkDialect):
    def idiv(self, a, b): return f"(({a}) // ({b}))"
    def epoch(self, ts): return f"CAST(floor(epoch({ts})) AS BIGINT)"
    def plus_hours(self, ts, h): return f"({ts} + to_hours(CAST({h} AS INTEGER)))"
    def ts(self, x): return f"CAST({x} AS TIMESTAMP)"
    def text(self, x): return f"CAST({x} AS VARCHAR)"
    def epoch_ts(self, x): return f"make_timestamp(CAST(({x}) * 1000000 AS BIGINT))"
    def array1(self, x): return f"[{x}]"
    def struct3(self, x): return f"{{'seller_address': {{'district': {x}}}}}"

    def repeat(self, base, n, name):
        return f"(SELECT b.*, CAST(t.k AS INTEGER) AS {name} FROM {base} b, range({n}) t(k))"


VIEWS: dict[str, Callable[[SparkDialect], str]] = {}


def view(fn):
    VIEWS[fn.__name__] = fn
    return fn


CHANNEL = ("CASE {x} % 7 WHEN 0 THEN 50015 WHEN 1 THEN 50016 WHEN 2 THEN 50021 WHEN 3 THEN 50011"
           " WHEN 4 THEN 50024 WHEN 5 THEN 50012 ELSE 50010 END")
CARRIER = ("CASE {x} % 7 WHEN 0 THEN 'VNPost Nhanh' WHEN 1 THEN 'VNPost Tiết Kiệm'"
           " WHEN 2 THEN 'Shopee Express' WHEN 3 THEN 'Standard Express VN'"
           " WHEN 4 THEN 'BEST Express' WHEN 5 THEN 'Giao Hàng Tiết Kiệm' ELSE 'Viettel Post' END")
PROVIDER = ("CASE {x} % 9 WHEN 0 THEN 'VN_JNT' WHEN 1 THEN 'VN_CB_SPX_N' WHEN 2 THEN 'VN_JNT_S'"
            " WHEN 3 THEN 'VN_CB_SPX_S' WHEN 4 THEN 'vn_j&t_local' ELSE 'VN_LOCAL' END")


@view
def fx_tracking(d):
    log = f"user_id * 10 + {d.idiv('day(ts) - 1', '6')}"
    return f"""
    SELECT event_id, {log} AS log_id,
      CASE event_type
        WHEN 'signup' THEN CASE WHEN event_id % 5 = 0 THEN 'F097' ELSE 'F000' END
        WHEN 'view' THEN CASE WHEN event_id % 2 = 0 THEN 'F001' ELSE 'F100' END
        WHEN 'click' THEN CASE event_id % 4 WHEN 1 THEN 'F600' WHEN 3 THEN 'F599' ELSE 'F650' END
        WHEN 'purchase' THEN CASE WHEN ({log}) % 3 = 0 THEN 'F420' ELSE 'F980' END
        ELSE CASE event_id % 3 WHEN 0 THEN 'F668' WHEN 1 THEN 'F699'
             ELSE CASE WHEN ({log}) % 2 = 0 THEN 'F999' ELSE 'F680' END END
      END AS tracking_code,
      {d.epoch('ts')} AS actual_time,
      {d.epoch('ts')} + (event_id % 7 - 3) * 600 AS ctime,
      CASE event_id % 4 WHEN 0 THEN 'tu choi' WHEN 1 THEN 'khong tim thay'
        WHEN 2 THEN 'hen lai' ELSE 'qua xa' END AS reason_description,
      'Parcel received at Hub ' || {d.text('event_id % 40')} AS description,
      {d.text('15 + event_id % 12')} AS resource_status, props AS tracking_detail
    FROM events"""


@view
def fx_legacy(d):
    return f"""
    SELECT log_id, actual_time,
      CASE tracking_code WHEN 'F000' THEN 1 WHEN 'F097' THEN 1 WHEN 'F001' THEN 26
        WHEN 'F100' THEN 2 WHEN 'F600' THEN 13 WHEN 'F599' THEN 13 WHEN 'F650' THEN 13
        WHEN 'F980' THEN 11 WHEN 'F420' THEN 11 WHEN 'F668' THEN 18 WHEN 'F699' THEN 19
        ELSE 12 END AS status
    FROM fx_tracking"""


@view
def fx_parcel_times(d):
    return "SELECT log_id, min(actual_time) AS first_time FROM fx_tracking GROUP BY log_id"


@view
def fx_parcel(d):
    order = d.idiv("log_id", "2")
    return f"""
    SELECT log_id, {order} AS order_id, 'SN' || {d.text(order)} AS order_sn,
      {d.array1("'SN' || " + d.text(order))} AS ordersn_list,
      'TN' || {d.text('log_id')} AS lm_tracking_no, 'CN' || {d.text('log_id')} AS consignment_no,
      {CHANNEL.format(x=order)} AS fulfillment_channel_id,
      {CARRIER.format(x=order)} AS lm_shipment_company,
      {PROVIDER.format(x='log_id')} AS lm_shipment_provider,
      CAST(log_id % 2 + 1 AS INT) AS inbound_type,
      CASE WHEN log_id % 9 = 0 THEN 0 ELSE first_time + 86400 * (log_id % 3) END
        AS scheduled_pickup_timestamp,
      CASE log_id % 8 WHEN 0 THEN 1000 WHEN 1 THEN 1040 WHEN 2 THEN 3060 WHEN 3 THEN 4097
        WHEN 4 THEN 8050 WHEN 5 THEN 9998 WHEN 6 THEN 4102 ELSE 77 END
        AS parcel_logistics_status_code,
      CASE log_id % 11 WHEN 0 THEN 'VNN' WHEN 1 THEN 'VNS' WHEN 2 THEN 'VNW' END AS whs_id,
      'NATION_' || {d.text('(log_id * 7 + 3) % 25')} AS seller_address_state,
      CASE WHEN log_id % 17 = 0 THEN 1 ELSE 0 END AS is_reverse,
      first_time + 7200 AS lm_inbound_timestamp,
      CASE WHEN log_id % 4 = 0 THEN first_time + 500000 END AS lm_delivered_timestamp,
      CASE WHEN log_id % 5 = 0 THEN first_time + 400000 END AS lm_first_attempt_delivery_timestamp,
      CASE WHEN log_id % 6 = 0 THEN first_time + 410000 END
        AS lm_first_failed_delivery_attempt_timestamp,
      CASE WHEN log_id % 7 = 0 THEN first_time + 420000 END AS lm_delivery_failed_timestamp,
      CASE WHEN log_id % 8 = 0 THEN first_time + 600000 END AS return_initiated_timestamp,
      CASE WHEN log_id % 9 = 0 THEN first_time + 610000 END AS return_pending_timestamp,
      CASE WHEN log_id % 10 = 0 THEN first_time + 620000 END AS return_completed_timestamp,
      first_time
    FROM fx_parcel_times"""


@view
def fx_fulfilment(d):
    return """
    SELECT order_id, log_id, log_id AS oms_forder_id, log_id * 3 AS ofg_id, consignment_no,
      first_time - 40000 AS order_arrange_shipping_timestamp,
      CAST((log_id % 50) * 1000 AS DOUBLE) AS items_sales_value_local,
      CAST((log_id % 60) * 100 AS DOUBLE) AS parcel_chargeable_weight, is_reverse
    FROM fx_parcel"""


@view
def fx_orders(d):
    return f"""
    SELECT o_orderkey AS order_id, 'SN' || {d.text('o_orderkey')} AS order_sn,
      1703030400 + (o_orderkey % 30) * 86400 + (o_custkey * 37) % 86400 AS create_timestamp,
      1703030400 + (o_orderkey % 30 + 12) * 86400 AS complete_timestamp,
      1703030400 + (o_orderkey % 30 + 15) * 86400 AS cancel_timestamp,
      'NATION_' || {d.text('(o_orderkey * 7 + 3) % 25')} AS seller_state,
      'City ' || {d.text('o_orderkey % 3')} AS seller_city,
      'District ' || {d.text('o_orderkey % 4')} AS seller_district,
      'NATION_' || {d.text('o_custkey % 25')} AS buyer_state,
      'City ' || {d.text('o_custkey % 3')} AS buyer_city,
      'District ' || {d.text('o_custkey % 4')} AS buyer_district,
      CAST(o_orderkey % 13 AS INT) AS logistics_status_id,
      CASE WHEN o_orderkey % 3 = 0 THEN 'PICKUP DONE' ELSE 'OTHER' END AS logistics_status,
      CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'OPEN' ELSE 'PAID' END
        AS order_be_status,
      CASE o_orderkey % 6 WHEN 0 THEN 'CANCEL_REASON_LOST_PARCEL'
        WHEN 1 THEN 'CANCEL_REASON_LOGISTICS_DELIVERY_FAILED' WHEN 2 THEN 'BUYER' END
        AS cancel_reason,
      CASE WHEN o_orderstatus = 'F' THEN 'PAY_COD' ELSE 'PAY_CC' END AS payment_method,
      CASE WHEN o_orderstatus = 'F' THEN 6 ELSE 4 END AS payment_method_id,
      CASE o_orderkey % 5 WHEN 0 THEN 51000 WHEN 1 THEN 50020 WHEN 2 THEN NULL ELSE 60000 END
        AS payment_be_channel_id,
      {CHANNEL.format(x='o_orderkey')} AS fulfilment_channel_id,
      {CARRIER.format(x='o_orderkey')} AS fulfilment_shipping_carrier,
      CASE o_orderkey % 3 WHEN 0 THEN 5001 WHEN 1 THEN 5002 ELSE 5009 END AS shipping_method_id,
      o_orderkey % 100 AS shop_id, o_orderkey % 100 + 1000000 AS seller_id,
      o_custkey AS buyer_id,
      CASE WHEN o_orderkey % 13 = 0 THEN 1 ELSE 0 END AS is_cb_shop,
      CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE 0 END AS is_preferred_shop,
      CASE WHEN o_orderkey % 4 = 1 THEN 1 ELSE 0 END AS is_preferred_plus_shop,
      CASE WHEN o_orderkey % 4 = 2 THEN 1 ELSE 0 END AS is_official_shop,
      round(o_totalprice) AS gmv, round(o_totalprice) - 100 AS escrow_to_seller_amt,
      CAST(o_orderkey % 3 AS DOUBLE) AS sv_rebate_by_seller_amt,
      CAST(o_orderkey % 5 AS DOUBLE) AS pv_rebate_by_seller_amt,
      CAST(o_orderkey % 7 AS DOUBLE) AS sv_rebate_by_platform_amt,
      CAST(o_orderkey % 2 AS DOUBLE) AS pv_rebate_by_platform_amt,
      CAST(20 AS DOUBLE) AS buyer_paid_shipping_fee, CAST(o_orderkey % 4 AS DOUBLE)
        AS card_rebate_by_bank_amt,
      CAST(o_orderkey % 6 AS DOUBLE) AS card_rebate_by_platform_amt,
      CAST(o_orderkey % 9 AS DOUBLE) AS coin_used_cash_amt,
      CAST(30 AS DOUBLE) AS estimate_shipping_fee, CAST(35 AS DOUBLE) AS actual_shipping_fee,
      CAST(3 AS DOUBLE) AS actual_shipping_rebate_by_seller_amt,
      CAST(o_orderkey % 8 AS DOUBLE) AS sv_coin_earn_by_seller_amt,
      {d.epoch_ts('1703030400 + (o_orderkey % 40) * 86400')} AS auto_cancel_arrange_ship_datetime,
      'Shop ' || {d.text('o_orderkey % 100')} AS shop_name,
      CASE WHEN o_orderkey % 3 > 0 THEN {d.epoch_ts('1703030400 + (o_orderkey % 50) * 86400')} END
        AS escrow_created_datetime,
      CASE WHEN o_orderkey % 3 = 1 THEN {d.epoch_ts('1703116800 + (o_orderkey % 50) * 86400')} END
        AS escrow_paid_datetime,
      {CARRIER.format(x='o_orderkey + 1')} AS shipping_carrier,
      CASE WHEN o_orderstatus = 'F' THEN 'Cash' ELSE 'Card ' || {d.text('o_orderkey % 2')} END AS payment_channel
    FROM orders"""


@view
def fx_items(d):
    return """
    SELECT l_orderkey AS order_id, l_partkey AS item_id, l_quantity AS item_amount,
      floor(l_extendedprice / 100) AS commission_fee, floor(l_extendedprice / 200) AS seller_txn_fee,
      floor(l_extendedprice / 300) AS service_fee, floor(l_extendedprice) AS cogs,
      floor(l_quantity / 10) AS insurance_premium_by_buyer_amt,
      CASE l_partkey % 4 WHEN 0 THEN 'Fashion' WHEN 1 THEN 'Home' WHEN 2 THEN 'Toys' END
        AS global_be_category, l_shipdate AS grass_date
    FROM lineitem"""


@view
def fx_item_dims(d):
    return f"""
    SELECT p_partkey AS item_id, {d.text('p_size * 10')} AS weight,
      {d.text('p_size + 1')} AS dim_width, {d.text('p_size + 2')} AS dim_length,
      {d.text('p_size + 3')} AS dim_height
    FROM part"""


@view
def fx_audit(d):
    return """
    SELECT """ + d.idiv("log_id", "2") + """ AS orderid, CAST(event_id % 13 AS INT) AS new_status,
      ctime FROM fx_tracking"""


@view
def fx_logistic(d):
    return f"""
    SELECT log_id AS slo_id, order_sn AS ordersn, consignment_no AS slo_tn,
      lm_tracking_no AS lm_tracking_number, parcel_logistics_status_code AS slo_status,
      log_id AS forderid, CAST(log_id % 30 AS DOUBLE) AS actual_shipping_fee,
      CAST(log_id % 40 * 100 AS DOUBLE) AS charged_weight
    FROM fx_parcel"""


@view
def fx_logistic_data(d):
    return """
    SELECT log_id, CASE WHEN log_id % 4 = 0 THEN 0 WHEN log_id % 4 = 1 THEN NULL
      ELSE first_time + 90000 END AS pickup_time
    FROM fx_parcel"""


@view
def fx_oms(d):
    return f"""
    SELECT log_id AS forder_id, order_id, CASE WHEN log_id % 5 = 0 THEN 'W0'
        WHEN log_id % 5 = 1 THEN 'W1' WHEN log_id % 5 = 2 THEN 'W2' END AS whs_id,
      {d.text('(log_id % 20) * 100000')} AS origin_shipping_fee, first_time - 100 AS arranged_time,
      first_time + 500 AS delivered_time,
      '{{"chargeable_weight": ' || {d.text('log_id % 9 * 500')} || '}}' AS attributes
    FROM fx_parcel"""


@view
def fx_warehouse(d):
    return f"""
    SELECT 'W' || {d.text('n_nationkey')} AS whs_id, n_name AS state,
      'City ' || {d.text('n_nationkey % 3')} AS city,
      'District ' || {d.text('n_nationkey % 4')} AS district
    FROM nation"""


@view
def fx_order_logistics(d):
    return f"""
    SELECT o_orderkey AS order_id, {d.struct3("'District ' || " + d.text('o_orderkey % 4'))} AS extinfo
    FROM orders"""


@view
def fx_sla(d):
    # nation x (25 nations x 3 cities x 3 cities x 2 versions)
    s, b = "n_nationkey", d.idiv("k", "18")
    cs, cb = d.idiv("k % 18", "6"), d.idiv("k % 6", "2")
    days = f"({s} * 3 + {b} * 5 + k % 2) % 6 + 1"
    return f"""
    SELECT lower(n_name) AS start_state, 'city ' || {d.text(cs)} AS start_city,
      'nation_' || {d.text(b)} AS end_state, 'city ' || {d.text(cb)} AS end_city,
      {d.text(days)} AS sla_vnp_ex, {d.text(f'({days}) + 1')} AS sla_vnp_eco,
      {d.text(days)} AS sla_vtp_urban, {d.text(f'({days}) + 2')} AS sla_vtp_rural,
      {d.text(days)} AS spx, CASE WHEN {b} % 4 = 0 THEN NULL ELSE {d.text(days)} END AS ghn,
      {d.text(days)} AS njv, {d.text(days)} || '.5' AS best, {d.text(days)} AS jnt,
      {d.text(days)} AS ghtk_1, {d.text(f'({days}) + 1')} AS ghtk_2,
      {d.text(f'({days}) + 2')} AS ghtk_3, k % 2 + 1 AS ingestion_timestamp
    FROM {d.repeat('nation', 450, 'k')} x WHERE ({s} + {b}) % 11 <> 0"""


@view
def fx_extend(d):
    # nation x (3 cities x 4 districts x 2 versions)
    c, t = d.idiv("k", "8"), d.idiv("k % 8", "2")
    return f"""
    SELECT n_name AS state, 'CITY ' || {d.text(c)} AS city, 'DISTRICT ' || {d.text(t)} AS district,
      CASE (n_nationkey + {t}) % 4 WHEN 0 THEN '0' WHEN 1 THEN '0.5' WHEN 2 THEN '1' ELSE NULL END
        AS extend_sla___addon,
      CASE (n_nationkey + {c}) % 3 WHEN 0 THEN 'Urban' WHEN 1 THEN 'Rural'
        ELSE 'Hard to delivery zone' END AS delivery_area,
      k % 2 + 1 AS ingestion_timestamp
    FROM {d.repeat('nation', 24, 'k')} x"""


@view
def fx_routes(d):
    b, cs, cb = d.idiv("k", "18"), d.idiv("k % 18", "6"), d.idiv("k % 6", "2")
    return f"""
    SELECT n_name AS start_state, 'City ' || {d.text(cs)} AS start_city,
      'Nation_' || {d.text(b)} AS end_state, 'City ' || {d.text(cb)} AS end_city,
      CASE WHEN n_nationkey = {b} AND {cs} = {cb} THEN 'Intra City'
        WHEN n_regionkey = {b} % 5 THEN 'Intra Region' ELSE 'Inter Region' END
        || CASE WHEN k % 2 = 0 THEN ' (old)' ELSE '' END AS route,
      k % 2 + 1 AS ingestion_timestamp
    FROM {d.repeat('nation', 450, 'k')} x"""


@view
def fx_regions(d):
    return f"""
    SELECT lower(n_name) AS state, 'Region ' || {d.text('(n_regionkey + k) % 5')} AS region,
      k + 1 AS ingestion_timestamp
    FROM {d.repeat('nation', 2, 'k')} x"""


@view
def fx_region_route(d):
    return f"""
    SELECT 'Region ' || {d.text('r_regionkey')} AS ship_from,
      'Region ' || {d.text(d.idiv('k', '2'))} AS ship_to,
      {d.text('(r_regionkey + k) % 5 + 2')} AS sla, k % 2 + 1 AS ingestion_timestamp,
      CASE WHEN r_regionkey = {d.idiv('k', '2')} THEN 'Intra Region' ELSE 'Inter Region' END
        AS route
    FROM {d.repeat('region', 10, 'k')} x"""


@view
def fx_area(d):
    return f"""
    SELECT lower(n_name) AS state, 'Area ' || {d.text('n_nationkey % 6')} AS area,
      k + 1 AS ingestion_timestamp
    FROM {d.repeat('nation', 2, 'k')} x"""


@view
def fx_express_route(d):
    return f"""
    SELECT lower(n_name) AS ship_from, 'Area ' || {d.text(d.idiv('k', '2'))} AS ship_to,
      {d.text('(n_nationkey + k) % 3 + 1')} || '.5' AS sla, k % 2 + 1 AS ingestion_timestamp
    FROM {d.repeat('nation', 12, 'k')} x WHERE n_nationkey <> 7"""


@view
def fx_rural(d):
    c, t = d.idiv("k", "8"), d.idiv("k % 8", "2")
    return f"""
    SELECT lower(n_name) || '-city ' || {d.text(c)} || '-district ' || {d.text(t)} AS address,
      CASE WHEN n_nationkey % 2 = 0 THEN '0.5' ELSE '1' END AS pickup,
      {d.text(f'{t} % 2')} AS intra, {d.text(f'{c} % 3')} AS inter,
      k % 2 + 1 AS ingestion_timestamp
    FROM {d.repeat('nation', 24, 'k')} x WHERE n_nationkey % 4 <> 3"""


@view
def fx_remote(d):
    return f"""
    SELECT lower(n_name) || '-city ' || {d.text(d.idiv('k', '2'))} AS buyer_address,
      {d.text('n_nationkey % 3 + 1')} AS added_leadtime, k % 2 + 1 AS ingestion_timestamp
    FROM {d.repeat('nation', 6, 'k')} x WHERE n_nationkey % 3 = 0"""


HOLIDAY_ROWS = [
    (carrier, kind, day, nb, version)
    for carrier in ("VNPost Nhanh", "VNPost Tiết Kiệm", "Shopee Xpress", "BEST Express")
    for kind in ("delivery", "return")
    for day, nb in (("2024-01-01", "1"), ("2024-01-10", "2"), ("2024-01-12", "1"),
                    ("2024-01-20", "1"))
    for version in (1, 2) if not (version == 2 and day == "2024-01-20")
]


@view
def fx_holiday(d):
    rows = ", ".join(f"('{a}', '{b}', '{c}', '{n}', {v})" for a, b, c, n, v in HOLIDAY_ROWS)
    return f"""
    SELECT * FROM (VALUES {rows})
      AS t(shipping_carrier, type, holiday_start, nb_holiday, ingestion_timestamp)"""


@view
def fx_created(d):
    part = d.idiv("user_id % 100", "4")
    hours = "event_id * 5 % 48"
    return f"""
    SELECT event_id AS ordercode, {d.ts('ts')} AS orderdate,
      CASE WHEN event_id % 10 = 9 THEN 1 ELSE 18692 END AS clientid,
      CASE WHEN event_id % 50 = 0 THEN NULL ELSE 'Region ' || {d.text(f'{part} % 5')} END
        AS fromregionshortname,
      'NATION_' || {d.text(part)} AS fromprovince,
      'District ' || {d.text('user_id % 4')} AS fromdistrict,
      'W' || {d.text('user_id % 100')} AS fromwardcode,
      CASE event_id % 7 WHEN 0 THEN 'Ahamove Hub' WHEN 1 THEN 'Kho 3' WHEN 2 THEN 'Kho 5'
        ELSE 'Bưu Cục ' || {d.text('user_id % 30')} END AS pickwh,
      CASE user_id % 40 WHEN 0 THEN 1297 WHEN 1 THEN 1327 ELSE user_id % 40 END AS pickwarehouseid,
      'Shop ' || {d.text('user_id % 20')} AS clientcontactname,
      CASE WHEN event_id % 10 < 9 THEN {d.plus_hours('ts', hours)} END AS firstupdatedpickeduptime,
      CASE WHEN event_id % 3 = 0 THEN {d.plus_hours('ts', hours + ' + 12')} END
        AS secondupdatedpickeduptime,
      CASE WHEN event_id % 3 = 0 THEN {d.plus_hours('ts', hours + ' + 6')} END
        AS secondcreatedpickeduptime,
      CASE WHEN event_id % 10 < 8 THEN {d.plus_hours('ts', 'event_id * 7 % 60')} END AS endpicktime,
      CASE event_id % 6 WHEN 0 THEN 'Nhân viên gặp sự cố' WHEN 1 THEN 'closed' END
        AS firstfailpicknote,
      CASE event_type WHEN 'error' THEN 'cancel' WHEN 'view' THEN 'ready_to_pick'
        WHEN 'click' THEN 'picking' ELSE 'delivered' END AS currentstatus,
      CASE WHEN event_type = 'error' THEN {d.plus_hours('ts', 'event_id % 30')} END AS canceltime,
      CASE WHEN event_id % 20 = 0 THEN 'WH - Shopee' ELSE 'MP' END AS channel,
      (event_id % 11 = 0) AS isexpecteddropoff,
      event_id % 3 AS numdeliver, event_id % 2 AS numreturn
    FROM events"""


@view
def fx_ward(d):
    return f"""
    SELECT 'W' || {d.text('n_nationkey * 4 + k')} AS ward_id, 'Ward ' || {d.text('k')} AS ward_name,
      'District ' || {d.text('k')} AS district_name, n_name AS province_name,
      'Region ' || {d.text('n_regionkey')} AS region_shortname
    FROM {d.repeat('nation', 4, 'k')} x"""


@view
def fx_dim_warehouse(d):
    return """
    SELECT n_nationkey AS warehouse_id,
      CASE WHEN n_nationkey % 5 = 0 THEN 'Freight Operations Department' ELSE 'Ops' END
        AS department_name,
      CASE WHEN n_nationkey % 7 = 0 THEN 'HN Kho Chuyển Tiếp 2' ELSE n_name END AS warehouse_name
    FROM nation"""


@view
def fx_account(d):
    return """
    SELECT s_suppkey AS shopid, s_suppkey + 1000000 AS userid, s_name AS username FROM supplier
    UNION ALL SELECT NULL, c_custkey, c_name FROM customer"""


@view
def fx_escrow(d):
    return """SELECT o_orderkey AS order_id, CAST(o_orderkey % 11 AS DOUBLE)
      AS buyer_paid_insurance_premium FROM orders WHERE o_orderkey % 5 = 0"""


@view
def fx_insurance(d):
    return """SELECT o_orderkey AS order_id, CAST(o_orderkey % 17 AS DOUBLE) AS premium,
      CAST(o_orderkey % 16 AS DOUBLE) AS premium_after_discount FROM orders
      WHERE o_orderkey % 4 = 0"""


@view
def fx_refund(d):
    return """SELECT o_orderkey AS order_id, o_orderkey * 10 AS refund_id FROM orders
      WHERE o_orderkey % 9 = 0"""


@view
def fx_ids(d):
    """Tracking numbers asked for: one in five parcels."""
    return """SELECT lm_tracking_no AS id FROM fx_parcel WHERE user_rank % 5 = 0""".replace(
        "user_rank", "log_id")


# --- building ------------------------------------------------------------------

_NAME = re.compile(r"\b[fo]x_[a-z_0-9]+\b")

# Oracle-side intermediate results, filled by checks.oracle_views.
ORACLE_VIEWS: dict[str, str] = {}


def _oracle_text(name: str) -> str | None:
    if name in VIEWS:
        return VIEWS[name](DuckDialect())
    return ORACLE_VIEWS.get(name)


def _closure(sql: str) -> list[str]:
    """Views a statement needs, each after the views it reads itself."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in dict.fromkeys(_NAME.findall(text)):
            body = _oracle_text(name)
            if body is not None and name not in order:
                visit(body)
                if name not in order:
                    order.append(name)

    visit(sql)
    return order


def with_views(sql: str) -> str:
    """Oracle statement with the views it reads as common table expressions."""
    ctes = [f"{n} AS ({_oracle_text(n).strip()})" for n in _closure(sql)]
    return ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + sql


class Views:
    """Spark side of the views, and the raw tables, as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._made: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        made = self.__dict__["_made"]
        if name not in made:
            made[name] = self._build(name)
        return made[name]

    def _build(self, name: str) -> DataFrame:
        if name in TABLES:
            reader = self.spark.read
            if name in SCHEMAS:  # stated, so that no job reads the footers
                reader = reader.schema(SCHEMAS[name])
            return reader.parquet(f"{self.sf_dir}/{name}.parquet")
        key = name if name.startswith("fx_") else f"fx_{name}"
        if key not in VIEWS:
            raise AttributeError(name)
        sql = VIEWS[key](SparkDialect())
        needed = {w for w in re.findall(r"\b[a-z_]+\b", sql) if w in TABLES or w in VIEWS}
        from_clause = {w for w in needed if re.search(rf"\bFROM\s+{w}\b", sql)}
        frames = {w: getattr(self, w) for w in from_clause}
        for w in from_clause:
            sql = re.sub(rf"\bFROM\s+{w}\b", f"FROM {{{w}}}", sql)
        sql = _protect_braces(sql, from_clause)
        return self.spark.sql(sql, **frames)


_KEPT: WeakKeyDictionary = WeakKeyDictionary()


def views_of(spark: SparkSession, sf_dir: str) -> Views:
    """The views of a folder; plans are kept per session, data never is."""
    return _KEPT.setdefault(spark, {}).setdefault(sf_dir, Views(spark, sf_dir))


def _protect_braces(sql: str, names: set[str]) -> str:
    """Braces that are text, not placeholders, are doubled for the formatter."""
    sql = sql.replace("{", "{{").replace("}", "}}")
    for n in names:
        sql = sql.replace("{{" + n + "}}", "{" + n + "}")
    return sql
