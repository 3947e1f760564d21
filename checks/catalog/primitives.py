"""Scans, projections and filters."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from waybill.functions import classify, codes
from waybill.functions.times import iso_week, month_label, period_start
from waybill.operators.lookups import exists_flag
from waybill.operators.orders import multi_parcel
from waybill.operators.pickup import hub_type, not_cancelled_same_day
from waybill.sources import marts, scans, sheets

from ..oracle_views import PARCEL_STATE
from ..registry import query

SNAPSHOT_DAY = dt.date(1998, 6, 2)


# --- scans ---------------------------------------------------------------------

@query("scan_table", "r_regionkey:i r_name:s", "SELECT r_regionkey, r_name FROM region")
def scan_table(v):
    return scans.read_files(v.spark, f"{v.sf_dir}/region.parquet")


@query("scan_snapshot", "l_orderkey:i l_linenumber:i l_quantity:f", """
    SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem
    WHERE l_shipdate = TIMESTAMP '1998-06-01'""")
def scan_snapshot(v):
    return scans.snapshot(v.lineitem, SNAPSHOT_DAY, lag=1, partition="l_shipdate")


@query("scan_snapshot_lag2", "l_orderkey:i l_linenumber:i l_quantity:f", """
    SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem
    WHERE l_shipdate = TIMESTAMP '1998-05-31'""")
def scan_snapshot_lag2(v):
    return scans.snapshot(v.lineitem, SNAPSHOT_DAY, lag=2, partition="l_shipdate")


@query("scan_month_days", "day:d n:i", """
    SELECT CAST(l_shipdate AS DATE) AS day, count(*) AS n FROM lineitem
    WHERE CAST(l_shipdate AS DATE) IN (SELECT CAST(o_orderdate AS DATE) FROM orders
      WHERE CAST(date_trunc('month', o_orderdate) AS DATE) = DATE '1995-03-01') GROUP BY 1""")
def scan_month_days(v):
    """The days of a month that had orders, taken from the order table."""
    days = scans.days_of(v.orders.select(F.to_date("o_orderdate").alias("day")),
                         F.date_trunc("month", "day").cast("date") == F.lit(dt.date(1995, 3, 1)))
    shipped = v.lineitem.select(F.to_date("l_shipdate").alias("day"))
    return scans.restrict_to_days(shipped, days, "day").groupBy("day").agg(F.count(F.lit(1)).alias("n"))


@query("scan_partition_range", "l_returnflag:s n:i qty:f", """
    SELECT l_returnflag, count(*) AS n, sum(l_quantity) AS qty FROM lineitem
    WHERE l_shipdate > TIMESTAMP '1999-01-01' AND l_linestatus = 'O' GROUP BY 1""")
def scan_partition_range(v):
    part = scans.partition_range(v.lineitem, dt.date(1999, 1, 1), "O", partition="l_shipdate",
                                 region_column="l_linestatus", inclusive=False)
    return part.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("qty"))


@query("scan_latest_version", "start_state:s end_state:s start_city:s end_city:s sla_vnp_ex:s", """
    SELECT start_state, end_state, start_city, end_city, sla_vnp_ex FROM fx_sla
    WHERE ingestion_timestamp = (SELECT max(ingestion_timestamp) FROM fx_sla)""")
def scan_latest_version(v):
    return scans.latest_version(v.sla)


@query("scan_all_versions", "buyer_state:s parcels:i", """
    SELECT o.buyer_state, count(*) AS parcels FROM fx_orders o
    LEFT JOIN fx_regions r ON lower(r.state) = lower(o.buyer_state) GROUP BY 1""")
def scan_all_versions(v):
    # every version joins, so each parcel counts once per version of its state
    joined = v.fx_orders.join(
        v.regions, F.lower(F.col("state")) == F.lower(F.col("buyer_state")), "left")
    return joined.groupBy("buyer_state").agg(F.count(F.lit(1)).alias("parcels"))


EVENT_DAYS_JAN = ("2024-01-05", "2024-01-06", "2024-01-07", "2024-01-14", "2024-01-21",
                  "2024-01-28", "2024-01-05")


@query("scan_values", "sla_date:d n:i", """
    SELECT c.d AS sla_date, count(*) AS n FROM events e
    JOIN (SELECT DISTINCT CAST(x AS DATE) AS d FROM (VALUES ('2024-01-05'), ('2024-01-06'),
      ('2024-01-07'), ('2024-01-14'), ('2024-01-21'), ('2024-01-28')) t(x)) c
    ON CAST(e.ts AS DATE) = c.d GROUP BY 1""")
def scan_values(v):
    days = scans.calendar(v.spark, EVENT_DAYS_JAN)
    return v.events.join(days, F.to_date("ts") == F.col("sla_date")).groupBy("sla_date").agg(
        F.count(F.lit(1)).alias("n"))


@query("scan_rejects", "column:s rows:i filled:i rejects:i", """
    SELECT 'p_size' AS column, count(*) AS rows, count(p_size) AS filled,
      count(CASE WHEN TRY_CAST(CAST(p_size AS VARCHAR) AS DOUBLE) IS NULL THEN p_size END) AS rejects FROM part
    UNION ALL SELECT 'p_brand', count(*), count(p_brand),
      count(CASE WHEN TRY_CAST(p_brand AS INTEGER) IS NULL THEN p_brand END) FROM part
    UNION ALL SELECT 'p_last', count(*), count(p_name),
      count(CASE WHEN TRY_CAST(right(p_brand, 2) AS INTEGER) IS NULL THEN p_brand END) FROM part""")
def scan_rejects(v):
    """How much of three columns can be read as numbers."""
    part = v.part.withColumn("p_last", F.expr("right(p_brand, 2)"))
    return sheets.rejected_cells(part, {"p_size": "double", "p_brand": "int", "p_last": "int"})


@query("scan_cross_source", "id:s channel:i weight:f", """
    SELECT i.id, p.fulfillment_channel_id AS channel, f.parcel_chargeable_weight AS weight
    FROM fx_ids i LEFT JOIN fx_parcel p ON p.lm_tracking_no = i.id
    LEFT JOIN fx_fulfilment f ON f.log_id = p.log_id""")
def scan_cross_source(v):
    # an exported id sheet against a mart: sources are only DataFrames
    parcels = v.parcel.join(v.fulfilment.select("log_id", "parcel_chargeable_weight"), "log_id")
    out = scans.enrich_list(v.ids, parcels, "id", "lm_tracking_no",
                            ["fulfillment_channel_id", "parcel_chargeable_weight"])
    return out.withColumnsRenamed({"fulfillment_channel_id": "channel",
                                   "parcel_chargeable_weight": "weight"})


@query("filter_id_list", "log_id:i lm_tracking_no:s", """
    SELECT log_id, lm_tracking_no FROM fx_parcel
    WHERE lm_tracking_no IN (SELECT id FROM fx_ids)""")
def filter_id_list(v):
    return scans.restrict_to_ids(v.parcel, "lm_tracking_no", v.ids)


@query("filter_param_list", "o_orderpriority:s n:i", """
    SELECT o_orderpriority, count(*) AS n FROM orders
    WHERE o_orderpriority IN ('1-URGENT', '5-LOW') GROUP BY 1""")
def filter_param_list(v):
    kept = scans.restrict_to_values(v.orders, "o_orderpriority", ["1-URGENT", "5-LOW"])
    return kept.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("filter_param_marker", "o_orderdate:d n:i", """
    SELECT o_orderdate, count(*) AS n FROM orders
    WHERE CAST(o_orderdate AS DATE) IN (DATE '1995-03-15', DATE '1996-02-29', DATE '1997-12-31') GROUP BY 1""")
def filter_param_marker(v):
    orders = v.orders.withColumn("o_orderdate", F.to_date("o_orderdate"))
    kept = scans.restrict_by_parameter(orders, "o_orderdate", ["1995-03-15", "1996-02-29", "1997-12-31"])
    return kept.groupBy("o_orderdate").agg(F.count(F.lit(1)).alias("n"))


# --- projections ---------------------------------------------------------------

@query("proj_rename", "order_id:i customer:i total:f", """
    SELECT o_orderkey AS order_id, o_custkey AS customer, o_totalprice AS total FROM orders""")
def proj_rename(v):
    return v.orders.select(F.col("o_orderkey").alias("order_id"),
                           F.col("o_custkey").alias("customer"),
                           F.col("o_totalprice").alias("total"))


@query("proj_quoted", "Tuần:i %share:f 1st_day:d Tuần_2:i", """
    SELECT week(ts) AS "Tuần", avg(CASE WHEN event_type = 'purchase' THEN 1.0 ELSE 0.0 END)
      AS "%share", min(CAST(ts AS DATE)) AS "1st_day", week(ts) AS "Tuần_2"
    FROM events GROUP BY 1""")
def proj_quoted(v):
    names = marts.unique_names(["Tuần", "%share", "1st_day", "Tuần"])
    weekly = v.events.groupBy(F.weekofyear("ts").alias("w")).agg(
        F.avg(F.when(F.col("event_type") == "purchase", 1.0).otherwise(0.0)).alias("share"),
        F.min(F.to_date("ts")).alias("day"))
    return weekly.select("w", "share", "day", "w").toDF(*names)


@query("proj_star_derived", "l_orderkey:i l_linenumber:i l_quantity:f net:f", """
    SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice * (1 - l_discount) AS net
    FROM (SELECT * FROM lineitem)""")
def proj_star_derived(v):
    return v.lineitem.withColumns(
        {"net": F.col("l_extendedprice") * (1 - F.col("l_discount"))})


@query("proj_constants", "log_id:i pickup:i disaster:i kind:s", """
    SELECT log_id, 0 AS pickup, 0 AS disaster, 'Daily' AS kind FROM fx_parcel""")
def proj_constants(v):
    return v.parcel.select("log_id", F.lit(0).alias("pickup"), F.lit(0).alias("disaster"),
                           F.lit("Daily").alias("kind"))


@query("proj_case", "log_id:i state:s", f"""
    SELECT log_id, {PARCEL_STATE.format(x='parcel_logistics_status_code')} AS state
    FROM fx_parcel""")
def proj_case(v):
    return v.parcel.select(
        "log_id", classify.parcel_state("parcel_logistics_status_code").alias("state"))


@query("proj_if", "log_id:i is_drop_off:i", """
    SELECT log_id, CASE WHEN inbound_type = 2 THEN 1 ELSE 0 END AS is_drop_off FROM fx_parcel""")
def proj_if(v):
    return v.parcel.select("log_id", F.when(F.col("inbound_type") == 2, 1).otherwise(0).alias(
        "is_drop_off"))


@query("proj_coalesce", "ordercode:i best:t", """
    SELECT ordercode, coalesce(firstupdatedpickeduptime, secondupdatedpickeduptime, endpicktime,
      canceltime, orderdate) AS best FROM fx_created""")
def proj_coalesce(v):
    return v.created.select("ordercode", F.coalesce(
        "firstupdatedpickeduptime", "secondupdatedpickeduptime", "endpicktime", "canceltime",
        "orderdate").alias("best"))


@query("proj_nullif", "l_orderkey:i l_linenumber:i per_tax:f", """
    SELECT l_orderkey, l_linenumber, l_discount / NULLIF(l_tax, 0) AS per_tax FROM lineitem""")
def proj_nullif(v):
    return v.lineitem.select("l_orderkey", "l_linenumber", (
        F.col("l_discount") / F.nullif("l_tax", F.lit(0.0))).alias("per_tax"))


@query("proj_cast", "start_state:s end_state:s start_city:s end_city:s days:f day_text:s", """
    SELECT start_state, end_state, start_city, end_city, CAST(best AS DOUBLE) AS days,
      CAST(ingestion_timestamp AS VARCHAR) AS day_text FROM fx_sla""")
def proj_cast(v):
    return v.sla.select(
        "start_state", "end_state", "start_city", "end_city",
        F.col("best").cast("double").alias("days"),
        F.col("ingestion_timestamp").cast("string").alias("day_text"))


@query("proj_case_in_subquery", "ordercode:i type_kh:s", """
    SELECT ordercode, CASE WHEN pickwh LIKE '%Ahamove%' THEN 'Ahamove'
        WHEN pickwarehouseid IN (1297, 1327) THEN 'KHL'
        WHEN pickwarehouseid IN (SELECT warehouse_id FROM fx_dim_warehouse
          WHERE department_name = 'Freight Operations Department'
             OR warehouse_name LIKE '%Kho Chuyển Tiếp %') THEN 'GXT'
        ELSE 'BC' END AS type_kh FROM fx_created""")
def proj_case_in_subquery(v):
    return hub_type(v.created, v.dim_warehouse)


@query("proj_bucket", "order_id:i value_class:s weight_class:s", """
    SELECT f.order_id,
      CASE WHEN o.gmv <= 100000 THEN '<100k' WHEN o.gmv <= 200000 THEN '100-200k'
        WHEN o.gmv > 200000 THEN '>200k' ELSE 'no' END AS value_class,
      CASE WHEN parcel_chargeable_weight <= 1000 THEN '<1kg'
        WHEN parcel_chargeable_weight <= 2000 THEN '1-2kg'
        WHEN parcel_chargeable_weight <= 3000 THEN '2-3kg'
        WHEN parcel_chargeable_weight <= 4000 THEN '3-4kg'
        WHEN parcel_chargeable_weight <= 5000 THEN '4-5kg'
        WHEN parcel_chargeable_weight > 5000 THEN '>5kg' ELSE 'no' END AS weight_class
    FROM fx_fulfilment f LEFT JOIN fx_orders o ON o.order_id = f.order_id""")
def proj_bucket(v):
    joined = v.fulfilment.join(v.fx_orders.select("order_id", "gmv"), "order_id", "left")
    return joined.select(
        "order_id", classify.value_bucket("gmv").alias("value_class"),
        classify.weight_bucket("parcel_chargeable_weight").alias("weight_class"))


@query("proj_distinct", "buyer_state:s buyer_city:s carrier:s", """
    SELECT DISTINCT buyer_state, buyer_city, fulfilment_shipping_carrier AS carrier
    FROM fx_orders""")
def proj_distinct(v):
    return v.fx_orders.select("buyer_state", "buyer_city", F.col(
        "fulfilment_shipping_carrier").alias("carrier")).distinct()


# --- filters -------------------------------------------------------------------

@query("filter_bool_tree", "order_id:i logistics_status_id:i", """
    SELECT order_id, logistics_status_id FROM fx_orders
    WHERE logistics_status_id NOT IN (7, 8, 10, 11) AND fulfilment_channel_id IN (50015, 50016)
      AND ((seller_state = 'NATION_3' AND logistics_status_id <> 4)
        OR (logistics_status_id = 2 AND buyer_state = 'NATION_3'))""")
def filter_bool_tree(v):
    status = F.col("logistics_status_id")
    return v.fx_orders.where(
        ~status.isin(7, 8, 10, 11) & F.col("fulfilment_channel_id").isin(50015, 50016)
        & (((F.col("seller_state") == "NATION_3") & (status != 4))
           | ((status == 2) & (F.col("buyer_state") == "NATION_3"))))


@query("filter_in_list", "event_type:s n:i", """
    SELECT event_type, count(*) AS n FROM events
    WHERE event_type IN ('view', 'click', 'error') AND user_id NOT IN (1, 2, 3) GROUP BY 1""")
def filter_in_list(v):
    kept = v.events.where(F.col("event_type").isin("view", "click", "error")
                          & ~F.col("user_id").isin(1, 2, 3))
    return kept.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("filter_between", "o_orderstatus:s n:i", """
    SELECT o_orderstatus, count(*) AS n FROM orders
    WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1998-12-02' AND DATE '1999-01-31'
       OR CAST(o_orderdate AS DATE) BETWEEN DATE '2001-08-01' - INTERVAL 6 MONTH
          AND DATE '2001-08-01' GROUP BY 1""")
def filter_between(v):
    as_of = F.lit(dt.date(2001, 8, 1))
    day = F.to_date("o_orderdate")
    kept = v.orders.where(
        day.between(F.lit(dt.date(1998, 12, 2)), F.lit(dt.date(1999, 1, 31)))
        | day.between(F.add_months(as_of, -6), as_of))
    return kept.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("filter_null", "ordercode:i", """
    SELECT ordercode FROM fx_created WHERE endpicktime IS NULL
      AND firstupdatedpickeduptime IS NOT NULL AND canceltime IS NULL""")
def filter_null(v):
    return v.created.where(F.col("endpicktime").isNull()
                           & F.col("firstupdatedpickeduptime").isNotNull()
                           & F.col("canceltime").isNull())


@query("filter_like", "pickwh:s n:i", """
    SELECT pickwh, count(*) AS n FROM fx_created
    WHERE lower(pickwh) LIKE 'bưu cục%' OR pickwh LIKE '%Ahamove%' GROUP BY 1""")
def filter_like(v):
    kept = v.created.where(F.lower("pickwh").like(codes.POST_OFFICE_LIKE)
                           | F.col("pickwh").like(codes.INSTANT_HUB_LIKE))
    return kept.groupBy("pickwh").agg(F.count(F.lit(1)).alias("n"))


@query("filter_regexp", "log_id:i reason_description:s", """
    SELECT log_id, reason_description FROM fx_tracking WHERE regexp_matches(reason_description,
      'tu choi|thay doi dia chi phat|khong tim thay|sai') = false""")
def filter_regexp(v):
    return v.tracking.where(~F.col("reason_description").rlike(codes.CUSTOMER_FAULT))


@query("filter_not", "o_orderstatus:s o_orderpriority:s n:i", """
    SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders
    WHERE 1 = 1 AND true AND NOT o_orderstatus = 'F' AND o_orderpriority <> '5-LOW'
    GROUP BY 1, 2""")
def filter_not(v):
    kept = v.orders.where(F.lit(True) & ~(F.col("o_orderstatus") == "F")
                          & (F.col("o_orderpriority") != "5-LOW"))
    return kept.groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("filter_not_and", "ordercode:i", """
    SELECT ordercode FROM fx_created WHERE NOT (currentstatus = 'cancel'
      AND CAST(canceltime AS DATE) <= CAST(orderdate AS DATE))""")
def filter_not_and(v):
    return v.created.where(not_cancelled_same_day())


@query("filter_derived", "l_orderkey:i l_linenumber:i net:f", """
    WITH d AS (SELECT *, l_extendedprice * (1 - l_discount) AS net FROM lineitem)
    SELECT l_orderkey, l_linenumber, net FROM d WHERE net BETWEEN 20000 AND 30000""")
def filter_derived(v):
    net = v.lineitem.withColumn("net", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return net.where(F.col("net").between(20000, 30000))


@query("proj_cte_reuse", "week:i users:i events:i buyers:i", """
    WITH w AS (SELECT week(ts) AS week, user_id, event_type FROM events),
    a AS (SELECT week, count(DISTINCT user_id) AS users, count(*) AS events FROM w GROUP BY 1),
    b AS (SELECT week, count(DISTINCT user_id) AS buyers FROM w
      WHERE event_type = 'purchase' GROUP BY 1)
    SELECT a.week, users, events, buyers FROM a LEFT JOIN b ON a.week = b.week""")
def proj_cte_reuse(v):
    # one aggregate per (week, user) feeds both consumers
    per_user = v.events.groupBy(F.weekofyear("ts").alias("week"), "user_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.max((F.col("event_type") == "purchase").cast("int")).alias("bought"))
    return per_user.groupBy("week").agg(
        F.count(F.lit(1)).alias("users"), F.sum("n").alias("events"),
        F.sum("bought").alias("buyers"))


@query("filter_scalar_subquery", "o_orderkey:i o_totalprice:f", """
    SELECT o_orderkey, o_totalprice FROM orders
    WHERE o_orderdate = (SELECT max(o_orderdate) FROM orders)""")
def filter_scalar_subquery(v):
    return scans.latest_version(v.orders, "o_orderdate")


@query("proj_period_label", "week_:i week_next:i month_no:i month_:s week_start:d n:i", """
    SELECT week(o_orderdate) AS week_, week(o_orderdate) + 1 AS week_next,
      month(o_orderdate) AS month_no, month(o_orderdate) || '/' || year(o_orderdate) AS month_,
      CAST(date_trunc('week', o_orderdate) AS DATE) AS week_start, count(*) AS n
    FROM orders GROUP BY ALL""")
def proj_period_label(v):
    d = "o_orderdate"
    return v.orders.groupBy(
        iso_week(d).alias("week_"), (iso_week(d) + 1).alias("week_next"),
        F.month(d).alias("month_no"), month_label(d).alias("month_"),
        period_start(d, "week").alias("week_start")).agg(F.count(F.lit(1)).alias("n"))


@query("join_exists_flag", "order_id:i multi:s", """
    SELECT o.order_id, CASE WHEN m.order_id IS NOT NULL THEN 'Multi WH' ELSE 'Not Multi WH' END
      AS multi FROM fx_orders o LEFT JOIN (SELECT order_id FROM fx_oms
        GROUP BY order_id HAVING count(DISTINCT forder_id) > 1) m ON m.order_id = o.order_id""")
def join_exists_flag(v):
    flagged = exists_flag(v.fx_orders, multi_parcel(v.oms, "order_id", "forder_id"),
                          ["order_id"], "is_multi")
    return flagged.withColumn("multi", F.when(F.col("is_multi"), "Multi WH").otherwise(
        "Not Multi WH"))
