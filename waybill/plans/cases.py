"""Case sheets: wide rows for a list of parcels, open orders, anomalies, fees."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions import classify, codes
from ..functions.times import REPORT_SHIFT, from_epoch
from ..operators import delivery as dlv
from ..operators import milestones as mst
from ..operators import orders as ord_
from ..sources.scans import restrict_to_ids

ORDER_COLUMNS = ("order_id", "order_sn", "logistics_status_id", "order_be_status",
                 "seller_state", "seller_city", "seller_district", "buyer_state", "buyer_city",
                 "buyer_district", "fulfilment_channel_id", "shipping_method_id",
                 "fulfilment_shipping_carrier", "payment_method")


def case_base(orders: DataFrame, logistic: DataFrame, parcel: DataFrame, fulfilment: DataFrame,
              times: DataFrame, order_columns: Sequence[str] = (),
              ids: DataFrame | None = None) -> DataFrame:
    """Orders with their logistic request, parcel, arrangement and milestones.

    ``ids`` (tracking numbers) cuts the request table before anything is
    joined, so only the listed parcels travel on.
    """
    if ids is not None:
        logistic = restrict_to_ids(logistic, "lm_tracking_number", ids)
    request = logistic.select(
        F.col("slo_id").alias("log_id"), F.col("ordersn").alias("order_sn"),
        F.col("slo_tn").alias("consignment_no"), "lm_tracking_number", "slo_status",
        "charged_weight")
    snap = parcel.select("log_id", "lm_shipment_provider", "inbound_type",
                         "scheduled_pickup_timestamp")
    arranged = fulfilment.groupBy("log_id").agg(
        F.max("order_arrange_shipping_timestamp").alias("arranged"),
        F.max("items_sales_value_local").alias("cogs_parcel"),
        F.max("parcel_chargeable_weight").alias("actual_weight"))
    head = orders.select(*ORDER_COLUMNS, *order_columns)
    joined = (
        times.join(request, "log_id", "right").join(snap, "log_id", "left")
        .join(arranged, "log_id", "left").join(head, "order_sn")
    )
    return joined.withColumns({
        "logistics_status": classify.order_state("logistics_status_id"),
        "sls_status": classify.parcel_state("slo_status"),
        "carrier": classify.carrier_label(provider="lm_shipment_provider"),
        "logistics_request_created": from_epoch("arranged", REPORT_SHIFT),
        "payment": classify.payment_type(),
        "shipment_type": classify.shipment_type_inbound("inbound_type"),
        "scheduled_pickup_time": from_epoch("scheduled_pickup_timestamp", REPORT_SHIFT),
    })


CASE_SHEET = ("lm_tracking_number", "order_id", "order_sn", "consignment_no", "logistics_status",
              "order_be_status", "sls_status", "seller_state", "seller_city", "seller_district",
              "buyer_state", "buyer_city", "buyer_district", "carrier",
              "logistics_request_created", "pku_done_time", "return_initiated_time", "payment")


def case_detail(base: DataFrame, audit: DataFrame,
                extra: Sequence[str] = ()) -> DataFrame:
    """Listed cases with the last audit change."""
    last = mst.audit_last(audit).withColumnRenamed("orderid", "order_id")
    return base.join(last, "order_id", "left").select(
        *CASE_SHEET, "lost_update_time", *extra).distinct()


def shipping_fee_check(base: DataFrame, parcel: DataFrame, fulfilment: DataFrame,
                       items: DataFrame, item_dims: DataFrame) -> DataFrame:
    """Listed cases with value, weights, order dimensions, multi-parcel and group flags.

    ``base`` carries the order columns ``gmv`` and ``create_timestamp``.
    """
    multi = ord_.multi_parcel(parcel, "log_id", "lm_tracking_no", F.col("whs_id").isNotNull())
    groups = ord_.group_size(fulfilment, "order_id", "oms_forder_id")
    dims = ord_.order_dims(items, item_dims).drop("weight")
    return (
        base.join(multi, "log_id", "left").join(groups, "order_id", "left")
        .join(dims, "order_id", "left")
        .withColumn("check_multi_wh", ord_.multi_label("nb_parcels"))
        .withColumn("check_group_shipment", ord_.group_label("total_group"))
        .select(*CASE_SHEET, F.col("gmv").alias("grand_total"), "charged_weight", "actual_weight", "cogs_parcel",
                "item_amount", "length", "width", "height", "check_multi_wh", "check_group_shipment",
                from_epoch("create_timestamp", REPORT_SHIFT).alias("order_created"))
        .distinct()
    )


def open_ready_orders(base: DataFrame, cancel_day: str, carriers: Sequence[str],
                      status: int = 9) -> DataFrame:
    """Ready orders that will be cancelled automatically on a day."""
    return base.where(
        F.col("fulfilment_shipping_carrier").isin(*carriers)
        & (F.col("logistics_status_id") == status)
        & (F.to_date("auto_cancel_arrange_ship_datetime") == F.lit(cancel_day).cast("date"))
    ).select("lm_tracking_number", "order_id", "order_sn", "consignment_no", "logistics_status",
             "order_be_status", "sls_status", "shop_id", "seller_id", "shop_name",
             "fulfilment_shipping_carrier").distinct()


def sequence_anomalies(base: DataFrame, audit: DataFrame,
                       channels=(codes.EXPRESS_CHANNEL, codes.ECONOMY_CHANNEL)) -> DataFrame:
    """All parcels failed after pickup that are still 'picked up', with the last audit change and the escrow times.

    ``base`` carries the order columns ``escrow_paid_datetime`` and ``escrow_created_datetime``.
    """
    found = mst.picked_then_failed(base).where(
        F.col("fulfilment_channel_id").isin(*channels) & (F.col("logistics_status_id") == 2))
    return case_detail(found, audit, ["escrow_paid_datetime", "escrow_created_datetime"])


def pending_parcels(base: DataFrame, state: str, city: str,
                    label_state: str | None = None) -> DataFrame:
    """Parcels pending pickup or delivery in a city, labelled by kind."""
    scoped = dlv.pending_in_area(base, state, city)
    return scoped.select(
        *CASE_SHEET, "shipment_type", "scheduled_pickup_time",
        dlv.pending_kind(label_state or state).alias("check_pending")).distinct()
