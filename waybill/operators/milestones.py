"""Milestones: first or last time of named event sets per parcel, in one scan."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import codes
from ..functions.times import REPORT_SHIFT, event_epoch, from_epoch

KEY = "log_id"


@dataclass(frozen=True)
class Milestone:
    """Events that make up a milestone.

    ``clock`` is 'reconciled' (earlier of event and create time) or 'actual';
    ``pick`` is 'first' or 'last'.
    """

    codes: Sequence
    clock: str = "reconciled"
    pick: str = "first"
    column: str = "tracking_code"


# Milestone sets of the report families.
DELIVERY = {
    "pku_done_time": Milestone(codes.PICKUP_DONE),
    "deli_done_time": Milestone(codes.DELIVERED),
    "deli_failed_time": Milestone(codes.RETURNED),
    "deli_1st_time": Milestone(codes.DELIVERY_FIRST_WIDE),
    "dli_pending_tracking_time": Milestone(codes.DELIVERY_PENDING, clock="actual"),
}
PICKUP = {
    "pku_done_time": Milestone(codes.PICKUP_DONE),
    "pku_1st_time": Milestone(codes.PICKUP_FIRST),
    "pku_failed_time": Milestone(codes.PICKUP_FAILED),
}
ALL_GAPS = {**DELIVERY, **PICKUP}
CASE = {
    "pku_done_time": Milestone(codes.PICKUP_DONE),
    "deli_done_time": Milestone(codes.DELIVERED),
    "deli_1st_time": Milestone(codes.DELIVERY_FIRST_WIDE),
    "return_initiated_time": Milestone(codes.RETURN_STARTED),
    "deli_failed_time": Milestone(codes.RETURNED),
}
ANOMALY = {
    **CASE,
    "pickup_failed_time2": Milestone(codes.RESOURCE_PICKUP_FAILED, column="resource_status"),
    "pickup_done_time2": Milestone(codes.RESOURCE_PICKUP_DONE, column="resource_status"),
}
BACKLOG = {
    "sls_received_time": Milestone(codes.RECEIVED, "actual"),
    "pku_done_tracking_time": Milestone(codes.PICKUP_DONE_WIDE, "actual"),
    "dli_done_tracking_time": Milestone(codes.DELIVERED, "actual"),
    "dli_pending_tracking_time": Milestone(codes.DELIVERY_PENDING, "actual"),
    "dli_delivering_tracking_time": Milestone(codes.DELIVERING, "actual"),
    "return_ini_tracking_time": Milestone(codes.RETURN_STARTED_WIDE, "actual"),
    "return_done_tracking_time": Milestone(codes.RETURNED_WIDE, "actual"),
    "return_pending_tracking_time": Milestone(codes.RETURN_PENDING, "actual"),
}
EXPRESS_PENALTY = {
    "sls_received_time": Milestone(codes.RECEIVED, "actual"),
    "sls_first_pickup_attempt": Milestone(codes.PICKUP_FIRST_EXPRESS, "actual"),
    "sls_pickup_done": Milestone(codes.PICKUP_DONE_EXPRESS, "actual"),
    "sls_first_delivery_pending": Milestone(codes.DELIVERY_PENDING, "actual"),
    "sls_first_delivery_attempt": Milestone(codes.DELIVERY_FIRST, "actual"),
    "sls_delivery_done": Milestone(codes.DELIVERED, "actual"),
    "sls_return_time": Milestone(codes.RETURN_STARTED_WIDE, "actual"),
    "sls_del_failed": Milestone(codes.RETURNED_WIDE, "actual"),
    "sls_return_pending": Milestone(codes.RETURN_PENDING, "actual"),
    "sls_first_return_attempt": Milestone(codes.RETURN_FIRST, "actual"),
}
LEGACY = {
    "sls_received_time": Milestone(codes.LEGACY_RECEIVED, "actual", column="status"),
    "sls_first_pickup_attempt": Milestone(codes.LEGACY_PICKUP_FIRST, "actual", column="status"),
    "sls_pickup_done": Milestone(codes.LEGACY_PICKUP_DONE, "actual", column="status"),
    "sls_delivery_done": Milestone(codes.LEGACY_DELIVERED, "actual", column="status"),
    "sls_return_time": Milestone(codes.LEGACY_RETURN, "actual", column="status"),
    "sls_del_failed": Milestone(codes.LEGACY_FAILED, "actual", "last", "status"),
    "sls_del_pending_sub": Milestone(codes.LEGACY_PENDING, "actual", "last", "status"),
}


def milestones(tracking: DataFrame, spec: Mapping[str, Milestone], key: str = KEY,
               actual: str = "actual_time", ctime: str = "ctime",
               shift: int = REPORT_SHIFT, listed_only: bool = False) -> DataFrame:
    """One row per parcel with every milestone of ``spec`` as a timestamp.

    All milestones come from a single conditional aggregate, so the event log
    is scanned and shuffled once, whatever their number.  The aggregate runs on
    epoch seconds (fixed-width buffers, combined per task before the shuffle,
    which also flattens hot parcels); timestamps are made afterwards.

    Parcels without a listed event keep a row of NULLs.  When the caller drops
    those, or outer-joins the result to parcels, ``listed_only`` gives the same
    rows and pushes the code filter into the scan of the log.
    """
    if listed_only:
        wanted: dict[str, list] = {}
        for m in spec.values():
            wanted.setdefault(m.column, []).extend(m.codes)
        keep = None
        for column, values in wanted.items():
            term = F.col(column).isin(*dict.fromkeys(values))
            keep = term if keep is None else keep | term
        tracking = tracking.where(keep)
    clocks = {"actual": event_epoch(actual)}
    if any(m.clock == "reconciled" for m in spec.values()):
        clocks["reconciled"] = event_epoch(actual, ctime)

    def pick(m: Milestone) -> Column:
        seconds = F.when(F.col(m.column).isin(*m.codes), clocks[m.clock])
        return F.min(seconds) if m.pick == "first" else F.max(seconds)

    picked = tracking.groupBy(key).agg(*[pick(m).alias(n) for n, m in spec.items()])
    return picked.select(key, *[from_epoch(n, shift).alias(n) for n in spec])


def first_time(tracking: DataFrame, event_codes: Iterable, key: str = KEY,
               output: str = "tracking_time", actual: str = "actual_time",
               ctime: str | None = None, column: str = "tracking_code",
               shift: int = REPORT_SHIFT) -> DataFrame:
    """First time of one event set; parcels without such an event are absent."""
    return (
        tracking.where(F.col(column).isin(*event_codes))
        .groupBy(key).agg(F.min(event_epoch(actual, ctime)).alias(output))
        .select(key, from_epoch(output, shift).alias(output))
    )


def bounded_pending(ms: DataFrame) -> DataFrame:
    """Adds first delivery pending/attempt and return pending/attempt.

    The single pending time of a parcel counts for delivery when it lies
    between pickup and return (or delivery), and for return strictly between
    return start and failure.  The attempts fall back to delivery done and
    failure, but only for parcels that have the pending time.  Everything is a
    property of the one milestone row, so no join is needed.
    """
    pending = F.col("sls_del_pending_sub")
    as_delivery = pending.between(
        F.col("sls_pickup_done"), F.coalesce("sls_return_time", "sls_delivery_done"))
    as_return = (pending > F.col("sls_return_time")) & (pending < F.col("sls_del_failed"))
    return (
        ms.withColumn("sls_first_delivery_pending", F.when(as_delivery, pending))
        .withColumn("sls_first_delivery_attempt", F.col("sls_first_delivery_pending"))
        .withColumn("sls_return_pending", F.when(as_return, pending))
        .withColumn("sls_first_return_attempt", F.col("sls_return_pending"))
    )


def hub_arrival(tracking: DataFrame, key: str = KEY, start: int = 20,
                event_codes: Iterable = codes.HUB_INBOUND) -> DataFrame:
    """First inbound scan per parcel and hub; the hub name ends the description."""
    return (
        tracking.where(F.col("tracking_code").isin(*event_codes))
        .groupBy(key, F.expr(f"substring(description, {start})").alias("lm_hub"))
        .agg(F.min("actual_time").alias("lm_hub_ib_time"))
        .select(key, "lm_hub", from_epoch("lm_hub_ib_time", REPORT_SHIFT).alias("lm_hub_ib_time"))
    )


# --- order audit -------------------------------------------------------------

def audit_first(audit: DataFrame, since: dt.date | None = None, shift: int = 0) -> DataFrame:
    """First time an order entered each status."""
    if since is not None:
        audit = audit.where(from_epoch("ctime", REPORT_SHIFT).cast("date") >= F.lit(since))
    return (
        audit.groupBy("orderid", F.col("new_status").alias("status"))
        .agg(F.min("ctime").alias("min_ctime"))
        .select("orderid", "status", from_epoch("min_ctime", shift).alias("min_ctime"))
    )


def audit_last(audit: DataFrame, output: str = "lost_update_time") -> DataFrame:
    """Last status change of an order."""
    return (
        audit.groupBy("orderid").agg(F.max("ctime").alias(output))
        .select("orderid", from_epoch(output, REPORT_SHIFT).alias(output))
    )


def audit_wide(audit: DataFrame, statuses: Mapping[str, int], since: dt.date | None = None,
               shift: int = 0) -> DataFrame:
    """First time of several statuses side by side: one aggregate instead of
    one self-join per status."""
    audit = audit.where(F.col("new_status").isin(*statuses.values()))
    if since is not None:
        audit = audit.where(from_epoch("ctime", REPORT_SHIFT).cast("date") >= F.lit(since))
    wide = audit.groupBy("orderid").agg(*[
        F.min(F.when(F.col("new_status") == s, F.col("ctime"))).alias(n)
        for n, s in statuses.items()])
    return wide.select("orderid", *[from_epoch(n, shift).alias(n) for n in statuses])


def resolve_milestones(ms: DataFrame, parcel: DataFrame, fulfilment: DataFrame,
                       audit: DataFrame, since: dt.date | None = None) -> DataFrame:
    """Best known milestones: tracking first, then audit, then parcel snapshot.

    Parcels handled by an own warehouse use its inbound time.  ``parcel`` is a
    snapshot; its earliest times per parcel and fulfilment row are used.
    """
    first_attempt = F.coalesce(
        "lm_first_attempt_delivery_timestamp", "lm_delivered_timestamp",
        "lm_first_failed_delivery_attempt_timestamp", "lm_delivery_failed_timestamp",
        "return_initiated_timestamp")
    returned = F.coalesce(
        "return_initiated_timestamp", "return_pending_timestamp", "return_completed_timestamp")
    snap = parcel.groupBy(
        "log_id", "lm_tracking_no", "inbound_type", "whs_id", "lm_shipment_provider",
        "seller_address_state", "fulfillment_channel_id",
    ).agg(
        F.min("scheduled_pickup_timestamp").alias("scheduled"),
        F.min("lm_inbound_timestamp").alias("inbound"),
        F.min("lm_delivered_timestamp").alias("delivered"),
        F.min(first_attempt).alias("attempted"),
        F.min(returned).alias("returned"),
    )
    orders_of = fulfilment.groupBy("log_id", "order_id", "oms_forder_id").agg(
        F.min("order_arrange_shipping_timestamp").alias("arranged"))
    status = audit_wide(audit, {
        "a_picked": codes.AUDIT_PICKUP_DONE,
        "a_delivered": codes.AUDIT_DELIVERED,
        "a_failed": codes.AUDIT_DELIVERY_FAILED,
    }, since)
    inbound = from_epoch("inbound", REPORT_SHIFT)
    own_warehouse = F.col("whs_id").isin(*codes.WAREHOUSES_NORTH, *codes.WAREHOUSES_SOUTH)
    joined = (
        ms.join(snap, "log_id")
        .join(orders_of, "log_id", "left")
        .join(status.withColumnRenamed("orderid", "order_id"), "order_id", "left")
    )
    return joined.select(
        "log_id", "order_id", "oms_forder_id", "lm_tracking_no", "lm_shipment_provider",
        "fulfillment_channel_id",
        F.when(F.col("inbound_type") == 2, 1).otherwise(0).alias("is_drop_off"),
        "whs_id", "seller_address_state",
        from_epoch("arranged", REPORT_SHIFT).alias("schedule_time"),
        from_epoch("scheduled").alias("scheduled_pickup_time"),
        F.when(own_warehouse, inbound).otherwise(
            F.coalesce("pku_done_tracking_time", "a_picked", inbound)).alias("pickup_done_time"),
        F.coalesce("dli_done_tracking_time", from_epoch("delivered", REPORT_SHIFT),
                   "a_delivered").alias("delivery_done_time"),
        F.coalesce("dli_delivering_tracking_time", "dli_pending_tracking_time",
                   "dli_done_tracking_time", "return_ini_tracking_time",
                   "return_pending_tracking_time", "return_done_tracking_time",
                   from_epoch("attempted", REPORT_SHIFT), "a_delivered",
                   "a_failed").alias("first_attempt_delivery_time"),
        F.coalesce("return_ini_tracking_time", "return_pending_tracking_time",
                   "return_done_tracking_time",
                   from_epoch("returned", REPORT_SHIFT)).alias("failed_delivery_time"),
        "dli_pending_tracking_time",
    )


def picked_then_failed(ms: DataFrame) -> DataFrame:
    """Parcels whose pickup failure is later than their pickup."""
    return ms.where(F.col("pickup_failed_time2") > F.col("pickup_done_time2"))
