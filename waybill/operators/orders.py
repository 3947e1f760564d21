"""Order-level operators: multi-parcel flags, group shipments, dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import codes


def multi_parcel(df: DataFrame, order: str, parcel: str,
                 only: Column | None = None) -> DataFrame:
    """Orders (or any ``order`` key) with more than one distinct parcel id.

    The distinct pairs are built first, keyed by both columns, so that an
    order with very many rows is spread before it is counted.
    """
    if only is not None:
        df = df.where(only)
    pairs = df.select(order, parcel).where(F.col(parcel).isNotNull()).distinct()
    return pairs.groupBy(order).agg(F.count(F.lit(1)).alias("nb_parcels")).where(
        F.col("nb_parcels") > 1)


def group_size(df: DataFrame, key: str, member: str, distinct: bool = False) -> DataFrame:
    """Fulfilment units per order or tracking number."""
    count = F.count_distinct(member) if distinct else F.count(member)
    return df.groupBy(key).agg(count.alias("total_group"))


def group_shipment_by_tracking(parcel: DataFrame, fulfilment: DataFrame,
                               orders: DataFrame) -> DataFrame:
    """Distinct order groups behind one tracking number, domestic forward parcels."""
    forward = parcel.where(
        (F.col("is_reverse") == 0) & (F.col("lm_shipment_company") != "Standard Express")
    ).select("log_id", "lm_tracking_no")
    units = fulfilment.select("log_id", "order_id", "ofg_id")
    domestic = orders.where(F.col("is_cb_shop") == 0).select("order_id")
    joined = forward.join(units, "log_id").join(domestic, "order_id", "left_semi")
    return group_size(joined, "lm_tracking_no", "ofg_id", distinct=True)


def group_label(total) -> Column:
    return F.when(F.col(total) > 1, "Grouped").otherwise("Not grouped")


def multi_label(nb) -> Column:
    return F.when(F.col(nb).isNotNull(), "Multi WH").otherwise("Not Multi WH")


def order_dims(order_items: DataFrame, items: DataFrame) -> DataFrame:
    """Per order: item count, total weight and the largest outer measures.

    Per item the heights of its lines add up; per order the largest of each
    measure counts.
    """
    measure = items.select(
        "item_id", *[F.col(c).try_cast("double").alias(c)
                     for c in ("weight", "dim_width", "dim_length", "dim_height")])
    amount = F.col("item_amount").try_cast("double")
    per_item = (
        measure.join(order_items.select("order_id", "item_id", "item_amount"), "item_id")
        .groupBy("order_id", "item_id").agg(
            F.sum(amount).alias("item_amount"),
            F.sum(F.col("weight") * amount).alias("weight"),
            F.max("dim_width").alias("width"),
            F.max("dim_length").alias("length"),
            F.sum("dim_height").alias("height"),
        )
    )
    return per_item.groupBy("order_id").agg(
        F.sum("item_amount").alias("item_amount"), F.sum("weight").alias("weight"),
        F.max("width").alias("width"), F.max("length").alias("length"),
        F.max("height").alias("height"))


def terminal_times(status_id="logistics_status_id", reason="cancel_reason") -> dict[str, Column]:
    """When an order was delivered, or failed/lost, by its back-end state."""
    return {
        "be_delivered_time": F.when(
            F.col(status_id) == 5, F.timestamp_seconds("complete_timestamp")),
        "be_delivery_failed_lost_time": F.when(
            F.col(reason).isin(*codes.FAILED_OR_LOST), F.timestamp_seconds("cancel_timestamp")),
    }


def terminal_between(df: DataFrame, first: str, last: str) -> DataFrame:
    """Orders delivered, or failed/lost, from ``first`` to ``last``."""
    def inside(column: str) -> Column:
        return F.to_date(F.col(column)).between(
            F.lit(first).cast("date"), F.lit(last).cast("date"))

    return df.where(inside("be_delivered_time") | inside("be_delivery_failed_lost_time"))
