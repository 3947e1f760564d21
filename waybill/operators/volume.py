"""Order volumes by month, category and carrier."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.times import REPORT_SHIFT, epoch_between, from_epoch, month_label


def volume_mix(orders: DataFrame, items: DataFrame, first: str, last: str) -> DataFrame:
    """Distinct orders per month and item category, item rows by payment type.

    Items are first counted per order and category, so the join carries one
    row per pair and no distinct set per group is needed.
    """
    created = from_epoch("create_timestamp", REPORT_SHIFT)
    head = orders.where(epoch_between("create_timestamp", first, last, REPORT_SHIFT)).select(
        "order_id", "order_sn", "payment_method", created.alias("created")).where(
        F.to_date("created").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    per_order = items.groupBy("order_id", "global_be_category").agg(
        F.count(F.lit(1)).alias("lines"))
    joined = head.join(per_order, "order_id", "left").withColumn(
        "lines", F.coalesce("lines", F.lit(1)))
    cod = F.col("payment_method") == "PAY_COD"
    return joined.groupBy(
        month_label("created").alias("month_"), F.col("global_be_category").alias("g_cate"),
    ).agg(
        F.count_distinct("order_sn").alias("nb_order"),
        F.sum(F.when(cod, F.col("lines")).otherwise(0)).alias("cod_order"),
        F.sum(F.when(~cod, F.col("lines")).otherwise(0)).alias("cc_order"))


def pickup_volume(orders: DataFrame, parcel: DataFrame, first: str, last: str,
                  carriers=None) -> DataFrame:
    """Distinct orders per scheduled pickup month and carrier, with the first day of the month."""
    scheduled = F.to_date(from_epoch("scheduled_pickup_timestamp", REPORT_SHIFT))
    when = parcel.where(epoch_between("scheduled_pickup_timestamp", first, last, REPORT_SHIFT)).select(
        "order_id", scheduled.alias("scheduled")).where(
        F.col("scheduled").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    head = orders.select("order_id", "order_sn", "fulfilment_shipping_carrier")
    if carriers is not None:
        head = head.where(F.col("fulfilment_shipping_carrier").isin(*carriers))
    return when.join(head, "order_id").groupBy(
        F.trunc("scheduled", "month").alias("month_start"), F.month("scheduled").alias("month"),
        "fulfilment_shipping_carrier",
    ).agg(F.count_distinct("order_sn").alias("nb_order"))
