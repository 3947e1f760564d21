"""Fee reconciliation: item fees, rates by channel and day, component check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import codes
from ..functions.classify import payment_type_by_id
from ..functions.times import REPORT_SHIFT, from_epoch
from .lookups import hot_keys, skew_join
from .orders import multi_label

ITEM_FEES = {
    "commission_fee": "comm_fee",
    "seller_txn_fee": "seller_transaction_fee_item",
    "service_fee": "service_fee",
    "cogs": "cogs_item",
    "insurance_premium_by_buyer_amt": "insurance_premium_by_buyer_amt",
}


def item_fees(items: DataFrame) -> DataFrame:
    """Fee sums per order."""
    return items.groupBy("order_id").agg(*[F.sum(c).alias(n) for c, n in ITEM_FEES.items()])


def seller_fee(amount, created: Column, channel="payment_be_channel_id") -> Column:
    """Rounded fee: free for some channels, else the rate valid on the day.

    An order without a payment channel has no fee.
    """
    amount, channel = F.col(amount), F.col(channel)
    rate = None
    for since, value in reversed(codes.FEE_RATES):
        days = created.isNotNull() if since is None else created >= F.lit(since).cast("date")
        rate = F.when(days, value) if rate is None else rate.when(days, value)
    return F.when(channel.isin(*codes.FEE_FREE_CHANNELS), F.lit(0.0)).when(
        channel.isNotNull(), F.round(amount * rate, 0))


def components_match() -> Column:
    """'True' when amount less shipping plus all rebates equals the goods value."""
    left = (
        F.col("cod_amount") - F.col("buyer_shipping_fee") + F.col("bank_card_rebate")
        + F.col("seller_voucher_rebate") + F.col("platform_card_rebate")
        + F.col("coin_rebate") + F.col("platform_voucher_rebate")
    )
    return F.when(left - F.col("cogs") == 0, "True").otherwise("False")


def fee_recon(orders: DataFrame, fulfilment: DataFrame, parcel: DataFrame, items: DataFrame,
              accounts: DataFrame, escrow: DataFrame, insurance: DataFrame, refunds: DataFrame,
              multi: DataFrame, groups: DataFrame) -> DataFrame:
    """One row per order and tracking number with fees, rebates and checks.

    Items, parcels and policies are brought to one row per key before they are
    joined, so the wide result needs no grouping of its own.  Total goods value
    is the value times the number of equal rows, which only repeated refund
    rows can cause.
    """
    created = from_epoch("create_timestamp", REPORT_SHIFT)
    head = orders.select(
        "order_id", "order_sn", created.alias("created_date"), "order_be_status",
        "logistics_status", payment_type_by_id().alias("payment_method"), "shipping_carrier", "payment_channel",
        "shop_id", "buyer_id",
        F.col("gmv").alias("cod_amount"),
        F.col("escrow_to_seller_amt").alias("escrow_to_seller"),
        seller_fee("gmv", F.to_date(created)).alias("seller_transaction_fee"),
        (F.col("sv_rebate_by_seller_amt") + F.col("pv_rebate_by_seller_amt")).alias(
            "seller_voucher_rebate"),
        F.col("buyer_paid_shipping_fee").alias("buyer_shipping_fee"),
        F.col("card_rebate_by_bank_amt").alias("bank_card_rebate"),
        F.col("card_rebate_by_platform_amt").alias("platform_card_rebate"),
        F.col("coin_used_cash_amt").alias("coin_rebate"),
        (F.col("sv_rebate_by_platform_amt") + F.col("pv_rebate_by_platform_amt")).alias(
            "platform_voucher_rebate"),
        F.col("estimate_shipping_fee").alias("esf"), F.col("actual_shipping_fee").alias("asf"),
        F.col("actual_shipping_rebate_by_seller_amt").alias("seller_shipping_rebate"),
        F.col("sv_coin_earn_by_seller_amt").alias("coin_earned_shop"),
        F.col("pv_rebate_by_platform_amt").alias("voucher_discount_platform"),
    )
    units = fulfilment.select(
        "log_id", "order_id", F.col("items_sales_value_local").alias("cogs"))
    tracked = parcel.select("log_id", "lm_tracking_no", "consignment_no")
    sellers = accounts.where(F.col("shopid").isNotNull()).select(
        F.col("shopid").alias("shop_id"), F.col("userid").alias("seller_userid"),
        F.col("username").alias("seller_user_name"))
    buyers = accounts.select(
        F.col("userid").alias("buyer_id"), F.col("username").alias("buyer_name"))
    refund_rows = refunds.groupBy("order_id", "refund_id").agg(
        F.count(F.lit(1)).alias("__repeats"))
    # equal shares of one tracked parcel count once
    shares = units.join(tracked, "log_id", "left").drop("log_id").distinct()
    # Left joins all along: an order without parcels keeps a row of its own.
    # One shop may hold a large part of all orders: only such shops are split.  Orders without a parcel, which may be
    # most of them, have no tracking number and are dealt out instead of meeting in one task.
    rows = (
        skew_join(head.join(shares, "order_id", "left"), sellers, {"shop_id": "shop_id"},
                  ["seller_userid", "seller_user_name"], ["order_id"], hot_keys(orders, ["shop_id"]))
        .join(item_fees(items), "order_id", "left")
        .join(buyers, "buyer_id", "left")
        .join(escrow.distinct(), "order_id", "left")
        .join(insurance.distinct(), "order_id", "left")
        .join(refund_rows, "order_id", "left")
        .join(multi, "order_id", "left")
    )
    rows = (
        skew_join(rows, groups, {"lm_tracking_no": "lm_tracking_no"},
                  [c for c in groups.columns if c != "lm_tracking_no"], ["order_id"])
        .withColumn("check_cogs", components_match())
        .withColumn("check_multi_wh", multi_label("nb_parcels"))
        .withColumnRenamed("total_group", "check_group")
    )
    return rows.withColumn(
        "total_cogs", F.col("cogs") * F.coalesce("__repeats", F.lit(1))
    ).drop("nb_parcels", "__repeats")
