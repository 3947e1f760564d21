"""Shapes of the marts: short address names and common projections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

ADDRESS = ("seller_state", "seller_city", "seller_district",
           "buyer_state", "buyer_city", "buyer_district")


def short_addresses(orders: DataFrame) -> DataFrame:
    """``seller_shipping_address_state`` … -> ``seller_state`` …"""
    return orders.withColumnsRenamed({
        f"{side}_shipping_address_{part}": f"{side}_{part}"
        for side in ("seller", "buyer") for part in ("state", "city", "district")})


def single_order_sn(parcel: DataFrame, separator: str = ", ") -> DataFrame:
    """Adds the order number text a parcel is matched by (all its orders,
    joined), computed once per parcel."""
    return parcel.withColumn("order_sn", F.array_join("ordersn_list", separator))


def unique_names(columns: Sequence[str]) -> list[str]:
    """Output names made unique: a repeated name gets ``_2``, ``_3`` …"""
    seen: dict[str, int] = {}
    out = []
    for name in columns:
        seen[name] = seen.get(name, 0) + 1
        out.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    return out
