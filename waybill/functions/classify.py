"""Row classifiers as Column expressions: states, carriers, payment, buckets."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, functions as F

from . import codes
from .times import _c, day, is_set, is_unset


def decode(code, mapping: Mapping, default: str | None = None) -> Column:
    """Label of a code; ``default`` (or NULL) when the mapping has none.

    The mapping is one literal map looked up per row: no join, and a plan that
    stays small however many labels there are.
    """
    entries = [F.lit(part) for pair in mapping.items() for part in pair]
    label = F.try_element_at(F.create_map(*entries), _c(code).cast("int"))
    return label if default is None else F.coalesce(label, F.lit(default))


def invert(groups: Mapping[str, Iterable]) -> dict:
    """{label: codes} -> {code: label}."""
    return {code: label for label, members in groups.items() for code in members}


def order_state(status_id) -> Column:
    return decode(status_id, codes.ORDER_STATES)


def parcel_state(status_code) -> Column:
    return decode(status_code, invert(codes.PARCEL_STATES), codes.PARCEL_STATE_UNKNOWN)


def _by_method(channel: Column, method: Column, table: Mapping) -> Column:
    keyed = {f"{c}/{m}": label for (c, m), label in table.items()}
    entries = [F.lit(part) for pair in keyed.items() for part in pair]
    key = F.concat(channel.cast("string"), F.lit("/"), method.cast("string"))
    return F.try_element_at(F.create_map(*entries), key)


def carrier_label(channel="fulfilment_channel_id", method="shipping_method_id",
                  carrier="fulfilment_shipping_carrier", provider=None) -> Column:
    """Carrier name from channel, then channel and method, then provider.

    ``provider`` switches the cross-border names on; without any match the
    order's own carrier text is kept.
    """
    channel, method, carrier = _c(channel), _c(method), _c(carrier)
    named = F.coalesce(
        decode(channel, codes.CARRIER_BY_CHANNEL),
        _by_method(channel, method, codes.CARRIER_BY_METHOD),
    )
    if provider is None:
        return F.coalesce(named, carrier)
    provider = _c(provider)
    cross_border = carrier.like(codes.CROSS_BORDER_CARRIER_LIKE)
    return (
        F.when(named.isNotNull(), named)
        .when(cross_border & provider.like(codes.CROSS_BORDER_SPX_LIKE),
              codes.CROSS_BORDER_SPX_LABEL)
        .when(cross_border & F.upper(provider).rlike(codes.CROSS_BORDER_JNT_PATTERN),
              codes.CROSS_BORDER_JNT_LABEL)
        .otherwise(carrier)
    )


def area_carrier_label(channel="fulfilment_channel_id", method="shipping_method_id") -> Column:
    channel, method = _c(channel), _c(method)
    return F.coalesce(
        decode(channel, codes.AREA_CARRIER_BY_CHANNEL),
        _by_method(channel, method, codes.AREA_CARRIER_BY_METHOD),
        F.lit(codes.PARCEL_STATE_UNKNOWN),
    )


def tpl_name(is_cb="is_cb_shop", provider="lm_shipment_provider",
             carrier="fulfilment_shipping_carrier") -> Column:
    cb, provider = _c(is_cb) == 1, _c(provider)
    return (
        F.when(cb & provider.isin(*codes.PROVIDERS_JNT), codes.TPL_NAME_JNT)
        .when(cb & provider.isin(*codes.PROVIDERS_SPX), codes.TPL_NAME_SPX)
        .otherwise(_c(carrier))
    )


def tpl_call(is_cb="is_cb_shop", provider="lm_shipment_provider",
             carrier="fulfilment_shipping_carrier", channel="fulfilment_channel_id") -> Column:
    cb, provider = _c(is_cb) == 1, _c(provider)
    return (
        F.when(cb & provider.isin(*codes.PROVIDERS_JNT), codes.TPL_CALL_JNT)
        .when(cb & provider.isin(*codes.PROVIDERS_SPX), codes.TPL_CALL_SPX)
        .otherwise(F.coalesce(decode(channel, codes.TPL_CALL_CHANNEL), _c(carrier)))
    )


def two_carrier_label(channel) -> Column:
    return decode(channel, {
        codes.EXPRESS_CHANNEL: codes.EXPRESS_CARRIER,
        codes.ECONOMY_CHANNEL: codes.ECONOMY_CARRIER,
    })


# --- origin ------------------------------------------------------------------

def origin_address(level: str, seller, warehouse, is_multi, is_cb="is_cb_shop",
                   provider="lm_shipment_provider", whs="whs_id") -> Column:
    """Where a parcel really starts; ``level`` is 'state' or 'city'.

    Cross-border providers start at a fixed hub, multi-parcel orders at their
    warehouse, parcels with a warehouse code in that warehouse's city, all
    others at the seller.
    """
    at = {"state": 0, "city": 1}[level]
    north, south = codes.HUB_NORTH[at], codes.HUB_SOUTH[at]
    cb, provider, whs = _c(is_cb) == 1, _c(provider), _c(whs)
    return (
        F.when(cb & provider.isin(*codes.PROVIDERS_NORTH), north)
        .when(cb & provider.isin(*codes.PROVIDERS_SOUTH), south)
        .when(_c(is_multi), _c(warehouse))
        .when(whs.isin(*codes.WAREHOUSES_NORTH), north)
        .when(whs.isin(*codes.WAREHOUSES_SOUTH), south)
        .otherwise(_c(seller))
    )


def warehouse_state(seller, whs="whs_id") -> Column:
    whs = _c(whs)
    return (
        F.when(whs.isin(*codes.WAREHOUSES_NORTH), codes.HUB_NORTH[0])
        .when(whs.isin(*codes.WAREHOUSES_SOUTH), codes.HUB_SOUTH[0])
        .otherwise(_c(seller))
    )


# --- small classifiers -------------------------------------------------------

def payment_type(method="payment_method") -> Column:
    return F.when(_c(method) == "PAY_COD", "COD").otherwise("CC")


def payment_type_by_id(method_id="payment_method_id") -> Column:
    return F.when(_c(method_id) == 6, "COD").otherwise("CC")


def seller_tier(preferred="is_preferred_shop", plus="is_preferred_plus_shop",
                official="is_official_shop") -> Column:
    return (
        F.when(_c(preferred) == 1, "preferred_shop")
        .when(_c(plus) == 1, "preferred_plus_shop")
        .when(_c(official) == 1, "shop Mall")
        .otherwise("no")
    )


def shipment_type(pickup_epoch, arranged_epoch, shift: int = -3600) -> Column:
    """'pickup' when a pickup time was set, 'drop-off' when only arranged."""
    return F.when(is_set(pickup_epoch, shift), "pickup").when(
        is_unset(pickup_epoch, shift) & is_set(arranged_epoch, shift), "drop-off"
    )


def shipment_type_inbound(inbound_type="inbound_type") -> Column:
    return decode(inbound_type, {1: "pickup", 2: "dropoff"})


def is_dropoff(pickup_epoch, shift: int = -3600) -> Column:
    """1 unless a pickup time was set (missing counts as drop-off)."""
    return F.when(is_set(pickup_epoch, shift), 0).otherwise(1)


def bucket(value, edges: Sequence[float], labels: Sequence[str], over: str,
           missing: str = "no") -> Column:
    """First label whose upper edge (inclusive) holds the value."""
    value = _c(value)
    chain = F.when(value <= edges[0], labels[0])
    for edge, label in zip(edges[1:], labels[1:]):
        chain = chain.when(value <= edge, label)
    return chain.when(value > edges[-1], over).otherwise(missing)


def value_bucket(gmv) -> Column:
    return bucket(gmv, [100000, 200000], ["<100k", "100-200k"], ">200k")


def weight_bucket(grams) -> Column:
    return bucket(grams, [1000, 2000, 3000, 4000, 5000],
                  ["<1kg", "1-2kg", "2-3kg", "3-4kg", "4-5kg"], ">5kg")


def campaign_bucket(date, windows, outside: str | None = None) -> Column:
    """Label of the campaign window a date falls into."""
    date, chain = day(date), None
    for first, last, label in windows:
        inside = date.between(F.lit(first).cast("date"), F.lit(last).cast("date"))
        chain = F.when(inside, label) if chain is None else chain.when(inside, label)
    return chain if outside is None else chain.otherwise(outside)


def in_campaign(date, windows) -> Column:
    return campaign_bucket(date, windows).isNotNull()
