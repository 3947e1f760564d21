"""Service levels: routes, days allowed, add-ons and holidays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import codes
from ..functions.times import day, round_half_up
from ..sources.scans import latest_version
from .lookups import ci_lookup, role_lookup

ROUTE_KEYS = {
    "seller_state": "start_state", "seller_city": "start_city",
    "buyer_state": "end_state", "buyer_city": "end_city",
}
DISTRICT_KEYS = {"buyer_state": "state", "buyer_city": "city", "buyer_district": "district"}


def number(text) -> Column:
    """Reference tables hold numbers as text; missing or unreadable is 0."""
    return F.coalesce(F.expr(f"try_cast({text} AS double)"), F.lit(0.0))


def unreadable(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows of a reference table whose numeric text cannot be read."""
    bad = F.lit(False)
    for c in columns:
        bad = bad | (F.col(c).isNotNull() & F.expr(f"try_cast({c} AS double)").isNull())
    return df.where(bad)


def route_lookup(df: DataFrame, routes: DataFrame) -> DataFrame:
    """Adds ``route`` from the newest route table by start and end city."""
    return ci_lookup(df, latest_version(routes), ROUTE_KEYS, ["route"])


def sla_days(df: DataFrame, sla: DataFrame, extend: DataFrame, channel: str,
             intra_city_bonus: float = 0.0) -> DataFrame:
    """Adds ``sla``: carrier's route level plus the buyer district's add-on.

    Missing levels and add-ons count as 0, other channels get 0 days.  With
    ``intra_city_bonus`` the express carrier has that much longer within a
    city (needs ``route``).  Also adds ``delivery_area``.
    """
    df = ci_lookup(df, latest_version(sla), ROUTE_KEYS, ["sla_vnp_ex", "sla_vnp_eco"])
    df = ci_lookup(df, latest_version(extend), DISTRICT_KEYS,
                   ["extend_sla___addon", "delivery_area"])
    addon = number("extend_sla___addon")
    express, economy = number("sla_vnp_ex") + addon, number("sla_vnp_eco") + addon
    rule = F.when(F.lit(False), F.lit(0.0))
    if intra_city_bonus:
        rule = rule.when(
            (F.col(channel) == codes.EXPRESS_CHANNEL) & (F.col("route") == "Intra City"),
            express + intra_city_bonus)
    rule = (
        rule.when(F.col(channel) == codes.EXPRESS_CHANNEL, express)
        .when(F.col(channel) == codes.ECONOMY_CHANNEL, economy).otherwise(F.lit(0.0))
    )
    return df.withColumn("sla", rule).drop("sla_vnp_ex", "sla_vnp_eco", "extend_sla___addon")


def cutoff_tier(pickup) -> Column:
    """1 up to 12:00:00, 2 up to 18:00:00, 3 later; NULL without a pickup."""
    pickup = F.col(pickup)
    second = F.hour(pickup) * 3600 + F.minute(pickup) * 60 + F.second(pickup)
    fraction = F.date_trunc("second", pickup) != pickup
    noon = (second < 12 * 3600) | ((second == 12 * 3600) & ~fraction)
    evening = (second < 18 * 3600) | ((second == 18 * 3600) & ~fraction)
    return F.when(noon, 1).when(evening, 2).when(pickup.isNotNull(), 3)


def sla_days_multi(df: DataFrame, sla: DataFrame, sla_two: DataFrame, extend: DataFrame,
                   extend_area: DataFrame, pickup: str = "pickup_done_time",
                   client: str = "client_channel_id",
                   order: str = "fulfilment_channel_id") -> DataFrame:
    """Adds ``total_sla`` for all carriers; NULL for carriers without a rule."""
    level_columns = ["spx", "ghn", "njv", "best", "jnt", "ghtk_1", "ghtk_2", "ghtk_3"]
    df = ci_lookup(df, latest_version(sla), ROUTE_KEYS, level_columns)
    two = ["sla_vnp_ex", "sla_vnp_eco", "sla_vtp_urban", "sla_vtp_rural"]
    df = ci_lookup(df, latest_version(sla_two), ROUTE_KEYS, two)
    df = ci_lookup(df, latest_version(extend), DISTRICT_KEYS, {"extend_sla___addon": "addon"})
    df = ci_lookup(df, latest_version(extend_area), DISTRICT_KEYS,
                   {"delivery_area": "area", "extend_sla___addon": "area_addon"})
    channel = {"client": F.col(client), "order": F.col(order)}
    rule = F.when(F.lit(False), F.lit(0.0))
    for side, channel_id, column, with_addon in codes.SLA_COLUMNS:
        days = number(column) + number("addon") if with_addon else number(column)
        rule = rule.when(channel[side] == channel_id, days)
    by_area = channel["client"] == codes.SLA_AREA_CHANNEL
    rule = (
        rule.when(by_area & (F.col("area") == codes.AREA_URBAN), number("sla_vtp_urban"))
        .when(by_area & (F.col("area") == codes.AREA_RURAL), number("sla_vtp_rural"))
        .when(by_area & (F.col("area") == codes.AREA_HARD),
              number("sla_vtp_urban") + number("area_addon"))
    )
    tier = cutoff_tier(pickup)
    for n in (1, 2, 3):
        rule = rule.when(
            (channel["client"] == codes.SLA_CUTOFF_CHANNEL) & (tier == n), number(f"ghtk_{n}"))
    return df.withColumn("total_sla", rule).drop(
        *level_columns, *two, "addon", "area", "area_addon")


def sla_region(df: DataFrame, regions: DataFrame, route: DataFrame) -> DataFrame:
    """Adds seller and buyer region, ``ship_from``, ``ship_to`` and ``sla`` (text)."""
    regions, route = latest_version(regions), latest_version(route)
    df = role_lookup(df, regions, "state", "region",
                     {"seller_state": "seller_region", "buyer_state": "buyer_region"})
    side = route.select("ship_from", "ship_to", "sla").distinct()
    return df.join(side, (F.col("seller_region") == F.col("ship_from"))
                   & (F.col("buyer_region") == F.col("ship_to")), "left")


def region_route(df: DataFrame, regions: DataFrame, route: DataFrame) -> DataFrame:
    """Adds ``route`` by seller and buyer region from unversioned tables.

    All rows of both tables count, so several uploads of a state repeat a
    parcel unless they agree; callers that want the newest one filter first.
    """
    df = role_lookup(df, regions, "state", "region",
                     {"seller_state": "__from", "buyer_state": "__to"})
    return ci_lookup(df, route, {"__from": "ship_from", "__to": "ship_to"}, ["route"]).drop(
        "__from", "__to")


def _address(state: str, city: str, district: str | None = None) -> Column:
    parts = [F.col(state), F.lit("-"), F.col(city)]
    if district:
        parts += [F.lit("-"), F.col(district)]
    return F.lower(F.concat(*parts))


def sla_express(df: DataFrame, areas: DataFrame, route: DataFrame,
                rural: DataFrame) -> DataFrame:
    """Adds the express level: route + 1 day + seller pickup add-on + the
    buyer's add-on for same-state or other-state parcels."""
    df = ci_lookup(df, latest_version(areas), {"buyer_state": "state"}, {"area": "buyer_area"})
    side = latest_version(route).select("ship_from", "ship_to", F.col("sla").alias("route_sla"))
    df = df.join(side.distinct(), (F.lower(F.col("seller_state")) == F.col("ship_from"))
                 & (F.col("buyer_area") == F.col("ship_to")), "left")
    rural = latest_version(rural)
    df = df.withColumn("concat_seller_address",
                       _address("seller_state", "seller_city", "seller_district"))
    df = df.withColumn("concat_buyer_address",
                       _address("buyer_state", "buyer_city", "buyer_district"))
    df = ci_lookup(df, rural, {"concat_seller_address": "address"}, {"pickup": "pickup_addon"})
    df = ci_lookup(df, rural, {"concat_buyer_address": "address"},
                   {"intra": "intra_addon", "inter": "inter_addon"})
    same = F.col("seller_state") == F.col("buyer_state")
    return df.withColumns({
        "sla": number("route_sla") + 1,
        "pickup": number("pickup_addon"),
        "intra": number("intra_addon"),
        "inter": number("inter_addon"),
        # hours until the level ends; NULL as soon as one part is unknown
        "window_hours": F.lit(24)
        + round_half_up(F.expr("try_cast(route_sla AS double)") * 24)
        + round_half_up(F.expr("try_cast(pickup_addon AS double)") * 24)
        + round_half_up(F.when(same, F.expr("try_cast(intra_addon AS double)")).otherwise(
            F.expr("try_cast(inter_addon AS double)")) * 24),
    }).withColumn(
        "total_sla",
        F.col("sla") + F.col("pickup") + F.when(same, F.col("intra")).otherwise(F.col("inter")),
    ).drop("route_sla", "pickup_addon", "intra_addon", "inter_addon", "buyer_area")


def remote_addon(df: DataFrame, remote: DataFrame) -> DataFrame:
    """Adds ``added_leadtime``: whole extra days of remote buyer cities, else 0."""
    df = df.withColumn("__city", _address("buyer_state", "buyer_city"))
    df = ci_lookup(df, latest_version(remote), {"__city": "buyer_address"},
                   {"added_leadtime": "__added"})
    return df.withColumn(
        "added_leadtime", F.coalesce(F.expr("try_cast(__added AS int)"), F.lit(0))
    ).drop("__city", "__added")


# --- holidays ----------------------------------------------------------------

def _holiday_lists(cal: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """Carrier -> its holidays of the newest calendar, one list per kind.

    A carrier's list is bounded by the days of the calendar: repeated uploads
    of a (day, length) pair are collapsed before the lists are made.
    """
    days = (
        latest_version(cal).where(F.col("type").isin(*kinds))
        .select(F.lower("shipping_carrier").alias("__carrier"), "type",
                F.col("holiday_start").try_cast("date").alias("first"),
                F.col("nb_holiday").try_cast("int").alias("nb"))
        .distinct()
    )
    return days.groupBy("__carrier").agg(*[
        F.collect_list(F.when(F.col("type") == k, F.struct("first", "nb"))).alias(f"__days_{k}")
        for k in kinds])


def holidays_in_windows(df: DataFrame, cal: DataFrame, carrier: str,
                        windows: dict[str, tuple[str, Column, Column]],
                        mode: str = "rows") -> DataFrame:
    """Adds, per window, the length of the holidays that begin in it.

    ``windows`` maps output -> (kind, start, last day or instant).  The calendar
    is joined once, as short lists per carrier, and searched per row, so facts
    are neither shuffled nor multiplied by the range conditions.
    ``mode='rows'`` repeats a row per different length found (several holidays
    in one window), ``mode='sum'`` adds the lengths up and keeps one row.
    No holiday gives 0.
    """
    kinds = list(dict.fromkeys(kind for kind, _, _ in windows.values()))
    out = df.join(_holiday_lists(cal, kinds),
                  F.lower(F.col(carrier)) == F.col("__carrier"), "left")

    def lengths(kind: str, start: Column, last: Column) -> Column:
        hits = F.filter(f"__days_{kind}", lambda d: d["first"].between(day(start), last))
        return F.transform(hits, lambda d: F.coalesce(d["nb"], F.lit(0)))

    if mode == "sum":
        total = {n: F.aggregate(lengths(*w), F.lit(0), lambda a, b: a + b)
                 for n, w in windows.items()}
        out = out.withColumns({n: F.coalesce(c, F.lit(0)).cast("double")
                               for n, c in total.items()})
    else:
        for name, window in windows.items():
            found = F.array_distinct(lengths(*window))
            # an empty list still gives one row, without a length
            out = out.withColumn(name, F.explode_outer(found))
        out = out.withColumns({n: F.coalesce(F.col(n), F.lit(0)).cast("double")
                               for n in windows})
    return out.drop("__carrier", *[f"__days_{k}" for k in kinds])


def holiday_days(df: DataFrame, cal: DataFrame, carrier: str, start, end,
                 kind: str = "delivery", output: str = "d_holidays",
                 mode: str = "rows") -> DataFrame:
    """One window of :func:`holidays_in_windows`."""
    return holidays_in_windows(df, cal, carrier, {output: (kind, start, end)}, mode)
