"""Pickup performance: schedules, on-time rules, penalties, scorecards.

The row rules are Columns over the wide order table (``orderdate``,
``firstupdatedpickeduptime``, ``endpicktime`` …).  All roll-ups start from
:func:`daily_base`, one aggregate per day and area; weeks, months, totals,
shares and Sunday slices are derived from that small table, so the order table
is scanned and shuffled once however many views a report shows.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import codes
from ..functions.classify import shipment_type, shipment_type_inbound
from ..functions.times import (
    day, elapsed, from_epoch, is_set, is_unset, iso_dow, period_number, period_start,
)
from .bitmaps import CELL, daily_bitmaps, distinct_counts
from .delivery import percentile

CUTOFF_HOUR = 18


# --- parcel pickup schedule (delivery marts) ---------------------------------

def pickup_schedule(df: DataFrame, request="pickup_time",
                    scheduled="scheduled_pickup_timestamp",
                    arranged="order_arrange_shipping_timestamp") -> DataFrame:
    """Resolved schedule and request/on-time/done/failed flags per parcel.

    The requested pickup time wins over the scheduled one; when the result was
    never set (1970) the arrangement time stands in.
    """
    best = F.coalesce(request, scheduled)
    asked = is_set(scheduled) & F.col(scheduled).isNotNull()
    due = day(from_epoch(scheduled))
    one = lambda cond: F.when(cond, 1).otherwise(0)
    return df.withColumns({
        "scheduled_date": from_epoch(best),
        "scheduled_date1": F.when(is_unset(best), from_epoch(arranged)).otherwise(
            from_epoch(best)),
        "shipment_type": shipment_type(request, arranged),
        "shipment_type1": shipment_type_inbound("inbound_type"),
        "gross_pickup_request": one(asked),
        "ontime_pickup_done": one(day("pku_done_time") <= due),
        "ontime_pickup": one(day("pku_1st_time") <= due),
        "gross_pickup_done": one(asked & F.col("pku_done_time").isNotNull()),
        "gross_pickup_failed": one(F.col("pku_failed_time").isNotNull()),
        "pickup_leadtime": elapsed("hour", from_epoch(arranged), "pku_done_time"),
    })


def pickup_kpis(df: DataFrame, by: Sequence, gap: Column | None = None) -> DataFrame:
    """Sums of the schedule flags; ``gap`` adds its 95th percentile."""
    sums = [
        F.sum("gross_pickup_request").alias("gross_pickup"),
        F.sum("gross_pickup_done").alias("gross_pickup_done"),
        F.sum("gross_pickup_failed").alias("gross_pickup_failed"),
        F.sum("ontime_pickup_done").alias("gross_ontime_pu_done"),
        F.sum("ontime_pickup").alias("gross_ontime_pu"),
    ]
    if gap is not None:
        sums.append(F.round(percentile(gap, 0.95), 3).alias("gap_time"))
    return df.groupBy(*by).agg(*sums)


# --- row rules ----------------------------------------------------------------

def _flag(cond: Column) -> Column:
    return F.when(cond, 1).otherwise(0)


def _deadline(cutoff: bool = True, grace: Column | None = None) -> Column:
    """Last day on which a pickup is on time: the order day, one more from
    18:00 on (``cutoff``), one more on days of grace."""
    extra = F.lit(0)
    if cutoff:
        extra = extra + F.when(F.hour("orderdate") >= CUTOFF_HOUR, 1).otherwise(0)
    if grace is not None:
        extra = extra + F.when(grace, 1).otherwise(0)
    return F.date_add(day("orderdate"), extra)


def _first_touch(as_of: dt.date | None) -> Column:
    known = [day("firstupdatedpickeduptime"), day("endpicktime")]
    return F.coalesce(*known, *([F.lit(as_of)] if as_of else []))


def incident() -> Column:
    """The carrier reported an incident and came again on another day."""
    return (
        (F.col("firstfailpicknote") == codes.INCIDENT_NOTE)
        & (day("firstupdatedpickeduptime") != day("secondcreatedpickeduptime"))
        & (day("firstupdatedpickeduptime") >= day("orderdate"))
    )


def ontime_first_v1(as_of: dt.date | None, grace: Column | None = None,
                    cutoff: bool = True) -> Column:
    """First contact (or end of pickup, or today) not after the deadline."""
    return _flag(F.col("orderdate").isNotNull()
                 & (_first_touch(as_of) <= _deadline(cutoff, grace)))


def ontime_first_v2(as_of: dt.date | None, grace: Column | None = None) -> Column:
    """As v1, but incidents are never on time."""
    return F.when(incident(), 0).otherwise(ontime_first_v1(as_of, grace))


def _tree(deadline: Column) -> Column:
    same_day = day("endpicktime") <= day("orderdate")
    had_incident = F.coalesce("firstfailpicknote", F.lit("")) == codes.INCIDENT_NOTE
    contact = F.when(had_incident, F.col("secondupdatedpickeduptime")).otherwise(
        F.coalesce("firstupdatedpickeduptime", "secondupdatedpickeduptime"))
    return F.coalesce(same_day, F.lit(False)) | F.coalesce(day(contact) <= deadline, F.lit(False))


def ontime_first_v3() -> Column:
    """Picked up on the order day, or contacted before the 18:00-aware
    deadline - after an incident the second contact counts."""
    return _flag(_tree(_deadline()))


def ontime_first_v4() -> Column:
    """As v3 without the 18:00 rule: only the order day counts."""
    return _flag(_tree(day("orderdate")))


def ontime_label_v3() -> Column:
    return F.when(ontime_first_v3() == 1, "Ontime").otherwise("Late")


def ontime_success(as_of: dt.date) -> Column:
    """Pickup finished by the deadline; from 18:00 on an open pickup counts as
    finished today, before 18:00 an open pickup is late."""
    late_order = F.hour("orderdate") >= CUTOFF_HOUR
    ended = F.when(late_order, F.coalesce(day("endpicktime"), F.lit(as_of))).otherwise(
        day("endpicktime"))
    return _flag(ended <= _deadline())


def ontime_success_v2(as_of: dt.date) -> Column:
    """As :func:`ontime_success`, but incidents are never on time."""
    return F.when(incident(), 0).otherwise(ontime_success(as_of))


def ontime_success_same_day() -> Column:
    return _flag(day("endpicktime") <= day("orderdate"))


def picked() -> Column:
    return _flag(F.col("endpicktime").isNotNull())


def late(flag: Column) -> Column:
    return F.lit(1) - flag


def on_event_day(days: Sequence[str]) -> Column:
    """Is the order day one of the given days of grace?

    The list is part of the rule, so it is a literal set looked up per row, not
    a join: order days are far too few to shuffle orders by.
    """
    if not days:
        return F.lit(False)
    return day("orderdate").isin(*[F.lit(d).cast("date") for d in dict.fromkeys(days)])


def not_cancelled_same_day() -> Column:
    """Excludes orders cancelled by the order day (unknown cancel day of a
    cancelled order is excluded as well)."""
    return ~((F.col("currentstatus") == "cancel") & (day("canceltime") <= day("orderdate")))


def hub_type(df: DataFrame, warehouses: DataFrame, output: str = "type_kh") -> DataFrame:
    """Instant hub by name, key-account by id, transit by warehouse, else post."""
    transit = warehouses.where(
        (F.col("department_name") == codes.FREIGHT_DEPARTMENT)
        | F.col("warehouse_name").like(codes.TRANSIT_WAREHOUSE_LIKE)
    ).select(F.col("warehouse_id").alias("__wh")).distinct()
    joined = df.join(transit, F.col("pickwarehouseid") == F.col("__wh"), "left")
    return joined.withColumn(
        output,
        F.when(F.col("pickwh").like(codes.INSTANT_HUB_LIKE), codes.HUB_INSTANT)
        .when(F.col("pickwarehouseid").isin(*codes.KEY_ACCOUNT_WAREHOUSES),
              codes.HUB_KEY_ACCOUNT)
        .when(F.col("__wh").isNotNull(), codes.HUB_TRANSIT)
        .otherwise(codes.HUB_POST),
    ).drop("__wh")


def hub_group() -> Column:
    return F.when(F.lower("pickwh").like(codes.POST_OFFICE_LIKE), codes.HUB_REGIONAL).otherwise(
        codes.HUB_KEY_OR_TRANSIT)


# --- scope ---------------------------------------------------------------------

def in_scope(df: DataFrame, first: dt.date | None = None, last: dt.date | None = None,
             client: int = codes.PICKUP_CLIENT_ID, keep_cancelled: bool = True,
             all_channels: bool = False) -> DataFrame:
    """Orders of one client to be picked up (no expected drop-off, no internal
    channel) in a range of order days.

    The day range is also stated on the raw timestamp, which is what a file
    scan can skip row groups by.
    """
    df = df.where(F.col("clientid") == client)
    if not all_channels:
        df = df.where(~F.col("isexpecteddropoff") & (F.col("channel") != codes.INTERNAL_CHANNEL))
    if first is not None:
        df = df.where(F.col("orderdate") >= F.lit(first).cast("timestamp"))
    if last is not None:
        df = df.where(F.col("orderdate")
                      < F.lit(last + dt.timedelta(days=1)).cast("timestamp"))
    return df if keep_cancelled else df.where(F.col("currentstatus") != "cancel")


# --- roll-ups ------------------------------------------------------------------

def daily_base(df: DataFrame, flags: dict[str, Column], dims: Sequence[str] = ()) -> DataFrame:
    """Orders and flag sums per order day and area: the base of all views."""
    marked = df.select(day("orderdate").alias("order_day"), *dims,
                       *[c.alias(n) for n, c in flags.items()])
    return marked.groupBy("order_day", *dims).agg(
        F.count(F.lit(1)).alias("orders"), *[F.sum(n).alias(n) for n in flags])


def regroup(base: DataFrame, grain: str, dims: Sequence[str], measures: Sequence[str],
            only: Column | None = None, prefix: str = "") -> DataFrame:
    """Sums of the base per period and dims, optionally of some days only.

    The period is its first day (weeks and months of different years stay
    apart); ``time`` is the week or month number.
    """
    if only is not None:
        base = base.where(only)
    return base.groupBy(period_start("order_day", grain).alias("period"), *dims).agg(
        *[F.sum(m).alias(prefix + m) for m in ("orders", *measures)])


def ratio(part, whole, digits: int = 4) -> Column:
    return F.round(F.col(part) / F.nullif(F.col(whole), F.lit(0)), digits)


def _on_sunday() -> Column:
    return iso_dow("order_day") == 7


def scorecard(df: DataFrame, grain: str, as_of: dt.date, grace_days: Sequence[str],
              first: dt.date, last: dt.date, version: int = 1,
              client: int = codes.PICKUP_CLIENT_ID) -> DataFrame:
    """Total volume, normal, penalty, success and Sunday rates per period.

    ``version`` 2 applies the incident rule.  One pass over the orders: the
    scopes (all orders, pickups, penalty, Sunday) are conditional sums.
    """
    first_rule = {1: ontime_first_v1, 2: ontime_first_v2}[version]
    success_rule = {1: ontime_success, 2: ontime_success_v2}[version]
    scoped = in_scope(df, first, last, client, all_channels=True)
    normal = F.coalesce(
        ~F.col("isexpecteddropoff") & (F.col("channel") != codes.INTERNAL_CHANNEL),
        F.lit(False))
    judged = normal & F.coalesce(not_cancelled_same_day(), F.lit(False))
    base = daily_base(scoped, {
        "normal": _flag(normal),
        "first_ok": F.when(normal, first_rule(as_of)).otherwise(0),
        "success_ok": F.when(normal, success_rule(as_of)).otherwise(0),
        "picked": F.when(normal, picked()).otherwise(0),
        "judged": _flag(judged),
        "penalty_ok": F.when(
            judged, first_rule(as_of, grace=on_event_day(grace_days))).otherwise(0),
    })
    sunday = _on_sunday()
    base = base.withColumn("sunday", F.when(sunday, F.col("normal"))).withColumn(
        "sunday_ok", F.when(sunday, F.col("first_ok")))
    table = regroup(base, grain, [], [
        "normal", "first_ok", "success_ok", "picked", "judged", "penalty_ok",
        "sunday", "sunday_ok"]).where((F.col("normal") > 0) & (F.col("judged") > 0))
    return table.select(
        "period", period_number("period", grain).alias("time"),
        F.col("orders").alias("total_volume"),
        ratio("first_ok", "normal").alias("ontime_first_normal"),
        ratio("penalty_ok", "judged").alias("ontime_first_penalty"),
        ratio("success_ok", "normal").alias("ontime_success_normal"),
        ratio("picked", "normal").alias("pickup_success_normal"),
        ratio("sunday_ok", "sunday").alias("ontime_first_sunday"),
    )


def _weekly_rules(df: DataFrame, as_of: dt.date, grace_days: Sequence[str], first: dt.date, penalty_first: dt.date,
                  client: int) -> tuple[DataFrame, dict[str, Column]]:
    """Orders in scope and the conditions that the scorecards without the 18:00 rule count."""
    last = as_of - dt.timedelta(days=1)
    scoped = in_scope(df, min(first, penalty_first), last, client)
    grace = on_event_day(grace_days)
    order_day = day("orderdate")
    live = (F.col("currentstatus") != "cancel") & (order_day >= F.lit(first))
    judged = not_cancelled_same_day() & (order_day >= F.lit(penalty_first))
    sunday = live & (iso_dow("orderdate") == 7)
    return scoped, {
        "live": live, "first_ok": live & (ontime_first_v4() == 1),
        "success_ok": live & (ontime_success_same_day() == 1),
        "picked": live & (picked() == 1),
        "judged": judged,
        "penalty_ok": judged & (ontime_first_v1(as_of, grace, cutoff=False) == 1),
        "sunday": sunday, "sunday_ok": sunday & (ontime_first_v4() == 1),
    }


def weekly_scorecard(df: DataFrame, grain: str, as_of: dt.date, grace_days: Sequence[str],
                     first: dt.date, penalty_first: dt.date,
                     client: int = codes.PICKUP_CLIENT_ID) -> DataFrame:
    """Rates per period without the 18:00 rule, on distinct orders.

    Copies of an order count once in the volumes and as often as they occur in
    the on-time sums; both are taken after one aggregate per order, so no
    distinct set is ever built for a whole period.
    """
    scoped, counted = _weekly_rules(df, as_of, grace_days, first, penalty_first, client)
    per_order = scoped.groupBy(period_start("orderdate", grain).alias("period"), "ordercode").agg(
        *[F.sum(F.when(c, 1).otherwise(0)).alias(n) for n, c in counted.items()])
    once = {"live", "judged", "sunday"}
    table = per_order.groupBy("period").agg(*[
        F.sum((F.col(n) > 0).cast("int") if n in once else F.col(n)).alias(n) for n in counted])
    return _weekly_table(table, grain)


def order_bitmaps(df: DataFrame, numbers: DataFrame, as_of: dt.date, grace_days: Sequence[str], first: dt.date,
                  penalty_first: dt.date, client: int = codes.PICKUP_CLIENT_ID) -> DataFrame:
    """The conditions of :func:`weekly_scorecard` as bitmaps of order numbers per order day (see ``bitmaps``)."""
    scoped, counted = _weekly_rules(df, as_of, grace_days, first, penalty_first, client)
    return daily_bitmaps(scoped.withColumn("order_day", day("orderdate")), numbers, "ordercode", ["order_day"], counted)


def distinct_scorecard(bitmaps: DataFrame, grain: str) -> DataFrame:
    """The rates of :func:`weekly_scorecard` on distinct orders in both parts of each ratio.

    An order is counted once per period even if it has rows on several days, and is on time if one of them is.  All
    grains come out of the same daily bitmaps; the orders are not read again.
    """
    flags = [c for c in bitmaps.columns if c not in ("order_day", *CELL)]
    return _weekly_table(distinct_counts(bitmaps, {"period": period_start("order_day", grain)}, flags), grain)


def _weekly_table(table: DataFrame, grain: str) -> DataFrame:
    table = table.where(F.col("live") > 0)
    return table.select(
        "period", period_number("period", grain).alias("time"),
        F.col("live").alias("total_orders"),
        ratio("first_ok", "live").alias("ontime_first"),
        ratio("penalty_ok", "judged").alias("ontime_penalty"),
        ratio("success_ok", "live").alias("ontime_success"),
        ratio("picked", "live").alias("success"),
        ratio("sunday_ok", "sunday").alias("ontime_sunday"),
    )


def breakdown(df: DataFrame, grain: str, dims: Sequence[str], as_of: dt.date, first: dt.date,
              last: dt.date, version: int = 2,
              client: int = codes.PICKUP_CLIENT_ID) -> DataFrame:
    """Rates per period and area, with each area's share of late orders in the
    period total.  Sunday figures use the same period and area keys."""
    first_rule = {1: ontime_first_v1, 2: ontime_first_v2}[version]
    success_rule = {1: ontime_success, 2: ontime_success_v2}[version]
    base = daily_base(in_scope(df, first, last, client), {
        "first_ok": first_rule(as_of), "success_ok": success_rule(as_of)}, dims)
    base = base.withColumn("sunday", F.when(_on_sunday(), F.col("orders"))).withColumn(
        "sunday_ok", F.when(_on_sunday(), F.col("first_ok")))
    areas = regroup(base, grain, dims, ["first_ok", "success_ok", "sunday", "sunday_ok"])
    totals = areas.groupBy(F.col("period").alias("__period")).agg(
        F.sum("orders").alias("period_total"))
    joined = areas.join(totals, F.col("period") == F.col("__period")).drop("__period")
    share = lambda part: F.round(part / F.col("period_total"), 6)
    return joined.select(
        "period", period_number("period", grain).alias("time"), *dims,
        F.col("orders").alias("volume_created"),
        "first_ok", "success_ok", "sunday", "sunday_ok",
        ratio("first_ok", "orders").alias("ontime_first_normal"),
        share(F.col("orders") - F.col("first_ok")).alias("first_contribution"),
        ratio("success_ok", "orders").alias("ontime_success_normal"),
        share(F.col("orders") - F.col("success_ok")).alias("success_contribution"),
        ratio("sunday_ok", "sunday").alias("ontime_first_sunday"),
        share(F.col("sunday") - F.col("sunday_ok")).alias("sunday_contribution"),
    )


def with_total(base: DataFrame, time: Sequence[str], region: str, total_label: str,
               measures: dict[str, str], digits: int = 4) -> DataFrame:
    """(time, region) and (time) grouping sets over a pre-aggregated table.

    ``measures`` maps output -> summed flag.  Total rows are told apart by
    ``grouping``, so a group of unknown region keeps a NULL region instead of
    looking like a second total.
    """
    keys = [F.col(t) for t in time]
    rolled = base.groupingSets([[*keys, F.col(region)], keys], *keys, F.col(region)).agg(
        F.grouping(region).alias("__total"),
        F.sum("orders").alias("__orders"),
        *[F.sum(flag).alias(out) for out, flag in measures.items()])
    return rolled.select(
        *time,
        F.when(F.col("__total") == 1, total_label).otherwise(F.col(region)).alias("region"),
        F.col("__total").alias("is_total"),
        *[F.round(F.col(out) / F.col("__orders"), digits).alias(out) for out in measures],
    )


def dashboard(df: DataFrame, as_of: dt.date, client: int = codes.PICKUP_CLIENT_ID) -> DataFrame:
    """Last ten days, last week on, month to date and the month before, each
    by region with a national total.

    The orders are aggregated once per day and region; every row of that small
    table is then repeated for the views it belongs to.
    """
    month_start = as_of.replace(day=1)
    previous_month = (month_start - dt.timedelta(days=1)).replace(day=1)
    ten_days = max(as_of - dt.timedelta(days=10), previous_month)
    week_start = max(as_of - dt.timedelta(days=as_of.weekday() + 7), previous_month)
    scoped = in_scope(df, previous_month, as_of - dt.timedelta(days=1), client,
                      keep_cancelled=False)
    base = daily_base(scoped, {
        "success_ok": ontime_success(as_of), "first_ok": ontime_first_v3()},
        ["fromregionshortname"])

    def view(kind: str, grain: str, since: dt.date) -> Column:
        row = F.struct(F.lit(kind).alias("time_type"),
                       period_start("order_day", grain).cast("string").alias("time_period"))
        return F.when(F.col("order_day") >= F.lit(since), row)

    views = F.array_compact(F.array(
        view("Daily", "day", ten_days), view("Weekly", "week", week_start),
        view("Monthly", "month", previous_month)))
    rows = base.withColumn("__view", F.explode(views)).select(
        "__view.*", "fromregionshortname", "orders", "success_ok", "first_ok")
    return with_total(rows, ["time_type", "time_period"], "fromregionshortname",
                      codes.TOTAL_LABEL,
                      {"ontime_success": "success_ok", "ontime_first": "first_ok"})


def weekly_region(df: DataFrame, as_of: dt.date, rule: Column, first: dt.date, last: dt.date,
                  client: int = codes.PICKUP_CLIENT_ID, output: str = "ontime") -> DataFrame:
    """On-time share per ISO week and region with a total row per week."""
    base = daily_base(in_scope(df, first, last, client), {"ok": rule}, ["fromregionshortname"])
    base = base.withColumn("time", F.weekofyear("order_day"))
    return with_total(base, ["time"], "fromregionshortname", codes.WEEKLY_TOTAL_LABEL,
                      {output: "ok"})


def pending_pick(df: DataFrame, wards: DataFrame, as_of: dt.date, days: int = 14,
                 client: int = codes.PICKUP_CLIENT_ID) -> DataFrame:
    """Orders, on-time, late and still open pickups per day, area, ward and hub."""
    scoped = in_scope(df, as_of - dt.timedelta(days=days), as_of - dt.timedelta(days=1), client,
                      keep_cancelled=False)
    is_open = F.col("currentstatus").isin(*codes.OPEN_PICKUP_STATUSES)
    base = daily_base(
        scoped.withColumn("type_kh", hub_group()),
        {"pending_pick": _flag(is_open), "ontime_orders": ontime_first_v3()},
        ["fromprovince", "fromdistrict", "fromwardcode", "pickwh", "type_kh"])
    names = wards.select(F.col("ward_id").alias("__ward"), "ward_name").distinct()
    named = base.join(names, F.col("fromwardcode") == F.col("__ward"), "left")
    return named.groupBy(
        "order_day", "fromprovince", "fromdistrict", "ward_name", "pickwh", "type_kh",
    ).agg(
        F.sum("pending_pick").alias("pending_pick"), F.sum("orders").alias("total_orders"),
        F.sum("ontime_orders").alias("ontime_orders"),
        F.sum(F.col("orders") - F.col("ontime_orders")).alias("late_orders"))


def latest_order(df: DataFrame, wards: DataFrame, client: int = codes.PICKUP_CLIENT_ID,
                 warehouses: Sequence[int] = codes.KEY_ACCOUNT_WAREHOUSES) -> DataFrame:
    """Newest order per ward and shop, with the ward's names.

    The newest row is a maximum over (day, order code), combined per task
    before the shuffle; ties of a day go to the larger order code.
    """
    scoped = df.where(
        (F.col("clientid") == client) & F.col("pickwarehouseid").isin(*warehouses)
        & (F.col("channel") != codes.INTERNAL_CHANNEL))
    newest = scoped.groupBy("fromwardcode", "clientcontactname").agg(
        F.max(F.struct(day("orderdate").alias("day"), "ordercode", "pickwh")).alias("top"))
    dim = wards.select("ward_id", "region_shortname", "province_name", "district_name",
                       "ward_name")
    return newest.join(dim, F.col("fromwardcode") == F.col("ward_id")).select(
        "fromwardcode", "clientcontactname", F.col("top.pickwh").alias("pickwh"),
        F.col("top.ordercode").alias("ordercode"), "region_shortname", "province_name",
        "district_name", "ward_name")


def hub_ontime(df: DataFrame, as_of: dt.date, provinces: Sequence[str], south: str,
               warehouses: Sequence[int] = codes.KEY_ACCOUNT_WAREHOUSES, days: int = 7,
               client: int = codes.PICKUP_CLIENT_ID) -> DataFrame:
    """Daily on-time share of the two key-account warehouses.

    Sums over sums: the mean of group sums divided by the mean of group
    volumes is the total over the total.
    """
    scoped = in_scope(df, as_of - dt.timedelta(days=days), as_of - dt.timedelta(days=1), client)
    scoped = scoped.where(F.col("fromprovince").isin(*provinces)
                          & F.col("pickwarehouseid").isin(*warehouses))
    named = scoped.withColumn("hub_name", F.when(
        F.col("fromprovince") == south, codes.WAREHOUSE_SOUTH).otherwise(codes.WAREHOUSE_NORTH))
    base = daily_base(named, {"ok": ontime_first_v2(None)}, ["hub_name"])
    return base.select("order_day", "hub_name", ratio("ok", "orders").alias("ontime"))
