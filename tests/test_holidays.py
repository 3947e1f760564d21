"""Windows over long calendars: the same rows as by lists, without a list per carrier."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from waybill.operators import holidays, sla

SCHEMA = "shipping_carrier string, type string, holiday_start string, nb_holiday string, ingestion_timestamp int"
FACTS = "id int, c string, a timestamp, b date"


def windows():
    return {"d": ("delivery", F.col("a"), F.col("b")), "r": ("return", F.col("a"), F.date_add(F.to_date("a"), 15))}


def rows(df):
    return sorted((r.id, r.d, r.r) for r in df.select("id", "d", "r").collect())


@pytest.fixture(scope="module")
def random_case(spark):
    pick = random.Random(5)
    start = dt.date(2023, 11, 1)
    cal = [(pick.choice(["Post", "POST", "Fast", None]), pick.choice(["delivery", "return", "other"]),
            str(start + dt.timedelta(pick.randrange(140))), pick.choice(["0", "1", "2", "3", None, "many"]),
            pick.choice([1, 2, 2])) for _ in range(400)]
    cal += [("post", "delivery", "no day", "1", 2), ("post", "delivery", None, "1", 2)]
    facts = []
    for i in range(600):
        a = dt.datetime(2023, 10, 1, pick.randrange(24)) + dt.timedelta(pick.randrange(230))
        b = a.date() + dt.timedelta(pick.choice([-400, -1, 0, 1, 5, 40, 400]))
        facts.append((i, pick.choice(["post", "Fast", "none", None]), pick.choice([a, a, a, None]), pick.choice([b, b, b, None])))
    return spark.createDataFrame(facts, FACTS), spark.createDataFrame(cal, SCHEMA)


@pytest.mark.parametrize("mode", ["sum", "rows"])
def test_same_rows_as_by_lists(random_case, mode):
    facts, cal = random_case
    got = rows(holidays.holidays_by_totals(facts, cal, "c", windows(), mode))
    assert got == rows(sla.holidays_in_windows(facts, cal, "c", windows(), mode))
    assert {r[0] for r in got} == set(range(600)) and any(r[1] > 3 for r in got) == (mode == "sum")


@pytest.mark.parametrize("mode", ["sum", "rows"])
def test_brute_force(random_case, mode):
    facts, cal = random_case
    newest = {(r.shipping_carrier.lower(), r.type, r.holiday_start, r.nb_holiday) for r in cal.collect()
              if r.ingestion_timestamp == 2 and r.shipping_carrier and r.holiday_start not in (None, "no day")}
    want = []
    for r in facts.collect():
        found = [int(nb) if nb in ("0", "1", "2", "3") else 0 for c, kind, first, nb in newest
                 if r.c and r.a and r.b and c == r.c.lower() and kind == "delivery"
                 and r.a.date() <= dt.date.fromisoformat(first) <= r.b]
        want += [(r.id, float(sum(found)))] if mode == "sum" else [(r.id, float(n)) for n in set(found) or {0}]
    one = {"d": ("delivery", F.col("a"), F.col("b"))}
    got = holidays.holidays_by_totals(facts, cal, "c", one, mode).select("id", "d").collect()
    assert sorted((r.id, r.d) for r in got) == sorted(want)


@pytest.mark.parametrize("mode", ["sum", "rows"])
def test_empty_tables(spark, random_case, mode):
    facts, cal = random_case
    without = holidays.holidays_by_totals(facts, cal.limit(0), "c", windows(), mode)
    assert {r[1:] for r in rows(without)} == {(0.0, 0.0)} and without.count() == 600
    assert holidays.holidays_by_totals(facts.limit(0), cal, "c", windows(), mode).count() == 0


def test_extra_columns_stay(spark, random_case):
    facts, cal = random_case
    clash = facts.withColumns({n: F.col("id") for n in ("carrier", "month", "rank", "kind", "nb", "first", "type")})
    out = holidays.holidays_by_totals(clash, cal, "c", windows(), "rows")
    assert out.columns == [*clash.columns, "d", "r"]
    assert rows(out) == rows(holidays.holidays_by_totals(facts, cal, "c", windows(), "rows"))
    assert out.where("rank <> id OR nb <> id OR month <> id").count() == 0


def test_fifty_years_of_a_thousand_carriers(spark):
    """A month's row holds at most 31 days, however long the calendar is; the windows agree with closed sums."""
    cal = spark.range(1000 * 600).select(
        F.concat(F.lit("c"), F.col("id") % 1000).alias("shipping_carrier"), F.lit("delivery").alias("type"),
        F.date_add(F.lit("1980-01-01").cast("date"), (F.floor(F.col("id") / 1000) * 30).cast("int")).cast("string").alias("holiday_start"),
        F.lit("2").alias("nb_holiday"), F.lit(1).alias("ingestion_timestamp"))
    entries = holidays.numbered_entries(cal, ["delivery"])
    table, _, _ = holidays.running_totals(entries, ["delivery"])
    shape = table.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("in_delivery")).alias("longest")).first()
    months = 591  # January 1980 to March 2029, where the 600th entry lies
    assert shape.n == 1000 * months and shape.longest <= 31
    facts = spark.range(20_000).select(
        F.col("id").cast("int").alias("id"), F.concat(F.lit("C"), F.col("id") % 1000).alias("c"),
        F.date_add(F.lit("1980-01-01").cast("date"), ((F.col("id") * 7919) % 17_000).cast("int")).cast("timestamp").alias("a"))
    facts = facts.withColumn("b", F.date_add(F.to_date("a"), (F.col("id") % 90).cast("int")))
    at = lambda c: F.datediff(c, F.lit("1980-01-01"))
    hits = F.floor(at("b") / 30) - F.floor((at("a") - 1) / 30)
    for mode, want in (("sum", hits * 2), ("rows", F.when(hits > 0, 2).otherwise(0))):
        out = holidays.holidays_by_totals(facts, cal, "c", {"d": ("delivery", F.col("a"), F.col("b"))}, mode)
        assert out.count() == 20_000 and out.where(F.col("d") != want).count() == 0
