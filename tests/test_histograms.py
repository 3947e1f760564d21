"""Counted histograms: exact, mergeable, one scan."""

import math
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from waybill.operators import delivery as dlv, histograms as hst


def rank_value(values, percent):
    return sorted(values)[max(math.ceil(len(values) * percent / 100), 1) - 1] if values else None


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    rows = [(rng.choice(["a", "b", None]), rng.choice(["x", "y"]), f"p{rng.randint(0, 200)}",
             rng.choice([None, *[float(rng.randint(-3, 40)) for _ in range(9)]]),
             f"2024-01-{rng.randint(1, 28):02d}") for _ in range(1500)]
    return rows + [("hot", "x", "p1", 2.0, "2024-01-05")] * 800 + [("none", "x", None, None, "2024-01-05")] * 3


def frame(spark, rows):
    return spark.createDataFrame(rows, "carrier string, state string, parcel string, lead double, due string").withColumn(
        "due", F.col("due").cast("timestamp"))


def test_figures_against_brute_force(spark, rows):
    got = {r.carrier: r for r in dlv.leadtime_stats(frame(spark, rows), ["carrier"], "lead", "parcel", 3).collect()}
    assert set(got) == {"a", "b", None, "hot", "none"}
    for carrier, r in got.items():
        lead = [x[3] for x in rows if x[0] == carrier and x[3] is not None]
        assert r.percentile_80 == rank_value(lead, 80) and r.percentile_95 == rank_value(lead, 95)
        assert r.avg_time == (pytest.approx(sum(lead) / len(lead), abs=6e-4) if lead else None)
        assert r.order_ == len({x[2] for x in rows if x[0] == carrier} - {None})


@pytest.mark.parametrize("n", [1, 2, 4, 5, 20, 100, 101])
def test_rank_of_any_size(spark, n):
    df = spark.range(n).select(F.lit(1).alias("g"), F.col("id").cast("double").alias("v"))
    counts = hst.value_histogram(df, ["g"], "v").groupBy("g").agg(hst.sorted_counts("v").alias("c"))
    row = counts.select(*[hst.discrete_percentile(F.col("c"), p).alias(f"p{p}") for p in (1, 50, 80, 95, 100)]).first()
    assert list(row) == [rank_value(range(n), p) for p in (1, 50, 80, 95, 100)]


def test_days_merge_to_the_month(spark, rows):
    df = frame(spark, rows)
    whole = hst.value_histogram(df, ["carrier"], "lead")
    days = [hst.value_histogram(df.where(F.dayofmonth("due") % 3 == i), ["carrier", "state"], "lead") for i in range(3)]
    assert sorted(map(repr, hst.merge_histograms(days, ["carrier"], "lead").collect())) == sorted(map(repr, whole.collect()))
    with pytest.raises(ValueError):
        hst.merge_histograms([], ["carrier"], "lead")


def test_two_periods(spark, rows):
    periods = {"1": ("2024-01-01", "2024-01-10"), "2": ("2024-01-08", "2024-01-28")}  # they overlap
    got = {r.carrier: r for r in dlv.compare_periods(
        frame(spark, rows), ["carrier"], periods, "due", "lead", 3).collect()}
    for carrier, r in got.items():
        for n, (first, last) in periods.items():
            lead = [x[3] for x in rows if x[0] == carrier and first <= x[4] <= last and x[3] is not None]
            assert r[f"percentile_80_{n}"] == rank_value(lead, 80) and r[f"percentile_95_{n}"] == rank_value(lead, 95)


def test_two_periods_weighted_as_a_join(spark, rows):
    left, right = ("2024-01-01", "2024-01-07"), ("2024-01-08", "2024-01-28")
    got = {(r.carrier, r.state): r for r in dlv.compare_periods_fanout(
        frame(spark, rows), left, right, "carrier", ["carrier", "state"], "due", "lead", 3).collect()}
    assert set(got) == {(x[0], x[1]) for x in rows if left[0] <= x[4] <= left[1]}
    for (carrier, state), r in got.items():
        second = [x[3] for x in rows if carrier and x[0] == carrier and right[0] <= x[4] <= right[1] and x[3] is not None]
        assert (r.percentile_80_2, r.percentile_95_2) == (rank_value(second, 80), rank_value(second, 95))
        first = [x[3] for x in rows if (x[0], x[1]) == (carrier, state) and left[0] <= x[4] <= left[1] and x[3] is not None]
        assert (r.percentile_80_1, r.percentile_95_1) == (rank_value(first, 80), rank_value(first, 95))


def scans(spark, sf_dir, name):
    plan = entry.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    return plan.split("== Initial Plan ==")[0].count("FileScan"), plan


@pytest.mark.parametrize("name", ["dom_leadtime_stats", "dom_compare_periods", "dom_compare_periods_joined",
                                  "rep_leadtime_by_route"])
def test_facts_are_read_once(spark, sf_dir, name):
    """As many scans as the weekly report, which aggregates the same facts once, and no sketch."""
    once, _ = scans(spark, sf_dir, "rep_weekly_delivery")
    found, plan = scans(spark, sf_dir, name)
    assert found <= once and "percentile_approx" not in plan
