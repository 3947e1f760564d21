"""Text sheets: rejects are kept, named and counted; nothing aborts; names of three parts."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from waybill.operators import sla
from waybill.sources import scans, sheets

TYPES = {"address": "string", "level": "double", "days": "int", "first": "date"}
LINES = ["address,level,days,first", "a,1.5,2,2024-01-05", "b,x,3,2024-01-06", "c, 2 ,,not a day", "d,4", "e,1,2,2024-01-07,more",
         '"f, with comma",7,8,2024-02-30', ",,,", "g,1e3,2.5,2024-01-08"]


@pytest.fixture(scope="module")
def path(tmp_path_factory):
    folder = tmp_path_factory.mktemp("sheet")
    (folder / "one.csv").write_text("\n".join(LINES) + "\n", encoding="utf-8")
    (folder / "two.csv").write_text("address,level,days,first\nh,zz,yy,2024-01-09\n", encoding="utf-8")
    return str(folder)


def test_rejects_are_named(spark, path):
    rows = {r.address: r for r in sheets.read_sheet(spark, path, TYPES).collect()}
    assert len(rows) == 9
    a, c = rows["a"], rows["c"]
    assert (a.level, a.days, a["first"], a.reject) == (1.5, 2, dt.date(2024, 1, 5), None)
    assert (c.level, c.days, c["first"], c.reject) == (2.0, None, None, "first=not a day")
    assert rows["b"].reject == "level=x" and rows["b"].level is None and rows["b"].days == 3
    assert rows["d"].reject == "d,4" and rows["d"].level == 4.0
    assert rows["e"].reject == "e,1,2,2024-01-07,more" and rows["e"].days == 2
    assert rows["f, with comma"].reject == "first=2024-02-30"
    assert rows["h"].reject == "level=zz; days=yy"
    assert rows[None].reject is None or rows[None].reject == ",,,"


def test_rejects_are_counted_in_the_pass_that_uses_the_rows(spark, path):
    sheet, seen = sheets.observe_rejects(sheets.read_sheet(spark, path, TYPES), "sheet")
    good = sheet.where("reject IS NULL").agg(F.sum("level").alias("s"))
    total = good.first().s
    counts = seen.get
    every = sheets.read_sheet(spark, path, TYPES).collect()
    assert counts["rows"] == len(every) == 9
    assert counts["rejects"] == sum(r.reject is not None for r in every) >= 6
    assert total == sum(r.level for r in every if r.reject is None and r.level is not None)


def test_reader_gives_the_same_for_any_columns(spark, path):
    whole = sheets.read_sheet(spark, path, TYPES)
    assert whole.where("reject IS NOT NULL").count() == sum(r.reject is not None for r in whole.collect())
    assert sorted(r.address or "" for r in whole.select("address").collect()) == sorted(
        r.address or "" for r in whole.collect())
    with pytest.raises(ValueError):
        sheets.read_sheet(spark, path, {"reject": "string"})


def test_broken_reference_text_changes_a_count_and_never_aborts(spark):
    cal = spark.createDataFrame(
        [("A", "delivery", "2024-01-05", "2", 1), ("A", "delivery", "someday", "1", 1), ("A", "delivery", "2024-01-06", "many", 1)],
        "shipping_carrier string, type string, holiday_start string, nb_holiday string, ingestion_timestamp int")
    watched, seen = sheets.observe_text(cal, "calendar", {"holiday_start": "date", "nb_holiday": "int"})
    facts = spark.createDataFrame([("A", dt.datetime(2024, 1, 4), dt.date(2024, 1, 8))], "c string, s timestamp, e date")
    out = sla.holiday_days(facts, watched, "c", F.col("s"), F.col("e"), mode="sum").collect()
    assert [r.d_holidays for r in out] == [2.0]  # the unreadable length counts as none
    assert (seen.get["rows"], seen.get["holiday_start"], seen.get["nb_holiday"]) == (3, 1, 1)


def test_empty_sheet(spark, tmp_path):
    (tmp_path / "e.csv").write_text("address,level,days,first\n", encoding="utf-8")
    assert sheets.read_sheet(spark, str(tmp_path), TYPES).count() == 0


def test_names_of_three_parts(spark, path):
    """Tables of two schemas by their full names, and a sheet, in one plan."""
    for schema in ("waybill_a", "waybill_b"):
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {schema}")
    try:
        spark.createDataFrame([(1, "a"), (2, "b")], "id int, address string").write.saveAsTable("waybill_a.parcels")
        spark.createDataFrame([(1, 9.0)], "id int, weight double").write.saveAsTable("waybill_b.weights")
        parcels = scans.read_table(spark, "spark_catalog.waybill_a.parcels")
        weights = scans.read_table(spark, "spark_catalog.waybill_b.weights")
        joined = parcels.join(weights, "id", "left").join(sheets.read_sheet(spark, path, TYPES), "address", "left")
        assert {(r.id, r.weight, r.level) for r in joined.collect()} == {(1, 9.0, 1.5), (2, None, None)}
    finally:
        for schema in ("waybill_a", "waybill_b"):
            spark.sql(f"DROP DATABASE {schema} CASCADE")
