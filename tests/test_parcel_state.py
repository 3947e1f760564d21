"""State per parcel: merged parts give what one pass over the whole log gives."""

import random

import pytest
from pyspark.sql import functions as F

from waybill.operators import attempts, milestones as mst, parcel_state as pst
from waybill.sources import scans

SPEC = {**mst.ALL_GAPS, "last_view": mst.Milestone(("F001",), "actual", "last")}
SCHEMA = "log_id bigint, tracking_code string, actual_time bigint, ctime bigint, reason_description string, arrived int"


@pytest.fixture(scope="module")
def log(spark):
    rng = random.Random(5)
    codes = ["F100", "F510", "F980", "F999", "F600", "F650", "F650", "F650", "F001", "F000", None]
    rows = [(rng.choice([*range(60), None]), rng.choice(codes), rng.choice([None, *[rng.randint(1000, 1040)] * 20]),
             rng.choice([None, *[rng.randint(900, 1100)] * 20]), rng.choice(["a", "b", None]), rng.randint(0, 4))
            for _ in range(3000)]
    rows += [(7, "F650", 500 + i % 40, 600, "hot", i % 5) for i in range(2000)]  # a hot parcel, late copies in every part
    rows += [(900, "F650", 10, 10, None, 4), (900, "F650", 20, 20, "x", 0), (901, "F000", 5, 5, None, 0)]
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


def rows_of(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("order", [(0, 1, 2, 3, 4), (4, 2, 0, 3, 1)])
def test_merged_days_equal_one_pass(log, order):
    state = None
    for i in order:
        today = pst.day_state(log.where(F.col("arrived") == i), SPEC, "F650")
        state = today if state is None else pst.merge_states([state, today], SPEC)
    assert rows_of(pst.state_milestones(state, SPEC)) == rows_of(mst.milestones(log, SPEC, listed_only=True))
    known = log.where("actual_time IS NOT NULL")  # an attempt without a time has no place among the others
    assert rows_of(pst.state_attempts(state)) == rows_of(attempts.attempts_wide(known, "F650"))


def test_one_part_and_none(log):
    whole = pst.day_state(log, SPEC, "F650", upto=2)
    again = pst.merge_states([whole], SPEC, upto=2)
    assert rows_of(again) == rows_of(whole.select(again.columns))
    empty = pst.day_state(log.where("false"), SPEC, "F650", upto=2)
    assert rows_of(pst.merge_states([whole, empty], SPEC, upto=2)) == rows_of(again)
    assert pst.state_attempts(empty).count() == 0
    with pytest.raises(ValueError):
        pst.merge_states([], SPEC)


def test_without_attempts(log):
    state = pst.day_state(log, {"pku_done_time": mst.DELIVERY["pku_done_time"]})
    assert state.columns == ["log_id", "pku_done_time", "attempts"]
    assert pst.state_attempts(state).count() == 0


def test_a_daily_report_reads_one_day(spark, log, tmp_path):
    """Yesterday's state and the partition of today are all that is read; the hot parcel sends few rows."""
    path = str(tmp_path / "log")
    scans.write_by_day(log, path, F.date_add(F.lit("2024-01-01").cast("date"), F.col("arrived")), spread="log_id", files=2)
    stored = spark.read.parquet(path)
    day = F.lit("2024-01-05").cast("date")
    pst.day_state(stored.where(F.col("grass_date") < day), SPEC, "F650").write.parquet(str(tmp_path / "state"))
    state = spark.read.parquet(str(tmp_path / "state"))
    today = pst.merge_states([state, pst.day_state(stored.where(F.col("grass_date") == day), SPEC, "F650")], SPEC)
    plan = today._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 3 and plan.count("grass_date#") and "(grass_date" in plan
    assert plan.count("PartitionFilters: [isnotnull(grass_date") == 2 and plan.count("WindowGroupLimit") == 2
    assert rows_of(pst.state_milestones(today, SPEC)) == rows_of(mst.milestones(log, SPEC, listed_only=True))
    # a day that is loaded again replaces its own files only
    scans.write_by_day(log.where("arrived = 2"), path, F.lit("2024-01-03").cast("date"), spread="log_id", files=2)
    assert spark.read.parquet(path).count() == log.count()
    files = spark.read.parquet(path).select(F.input_file_name().alias("f"), "grass_date").distinct()
    assert files.groupBy("grass_date").count().agg(F.max("count")).first()[0] <= 2
