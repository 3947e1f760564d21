"""On-time rules of pickups as a truth table worked out by hand, and distinct orders over a year's end."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from waybill.operators import bitmaps
from waybill.operators import pickup as pu

AS_OF = dt.date(2024, 1, 31)
INCIDENT = "Nhân viên gặp sự cố"
SCHEMA = ("ordercode string, orderdate timestamp, firstupdatedpickeduptime timestamp, secondupdatedpickeduptime timestamp, "
          "secondcreatedpickeduptime timestamp, endpicktime timestamp, firstfailpicknote string, currentstatus string, "
          "canceltime timestamp, clientid int, isexpecteddropoff boolean, channel string")

# Hour of the order; note (I: incident, x: another, -: none); days after the order day of the first contact, the second
# contact, the creation of the second, the end of the pickup; then the verdicts of v1 (first contact, 18:00 rule), v2 (as v1
# but incidents are late), v3 (pickup on the order day or contact, second one after an incident), v4 (v3 without 18:00).
TABLE = """
17 -   0  -  -  -   1 1 1 1
17 -   1  -  -  -   0 0 0 0
18 -   1  -  -  -   1 1 1 0
18 -   2  -  -  -   0 0 0 0
17 -   -  0  -  -   0 0 1 1
18 -   -  1  -  -   0 0 1 0
17 -   -  -  -  0   1 1 1 1
17 -   -  -  -  1   0 0 0 0
18 -   -  -  -  1   1 1 0 0
17 -   1  0  -  0   0 0 1 1
17 -   1  0  -  -   0 0 0 0
18 -   1  0  -  -   1 1 1 0
17 -  -1  1  -  2   1 1 1 1
17 -   -  -  -  -   0 0 0 0
18 -   -  -  -  -   0 0 0 0
17 I   0  -  1  -   1 0 0 0
17 I   0  -  -  -   1 1 0 0
17 I   0  0  0  -   1 1 1 1
17 I   0  1  1  -   1 0 0 0
18 I   0  1  1  -   1 0 1 0
18 I   0  2  2  -   1 0 0 0
18 I   1  1  1  -   1 1 1 0
18 I   1  1  2  -   1 0 1 0
18 I   2  1  1  -   0 0 1 0
17 I  -1  0  1  -   1 1 1 1
17 I  -1  1  0  2   1 1 0 0
17 I   -  0  1  -   0 0 1 1
17 I   0  -  1  0   1 0 1 1
18 I   0  1  1  0   1 0 1 1
17 x   0  -  1  -   1 1 1 1
18 x   1  0  2  -   1 1 1 0
"""


def test_truth_table(spark):
    order_day = dt.datetime(2024, 1, 3)
    rows, want = [], {}
    for n, line in enumerate(TABLE.strip().splitlines()):
        hour, note, *cells = line.split()
        first, second, created, end = (
            None if c == "-" else order_day + dt.timedelta(days=int(c), hours=23, minutes=59) for c in cells[:4])
        rows.append((str(n), order_day.replace(hour=int(hour)), first, second, created, end,
                     {"I": INCIDENT, "x": "khác", "-": None}[note], "delivered", None, 18692, False, "web"))
        want[str(n)] = (line, tuple(map(int, cells[4:])))
    rules = [pu.ontime_first_v1(AS_OF), pu.ontime_first_v2(AS_OF), pu.ontime_first_v3(), pu.ontime_first_v4()]
    got = spark.createDataFrame(rows, SCHEMA).select("ordercode", *[r.alias(f"v{n}") for n, r in enumerate(rules, 1)])
    assert {r.ordercode: (want[r.ordercode][0], tuple(r)[1:]) for r in got.collect()} == want


@pytest.mark.parametrize("grain, periods", [
    ("week", {dt.date(2023, 12, 25): 52, dt.date(2024, 1, 1): 1}), ("month", {dt.date(2023, 12, 1): 12, dt.date(2024, 1, 1): 1})])
def test_distinct_scorecard_over_the_end_of_a_year(spark, grain, periods):
    def row(code, on, done):
        at = dt.datetime.fromisoformat(on).replace(hour=10)
        return (code, at, None, None, None, at if done else None, None, "delivered", None, 18692, False, "web")

    orders = spark.createDataFrame([
        row("a", "2023-12-30", True), row("a", "2023-12-31", False), row("a", "2024-01-01", True),
        row("b", "2024-01-01", True), row("b", "2024-01-01", True), row("b", "2024-01-01", False), row("c", "2023-12-31", False)], SCHEMA)
    numbers = bitmaps.order_numbers(orders.withColumn("d", F.to_date("orderdate")), "ordercode", "d")
    first = dt.date(2023, 12, 1)
    daily = pu.order_bitmaps(orders, numbers, AS_OF, [], first, first)
    old, new = sorted(pu.distinct_scorecard(daily, grain).collect(), key=lambda r: r.period)
    assert {old.period: old.time, new.period: new.time} == periods
    assert tuple(old)[2:] == (2, 0.5, 0.5, 0.5, 0.5, 0.0)    # a and c; on Sunday none on time
    assert tuple(new)[2:] == (2, 1.0, 1.0, 1.0, 1.0, None)   # a and b, each once however many rows
    flags = [c for c in daily.columns if c not in ("order_day", *bitmaps.CELL)]
    assert bitmaps.distinct_counts(daily, {}, flags).first().live == 3
